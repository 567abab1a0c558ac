"""Each stage against a brute-force version on its own input."""

import pytest
from pyspark.sql import functions as F
from test_bpe_packing import check_pieces
from test_dedup import brute_components, brute_cut

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            import tokenizers
            from lodeworks.llm.queries import vocabulary

            check_pieces(docs.collect(), before, tokenizers.Tokenizer.from_file(vocabulary("byte_bpe_50k.json")))
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
            clean = [i for i in before if labels.get(i) == 1]
            assert sum(i in after for i in clean) >= 0.98 * len(clean) and 0 < len(after) < len(before)
        elif name == "exact":
            classes = {}
            for i, t in before.items():
                classes.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i))
            assert set(after) == {min(c)[1] for c in classes.values()}
        elif name == "near":
            assert set(after) == {i for i, (_, c) in brute_components(list(before.items())).items() if i == c}
        elif name == "passages":
            assert after == brute_cut(sorted(before.items()))
            assert docs.where(F.col("n_chars") != F.char_length("text")).count() == 0
        before = after


LONG = "A sentence of a very long document, number "


def odd_documents(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the stages use inside."""
    prose = "The committee met on Tuesday and agreed that the old bridge over the river should be repaired before winter comes. "
    rows = [
        (1, prose + "First."), (1, prose + "First."), (2, prose + "First."), (1, "Quite another text with the same id as the first one has, and a second sentence to it."),
        (None, "A text without an id that is found twice, which should leave one."), (None, "A text without an id that is found twice, which should leave one."),
        (3, None), (4, ""), (4, ""), (5, " \n"), (6, "".join(f"{LONG}{k}. " for k in range(20_000))), (7, "A text  without an id that is found twice, which should leave one."),
    ]
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit("x").alias(c) for c in ("_score", "_id", "_text", "carried", "kept", "row", "n", "mark", "score", "text_md5", "seed")])


def taken(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_without_rows(spark, small, stage):
    docs = odd_documents(spark).where("false")
    out = stage(spark, docs, small)
    assert out.count() == 0 and (out.columns == docs.columns or stage is corpus_pipeline.pack)


def test_quality_of_odd_documents(spark, small):
    docs = odd_documents(spark)
    out = corpus_pipeline.keep_quality(spark, docs, small)
    assert out.columns == docs.columns and {r["_score"] for r in out.collect()} <= {"x"}
    before, after = taken(docs), taken(out)
    assert all(after.count(x) in (0, before.count(x)) for x in before)


def test_exact_of_odd_documents(spark, small):
    docs = odd_documents(spark)
    out = corpus_pipeline.drop_exact(spark, docs, small)
    before = taken(docs)
    first, other = next(t for i, t in before if i == 2), next(t for i, t in before if i == 1 and t.startswith("Quite"))
    want = [(1, first), (1, other), (5, " \n"), next(x for x in before if x[0] == 6), next(x for x in before if x[0] == 7)]
    assert out.columns == docs.columns and taken(out) == sorted(want, key=repr)
    assert taken(corpus_pipeline.drop_exact(spark, docs.where("doc_id is null"), small)) == [x for x in before if x[0] is None][:1]


def test_near_of_odd_documents(spark, small):
    docs = odd_documents(spark)
    out = corpus_pipeline.drop_near(spark, docs, small)
    before = taken(docs)
    keep = {(1, next(t for i, t in before if i == 2)), *(x for x in before if x[0] in (3, 4, 5, 6, 7)), *(x for x in before if x[0] == 1 and x[1].startswith("Quite"))}
    assert out.columns == docs.columns and taken(out) == sorted(keep, key=repr)


def test_passages_of_odd_documents(spark, small):
    docs = odd_documents(spark)
    out = corpus_pipeline.cut_passages(spark, docs, small)
    rows = out.collect()
    assert out.columns == docs.columns and len(rows) == docs.count() and all(r["n_chars"] == len(r["text"]) and r["carried"] == "x" for r in rows)
    assert [t for _, t in taken(out.where("doc_id = 1"))] == [t for _, t in taken(docs.where("doc_id = 1"))]
    assert taken(out.where("doc_id is null")) == taken(docs.where("doc_id is null"))


def test_packing_of_odd_documents(spark, small):
    docs = odd_documents(spark)
    rows = corpus_pipeline.pack(spark, docs, small).collect()
    assert sum(r["start"] == 0 for r in rows) == docs.count() and sum(r["doc_tokens"] == 1 for r in rows) == 3
    filled = {}
    for r in rows:
        filled[r["sequence_id"]] = filled.get(r["sequence_id"], 0) + r["length"]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in filled.values())


def test_operators_leave_the_session_alone(spark, small):
    from lodeworks.llm import queries
    from lodeworks.plans.queries import queries as library

    before, candidates = dict(spark.conf.getAll), sorted(map(tuple, library()["son_candidates"](spark, small).collect()))
    queries.op1_bpe(spark, small).count()
    queries.op4_minhash(spark, small).count()
    assert dict(spark.conf.getAll) == before
    assert sorted(map(tuple, library()["son_candidates"](spark, small).collect())) == candidates


def test_run_is_registered(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, small).count() > 0
