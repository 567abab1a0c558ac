"""A corpus from documents to packed windows, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again, and
returns the columns of documents; the last one returns packed pieces. SQL cannot
express all stages; tests hold each one against a brute-force version.

All stages take null, empty and very long texts, null and repeated ids, further
columns of any name, and tables without rows, from which they return none. A null
text counts as empty, and stays null where a stage keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import exact_dedup, minhash, packing, quality, substring
from lodeworks.llm.common import Scratch, broadcast_if_small, settled
from lodeworks.llm.queries import table, vocabulary

#: Largest list of dropped ids, in bytes, that is sent to all executors; a longer one is joined by shuffle.
GONE_BYTES = 16 << 20


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    It decides row by row from the text alone: repeated rows stay or go together, an empty or null text has a
    score like any other, and a score of exactly ``ACCEPT`` stays. No column is added or read but the text.
    """
    score = quality.scorer(spark, quality.train(docs, table(spark, sf_dir, "labels")))
    return settled(docs.where(score(F.col("text")) >= quality.ACCEPT), "quality")


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that are equal but for white space.

    The longest original stays, then the smallest id, null ids last. Of repeated rows, with one id or with null
    ids, exactly one stays; rows that share an id but not a text are told apart. All null and empty texts are one class.
    """
    return _kept(docs, exact_dedup.exact_duplicates(docs), "exact")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id, null ids last.

    Texts without words are near nothing and stay, but of rows with one id and one text, one stays. Rows that
    share an id but not a text are told apart.
    """
    return _kept(docs, minhash.near_duplicates(docs), "near")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less passages that one with a smaller id has as well; ``n_chars`` follows.

    Every row stays, repeated ones too. Rows with equal ids are one document; rows with null ids lose nothing and
    take nothing from others. A null text becomes empty; a text that is all one passage may become empty.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = substring.cut_repeated_passages(docs, carry=rest)
    columns = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long"), "doc_id": F.col("doc_id")}
    return settled(cut.select(*[columns.get(c, F.col("carried").getField(c)).alias(c) for c in docs.columns]), "passages")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 2048 ids.

    Every row is packed, repeated ones and those with a null id too; a null or empty text is its end mark alone.
    """
    pieces = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return settled(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"), "packing")


def _kept(docs: DataFrame, decided: DataFrame, label: str) -> DataFrame:
    """Rows of ``docs`` that were not decided against.

    An id that one row has decides for itself. Where it is null or repeats, rows are told apart by their text's
    digest, and of rows alike in both one stays, whichever, as they differ in other columns at most.
    """
    scratch = Scratch(docs.sparkSession, label)
    mine, text = _fresh(docs, "id"), _fresh(docs, "text")
    decided = scratch.write(decided.select(F.col("doc_id").alias(mine), F.col("text_md5").alias(text), "kept"), "decided")
    ids = decided.groupBy(mine).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("n_kept"))
    single = f"n = 1 AND {mine} IS NOT NULL"
    odd = scratch.write(ids.where(f"NOT ({single})").select(mine), "odd")
    gone = scratch.write(ids.where(f"NOT ({single}) OR n_kept = 0").where(F.col(mine).isNotNull()).select(mine), "gone")
    same = lambda known: docs["doc_id"].cast("long").eqNullSafe(known[mine])
    gone_ids = broadcast_if_small(scratch, gone, "gone", GONE_BYTES)
    plain = docs.where(docs["doc_id"].isNotNull()).join(gone_ids, docs["doc_id"].cast("long") == gone_ids[mine], "left_anti")
    if odd.isEmpty():
        return plain.select(*docs.columns)
    odd = broadcast_if_small(scratch, odd, "odd", GONE_BYTES)
    keys = decided.where("kept").join(odd.select(F.col(mine).alias("_odd")), F.col(mine).eqNullSafe(F.col("_odd")), "left_semi").select(mine, text).distinct()
    keys = broadcast_if_small(scratch, scratch.write(keys, "keys"), "keys", GONE_BYTES)
    rows = docs.join(keys, same(keys) & (F.md5(F.coalesce(docs["text"], F.lit(""))) == keys[text]))
    whole = F.struct(*[docs[c] for c in docs.columns])
    once = rows.groupBy(mine, text).agg(F.first(whole).alias("row"))
    return plain.select(*docs.columns).union(once.select("row.*"))


def _fresh(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has, in any case."""
    taken = {c.lower() for c in docs.columns}
    while (name := "_" + name) in taken:
        pass
    return name


STAGES = [("quality", keep_quality), ("exact", drop_exact), ("near", drop_near), ("passages", cut_passages), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
