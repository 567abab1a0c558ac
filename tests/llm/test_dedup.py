import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from helpers import documents, rows_of

from lodeworks.llm import components, exact_dedup, lines, minhash, queries, substring
from lodeworks.llm.quotient import CountingQuotientFilter

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    from oracle import same

    same(spark, small, queries.queries()[name], SQL[name])


# counting quotient filters


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_quotient_filter_is_lossless(n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, 1 << 62, max(1, n // 2), dtype=np.uint64)[rng.integers(0, max(1, n // 2), n)] << np.uint64(2) if n else np.zeros(0, np.uint64)
    values = np.append(values, np.repeat(values[:1], 400))
    unique, counts = np.unique(values, return_counts=True)
    one = CountingQuotientFilter.load(CountingQuotientFilter.of(values).dump())
    parts = [CountingQuotientFilter.load(CountingQuotientFilter.of(v).dump()) for v in np.array_split(values, 3)]
    merged = parts[0].merged(parts[1]).merged(parts[2])
    for f in (one, merged):
        found, n_found = f.items()
        assert (found == unique).all() and (n_found == counts).all()
    assert merged.dump() == one.dump()


def test_quotient_filter_of_a_range():
    bits, prefix = 5, 19
    values = (np.uint64(prefix) << np.uint64(59)) | np.random.default_rng(1).integers(0, 1 << 59, 500, dtype=np.uint64)
    f = CountingQuotientFilter.load(CountingQuotientFilter.of(values, shared_bits=bits).dump())
    assert (f.items(prefix, bits)[0] == np.unique(values)).all()


# exact duplicates


def test_exact_edges(spark):
    df = documents(spark, [(1, "a b"), (2, "a  b "), (3, "A b"), (4, None), (5, ""), (6, "ab"), (6, "ab"), (None, "z"), (9, " ab"), (10, " \t\n\x0b\x0c\r")])
    found = rows_of(exact_dedup.exact_duplicates(df), "doc_id", "keep_id", "group_size", "kept")
    # "a  b " is the longest of its class; white space alone is the longest empty text
    expected = [(1, 2, 4, False), (2, 2, 4, True), (3, 3, 1, True), (4, 10, 3, False), (5, 10, 3, False), (6, 2, 4, False), (6, 2, 4, False), (9, 9, 1, True), (None, None, 1, True), (10, 10, 3, True)]
    assert found == sorted(expected, key=repr)
    assert exact_dedup.exact_duplicates(df.where("false")).count() == 0


def test_exact_repeated_rows(spark):
    df = documents(spark, [(6, "same"), (6, "same"), (7, "same"), (6, "other"), (None, "z"), (None, "z"), (-(1 << 63), "long " * 100_000), (5, "long " * 100_000)])
    found = rows_of(exact_dedup.exact_duplicates(df), "doc_id", "keep_id", "group_size", "kept")
    least = -(1 << 63)
    expected = [(6, 6, 3, True), (6, 6, 3, False), (7, 6, 3, False), (6, 6, 1, True), (None, None, 2, True), (None, None, 2, False), (least, least, 2, True), (5, least, 2, False)]
    assert found == sorted(expected, key=repr)


def test_exact_ties_and_digest(spark):
    found = exact_dedup.exact_duplicates(documents(spark, [(8, "x y"), (7, "xy "), (3, "x y"), (5, None)]))
    assert rows_of(found, "doc_id", "keep_id") == [(3, 3), (5, 5), (7, 3), (8, 3)]
    assert {r["text_sha256"] for r in found.collect()} == {hashlib.sha256(b"xy").hexdigest(), hashlib.sha256(b"").hexdigest()}


# near duplicates


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    low = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            m = min(low[i], low[j])
            changed |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return {i: (len(sets[i]), low[i]) for i in sets}


def variants(seed, groups, copies, words=120):
    """Groups of copies with single words changed, from light to heavy, so that similarities lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 5000)}"
    passage = [word() for _ in range(60)]
    docs = []
    for g in range(groups):
        base = [word() for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for _ in range(int(rng.integers(0, 9))):
                text[int(rng.integers(0, words))] = word()
            docs.append(" ".join(text + (passage if g % 2 else [])))
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "groups", "copies"), [(1, 30, 5), (2, 2, 90)])
def test_near_duplicates_against_all_pairs(spark, seed, groups, copies):
    docs = variants(seed, groups, copies)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    assert found == brute_components(docs)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    docs = variants(3, 2, 60)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "LISTED", 600)
    monkeypatch.setattr(minhash, "CLOSEST", 1)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    assert found == brute_components(docs)


def test_near_edges(spark):
    long = " ".join(f"word{k}" for k in range(3000))
    df = documents(spark, [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\x0btwo"), (6, "one two three"), (7, long), (8, long + " more"), (8, long + " more"), (None, long), (None, "alone here")])
    found = rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    expected = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 2996, 7, True)]
    expected += [(8, 2997, 7, False)] * 2 + [(None, 2996, 7, False), (None, 1, None, True)]
    assert found == sorted(expected, key=repr)
    least = -(1 << 63)
    df = documents(spark, [(least, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (9, "quite another text of nine words in one"), (None, long), (None, long), (None, long + " more")])
    found = rows_of(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept")
    expected = [(least, 2, least, True), (9, 2, least, False), (9, 2, least, False), (9, 4, 9, True), (None, 2996, None, True), (None, 2996, None, False), (None, 2997, None, False)]
    assert [r[:3] for r in found] == [r[:3] for r in sorted(expected, key=repr)] and sum(r[3] for r in found) == 3
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_links_of_many_documents_are_found(spark):
    """5,400 documents around the threshold: every link by an exact prefix-filter join, and the components it makes."""
    docs = variants(5, 1800, 3)
    sets = {i: shingle_set(t) for i, t in docs}
    often = defaultdict(int)
    for s in sets.values():
        for x in s:
            often[x] += 1
    lists, pairs = defaultdict(list), set()
    for i, s in sets.items():
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - -(-75 * len(s) // 100) + 1]
        for x in rare:
            pairs |= {(j, i) for j in lists[x]}
            lists[x].append(i)
    links = [(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            low[i] = i = low[low[i]]
        return i

    for i, j in links:
        a, b = top(i), top(j)
        low[max(a, b)] = min(a, b)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents(spark, docs)).collect()}
    assert len(links) > 1000 and sum(found[i] == found[j] for i, j in links) >= 0.9995 * len(links)
    assert sum(found[i] == top(i) for i in found) >= 0.9995 * len(found) and len(found) == len(docs)


def test_far_pairs_are_those_that_need_not_meet():
    assert minhash.FAR == 2 * minhash.CHUNKS - 1


def test_keys_meet_within_the_distance():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 16, (200, minhash.PLACES), dtype=np.uint16)
    y = x.copy()
    for k in range(len(y)):
        off = rng.permutation(minhash.PLACES)[: 2 * minhash.CHUNKS - 1]
        y[k, off] += 1
    a, b = minhash._all_keys(x), minhash._all_keys(y)
    assert all(set(a[k]) & set(b[k]) for k in range(len(x)))
    first = [next(v for v in a[k] if v in set(b[k])) for k in range(len(x))]
    assert all(minhash._has_first(np.stack([x[k], y[k]]), np.array([0]), np.array([1]), first[k])[0] for k in range(len(x)))


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 7), (2, 2)], "a long, b long")
    assert rows_of(components.connected_components(edges), "node", "component") == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3)]


# lines


def brute_lines(docs):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = {}
    for i, t in docs:
        all_lines = (t or "").split("\n")
        stay = [x for x in all_lines if len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        out[i] = (len(all_lines), len(all_lines) - len(stay), "\n".join(stay))
    return out


def test_lines(spark):
    common = "This line is common to many documents."
    docs = [(1, f"{common}\nown line of the first document\n{common.upper()} \r"), (2, f"\t{common}\nshort\n"), (3, common), (4, "short\nshort"), (5, None), (6, ""), (7, "short\nÄ line with ünïcode letters\n\n"), (8, "ä line with ünïcode letters")]
    docs += [(k, "x\n" + "A different line, found twice only"[: 30 + k % 2]) for k in (20, 21, 22)]
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_repeated_lines(documents(spark, docs)).collect()}
    assert found == brute_lines(docs)
    assert lines.drop_repeated_lines(documents(spark, docs).where("false")).count() == 0


def test_lines_null_ids(spark):
    common = "This line is common to many documents."
    found = lines.drop_repeated_lines(documents(spark, [(None, common), (None, common + "\nb"), (4, common), (3, common)]))
    assert rows_of(found, "doc_id", "n_dropped", "kept_text") == [(3, 1, ""), (4, 0, common), (None, 1, ""), (None, 1, "b")]
    alone = lines.drop_repeated_lines(documents(spark, [(None, common)] * 3))
    assert {r["n_dropped"] for r in alone.collect()} == {0}


def test_lines_of_equal_ids_are_one_document(spark):
    common, other = "This line is common to many documents.", "Another line that is held by three documents."
    docs = [(1, common + "\na"), (1, common + "\nb"), (1, common + "\nb"), (2, common), (3, other), (4, other + "\n" + other), (5, other), (5, "x\n" + other)]
    found = rows_of(lines.drop_repeated_lines(documents(spark, docs)), "doc_id", "n_lines", "n_dropped", "kept_text")
    expected = [(1, 2, 0, common + "\na"), (1, 2, 0, common + "\nb"), (1, 2, 0, common + "\nb"), (2, 1, 0, common), (3, 1, 1, ""), (4, 2, 2, ""), (5, 1, 0, other), (5, 2, 0, "x\n" + other)]
    assert found == sorted(expected, key=repr)


def test_a_document_of_very_many_lines(spark):
    import time

    body = "\n".join(f"line number {k} of a very long log file" for k in range(200_000))
    began = time.perf_counter()
    found = lines.drop_repeated_lines(documents(spark, [(k, body) for k in (1, 2, 3)])).select("doc_id", "n_lines", "n_dropped").collect()
    assert sorted(map(tuple, found)) == [(1, 200_000, 200_000), (2, 200_000, 200_000), (3, 200_000, 0)]
    assert time.perf_counter() - began < 120  # by the square of its lines it would be half an hour


def test_blooms_never_miss():
    values = np.random.default_rng(0).integers(0, 1 << 62, 4000, dtype=np.uint64)
    f = lines.TwoBlooms(4000)
    f.add(values)
    f.add(values[:500])
    suspected = set(f.suspected(values).tolist())
    assert set(values[:500].tolist()) <= suspected and len(suspected) < 520


# substrings


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def test_chunks_resist_shifts():
    rng = np.random.default_rng(5)
    text = words(rng, 2000)
    a, b = set(substring.chunks(text)[1].tolist()), set(substring.chunks("an insertion " + text[:3000] + "another" + text[3000:])[1].tolist())
    assert len(a - b) <= 6
    starts, digests = substring.chunks(text)
    assert starts[0] == 0 and starts[-1] == len(text) and len(digests) == len(starts) - 1 and (np.diff(starts) > 0).all()


def brute_cut(docs, least=substring.LEAST):
    """Chunk by chunk, from the same borders, with the bytes themselves for digests."""
    held = defaultdict(set)
    cut = {}
    for i, t in docs:
        data = (t or "").encode()
        stops = substring.ends(np.frombuffer(data, dtype=np.uint8)).tolist() if data else []
        cut[i] = [(a, b, data[a:b]) for a, b in zip([0, *stops], stops, strict=False)]
        for _, _, piece in cut[i]:
            held[piece].add(i)
    out = {}
    for i, t in docs:
        spans = []
        for a, b, piece in cut[i]:
            if min(held[piece]) < i:
                spans = [*spans[:-1], (spans[-1][0], b)] if spans and spans[-1][1] == a else [*spans, (a, b)]
        data, kept, at = (t or "").encode(), b"", 0
        for a, b in spans:
            if b - a >= least:
                kept += data[at:a]
                at = b
        out[i] = (kept + data[at:]).decode()
    return out


def test_repeated_passages_are_cut(spark):
    rng = np.random.default_rng(6)
    passages = [words(rng, 60) for _ in range(4)]
    docs = []
    for k in range(40):
        parts = [words(rng, 80), *([passages[k % 4]] if k % 3 == 0 else []), words(rng, 40)]
        docs.append((k, " ".join(parts)))
    docs += [(50, None), (51, ""), (52, docs[1][1])]
    found = {r["doc_id"]: r for r in substring.cut_repeated_passages(documents(spark, docs), carry=("n", "size")).collect()}
    assert {i: r["kept_text"] for i, r in found.items()} == brute_cut(docs)
    first = {}
    for k in range(40):
        if k % 3 == 0:
            holder = first.setdefault(k % 4, k)
            assert (found[k]["n_removed"] > 0) == (holder != k)
            assert (passages[k % 4] in found[k]["kept_text"]) == (holder == k)
            if holder != k:
                assert found[k]["source_ids"] == [holder]
        else:
            assert found[k]["n_removed"] == 0
        assert len(found[k]["spans"]) == (found[k]["n_removed"] > 0)
    assert found[52]["source_ids"] == [1] and len(found[52]["kept_text"]) < 120
    assert found[1]["carried"]["size"] == "x"


def test_substring_edges(spark):
    text = "ä" * 10 + " " + words(np.random.default_rng(7), 100) + "ü" * 5
    df = documents(spark, [(1, text), (2, text), (2, text), (None, text), (3, "z" * 20_000), (4, "z" * 20_000 + "!")])
    found = rows_of(substring.cut_repeated_passages(df), "doc_id", "n_bytes", "n_removed")
    size = len(text.encode())
    by = {r[0]: r for r in found}
    assert by[1][2] == 0 and by[None] == (None, size, 0) and by[2][2] > size - 40 and by[4][2] > 19_000
    assert substring.cut_repeated_passages(df.where("false")).count() == 0


def test_whole_characters_are_cut():
    assert substring.without("aäb", [(2, 4)]) == ("aä", [(3, 4)])
    assert substring.without("aäb", [(0, 2)]) == ("äb", [(0, 1)])


def test_shuffled_tables_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    shared = words(rng, 70)
    docs = [(k, words(rng, 30) + " " + shared) for k in range(6)] + [(7, "la " * 90), (8, words(rng, 60) + " la" * 80)]
    want = rows_of(substring.cut_repeated_passages(documents(spark, docs)), "doc_id", "kept_text")
    monkeypatch.setattr(substring, "BROADCAST_BYTES", -1)
    assert rows_of(substring.cut_repeated_passages(documents(spark, docs)), "doc_id", "kept_text") == want


def brute_windows(docs):
    """Words in a window of more than 50 that a smaller id has too, by the words themselves: (id, [first and last word of each window])."""
    size, first, out = 51, {}, {}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in docs}
    for i, _ in sorted(docs):
        grams = [tuple(split[i][k : k + size]) for k in range(len(split[i]) - size + 1)]
        out[i] = [g for g in grams if first.get(g, i) < i]
        for g in grams:
            first.setdefault(g, i)
    return out


def test_short_and_periodic_passages_are_cut(spark):
    rng = np.random.default_rng(9)
    letters = lambda n, m: " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), m)) for _ in range(n))
    docs, planted = [], {}
    for k, passage in enumerate([*[letters(55, 1 + j % 3) for j in range(30)], letters(51, 1), "la " * 70, "do re mi " * 30, "1, 0,\n" * 40]):
        passage = passage.strip()
        docs.append((2 * k, letters(80, 5) + " " + passage + " " + letters(70, 5)))
        docs.append((2 * k + 1, letters(47 + k % 7, 5) + " " + passage + " " + letters(60, 5)))
        planted[2 * k + 1] = passage
    docs.append((100, docs[0][1][:300].rsplit(" ", 1)[0] + " " + letters(20, 5) + " " + planted[1].rsplit(" ", 5)[0]))  # at most 50 words of either
    found = {r["doc_id"]: r for r in substring.cut_repeated_passages(documents(spark, docs)).collect()}
    shared = brute_windows(docs)
    assert all(bool(shared[i]) == (i in planted) for i, _ in docs)
    texts = dict(docs)
    for i, passage in planted.items():
        at = texts[i].encode().index(passage.encode())
        assert any(x["start"] < at + len(passage) and at < x["end"] for x in found[i]["spans"]), passage
        assert found[i]["source_ids"] == [i - 1]
        left = found[i]["kept_text"]
        assert not {g for g in brute_windows([(-1, texts[i - 1]), (i, left)])[i]}, passage
        before, behind = texts[i].split(passage)
        assert left.startswith(before) and left.endswith(behind)
    for i in range(0, 68, 2):
        assert found[i]["n_removed"] == 0
