import hashlib
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from lodeworks.llm import bpe, packing, queries

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

ODD = [
    "", " ", "a", "ΣΑΣ ΣΟΦΟΣ", "İstanbul\x85x\x1cy z", "hi <|endoftext|> there<|startoftext|>", "é café Å", "don't 'S WE'RE 123 ４５ ½",
    "​﻿x", "日本語テキスト😀😀", "a" * 3000, "ab \n\n\n  c\t\td   ", "\x00\x01 x", "ﬁ ǅ ẞ", "<|endoftext|>", "x" + " " * 5000 + "y", "!?" * 2000,
]


def library(name):
    return tokenizers.Tokenizer.from_file(P.path(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_as_the_library(name, texts):
    own, lib = bpe.Bpe(bpe.read_spec(P.path(name)), bpe.differing()), library(name)
    for text in ODD + texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text[:80]
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), text[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_code_point_as_the_library(name):
    """All characters alone, behind a letter, and behind a letter and a mark with a mark behind, 32 words a text, and the texts that differ word by word."""
    own, lib = bpe.Bpe(bpe.read_spec(P.path(name)), bpe.differing()), library(name)
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and not 0xE000 <= c < 0xF900 and c < 0xE0200]
    assigned = [c for k, c in enumerate(every) if ord(c) < 0x20000 or k % 64 == 0]  # of the large plain blocks one in 64
    texts = [f" {c} x{c} Ae\u0301{c}\u0323y" for c in assigned]
    joined = ["|".join(texts[k : k + 32]) for k in range(0, len(texts), 32)]
    found = lib.encode_batch(joined, add_special_tokens=False)
    bad = [k for k, (text, f) in enumerate(zip(joined, found, strict=True)) if own.encode(text) != f.ids]
    assert not bad, [hex(ord(c)) for k in bad for c in assigned[32 * k : 32 * k + 32] if own.encode(f" {c} x{c}") != lib.encode(f" {c} x{c}", add_special_tokens=False).ids][:40]


def test_fast_encoder_is_the_same(texts):
    fast, lib = packing._fast_encoder(bpe.read_spec(P.path("byte_bpe_50k.json"))), library("byte_bpe_50k.json")
    for text in ODD + texts:
        assert fast(text).tolist() == lib.encode(text, add_special_tokens=False).ids, text[:80]


def test_stale_entries_and_long_words():
    own = bpe.Bpe(bpe.read_spec(P.path("byte_bpe_50k.json")))
    assert own.decode(own.encode("z" * 200_000)) == "z" * 200_000


def test_query_round_trip(spark, small):
    lib = library("word_bpe_49k.json")
    docs = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, small, "documents").collect()}
    found = queries.op1_bpe(spark, small).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    for r in found:
        ids = lib.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark):
    df = documents(spark, [(1, None), (1, None), (None, "a b"), (3, ""), (4, "x " * 50_000)])
    path = P.path("word_bpe_49k.json")
    found = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in found) == [(0, 2), (1, 0), (1, 0), (3, 0), (4, 50_000)]
    assert bpe.bpe_encode(df.where("false"), path).count() == 0


def check_pieces(rows, docs, lib):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(docs)
    for doc_id, pieces in by_doc.items():
        ids = [*lib.encode(docs[doc_id] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing_query(spark, small):
    docs = {r["doc_id"]: r["text"] for r in queries.table(spark, small, "documents").collect()}
    rows = queries.op9_packing(spark, small).collect()
    assert check_pieces(rows, docs, library("byte_bpe_50k.json")) == 0
    steps = {}
    for r in rows:
        steps[r["step_group"]] = steps.get(r["step_group"], 0) + r["length"]
    assert max(steps.values()) - min(steps.values()) <= 2048 or len(steps) == 1


def test_packing_edges(spark):
    docs = {1: None, 2: "", 3: "word " * 9000, 4: "short text"}
    df = documents(spark, list(docs.items()))
    rows = packing.pack_documents(df, P.path("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, docs, library("byte_bpe_50k.json"))
    assert packing.pack_documents(df.where("false"), P.path("byte_bpe_50k.json")).count() == 0
    twice = packing.pack_documents(documents(spark, [(7, "a"), (7, "a"), (None, "b")]), P.path("byte_bpe_50k.json")).collect()
    assert len(twice) == 3


@pytest.mark.parametrize("seed", range(20))
def test_pack_places_every_token_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [5, 200, 3000, 9000][seed % 4], size=rng.integers(1, 200)).tolist()
    windows = packing.pack(lengths)
    seen = [np.zeros(n, dtype=int) for n in lengths]
    for w in windows:
        for row, start, n in w:
            seen[row][start : start + n] += 1
    assert all((s == 1).all() for s in seen)
    sizes = [sum(p[2] for p in w) for w in windows]
    assert all(s & (s - 1) == 0 and s <= 2048 for s in sizes)
    groups = packing.step_groups(sizes, 16 * 2048)
    totals = np.bincount(groups, weights=sizes)
    assert totals.max() - totals.min() <= 2048
