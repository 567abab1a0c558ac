"""Byte-pair encoding and decoding with public vocabularies (operator 1).

A pre-token is encoded by a priority queue of merge ranks over a doubly linked
list of symbols. An entry of the queue names the pair it was made for; if one of
the two symbols has meanwhile been merged or has grown, the entry is stale and is
skipped. The cost is O(n log n) in the length of a pre-token, so that one word of
a million characters is no obstacle. Decoding concatenates vocabulary strings.

Texts consist of few different pre-tokens, so each worker keeps a bounded table
of those met so far.

Letters, numbers, white space and cases are those of the Unicode version that the
vocabulary's library has. Where Python's differ, or do not know a character, a text
with such a character is normalised and cut by the library's own components, which
the file names; merges are always those of the queue.

Edge cases: a null or empty text has no ids and decodes to the empty text;
repeated rows and rows with a null id are encoded like any other; columns besides
id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeworks.llm.common import id_and_text, map_rows

#: Pattern of the byte-level pre-tokenizer (fixed value, from the published vocabulary's description).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Different pre-tokens that a worker keeps.
KEPT_WORDS = 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + len(letters) - len(shown))
    return [letters[b] for b in range(256)]


class _Words(dict):
    """Pre-token to packed ids, filled on demand and emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Bpe:
    """A byte-pair vocabulary as described by a tokenizer's JSON file."""

    def __init__(self, spec: str, odd: bytes | None = None):
        """``odd``: what :func:`differing` returns; without it all characters are Python's."""
        j = json.loads(spec)
        self.odd = np.unpackbits(np.frombuffer(odd, dtype=np.uint8)).astype(bool) if odd else None
        self.library = tokenizers.Tokenizer.from_str(spec) if odd else None
        model = j["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.unknown = self.vocab.get(model.get("unk_token") or "", None)
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens") or []}
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for table in (self.vocab, self.special):
            for token, k in table.items():
                self.strings[k] = token
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._normal = self._steps(j.get("normalizer"))
        self._find, self._prefix_space = self._pretokenizer(j.get("pre_tokenizer"))
        self._bytewise = (j.get("decoder") or {}).get("type") == "ByteLevel"
        self._letters = byte_letters()
        self._bytes = {letter: b for b, letter in enumerate(self._letters)}
        if self._bytewise:
            self._raw = [s.encode() if s in self.special else b"".join(bytes([self._bytes[c]]) if c in self._bytes else c.encode() for c in s) for s in self.strings]
        self.words = _Words(self.encode_word)

    @staticmethod
    def _steps(node: dict | None) -> list:
        if node is None:
            return []
        if node["type"] == "Sequence":
            return [s for n in node["normalizers"] for s in Bpe._steps(n)]
        if node["type"] in ("NFC", "NFKC", "NFD", "NFKD"):
            return [lambda s, form=node["type"]: s if s.isascii() else unicodedata.normalize(form, s)]
        if node["type"] == "Lowercase":
            return [lambda s: (s if s.isascii() else s.replace("Σ", "σ")).lower()]  # each letter by itself: no final sigma
        if node["type"] == "Replace":
            if set(node["pattern"]) == {"Regex"}:
                pattern = regex.compile(node["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
                return [lambda s, p=pattern, to=node["content"]: p.sub(lambda _: to, s)]
            return [lambda s, old=node["pattern"]["String"], to=node["content"]: s.replace(old, to)]
        raise ValueError(f"normalizer {node['type']} is not supported")

    @staticmethod
    def _pretokenizer(node: dict | None):
        parts = node["pretokenizers"] if node and node["type"] == "Sequence" else [node]
        find, prefix = None, False
        for p in parts:
            if p and p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]:
                find = regex.compile(p["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
            elif p and p["type"] == "ByteLevel":
                prefix = p["add_prefix_space"]
                if p["use_regex"]:
                    find = regex.compile(BYTE_LEVEL).findall
            else:
                raise ValueError(f"pre-tokenizer {p and p['type']} is not supported")
        return find, prefix

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        symbols = [self._letters[b] for b in word.encode()]
        if not symbols:
            return []
        symbols[-1] += self.suffix
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, k, symbols[k], symbols[k + 1]) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, left, right = heapq.heappop(queue)
            nxt = after[k]
            if symbols[k] != left or nxt < 0 or symbols[nxt] != right:
                continue  # stale: a side has been merged since
            symbols[k], symbols[nxt] = left + right, ""
            after[k] = far = after[nxt]
            if far >= 0:
                before[far] = k
                if (r := ranks.get((symbols[k], symbols[far]))) is not None:
                    heapq.heappush(queue, (r, k, symbols[k], symbols[far]))
            if (near := before[k]) >= 0 and (r := ranks.get((symbols[near], symbols[k]))) is not None:
                heapq.heappush(queue, (r, near, symbols[near], symbols[k]))
        out, k = [], 0
        while k >= 0:
            token = self.vocab.get(symbols[k], self.unknown)
            if token is not None:
                out.append(token)
            k = after[k]
        return out

    def _unlettered(self, piece: str) -> str:
        return bytes(map(self._bytes.__getitem__, piece)).decode()

    def _ordinary(self, text: str) -> bytes:
        if self.odd is not None and not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")].any():
            text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
            return b"".join(self.words[self._unlettered(piece)] for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text))
        for step in self._normal:
            text = step(text)
        if self._prefix_space and text and not text[0].isspace():
            text = " " + text
        words = self._find(text) if self._find else [text]
        return b"".join(map(self.words.__getitem__, words))

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers. Strings of special tokens become their ids."""
        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(np.array([self.special[p]], dtype="<u4").tobytes() if p in self.special else self._ordinary(p) for p in self._cut.split(text) if p)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """Vocabulary strings of the ids: bytewise where the file names such a decoder, else joined by spaces."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        if self._bytewise:
            return b"".join(map(self._raw.__getitem__, ids)).decode("utf-8", "replace")
        return " ".join(map(self.strings.__getitem__, ids))

    def decode_packed(self, ids: bytes) -> str:
        return self.decode(np.frombuffer(ids, dtype="<u4"))


@lru_cache(maxsize=1)
def differing() -> bytes:
    """A bit for each code point that Python's tables and the library's classify, lower or normalise differently, or that Python's do not know."""
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    apart = {c for c in every if unicodedata.category(c) == "Cn"}
    text, lines = "".join(every), "\n".join(every)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        cut = tokenizers.pre_tokenizers.Split(tokenizers.Regex(kind + "+"), "removed", invert=True).pre_tokenize_str(text)
        apart |= set(regex.findall(kind.replace(r"\s", r"\p{White_Space}"), text)) ^ set("".join(piece for piece, _ in cut))
    nfc = tokenizers.normalizers.NFC()
    for own, step in ((unicodedata.normalize("NFC", lines), nfc), (lines.replace("Σ", "σ").lower(), tokenizers.normalizers.Lowercase())):
        apart |= {c for c, a, b in zip(every, own.split("\n"), step.normalize_str(lines).split("\n"), strict=True) if a != b}
    for c in filter(unicodedata.combining, every):  # marks that change places with others for one of the two only
        if nfc.normalize_str(f"\u0301{c}\u0334") != unicodedata.normalize("NFC", f"\u0301{c}\u0334"):
            apart.add(c)
    bits = np.zeros(0x110000, dtype=bool)
    bits[[ord(c) for c in apart]] = True
    return np.packbits(bits).tobytes()


@lru_cache(maxsize=4)
def _loaded(spec: str, odd: bytes | None = None) -> Bpe:
    return Bpe(spec, odd)


def read_spec(path: str) -> str:
    """A vocabulary file's text, read by the driver. Tasks get it with their code: a few MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def shared_bpe(spark, path: str):
    """A function that returns the worker's own :class:`Bpe`; file and table go out once as a broadcast of their fixed size."""
    sent = spark.sparkContext.broadcast((read_spec(path), differing()))
    return lambda: _loaded(*sent.value)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
DECODED = T.StructType([*ENCODED.fields, T.StructField("decoded", T.StringType())])


def bpe_encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers, one row per row of ``df``."""
    bpe = shared_bpe(df.sparkSession, vocabulary)

    def start():
        encode = bpe().encode_packed

        def each(c):
            ids = [encode(t) for t in c["text"]]
            return {"doc_id": c["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

        return each

    return map_rows(id_and_text(df, id_col, text_col), start, ENCODED)


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The columns of :func:`bpe_encode` and ``decoded``, the text of the ids."""
    bpe = shared_bpe(encoded.sparkSession, vocabulary)

    def start():
        decode = bpe().decode_packed
        return lambda c: c | {"decoded": [decode(x or b"") for x in c["ids"]]}

    return map_rows(encoded.select("doc_id", "n_tokens", "ids"), start, DECODED)
