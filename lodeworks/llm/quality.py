"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 10).

The statistics of a text are shares of kinds of characters, entropy, and counts
and repetition of its words and lines; nothing but the text enters. Trees are
grown level by level from histograms of binned statistics and stored as complete
binary trees in flat arrays, which numpy walks for all rows and trees at once.

Training uses at most ``sample_rows`` labelled rows, chosen by a hash of their id;
scoring covers every whole text.

Edge cases: a null or empty text has the statistics zero and gets a score;
labels that are null, and labelled ids without a document, are not learned from;
with no labelled row at all every score is 0.5; repeated rows are scored each; an
empty table gives no rows; columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.llm.common import id_and_text, map_rows, small_batches

SAMPLE_ROWS = 20_000
FOLDS = 5
#: Scores from here on predict label 1.
ACCEPT = 0.3

_MARKS = b"!?.,;:|#$%&*<>{}=@/\\\"'-_()[]+~^"
_LOWER, _UPPER, _DIGIT = np.arange(97, 123), np.arange(65, 91), np.arange(48, 58)
N_FEATURES = 17 + len(_MARKS)


def statistics(text: str) -> np.ndarray:
    """Statistics of one text."""
    out = np.zeros(N_FEATURES)
    data = text.encode("utf-8", "replace")
    n = len(data)
    if not n:
        return out
    shares = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / n
    used = shares[shares > 0]
    words, lines = data.split(), data.split(b"\n")
    different = set(words)
    kinds = [shares[_LOWER].sum(), shares[_UPPER].sum(), shares[_DIGIT].sum(), shares[128:].sum(), shares[32], shares[10]]
    marks = shares[list(_MARKS)]
    full = [x for x in lines if x]
    out[:17] = [
        np.log1p(n),
        *kinds,
        marks.sum(),
        (used * np.log(used)).sum(),
        np.log1p(len(words)),
        n / (len(words) + 1),
        len(different) / (len(words) + 1),
        sum(map(len, different)) / (len(different) + 1),
        np.log1p(len(lines)),
        n / len(lines),
        len(set(full)) / (len(full) + 1),
        max(map(len, words), default=0),
    ]
    out[17:] = marks
    return out


@dataclass
class Forest:
    """Complete trees of one depth: node k of a tree has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        if not trees:
            return np.full(len(x), self.base)
        node = np.zeros((len(x), trees), dtype=np.int64)
        tree, row = np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.base + self.leaf[tree, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0) -> Forest:
    """Boost trees on the logistic loss. ``least``: hessian that a child has at least."""
    inner, features = 2**depth - 1, x.shape[1]
    if not len(y):
        return Forest(0.0, np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(features)], axis=1)
    cells = binned + np.arange(features) * bins
    raw = np.full(len(y), np.log(p / (1 - p)))
    all_features = np.zeros((trees, inner), dtype=np.int64)
    all_thresholds = np.full((trees, inner), np.inf)
    all_leaves = np.zeros((trees, inner + 1))
    gain = lambda g, h: g * g / (h + ridge)
    for t in range(trees):
        s = 1 / (1 + np.exp(-raw))
        grad, hess = y - s, s * (1 - s)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (features * bins) + cells).ravel()
            g, h = (np.bincount(at, np.repeat(v, features), width * features * bins).reshape(width, features, bins) for v in (grad, hess))
            gl, hl = g.cumsum(axis=2), h.cumsum(axis=2)
            gs, hs = gl[:, :1, -1:], hl[:, :1, -1:]
            gains = gain(gl, hl) + gain(gs - gl, hs - hl) - gain(gs, hs)
            gains[(hl < least) | (hs - hl < least)] = 0
            best = gains.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gains[k, f, b] > 1e-9 and b < len(edges[f]):
                    all_features[t, first + k], all_thresholds[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), all_features[t, node]] > all_thresholds[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        all_leaves[t] = rate * g / (h + ridge)
        raw += all_leaves[t, leaf]
    return Forest(float(np.log(p / (1 - p))), all_features, all_thresholds, all_leaves)


def fold(doc_id: Column) -> Column:
    """Remainder that decides whether a row may be learned from: 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def train(documents: DataFrame, labels: DataFrame, target: str = "quality", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Fit on at most ``sample_rows`` labelled rows that are not held out; these rows' statistics come to the driver."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & (fold(F.col("doc_id")) != 0))
    share = min(1.0, sample_rows / max(1, known.count()))
    part = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).orderBy("doc_id", "y").limit(sample_rows)
    texts = id_and_text(documents, id_col, text_col).join(F.broadcast(part), "doc_id")  # sample_rows ids at most

    def start():
        return lambda c: {"y": c["y"], "x": [statistics(t).tolist() for t in c["text"]]}

    rows = map_rows(texts.select("y", "text"), start, T.StructType([T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    with small_batches(documents.sparkSession):
        rows = rows.limit(2 * sample_rows).toArrow()  # repeated ids may bring more rows than the sample has
    if not rows.num_rows:
        return fit(np.zeros((0, N_FEATURES)), np.zeros(0))
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, N_FEATURES)
    y = rows.column("y").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # whatever the order in which rows arrive
    return fit(x[order], y[order])


def scorer(spark: SparkSession, forest: Forest) -> Callable[[Column], Column]:
    """Function from a column of texts to their scores; a null text counts as empty."""
    sent = spark.sparkContext.broadcast(forest)  # a few hundred KB, whatever the corpus

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            part = texts.iloc[at : at + 512]
            out[at : at + 512] = sent.value.score(np.stack([statistics(t) for t in part]))
        return pd.Series(out)

    return lambda text: score(F.coalesce(text, F.lit("")))


def score_documents(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row."""
    return id_and_text(df, id_col, text_col).select("doc_id", scorer(df.sparkSession, forest)(F.col("text")).alias("score"))
