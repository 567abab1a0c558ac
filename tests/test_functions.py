import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import scalar, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("city", "modulus", "fold", "hashes"),
    [
        ("Las Vegas", 200, 107, [46, 176, 80, 50, 146, 54]),
        ("Toronto", 200, 127, [186, 156, 20, 110, 86, 74]),
        ("Belœil", 200, 172, [101, 11, 185, 45, 51, 69]),
        ("Las Vegas", 512, 371, [134, 136, 408, 466, 250, 174]),
        ("Toronto", 512, 111, [362, 156, 340, 70, 502, 434]),
        ("Belœil", 512, 364, [85, 235, 97, 349, 499, 309]),
        ("", 200, 0, [97, 63, 21, 9, 47, 97]),
    ],
)
def test_byte_fold(spark, city, modulus, fold, hashes):
    x = scalar.byte_fold(F.lit(city), modulus)
    assert one(spark, x) == fold
    assert one(spark, scalar.linear_hashes(x, modulus)) == hashes


def test_byte_fold_is_the_big_number(spark):
    text = "a long text, wholly beyond 64 bits: ÄÖÜ"
    assert one(spark, scalar.byte_fold(F.lit(text), 997)) == int(text.encode().hex(), 16) % 997


def test_trailing_zeros(spark):
    assert [one(spark, scalar.trailing_zeros(F.lit(x))) for x in (0, 1, 8, 96)] == [0, 0, 3, 5]


def test_py_round(spark):
    values = [3.25, 2.45, 2.675, 0.05, -1.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0] for r in df.select(scalar.py_round("v", F.lit(1))).collect()]
    assert [None if pd.isna(x) else x for x in found] == [None if v is None else round(v, 1) for v in values]


def test_clip_default_and_jaccard(spark):
    assert [one(spark, scalar.clip(F.lit(x))) for x in (0.2, 3.3, 9.0)] == [1.0, 3.3, 5.0]
    assert one(spark, scalar.zero_default(F.lit(0.0))) == 3.0
    assert one(spark, scalar.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    empty = F.array().cast("array<int>")
    assert one(spark, scalar.jaccard(empty, empty)) is None


def test_seconds_text(spark):
    assert one(spark, scalar.seconds_text(F.lit("2019-01-31 23:59:59.999").cast("timestamp"))) == "2019-01-31 23:59:59"


@pytest.mark.parametrize(("pairs", "expected"), [([(1, 1), (1, 2)], 0.0), ([(3, 4)], 0.0), ([(1, 2), (2, 4), (3, 6)], 1.0), ([(1, 3), (2, 2), (3, 1)], -1.0)])
def test_pearson(spark, pairs, expected):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pairs], "x double, y double")
    assert df.agg(stats.pearson("x", "y").alias("p")).first()["p"] == pytest.approx(expected)


def test_error_histogram_gap(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 4.5), (1.0, 2.0)], "t double, p double")
    assert tuple(stats.error_histogram(df, "t", "p").first()) == (1, 1, 0, 0, 1)
    assert tuple(stats.error_histogram(df, "t", "p", legacy_gap=True).first()) == (1, 1, 0, 0, 0)
    assert stats.rmse(df, "t", "p").first()["rmse"] == pytest.approx((17.25 / 3) ** 0.5)


def test_minhash_pairs(spark):
    from lodeworks.operators.similarity import lsh_candidates, signatures

    rows = spark.createDataFrame([("a", u) for u in range(3)] + [("b", u) for u in range(4)] + [("c", u) for u in (4, 5, 6)], "k string, m int")
    sig = {r["k"]: list(r)[1:] for r in signatures(rows, "k", "m").collect()}
    assert sig["a"] == [6, 0, 2, 0, 1, 2, 2, 1, 4, 2, 3, 0, 2, 2, 0, 1, 1, 3]
    assert sig["b"] == [6, 0, 2, 0, 1, 2, 2, 1, 0, 1, 2, 0, 1, 2, 0, 0, 1, 2]
    assert ("a", "b") in {tuple(r) for r in lsh_candidates(rows, "k", "m").collect()}
