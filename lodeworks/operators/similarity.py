"""Set similarity: exact Jaccard join and MinHash with bands (survey J6, J7, D8, D9, D13, E18, H1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.scalar import HASH_PAIRS
from lodeworks.operators.counts import ordinals
from lodeworks.plans.stages import Scratch

#: Members of the largest set, at most, for sets to be sent along with each of their bands.
CARRIED = 256


def overlaps(rows: DataFrame, key: str, member: str, least: int = 1) -> DataFrame:
    """(a, b, common) with a < b: pairs of keys that share at least ``least`` members, by inverted index (D8). Needs least >= 1."""
    if least < 1:
        raise ValueError("pairs without a common member are not listed")
    rows = rows.select(F.col(key).alias("_k"), F.col(member).alias("_m")).distinct()
    left, right = rows.select(F.col("_k").alias("a"), "_m"), rows.select(F.col("_k").alias("b"), "_m")
    pairs = left.join(right, "_m").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return pairs.where(F.col("common") >= least)


def with_jaccard(pairs: DataFrame, rows: DataFrame, key: str, member: str) -> DataFrame:
    """(a, b, jaccard) from pairs with their number of common members."""
    sizes = rows.groupBy(key).agg(F.countDistinct(member).alias("n"))
    of = lambda s: sizes.select(F.col(key).alias(s), F.col("n").alias(f"n_{s}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", (F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common"))).alias("jaccard"))


def exact_jaccard(rows: DataFrame, key: str, member: str, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of all pairs at or over ``least``."""
    return with_jaccard(overlaps(rows, key, member), rows, key, member).where(F.col("jaccard") >= least)


def signatures(rows: DataFrame, key: str, member: str, pairs=tuple(HASH_PAIRS)) -> DataFrame:
    """(key, s0, s1, ...): the smallest ``(a * ordinal + b) % m`` of a key's members for each pair; m members in all.

    The minima are aggregates, combined in each task before the shuffle.
    """
    scratch = Scratch(rows.sparkSession, "minhash")
    codes = scratch.write(ordinals(rows, member, "_o"), "codes")
    m = max(1, codes.count())
    coded = rows.join(codes, member)
    mins = [F.min((F.lit(a).cast("long") * F.col("_o") + b) % m).alias(f"s{k}") for k, (a, b) in enumerate(pairs)]
    return coded.groupBy(key).agg(*mins)


def lsh_candidates(rows: DataFrame, key: str, member: str, bands: int = 9, pairs=tuple(HASH_PAIRS)) -> DataFrame:
    """(a, b) with a < b: different pairs of keys that agree in all rows of a band."""
    per = len(pairs) // bands
    sig = signatures(rows, key, member, pairs)
    cut = F.array(*[F.struct(F.lit(k).alias("band"), *[F.col(f"s{k * per + r}").alias(f"r{r}") for r in range(per)]) for k in range(bands)])
    keyed = sig.select(F.col(key).alias("_k"), F.explode(cut).alias("x")).select("_k", "x.*")
    keyed = Scratch(rows.sparkSession, "bands").write(keyed, "keyed")
    on = ["band", *[f"r{r}" for r in range(per)]]
    return keyed.withColumnRenamed("_k", "a").join(keyed.withColumnRenamed("_k", "b"), on).where("a < b").select("a", "b").distinct()


def _band_pairs(rows: DataFrame, key: str, member: str, least: float, scratch: Scratch, bands: int = 9, pairs=tuple(HASH_PAIRS)) -> DataFrame:
    """(a, b, jaccard) of ``lsh_candidates`` at or over ``least``; sets go along with the bands' keys, so that candidates are neither shuffled nor written.

    Bands are joined one by one: together, their keys would not fit the tasks that sort them.
    """
    codes = scratch.write(ordinals(rows, member, "_o"), "codes")
    m, per = max(1, codes.count()), len(pairs) // bands
    kind = "int" if m < 1 << 31 else "long"
    coded = rows.join(codes, member).select(F.col(key).alias("k"), F.col("_o").cast(kind)).repartition("k")
    sets = coded.groupBy("k").agg(F.collect_list("_o").alias("members"))

    def smallest(a, b):
        return F.array_min(F.transform("members", lambda o: (F.lit(a).cast("long") * o + b) % m))

    sets = scratch.write(sets.select("k", "members", *[smallest(*pairs[j]).alias(f"s{j}") for j in range(per * bands)]), "sets")
    found = []
    for band in range(bands):
        on = [f"s{band * per + r}" for r in range(per)]
        side = lambda s, on=on: sets.select(F.col("k").alias(s), F.col("members").alias(f"m_{s}"), *on)
        n_a, n_b = F.size("m_a"), F.size("m_b")
        near = F.least(n_a, n_b) >= (least - 1e-9) * F.greatest(n_a, n_b)
        met = side("a").join(side("b").hint("merge"), on).where(F.col("a") < F.col("b")).where(near)
        common = F.size(F.array_intersect("m_a", "m_b"))
        met = met.select("a", "b", (common / (n_a + n_b - common)).alias("jaccard")).where(F.col("jaccard") >= least)
        found.append(scratch.write(met, f"band{band}"))
    return reduce(DataFrame.union, found).distinct()


def lsh_jaccard(rows: DataFrame, key: str, member: str, least: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of the candidates at or over ``least``, verified on the whole sets.

    Sets of at most ``CARRIED`` members go along with their bands; if there is a larger one, the candidates fetch the members.
    """
    scratch = Scratch(rows.sparkSession, "lsh")
    rows = scratch.write(rows.select(key, member).distinct(), "rows")
    if (rows.groupBy(key).agg(F.count(member).alias("n")).agg(F.max("n")).first()[0] or 0) <= CARRIED:
        return _band_pairs(rows, key, member, least, scratch)
    candidates = scratch.write(lsh_candidates(rows, key, member), "candidates")
    left = rows.select(F.col(key).alias("a"), F.col(member).alias("_m"))
    right = rows.select(F.col(key).alias("b"), F.col(member).alias("_m"))
    common = candidates.join(left, "a").join(right, ["b", "_m"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    return with_jaccard(common, rows, key, member).where(F.col("jaccard") >= least)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (n_found, n_truth, n_common, precision, recall) of two tables of pairs (a, b)."""
    f = found.select("a", "b", F.lit(1).alias("f"))
    t = truth.select("a", "b", F.lit(1).alias("t"))
    n_f, n_t, n_c = F.count("f"), F.count("t"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull())
    return f.join(t, ["a", "b"], "full_outer").agg(
        n_f.alias("n_found"), n_t.alias("n_truth"), n_c.alias("n_common"), F.try_divide(n_c, n_f).alias("precision"), F.try_divide(n_c, n_t).alias("recall")
    )
