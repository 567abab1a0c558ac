"""Collaborative filtering (survey J8-J15, D2, D3, D5-D7, D11, D12, E13-E17, F2, F3).

Ratings are long tables (user, item, rating), one row for each pair; ``test`` has
the pairs to predict. Neighbours are found by joins on the shared key, and only
the similarities that a prediction needs are computed, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.scalar import clip, rounded, zero_default
from lodeworks.functions.stats import mean_without, pearson, weighted
from lodeworks.operators import neighbours
from lodeworks.operators.neighbours import moves
from lodeworks.plans.stages import Scratch, broadcast_if_small

#: Largest table of needed pairs, in bytes, that is sent to all executors; a larger one is joined by shuffle.
BROADCAST_BYTES = 16 << 20


def known_only(test: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows whose user and whose item occur in training."""
    return test.join(train.select("user").distinct(), "user", "left_semi").join(train.select("item").distinct(), "item", "left_semi")


def similarities(train: DataFrame, of: str, over: str) -> DataFrame:
    """(a, b, sim): Pearson of every ordered pair of different ``of`` that have an ``over`` in common."""
    return neighbours.similarities(train, of, over)


def needed_similarities(train: DataFrame, of: str, over: str, needed: DataFrame) -> DataFrame:
    """(a, b, sim) as :func:`similarities`, of the pairs (a, b) in ``needed`` only, each in both orders; those with nothing in common are left out.

    Either the pairs that meet under an ``over`` are reduced to the needed ones before they are aggregated, or the
    needed pairs fetch the ratings of the one of the two that has fewer, and of the other only those that match.
    Both costs are counted in rows first and the lesser one is paid: a popular item with a million raters, which
    alone makes 10**12 pairs, then costs its ratings times the pairs that need it.
    """
    scratch = Scratch(train.sparkSession, "similarities")
    half = needed.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sizes = train.groupBy(of).agg(F.count(F.lit(1)).alias("n"))
    size = lambda s: sizes.select(F.col(of).alias(s), F.col("n").alias(f"n_{s}"))
    half = scratch.write(half.join(size("a"), "a").join(size("b"), "b"), "needed")
    by_pair = half.agg(F.sum(F.least("n_a", "n_b")).alias("n")).first()["n"] or 0
    by_key = train.groupBy(over).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("n")).first()["n"] or 0
    n, found = half.count(), sizes.count()
    side = lambda s, of_s: train.select(F.col(of).alias(of_s), over, F.col("rating").alias(f"r_{s}"))
    if by_pair < by_key:
        few = F.when(F.col("n_a") <= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("few")
        many = F.when(F.col("n_a") <= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("many")
        met = half.select("a", "b", few, many).join(side("a", "few").hint("merge"), "few").join(side("b", "many").hint("merge"), ["many", over])
    else:
        met = side("a", "a").join(side("b", "b"), over).where("a < b")
        if 4 * n < found * (found - 1):  # of more than half of all pairs, reducing saves less than it costs
            met = met.join(broadcast_if_small(scratch, half.select("a", "b"), "needed", BROADCAST_BYTES), ["a", "b"], "left_semi")
    found = met.groupBy("a", "b").agg(pearson("r_a", "r_b").alias("sim"))
    return found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def means(train: DataFrame, of: str, name: str) -> DataFrame:
    """(of, name): mean rating."""
    return train.groupBy(of).agg(F.avg("rating").alias(name))


def _drawn_neighbours(test: DataFrame, train: DataFrame, sample: int, seed: int) -> DataFrame:
    """(user, item, other, off, times, sim): raters of a test pair's item among the users drawn for it, how often each was drawn, how far it is off its own mean without it, and its similarity.

    Draws outnumber the tests they are made from, which a plan's estimate does not see: they are written, so that joins
    know their size, and only those that are raters go on. What grows with the ratings is joined by shuffle whatever its
    files' size: on the driver a broadcast takes many times that.
    """
    from lodeworks.operators.counts import ordinals

    scratch = Scratch(train.sparkSession, "pairs")
    codes = scratch.write(ordinals(train, "user", "code"), "codes")
    n = codes.count()
    asked = test.select("user", "item").distinct().repartition(2 * train.sparkSession.sparkContext.defaultParallelism, "user", "item")
    drawn = asked.select("user", "item", F.explode(F.sequence(F.lit(1), F.lit(sample))).alias("k"))
    digits = F.substring(F.md5(F.concat_ws("/", F.col("user").cast("string"), F.col("item").cast("string"), F.col("k").cast("string"), F.lit(str(seed)))), 1, 15)
    drawn = scratch.write(drawn.select("user", "item", (F.conv(digits, 16, 10).cast("long") % n).alias("code")), "drawn")
    own = train.groupBy("user").agg(F.sum("rating").alias("total"), F.count(F.lit(1)).alias("n"))
    off = F.coalesce(F.col("rating") - mean_without(F.col("total"), F.col("n"), F.col("rating")), F.lit(0.0))
    raters = train.join(own.hint("merge"), "user").join(codes.hint("merge"), "user").select(F.col("user").alias("other"), "item", "code", off.alias("off"))
    pairs = drawn.join(raters.hint("merge"), ["item", "code"]).where("user <> other")
    pairs = scratch.write(pairs.groupBy("user", "item", "other", "off").agg(F.count(F.lit(1)).alias("times")), "pairs")
    needed = pairs.select(F.col("user").alias("a"), F.col("other").alias("b"))
    sims = needed_similarities(train, "user", "item", needed).select(F.col("a").alias("user"), F.col("b").alias("other"), "sim")
    return pairs.join(sims.hint("merge"), ["user", "other"], "left").select(*pairs.columns, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def _rated(test: DataFrame, train: DataFrame) -> DataFrame:
    """(user, item, other, rating): what a test pair's user rated besides the item."""
    rated = train.select("user", F.col("item").alias("other"), "rating")
    return test.select("user", "item").distinct().join(rated, "user").where("item <> other")


def _with_similarity(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """``pairs`` (item, other, ...) and the similarity of both, 0 without a common rater."""
    pairs = Scratch(train.sparkSession, "pairs").write(pairs, "pairs")
    needed = pairs.select(F.col("item").alias("a"), F.col("other").alias("b"))
    sims = needed_similarities(train, "item", "user", needed).select(F.col("a").alias("item"), F.col("b").alias("other"), "sim")
    return pairs.join(sims, ["item", "other"], "left").select(*pairs.columns, F.coalesce("sim", F.lit(0.0)).alias("sim"))


def _first(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k neighbours of each pair."""
    place = F.row_number().over(Window.partitionBy("user", "item").orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _centred(test: DataFrame, train: DataFrame, moved: DataFrame) -> DataFrame:
    """User mean plus the weighted deviation of neighbours (user, item, move), in bounds."""
    out = test.select("user", "item").distinct().join(means(train, "user", "mean").hint("merge"), "user").join(moved.hint("merge"), ["user", "item"], "left")
    return out.select("user", "item", clip(F.col("mean") + F.coalesce("move", F.lit(0.0))).alias("prediction"))


def user_cf(test: DataFrame, train: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """User-based prediction from all raters of the item.

    ``sample`` draws that many users, with replacement, for each test pair instead; a draw that did not
    rate the item is void, one drawn twice counts twice. Draws follow from the seed and the pair alone.
    """
    test = known_only(test, train)
    if sample is not None:
        near = _drawn_neighbours(test, train, sample, seed).withColumn("off", F.col("off") * F.col("times"))
        weight = F.sum(F.abs("sim") * F.col("times"))
        moved = near.groupBy("user", "item").agg(F.coalesce(F.try_divide(F.sum(F.col("off") * F.col("sim")), weight), F.lit(0.0)).alias("move"))
        return _centred(test, train, moved)
    return _centred(test, train, moves(test, train))


def item_cf_first(test: DataFrame, train: DataFrame, k: int = 20) -> DataFrame:
    """Item-based prediction from the first k items, in order of id, that the user rated."""
    test = known_only(test, train)
    near = _with_similarity(_first(_rated(test, train), k, F.col("other")), train)
    score = near.groupBy("user", "item").agg(weighted(F.col("rating"), F.col("sim")).alias("score"))
    out = test.select("user", "item").distinct().join(score, ["user", "item"], "left")
    return out.select("user", "item", clip(zero_default(F.coalesce("score", F.lit(0.0)))).alias("prediction"))


def item_cf_lsh(test: DataFrame, train: DataFrame) -> DataFrame:
    """Item-based prediction from all items that share a MinHash band with the item; an item without any has its mean."""
    from lodeworks.operators.similarity import lsh_candidates

    test = Scratch(train.sparkSession, "test").write(known_only(test, train), "test")
    half = lsh_candidates(train.select("item", "user").distinct(), "item", "user")
    linked = half.union(half.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("item"), F.col("b").alias("other"))
    linked = Scratch(train.sparkSession, "linked").write(linked, "linked")
    near = _with_similarity(_rated(test, train).join(linked, ["item", "other"], "left_semi"), train)
    score = near.groupBy("user", "item").agg(weighted(F.col("rating"), F.col("sim")).alias("score"))
    alone = test.select("user", "item").distinct().join(linked.select("item").distinct().withColumn("linked", F.lit(True)), "item", "left")
    out = alone.join(score, ["user", "item"], "left").join(means(train, "item", "mean"), "item")
    raw = F.when(F.col("linked"), F.coalesce("score", F.lit(0.0))).otherwise(F.col("mean"))
    return out.select("user", "item", clip(zero_default(raw)).alias("prediction"))


def ranked_neighbours(train: DataFrame) -> DataFrame:
    """(item, other, sim): items that share a MinHash band, with their Pearson similarity, each item's most similar ones first."""
    from lodeworks.operators.similarity import lsh_candidates

    half = lsh_candidates(train.select("item", "user").distinct(), "item", "user").select(F.col("a").alias("item"), F.col("b").alias("other"))
    both = half.union(half.select(F.col("other").alias("item"), F.col("item").alias("other")))
    return _with_similarity(both, train).orderBy("item", F.desc("sim"), "other")


def user_cf_top(test: DataFrame, train: DataFrame, item_profile: DataFrame, k: int = 10) -> DataFrame:
    """User-based prediction from the k most similar raters of the item; a user without ratings gets the item's profile mean.

    ``item_profile``: (item, item_mean). Ties in similarity go to the smaller user.
    """
    pairs = test.select("user", "item").distinct()
    moved = moves(pairs, train, k)
    out = pairs.join(means(train, "user", "mean"), "user", "left").join(moved, ["user", "item"], "left").join(item_profile, "item", "left")
    raw = F.when(F.coalesce("mean", F.lit(0.0)) == 0, F.col("item_mean")).otherwise(F.col("mean") + F.coalesce("move", F.lit(0.0)))
    return out.select("user", "item", clip(raw).alias("prediction"))


def item_cf_top(test: DataFrame, train: DataFrame, user_profile: DataFrame, k: int = 10) -> DataFrame:
    """Item-based prediction from the k most similar items that the user rated; else the user's profile mean.

    ``user_profile``: (user, user_mean). Ties in similarity go to the smaller item.
    """
    pairs = test.select("user", "item").distinct()
    score = moves(pairs, train, k, of="item", over="user", own_value=True).withColumnRenamed("move", "score")
    out = pairs.join(score, ["user", "item"], "left").join(user_profile, "user", "left")
    raw = F.when(F.coalesce("score", F.lit(0.0)) == 0, F.col("user_mean")).otherwise(F.col("score"))
    return out.select("user", "item", clip(raw).alias("prediction"))


def oracle_blend(truth: Column, first: Column, second: Column) -> Column:
    """Whichever of two estimates is nearer the truth, the first on ties (J12). It reads the label: for comparisons only."""
    return F.when(F.abs(truth - first) > F.abs(truth - second), second).otherwise(first)


def hybrid(test: DataFrame, train: DataFrame, user_profile: DataFrame, item_profile: DataFrame, k: int = 10, oracle: bool = False, digits: int | None = None) -> DataFrame:
    """(user, item, rating, prediction) of each test row.

    The mean of both profile means; where these differ by more than 0.5, the mean of the two filters if they
    agree within 1, else the mean of the profiles again. ``oracle`` takes the estimate nearest the label there.
    With ``digits``, the filters' estimates are rounded to so many places before they are compared and blended.
    """
    p = [user_cf_top(test, train, item_profile, k).withColumnRenamed("prediction", "p0"), item_cf_top(test, train, user_profile, k).withColumnRenamed("prediction", "p1")]
    rows = test.join(p[0], ["user", "item"]).join(p[1], ["user", "item"])
    rows = rows.join(user_profile.withColumnRenamed("user_mean", "p2"), "user", "left").join(item_profile.withColumnRenamed("item_mean", "p3"), "item", "left")
    c = [F.col(f"p{j}") if digits is None or j > 1 else rounded(F.col(f"p{j}"), digits) for j in range(4)]
    middle = (c[2] + c[3]) / 2
    if oracle:
        off = [F.abs(x - F.col("rating")) for x in c]
        nearest = F.when(off[0] == F.least(*off), c[0]).when(off[1] == F.least(*off), c[1]).when(off[2] == F.least(*off), c[2]).otherwise(c[3])
    else:
        nearest = middle
    apart = F.when(F.abs(c[0] - c[1]) < 1.0, (c[0] + c[1]) / 2).otherwise(nearest)
    return rows.select("user", "item", "rating", F.when(F.abs(c[2] - c[3]) > 0.5, apart).otherwise(middle).alias("prediction"))


def als(test: DataFrame, train: DataFrame, rank: int = 2, rounds: int = 5, ridge: float = 0.01, seed: int = 7) -> DataFrame:
    """(user, item, prediction) by alternating least squares over ordinals of users and items, in bounds."""
    from pyspark.ml.recommendation import ALS

    from lodeworks.operators.counts import ordinals

    test = known_only(test, train)
    u, i = ordinals(train, "user", "u"), ordinals(train, "item", "i")
    coded = train.join(u, "user").join(i, "item").select(F.col("u").cast("int"), F.col("i").cast("int"), F.col("rating").cast("float"))
    model = ALS(rank=rank, maxIter=rounds, regParam=ridge, seed=seed, userCol="u", itemCol="i", ratingCol="rating", coldStartStrategy="drop").fit(coded)
    asked = test.select("user", "item").distinct().join(u, "user").join(i, "item").select("user", "item", F.col("u").cast("int"), F.col("i").cast("int"))
    return model.transform(asked).select("user", "item", clip(F.col("prediction").cast("double")).alias("prediction"))
