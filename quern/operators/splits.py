"""Splits by whole families that meet the targets of many strata at once: a greedy search in rounds of bids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.curation import checkpointed

#: Splits in the order in which a tie falls to them.
SPLITS = ("val", "test", "train")
#: Hash prefixes by which bids of a stratum are put in order before single bids are.
PREFIXES = 4096


def targets(n: Column, val: float = 0.05, test: float = 0.20) -> Column:
    """K13. struct(val, test, train) of a stratum of n rows: shares rounded half up, at least one of each from three rows on,
    train and test of two rows, train of one."""
    half_up = lambda share: F.greatest(F.lit(1), F.floor(n * share + F.lit(0.5))).cast("long")
    v = F.when(n >= 3, half_up(val)).otherwise(0).cast("long")
    t = F.when(n >= 3, half_up(test)).when(n == 2, 1).otherwise(0).cast("long")
    return F.struct(v.alias("val"), t.alias("test"), (n - v - t).cast("long").alias("train"))


def stratum_targets(members: DataFrame) -> DataFrame:
    """K13. members (stratum, n): stratum, split, target, one row for each split."""
    sums = members.groupBy("stratum").agg(F.sum("n").cast("long").alias("_n")).withColumn("_t", targets(F.col("_n")))
    return sums.select("stratum", F.explode(F.array(*[F.struct(F.lit(s).alias("split"), F.col(f"_t.{s}").alias("target")) for s in SPLITS])).alias("x")).select("stratum", "x.split", "x.target")


def _bids(left: DataFrame, state: DataFrame) -> DataFrame:
    """The split that adds least to the squared deviations, for each family that is left: family, split. A row above a target
    costs ten and twice the excess more."""
    after = F.col("assigned") + F.col("n")
    over = F.greatest(after - F.col("target"), F.lit(0))
    cost = (after - F.col("target")) ** 2 - (F.col("assigned") - F.col("target")) ** 2 + F.when(over > 0, 10 + 2 * over).otherwise(0)
    costs = left.join(state, "stratum").groupBy("family", "split").agg(F.sum(cost).alias("cost"))
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(SPLITS) for x in (s, i)])
    return costs.groupBy("family").agg(F.min(F.struct("cost", rank[F.col("split")].alias("rank"), "split")).alias("x")).select("family", F.col("x.split").alias("split"))


def _accepted(bids: DataFrame, state: DataFrame) -> DataFrame:
    """Families whose bids all of their strata accept: in the order of size and hash, up to the gap of each split, and the first
    bid always. bids: family, split, stratum, n, place (size class and hash prefix), h.

    Whole places before the gap's end are accepted by running sums over places; only at the place where it ends single bids are
    put in order.
    """
    key = ["stratum", "split"]
    places = bids.groupBy(*key, "place").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*key).orderBy("place")
    places = places.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("first", F.row_number().over(w) == 1)
    places = places.join(state.select(*key, (F.col("target") - F.col("assigned")).alias("gap")), key)
    places = places.where("first or before < gap").select(*key, "place", "before", "gap", "first", (F.col("before") + F.col("n") <= F.col("gap")).alias("whole"))
    x = bids.join(places, [*key, "place"], "left")
    w = Window.partitionBy(*key, "place").orderBy("h", "family")
    edge = x.where("not whole").withColumn("upto", F.sum("n").over(w)).withColumn("k", F.row_number().over(w))
    edge = edge.where((F.col("before") + F.col("upto") <= F.col("gap")) | (F.col("first") & (F.col("k") == 1)))
    good = x.where("whole").select("family", "stratum").union(edge.select("family", "stratum"))
    need = bids.groupBy("family", "split").agg(F.count("*").alias("need"))
    got = good.groupBy("family").agg(F.count("*").alias("got"))
    return need.join(got, "family").where("need = got").select("family", "split")


def family_splits(members: DataFrame, seed: str) -> tuple[DataFrame, DataFrame]:
    """K24. A split for every family, so that each stratum's rows come near its targets (K13), families never divided.

    members: family, stratum, n (rows of the family in the stratum). Gives (family, split) and (stratum, split, target, assigned).
    In each round every family left bids for the split that raises the sum of squared deviations least, and strata accept bids,
    large families first, until the split's gap is filled; a family goes where all of its strata accept it. The first family of the order is
    always accepted, so rounds come to an end: a few for families of one stratum, as most are; families of several follow in
    more. No window holds a stratum's rows, only its places, which size classes and PREFIXES bound, and the bids of one place.
    """
    members = members.groupBy("family", "stratum").agg(F.sum("n").cast("long").alias("n")).where("n > 0")
    size = members.groupBy("family").agg(F.sum("n").alias("size")).withColumn("h", F.sha2(F.concat_ws("|", F.lit(seed), F.col("family").cast("string")), 256))
    place = F.struct((-F.floor(F.log2("size"))).cast("int").alias("c"), F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(PREFIXES)).cast("int").alias("p"))
    members = checkpointed(members.join(size.select("family", "h", place.alias("place")), "family"))
    state = checkpointed(stratum_targets(members).withColumn("assigned", F.lit(0).cast("long")))
    left, done = members, None
    while not left.isEmpty():
        bids = checkpointed(left.join(_bids(left, state), "family"))
        took = checkpointed(_accepted(bids, state))
        more = members.join(took, "family").groupBy("stratum", "split").agg(F.sum("n").alias("_more"))
        state = checkpointed(state.join(more, ["stratum", "split"], "left").withColumn("assigned", F.col("assigned") + F.coalesce("_more", F.lit(0))).drop("_more"))
        done = took if done is None else done.union(took)
        left = checkpointed(left.join(took, "family", "left_anti"))
    if done is None:
        done = members.select("family", F.lit("").alias("split"))
    return done, state
