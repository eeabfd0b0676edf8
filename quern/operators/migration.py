"""Moving a corpus of phrases from draft and registry lanes to standard and similar phrases, with proof that nothing is lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.tables import multiset_difference


def _own(rows: DataFrame) -> DataFrame:
    return rows.select("capability", "phrase", "kind", "position", "enabled", "lane")


def source_phrases(drafts: DataFrame, registry: DataFrame) -> DataFrame:
    """J13. All phrases of both lanes: capability, phrase, kind, position, enabled, lane. drafts: capability, kind (standard or similar; others
    are left out), position, item_id, phrase, enabled; registry: capability, standard (one phrase, or empty), similar (array or
    null), whose places are their positions."""
    w = Window.partitionBy("capability", "kind").orderBy("position", "item_id")
    d = drafts.where("kind in ('standard', 'similar')").withColumn("_rn", F.row_number().over(w)).withColumn("lane", F.lit("draft"))
    # of several draft items in one place the first is promoted, so places are made unique
    d = d.withColumn("position", (F.col("_rn") - 1).cast("int"))
    one = registry.where("standard <> ''").select("capability", F.col("standard").alias("phrase"), F.lit("standard").alias("kind"), F.lit(0).alias("position"), F.lit(True).alias("enabled"), F.lit("registry").alias("lane"))
    many = registry.select("capability", F.posexplode("similar").alias("position", "phrase")).select("capability", "phrase", F.lit("similar").alias("kind"), "position", F.lit(True).alias("enabled"), F.lit("registry").alias("lane"))
    return _own(d).unionByName(_own(one)).unionByName(_own(many))


def promoted(phrases: DataFrame, language) -> DataFrame:
    """W1/J13. phrases with target: standard phrases stay standard; the first similar phrase of a capability and lane is promoted to its
    English standard; the others are similar and belong to the standard of their language. language: a column of phrase."""
    first = (F.col("kind") == "similar") & (F.col("position") == 0)
    return phrases.withColumn("language", F.when(first, "en").otherwise(language)).withColumn("target", F.when((F.col("kind") == "standard") | first, "standard").otherwise("similar"))


def migrated(phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J13. Standard phrases (standard_id, capability, language, phrase, position) and similar ones (standard_id, phrase, position,
    enabled), joined by capability and language; ids are hashes of both. A similar phrase without a standard has a null id."""
    sid = F.substring(F.sha2(F.concat_ws("\x1f", F.col("capability").cast("string"), "language"), 256), 1, 16)
    std = phrases.where("target = 'standard'").select(sid.alias("standard_id"), "capability", "language", "phrase", "position")
    have = std.select("capability", "language", "standard_id").distinct()
    sim = phrases.where("target = 'similar'").join(have, ["capability", "language"], "left")
    return std, sim.select("standard_id", "capability", "language", "phrase", "position", "enabled")


def conservation(phrases: DataFrame, standard: DataFrame, similar: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """U3/A27. What forbids publishing, as rows rule, subject, n: phrases lost or added (multiset differences both ways), capabilities
    without exactly one standard of each language, and similar phrases without a standard. None: an empty table."""
    after = standard.select("phrase").union(similar.select("phrase"))
    before = phrases.select("phrase")
    diff = multiset_difference(before, after)
    per = standard.groupBy("capability").pivot("language", list(languages)).agg(F.count(F.lit(1)))
    per = phrases.select("capability").distinct().join(per, "capability", "left")
    wrong = [F.when(F.coalesce(F.col(f"`{x}`"), F.lit(0)) != 1, F.struct(F.lit(x).alias("l"), F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias("n"))) for x in languages]
    counts = per.select("capability", F.explode(F.array_compact(F.array(*wrong))).alias("x"))
    rows = lambda df, rule, subject, n: df.select(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))
    return (
        rows(diff.where("surplus > 0"), "lost", F.col("phrase"), F.col("surplus"))
        .union(rows(diff.where("surplus < 0"), "added", F.col("phrase"), -F.col("surplus")))
        .union(rows(counts, "standards", F.concat_ws("/", F.col("capability").cast("string"), "x.l"), F.col("x.n")))
        .union(rows(similar.where("standard_id is null").groupBy("phrase").agg(F.count("*").alias("n")), "orphan", F.col("phrase"), F.col("n")))
    )


def merged(corpus: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """J13. The corpus (keys, version, ...) after changes of the same columns but version: a row of known keys takes the change and the
    next version, one of new keys comes in as version 1, others stay. Of several changes of a key the last by all its columns counts."""
    rest = [c for c in corpus.columns if c not in (*keys, "version")]
    last = changes.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_new"))
    j = corpus.withColumn("_had", F.lit(True)).join(last, keys, "full_outer")
    version = F.when(F.col("_new").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
    return j.select(*keys, *[F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.col(f"_new.{c}")).alias(c) for c in rest], version.cast("int").alias("version"))
