"""11. Importance resampling towards a target distribution.

Identical texts are collapsed first: rows are grouped by their full text, which combines copies before the shuffle, and a
text's words, buckets and counts are computed once. Bucket counts of the corpus weigh each text by its number of copies. A
bucket's gain is the logarithm of how much likelier it is in the target than in the corpus; a text's weight is the floored
mean of its features' gains. Weights then go back to the documents by a join on the texts' sha-256, and only then comes the
document's own noise (Gumbel noise from a hash of the seed and the id), so copies get one weight and different scores.

The highest scores are drawn without sorting the table: scores are whole numbers within a range that the parameters bound, so
the driver reads how many documents have each score, and a rank is that score's offset plus a row number among its equals.
Noise spreads equal weights over thousands of scores, so no score holds more than a two-thousandth of the rows of distinct
ids, however the texts repeat.

All steps are column expressions. Null and empty texts have no features and weight 0; they count towards neither the corpus nor
the draw. A null id has the noise of an empty id. Repeated ids are rows of their own; equal rows take successive ranks. An
empty target or corpus has only the smoothing. Other columns are passed over, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import saved

#: What stands between words: ASCII characters other than digits and letters. Words are read from lower-cased text.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10000
SEED = 2024
#: One part of a score in thousandths of a natural logarithm.
SCALE = 1000


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased, in order; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def features_of(words: Column, longest: int = 1) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space, repeats kept."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    runs = words
    for n in range(2, longest + 1):
        runs = F.concat(runs, of(n))
    return runs


def bucketed(texts: DataFrame, copies: Column, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """digest, copies, n_words and the bucket of every feature of each row of texts (text)."""
    words = texts.select(F.sha2("text", 256).alias("digest"), copies.cast("long").alias("copies"), words_of(F.col("text")).alias("words"))
    at = F.transform(features_of(F.col("words"), longest), lambda x: F.pmod(F.crc32(x), F.lit(buckets)).cast("int"))
    return words.select("digest", "copies", F.size("words").cast("long").alias("n_words"), at.alias("at"))


def bucket_counts(rows: DataFrame) -> dict[int, int]:
    """How many features lie in each bucket; at most as many rows reach the driver as there are buckets."""
    long = rows.select("copies", F.explode("at").alias("bucket"))
    return {r["bucket"]: r["n"] for r in long.groupBy("bucket").agg(F.sum("copies").alias("n")).collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Per bucket floor(1000 * ln((t+1)(S+buckets) / ((s+1)(T+buckets)))), smoothed by one feature a bucket."""
    s_all, t_all = sum(corpus.values()), sum(target.values())
    return [math.floor(SCALE * math.log((target.get(b, 0) + 1) * (s_all + buckets) / ((corpus.get(b, 0) + 1) * (t_all + buckets)))) for b in range(buckets)]


def weights(rows: DataFrame, gain: list[int]) -> DataFrame:
    """digest, n_words, n_features and weight of rows of bucketed()."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<int>")  # folded to one literal
    total = F.aggregate("at", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    sums = rows.select("digest", "n_words", F.size("at").cast("long").alias("n_features"), total.alias("total"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) div n_features END")
    return sums.select("digest", "n_words", "n_features", mean.alias("weight"))


def weighted(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document towards the target's texts."""
    texts = docs.groupBy("text").agg(F.count("*").alias("copies"))
    rows = saved(bucketed(texts, F.col("copies"), longest, buckets), "text-buckets", "zstd")
    gain = gains(bucket_counts(rows), bucket_counts(bucketed(target, F.lit(1), longest, buckets)), buckets)
    once = weights(rows.where("digest is not null"), gain)
    ids = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_words", "n_features", "weight")]
    return ids.join(once, "digest", "left").select("doc_id", *zero)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of a document, floored to a whole number of thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, ... for the `percent` highest scores of the documents of at least
    least_words words, ties to the smaller id; null for the others."""
    spark = scored.sparkSession
    may = F.col("n_words") >= least_words
    per_score = sorted(scored.where(may).groupBy("score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["score"])
    left = sum(r["n"] for r in per_score) * percent // 100
    offsets, before = [], 0
    for r in per_score:
        if before >= left:
            break
        offsets.append((r["score"], before))
        before += r["n"]
    if not offsets:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    # as many rows as scores differ, which the gains and the noise bound to some tens of thousands
    offsets = F.broadcast(spark.createDataFrame(offsets, "score long, before long"))
    taken = scored.where(may).join(offsets, "score")
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    taken = taken.withColumn("rank", F.col("before") + place).withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    rest = scored.join(offsets, (scored["score"] == offsets["score"]) & may, "left_anti")
    return taken.select(*scored.columns, "rank").union(rest.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document of docs (doc_id, text), drawn towards the texts of
    target (text)."""
    rows = weighted(docs, target, longest, buckets)
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(saved(scored, "scores"), percent, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document, drawn towards the benchmark."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resampled(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_BYTE = "('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT"

#: DuckDB: words by SQL, crc32 of each different word bit by bit, everything else as the contract says.
SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
     dw AS (SELECT doc_id, unnest(words) AS word FROM d),
     bw AS (SELECT unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS word FROM benchmark),
     tbl AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(k, [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS k))),
     crc AS (SELECT word, xor(list_reduce(list_prepend(4294967295, [{_BYTE} FOR i IN range(1, strlen(word) + 1)]), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % {BUCKETS} AS bucket
             FROM (SELECT word FROM dw UNION SELECT word FROM bw), tbl),
     s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
     t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
     gain AS (SELECT bucket, floor({SCALE} * ln((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
     w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS total FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
     sc AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (total - ((total % n) + n) % n) // n END AS weight,
                   ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
            FROM d LEFT JOIN w USING (doc_id)),
     e AS (SELECT doc_id, n_features, weight, weight + floor(-{SCALE}.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM sc),
     r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * 10 // 100 THEN rank END AS rank
FROM e LEFT JOIN r USING (doc_id)
"""
