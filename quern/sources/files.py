"""Readers and writers of the files that a corpus arrives in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.functions.text import stripped


def jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """S17. JSON lines under a schema; a line that does not fit it stops the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """S17. Rows as JSON lines, UTF-8, one object a line; nulls are kept as nulls, so what is read back has every key."""
    rows.write.option("ignoreNullFields", "false").option("encoding", "UTF-8").json(path)


def plain_text(spark: SparkSession, path: str) -> DataFrame:
    """S2, S9. Whole files as path, text: UTF-8 without its mark, else Latin-1; control characters stripped."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, F.decode("content", "ISO-8859-1"))
    return raw.select("path", F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "").alias("text"))


def extracted(files: DataFrame) -> DataFrame:
    """S3. Files (path, content) by their extension: path, text, error. Texts, subtitles, logs and pages are decoded; another
    extension is an error of its row and stops nothing."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    utf8 = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    text = F.regexp_replace(F.regexp_replace(utf8, "^\ufeff", ""), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    plain = ext.isin("txt", "md", "csv", "json", "jsonl", "log", "srt", "vtt", "lrc")
    page = ext.isin("html", "htm")
    return files.select("path", F.when(plain, text).when(page, stripped(text)).alias("text"), F.when(~(plain | page), F.concat(F.lit("no extractor for ."), ext)).alias("error"))


def rss_items(feeds: DataFrame) -> DataFrame:
    """S18. Feeds (id, xml) as items: id, pos, title, link, description. Sections of character data are written out as escaped text
    first, so what stands in one opens or closes no item."""
    parts = F.split("xml", r"<!\[CDATA\[")
    shut = lambda p: F.position(F.lit("]]>"), p)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = F.array_join(F.transform(parts, lambda p, i: F.when((i == 0) | (shut(p) == 0), p).otherwise(F.concat(escaped(F.substring(p, F.lit(1), shut(p) - 1)), F.substring(p, shut(p) + 3, F.length(p))))), "")
    items = F.regexp_extract_all(plain, F.lit(r"(?s)<item(?: [^>]*)?>.*?</item>"), F.lit(0))
    f = feeds.select("id", F.posexplode(items).alias("pos", "x"))
    return f.select("id", "pos", *[F.expr(f"xpath_string(x, 'item/{tag}')").alias(tag) for tag in ("title", "link", "description")])


def log_tail(files: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """S22. The lines (file, pos, line) of the last `limit` bytes of files (path, content); a line that the cut goes through is left
    out."""
    cut = F.octet_length("content") > limit
    tail = F.decode(F.expr(f"if(octet_length(content) > {limit}, right_bytes, content)"), "ISO-8859-1")
    f = files.withColumn("right_bytes", F.expr(f"substring(content, greatest(octet_length(content) - {limit}, 0) + 1)")).select("path", cut.alias("cut"), tail.alias("t"))
    f = f.select("path", F.when(F.col("cut"), F.regexp_replace("t", r"^[^\n]*\n", "")).otherwise(F.col("t")).alias("t"))
    return f.select(F.col("path").alias("file"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))


def terms(lines: DataFrame) -> DataFrame:
    """S16. Lines (line) word[,definition[,freq[,star]]]; numbers that are not all digits count as 1, lines without a word go."""
    p = F.split("line", ",")
    at = lambda i: F.trim(F.coalesce(F.get(p, i), F.lit("")))
    num = lambda i: F.when(at(i).rlike("^[0-9]{1,9}$"), at(i).cast("int")).otherwise(1)
    return lines.select(at(0).alias("word"), at(1).alias("definition"), num(2).alias("freq"), num(3).alias("star")).where("word <> ''")


def log_entries(lines: DataFrame, levels: list[str]) -> DataFrame:
    """S22. Log lines (file, pos, line) as entries of the wanted levels: a line that begins with four digits opens an entry, the
    lines after it (stack traces) belong to it."""
    opens = F.col("line").rlike("^[0-9]{4}")
    n = F.sum(opens.cast("int")).over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    e = lines.withColumn("entry", n).where("entry > 0").groupBy("file", "entry").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return e.where(F.split("text", "\n")[0].rlike(r"\b(?:" + "|".join(levels) + r")\b"))
