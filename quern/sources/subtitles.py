"""Subtitle files (id, text) as cues (id, index, start_ms, end_ms, text). Cues without text are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ms(h: Column, m: Column, s: Column, frac: Column) -> Column:
    n = lambda c: F.coalesce(F.try_to_number(F.when(c != "", c), F.lit("999999")).cast("long"), F.lit(0))
    return ((n(h) * 60 + n(m)) * 60 + n(s)) * 1000 + n(F.rpad(frac, 3, "0"))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _blocks(files: DataFrame) -> DataFrame:
    t = F.regexp_replace("text", r"\r\n?", "\n")
    return files.select("id", F.posexplode(F.split(t, r"\n[ \t]*\n+")).alias("block", "b"))


def without_tags(text: Column) -> Column:
    """F16. The text of a WebVTT line: inline times, classes, voices and plain lower-case tags go, \\N and \\n are spaces, \\h nothing."""
    t = F.regexp_replace(text, r"<\d+:\d{2}:\d{2}\.\d{1,3}>|</?[cv](?:\.\w+)*>|</?[a-z]+>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\\[Nn]", " "), r"\\h", ""), " {2,}", " "))


def _spoken(block: Column) -> Column:
    """S11. The lines of a cue block that are text: not its time line, and none that begins with NOTE, STYLE or REGION."""
    lines = F.transform(F.split(block, "\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~F.contains(x, F.lit("-->")) & ~x.rlike("^(NOTE|STYLE|REGION)"))
    return F.array_join(F.filter(F.transform(kept, without_tags), lambda x: x != ""), " ")


def _cues(files: DataFrame, strip_tags: bool) -> DataFrame:
    time = r"(?:(\d{1,3}):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"
    line = rf"(?s){time}[ \t]*-->[ \t]*{time}[^\n]*(?:\n(.*))?$"
    g = lambda i: F.regexp_extract("b", line, i)
    text = _spoken(F.col("b")) if strip_tags else g(9)
    c = _blocks(files).where(F.col("b").rlike(line)).select("id", "block", _ms(g(1), g(2), g(3), g(4)).alias("start_ms"), _ms(g(5), g(6), g(7), g(8)).alias("end_ms"), _flat(text).alias("text")).where("text <> ''")
    return c.withColumn("index", F.row_number().over(Window.partitionBy("id").orderBy("block"))).select("id", "index", "start_ms", "end_ms", "text")


def srt(files: DataFrame) -> DataFrame:
    """S10."""
    return _cues(files, False)


def vtt(files: DataFrame) -> DataFrame:
    """S11, F16. The header and note blocks have no time line and so are no cues; hours are optional; inline tags and the note, style
    and region lines of a cue go."""
    return _cues(files, True)


def lrc(files: DataFrame) -> DataFrame:
    """S12, W6. A line ends where the next one starts, the last after three seconds; lines without text end others and then go.
    Lines stay in the file's order."""
    line = r"^\[(\d{1,3}):(\d{2})(?:[.:](\d{1,3}))?\](.*)$"
    g = lambda i: F.regexp_extract("l", line, i)
    rows = files.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "l")).where(F.col("l").rlike(line))
    rows = rows.select("id", "pos", _ms(F.lit("0"), g(1), g(2), F.when(g(3) == "", "0").otherwise(g(3))).alias("start_ms"), _flat(g(4)).alias("text"))
    w = Window.partitionBy("id").orderBy("pos")
    rows = rows.withColumn("end_ms", F.coalesce(F.lead("start_ms").over(w), F.col("start_ms") + 3000)).where("text <> ''")
    return rows.withColumn("index", F.row_number().over(w)).select("id", "index", "start_ms", "end_ms", "text")
