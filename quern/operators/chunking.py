"""Chunking of texts (id, text) with array functions: no Python, one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapsed(text: Column) -> Column:
    """F1. White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def _windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    step = max(1, size - overlap)
    t = docs.select("id", collapsed(F.col("text")).alias("t")).withColumn("len", F.length("t")).where("len > 0")
    starts = F.when(F.col("len") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("len") - 1, F.lit(step)))
    return t.select("id", "t", "len", F.posexplode(starts).alias("seq", "start")).select("id", "len", "seq", "start", F.expr(f"substring(t, start + 1, {size})").alias("chunk"))


def fixed_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """C1/C4. id, seq (from 0), start, chunk. A text of at most `size` characters is one chunk; an empty text has none."""
    return _windows(docs, size, overlap).select("id", "seq", "start", "chunk")


def hierarchy(docs: DataFrame, size: int, overlap: int, parent_size: int) -> DataFrame:
    """C6/J11. Leaves with the first parent window that holds their midpoint (null past the last parent): id, seq, chunk, parent_seq.

    Parents are windows of parent_size with the same overlap, so the first that holds a place is found by arithmetic.
    """
    step = max(1, parent_size - overlap)
    j = _windows(docs, size, overlap).withColumn("mid", F.col("start") + F.floor(F.length("chunk") / 2))
    first = F.greatest(F.floor((F.col("mid") - parent_size) / step) + 1, F.lit(0))
    last = F.when(F.col("len") <= parent_size, 0).otherwise(F.floor((F.col("len") - 1) / step))
    return j.select("id", "seq", "chunk", F.when(F.col("len") <= size, F.lit(None)).when((first <= last) & (F.col("mid") < first * step + parent_size), first).cast("long").alias("parent_seq"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """C2. Paragraphs between blank lines, stripped, empty ones left out: id, seq, unit."""
    parts = F.filter(F.transform(F.split("text", r"\n[ \t\r]*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("id", F.posexplode(parts).alias("seq", "unit"))


def sentences(docs: DataFrame, least: int = 1) -> DataFrame:
    """C3/C11. Sentences after . ! ? and at line ends, at least `least` characters: id, seq, unit."""
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?。！？])\s+|\n"), lambda x: F.trim(x)), lambda x: F.length(x) >= least)
    return docs.select("id", F.posexplode(parts).alias("seq", "unit"))


def merged_units(units: Column, size: int, joiner: str, overlap: int = 0) -> Column:
    """C5/W15. Greedy merge of an array of units into chunks of at most `size` characters. A unit longer than that closes the
    open chunk and is cut into windows of `size` that overlap; its last window stays open for the units after it."""
    step_ = max(1, size - overlap)
    cut = lambda u: F.transform(F.sequence(F.lit(0), F.length(u) - 1, F.lit(step_)), lambda i: F.substring(u, i + 1, F.lit(size)))
    pieces = F.flatten(F.transform(units, lambda u: F.when(F.length(u) <= size, F.array(F.struct(u.alias("u"), F.lit(False).alias("cut")))).otherwise(F.transform(cut(u), lambda w: F.struct(w.alias("u"), F.lit(True).alias("cut"))))))
    empty = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(a, p):
        fits = ~p["cut"] & (F.length(a["open"]) + len(joiner) + F.length(p["u"]) <= size)
        return F.when(a["open"].isNull(), F.struct(a["done"].alias("done"), p["u"].alias("open"))).when(fits, F.struct(a["done"].alias("done"), F.concat(a["open"], F.lit(joiner), p["u"]).alias("open"))).otherwise(F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), p["u"].alias("open")))

    return F.aggregate(pieces, empty, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def merged_paragraphs(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """C2 with C5. Paragraphs merged with blank lines: id, seq, chunk."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return docs.select("id", F.posexplode(merged_units(parts, size, "\n\n", overlap)).alias("seq", "chunk"))


def _sentences_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?。！？])\s+|\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def merged_sentences(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """C3 with C5. Sentences merged with spaces: id, seq, chunk."""
    return docs.select("id", F.posexplode(merged_units(_sentences_of(F.col("text")), size, " ", overlap)).alias("seq", "chunk"))


def subtitle_chunks(cues: DataFrame, size: int) -> DataFrame:
    """C9/W14. Cues (id, index, start_ms, end_ms, text) grouped in order while their joined text fits: id, seq, chunk, start_ms,
    end_ms and their H:MM:SS stamps. A cue longer than that is windows of its own with the cue's times."""
    c = F.array_sort(F.collect_list(F.struct("index", "start_ms", "end_ms", F.col("text").alias("t"))))
    wide = lambda x: F.transform(F.sequence(F.lit(0), F.length(x["t"]) - 1, F.lit(size)), lambda i: F.struct(x["start_ms"], x["end_ms"], F.substring(x["t"], i + 1, F.lit(size)).alias("t"), F.lit(False).alias("open")))
    part = lambda x: F.struct(x["start_ms"], x["end_ms"], x["t"].alias("t"), F.lit(True).alias("open"))
    kind = "array<struct<start_ms: bigint, end_ms: bigint, t: string, open: boolean>>"

    def step(a, x):
        last = F.try_element_at(a, F.lit(-1))
        fits = last["open"] & (F.length(last["t"]) + 1 + F.length(x["t"]) <= size)
        grown = F.struct(last["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"), F.concat(last["t"], F.lit("\n"), x["t"]).alias("t"), F.lit(True).alias("open"))
        return F.when(F.length(x["t"]) > size, F.concat(a, wide(x)).cast(kind)).when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown)).cast(kind)).otherwise(F.concat(a, F.array(part(x))).cast(kind))

    stamp = lambda ms: F.format_string("%d:%02d:%02d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60)
    some = cues.where("trim(text) <> ''").select("id", "index", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text")
    g = some.groupBy("id").agg(F.aggregate(c, F.expr(f"cast(array() as {kind})"), step).alias("g"))
    return g.select("id", F.posexplode("g").alias("seq", "x")).select("id", "seq", F.col("x.t").alias("chunk"), "x.start_ms", "x.end_ms", stamp(F.col("x.start_ms")).alias("start_ts"), stamp(F.col("x.end_ms")).alias("end_ts"))


def sections(docs: DataFrame, blank: bool = False) -> DataFrame:
    """Markdown sections at lines that begin with '## ': id, seq, title, body. What stands before the first heading is a section
    of its own if it is not blank; with blank, also if it is, and an empty text is one section."""
    parts = F.split("text", r"\n(?=## )")
    if not blank:
        parts = F.filter(parts, lambda x: F.trim(x) != "")
    s = docs.select("id", F.posexplode(parts).alias("seq", "s"))
    return s.select("id", "seq", F.regexp_extract("s", r"^## ([^\n]*)", 1).alias("title"), F.trim(F.regexp_replace("s", r"^## [^\n]*\n?", "")).alias("body"))


def section_pieces(docs: DataFrame, default_title: str, cap: int = 1100, size: int = 900) -> DataFrame:
    """C10. Sections of markdown pages, each piece under 【title · section】: id, seq, chunk. A part of more than `cap` characters
    is cut at sentences into pieces of at most `size`; a part that is its heading alone is left out."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split("text", r"\n(?=## )"), strip), lambda x: x != "")
    plain = lambda h: F.trim(F.regexp_replace(h, r"^[# ]+", ""))
    title = plain(F.regexp_extract("text", r"(?m)^(# [^\n]*)$", 1))
    s = docs.select("id", F.when(title == "", default_title).otherwise(title).alias("title"), F.posexplode(parts).alias("part", "s"))
    s = s.withColumn("head", F.regexp_extract("s", r"(?m)^(##? [^\n]*)$", 1)).where("s <> head")
    section = plain(F.col("head"))
    prefix = F.when(section != F.col("title"), F.concat(F.lit("【"), "title", F.lit(" · "), section, F.lit("】"))).otherwise(F.concat(F.lit("【"), "title", F.lit("】")))
    pieces = F.when(F.length("s") > cap, merged_units(_sentences_of(F.col("s")), size, " ")).otherwise(F.array("s"))
    p = s.select("id", "part", prefix.alias("prefix"), F.posexplode(pieces).alias("piece", "body"))
    seq = F.row_number().over(Window.partitionBy("id").orderBy("part", "piece")) - 1
    return p.select("id", seq.alias("seq"), F.concat("prefix", F.lit("\n"), "body").alias("chunk"))


def contextualized(chunks: DataFrame, context: DataFrame) -> DataFrame:
    """C7. Chunks (id, seq, chunk) with the context of (id, seq, context) before them; chunks without one stay."""
    j = chunks.join(context, ["id", "seq"], "left")
    return j.select("id", "seq", F.when(F.length("context") > 0, F.concat_ws("\n", "context", "chunk")).otherwise(F.col("chunk")).alias("chunk"), F.col("chunk").alias("raw"))


def with_sentinels(chunks: DataFrame, column: str = "chunk") -> DataFrame:
    """C13. chunks without the sentinels [[PAGE:n]] and [[PARA:n]] in their text, and with pages and paras: the numbers that stand in the chunk, in
    order, each once. White space that a sentinel leaves doubled is one space."""
    mark = r"\[\[(PAGE|PARA):([0-9]{1,9})\]\]"
    numbers = lambda kind: F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(column, F.lit(rf"\[\[{kind}:([0-9]{{1,9}})\]\]"), F.lit(1)), lambda n: n.cast("int"))))
    clean = F.trim(F.regexp_replace(F.regexp_replace(column, mark, "\x01"), "[ \t]*\x01[ \t]*", " "))
    return chunks.select(*[c for c in chunks.columns if c != column], clean.alias(column), numbers("PAGE").alias("pages"), numbers("PARA").alias("paras"))


def with_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """C13. chunks (id, seq, pages) with image_ids: those of images (id, page, image_id) on one of their pages, in order."""
    on = chunks.select("id", "seq", F.explode("pages").alias("page")).join(images, ["id", "page"])
    ids = on.groupBy("id", "seq").agg(F.array_sort(F.collect_set("image_id")).alias("image_ids"))
    return chunks.join(ids, ["id", "seq"], "left").withColumn("image_ids", F.coalesce("image_ids", F.array().cast(ids.schema["image_ids"].dataType)))
