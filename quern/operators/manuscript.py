"""Markdown manuscripts as blocks with ids: the line states of a text as window sums, one shuffle for all of them.

Lines outside fences are blank, rule, heading, bar (begins with |), bullet, number, quote or paragraph lines; neighbouring lines of
a kind are one block. Whether a line lies in a fence is a prefix sum: a fence line of kind p (1 or 2) takes the state x (0 outside,
1 or 2 inside a fence of that kind) to p - x modulo 3, which opens, closes or, inside the other kind, leaves it as it is. So the
state after k fence lines is the alternating sum of their kinds, and no line waits for the one before.

A text is one window partition, so a task holds the lines of one text at a time. White space is that of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WS = r"[ \t\x0B\f\r]"
#: The line syntax.
HEADING = rf"^(#{{1,6}}){_WS}+(.*?){_WS}*#*{_WS}*$"
BULLET = rf"^{_WS}*[-*+]{_WS}+(.*)$"
NUMBER = rf"^{_WS}*[0-9]+[.)]{_WS}+(.*)$"
SEPARATOR = rf"^{_WS}*\|?{_WS}*:?-{{3,}}.*$"
QUOTE = rf"^>{_WS}?(.*)$"
RULE = rf"^{_WS}*(?:-{{3,}}|\*{{3,}}|_{{3,}}){_WS}*$"
#: The syntax inside a block.
LINK = r"\[([^\]]*)\]\(([^) \t\n\x0B\f\r]*)[^)]*\)"
BOLD = r"\*\*([^ \t\n\x0B\f\r](?:.*?[^ \t\n\x0B\f\r])??)\*\*"
CODE = r"`([^`]+)`"

NO_TITLE, EARLY, EMPTY = "no level-1 heading", "content before the first level-1 heading", "empty manuscript"
#: The letters that a kind's ids begin with.
PREFIX = {"paragraph": "p", "heading": "h", "code": "code", "table": "t", "list": "l", "quote": "q"}


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def _lines(docs: DataFrame) -> DataFrame:
    """id, n, line, kind and the numbers of the block and of the section that each line belongs to; kind is null for lines
    that are no content."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    w = Window.partitionBy("id").orderBy("n")
    x = docs.select("id", F.posexplode(F.split(text, "\n")).alias("n", "line"))
    bare = _stripped(F.col("line"))
    x = x.withColumn("fence", F.when(bare.startswith("```"), 1).when(bare.startswith("~~~"), 2))
    sign = F.lit(1) - 2 * (F.col("k") % 2)
    x = x.withColumn("k", F.count("fence").over(w))
    x = x.withColumn("after", F.pmod(sign * F.coalesce(F.sum(sign * F.col("fence")).over(w), F.lit(0)), F.lit(3)))
    x = x.withColumn("before", F.lag("after", 1, 0).over(w))
    has = lambda p: F.col("line").rlike(f"(?s){p}")
    kind = (
        F.when((F.col("before") != 0) | (F.col("after") != 0), "code")
        .when((bare == "") | has(RULE), None)
        .when(has(HEADING), "heading")
        .when(bare.startswith("|"), "bar")
        .when(has(BULLET), "bullet")
        .when(has(NUMBER), "number")
        .when(has(QUOTE), "quote")
        .otherwise("paragraph")
    )
    x = x.withColumn("kind", kind).withColumn("was", F.lag("kind").over(w))
    # a table begins at the first bar line of a run that a separator follows, and takes the rest of the run
    begins = (F.col("kind") == "bar") & F.coalesce(F.lead("line").over(w).rlike(f"(?s){SEPARATOR}"), F.lit(False))
    x = x.withColumn("run", F.max(F.when((F.col("kind") == "bar") & ~F.col("was").eqNullSafe("bar"), F.col("n"))).over(w))
    x = x.withColumn("top", F.max(F.when(begins, F.col("n"))).over(w))
    x = x.withColumn("top_was", F.lag("top").over(w))
    table = (F.col("kind") == "bar") & (F.col("top") >= F.col("run"))
    x = x.withColumn("first", table & F.coalesce(F.col("top_was") < F.col("run"), F.lit(True)))
    x = x.withColumn("kind", F.when(table, "table").when(F.col("kind") == "bar", "paragraph").otherwise(F.col("kind")))
    x = x.withColumn("was", F.lag("kind").over(w))
    starts = (
        F.when(F.col("kind").isNull(), False)
        .when(F.col("kind") == "code", F.col("before") == 0)
        .when(F.col("kind") == "table", F.col("first"))
        .otherwise((F.col("kind") == "heading") | ~F.col("kind").eqNullSafe(F.col("was")))
    )
    level = F.length(F.regexp_extract("line", f"(?s){HEADING}", 1))
    x = x.withColumn("level", F.when(F.col("kind") == "heading", level))
    x = x.withColumn("block", F.sum(starts.cast("int")).over(w)).withColumn("section", F.sum((F.col("level") == 1).cast("int")).over(w))
    return x.withColumn("inner", (F.col("before") != 0) & (F.col("after") != 0)).select("id", "n", "line", "kind", "level", "block", F.coalesce("section", F.lit(0)).alias("section"), "inner")


def _hashed(kind: Column, payload: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(payload, 256), 1, 10))


def blocks(docs: DataFrame) -> DataFrame:
    """C17. The blocks of manuscripts docs (id, text) that open with a level-1 heading, in order: id, section, section_id, block,
    kind, level, text, items (of lists), cells (of tables: rows of cells, the header first), block_id and stable_id.

    block_id is a hash of the content, numbered by its occurrences in the manuscript; stable_id holds the section's id
    and numbers occurrences within the section, so what is inserted changes no id but of equal content after it in its section.
    Manuscripts that cannot be projected have no blocks; `problems` says why. Texts of equal ids are not kept apart.
    """
    x = _lines(docs).where("kind is not null")
    g = x.groupBy("id", "block").agg(
        F.first("kind").alias("k"), F.max("level").alias("level"), F.min("section").alias("section"), F.min("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "line", "inner"))), lambda s: s).alias("ls"),
    )
    raw = F.transform("ls", lambda s: s["line"])
    taken = lambda p, i=1: F.transform(raw, lambda s: F.regexp_extract(s, f"(?s){p}", i))
    kind = F.when(F.col("k").isin("bullet", "number"), "list").otherwise(F.col("k"))
    text = (
        F.when(F.col("k") == "code", F.array_join(F.transform(F.filter("ls", lambda s: s["inner"]), lambda s: s["line"]), "\n"))
        .when(F.col("k") == "heading", F.element_at(taken(HEADING, 2), 1))
        .when(F.col("k") == "quote", F.array_join(taken(QUOTE), "\n"))
        .when(F.col("k") == "paragraph", F.array_join(F.transform(raw, _stripped), " "))
    )
    items = F.when(F.col("k") == "bullet", taken(BULLET)).when(F.col("k") == "number", taken(NUMBER))
    cells = lambda s: F.transform(F.split(F.regexp_replace(_stripped(s), r"^\|+|\|+$", ""), r"\|"), _stripped)
    rows = F.when(F.col("k") == "table", F.transform(F.filter(raw, lambda s: ~s.rlike(f"(?s){SEPARATOR}")), cells))
    # a list is known by its last line, a table by its first
    payload = F.when(F.col("k") == "table", F.element_at(raw, 1)).when(kind == "list", F.element_at(raw, -1)).otherwise(text)
    prefix = F.create_map(*[F.lit(v) for kv in PREFIX.items() for v in kv])[kind]
    b = g.select("id", "section", "block", kind.alias("kind"), "level", (F.col("k") == "number").alias("ordered"), text.alias("text"), items.alias("items"), rows.alias("cells"), _hashed(prefix, payload).alias("base"), "n")
    top = (F.col("kind") == "heading") & (F.col("level") == 1)
    title = F.when(top, _hashed(F.lit("sec"), F.col("text")))
    b = b.withColumn("title", title).withColumn("nth", F.when(top, F.row_number().over(Window.partitionBy("id", "title").orderBy("block"))))
    own = F.when(top, F.when(F.col("nth") == 1, F.col("title")).otherwise(F.concat_ws("-", "title", "nth")))
    w = Window.partitionBy("id").orderBy("block")
    b = b.withColumn("section_id", F.last(own, ignorenulls=True).over(w)).withColumn("early", F.first("section").over(w) == 0)
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys, "base").orderBy("block")) - 1
    b = b.withColumn("_doc", place("id")).withColumn("_sec", place("id", "section"))
    numbered = lambda c: F.when(F.col(c) == 0, F.col("base")).otherwise(F.concat_ws("-", "base", c))
    out = b.where("not early").withColumn("block_id", numbered("_doc")).withColumn("stable_id", F.concat_ws("/", "section_id", numbered("_sec")))
    return out.select("id", "section", "section_id", "block", "kind", "level", "ordered", "text", "items", "cells", "block_id", "stable_id")


def problems(docs: DataFrame) -> DataFrame:
    """C17. id and problem of manuscripts that cannot be projected: they are empty, have content before their title, or none."""
    x = _lines(docs).groupBy("id").agg(F.count("kind").alias("n"), F.min(F.when(F.col("kind").isNotNull(), F.col("section"))).alias("least"), F.max("section").alias("most"), F.max(F.length(_stripped(F.col("line")))).alias("size"))
    why = F.when(F.col("size") == 0, EMPTY).when((F.col("n") > 0) & (F.col("least") == 0), EARLY).when(F.col("most") == 0, NO_TITLE)
    return x.select("id", why.alias("problem")).where("problem is not null")


#: Control characters that stand for syntax while a text is cut; they are taken out of it before.
_CUT, _STRONG, _MONO, _OPEN, _SHUT = "\x01", "\x02", "\x03", "\x04", "\x05"


def linked(text: Column) -> Column:
    """A text with links written out: the label, and the target in brackets where there is one."""
    t = F.regexp_replace(F.translate(text, _CUT + _STRONG + _MONO + _OPEN + _SHUT, ""), LINK, f"$1{_OPEN}$2{_SHUT}")
    return F.replace(F.replace(F.replace(t, F.lit(_OPEN + _SHUT), F.lit("")), F.lit(_OPEN), F.lit(" (")), F.lit(_SHUT), F.lit(")"))


def _cut(text: Column, pattern: str, mark: str) -> Column:
    return F.split(F.regexp_replace(text, f"(?s){pattern}", f"{_CUT}{mark}$1{_CUT}"), _CUT)


def with_inlines(rows: DataFrame, text: str, markers: Column | None = None) -> DataFrame:
    """rows with spans (array of text, bold, code) and citations of a text column: links are written out, the first occurrence of each marker (a
    map of marker to citation) is taken out, then bold and code spans are cut out; neighbours of one style are one span. Each step is a
    column of its own, as a step's result is used many times by the next."""
    x = rows.withColumn("_t", linked(F.coalesce(text, F.lit(""))))
    t, hits = F.col("_t"), F.col("_hits")
    if markers is None:
        x = x.withColumn("citations", F.array().cast("array<string>")).withColumn("_parts", F.array("_t"))
    else:
        found = F.filter(F.map_entries(F.coalesce(markers, F.expr("cast(map() as map<string,string>)"))), lambda e: (e["key"] != "") & F.contains(t, e["key"]))
        x = x.withColumn("_hits", F.array_sort(F.transform(found, lambda e: F.struct(F.position(e["key"], t).alias("at"), F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("id")))))
        x = x.withColumn("citations", F.array_distinct(F.transform(hits, lambda h: h["id"])))
        # what stands between the markers, by their places in the whole text; where two overlap, nothing does
        begin = lambda i: F.when(i == 0, 1).otherwise(F.get(hits, i - 1)["at"] + F.get(hits, i - 1)["n"])
        between = F.transform(hits, lambda h, i: F.substring(t, begin(i), F.greatest(h["at"] - begin(i), F.lit(0))))
        x = x.withColumn("_parts", F.concat(between, F.array(F.substring(t, begin(F.size(hits)), F.length(t)))))
    x = x.withColumn("_strong", F.flatten(F.transform("_parts", lambda s: _cut(s, BOLD, _STRONG))))

    def code(s: Column) -> Column:
        bold = s.startswith(_STRONG)
        return F.transform(_cut(F.regexp_replace(s, f"^{_STRONG}", ""), CODE, _MONO), lambda c: F.struct(F.regexp_replace(c, f"^{_MONO}", "").alias("text"), bold.alias("bold"), c.startswith(_MONO).alias("code")))

    x = x.withColumn("_spans", F.filter(F.flatten(F.transform("_strong", code)), lambda s: s["text"] != ""))
    spans, heads = F.col("_spans"), F.col("_heads")
    changed = lambda s, i: (i == 0) | (s["bold"] != F.get(spans, i - 1)["bold"]) | (s["code"] != F.get(spans, i - 1)["code"])
    x = x.withColumn("_heads", F.filter(F.transform(spans, lambda s, i: F.when(changed(s, i), i + 1)), lambda i: i.isNotNull()))
    end = lambda i: F.coalesce(F.get(heads, i + 1), F.size(spans) + 1)
    one = lambda a, i: F.struct(F.array_join(F.transform(F.slice(spans, a, end(i) - a), lambda s: s["text"]), "").alias("text"), F.get(spans, a - 1)["bold"].alias("bold"), F.get(spans, a - 1)["code"].alias("code"))
    none = F.array(F.struct(F.lit("").alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("code")))
    x = x.withColumn("spans", F.when(F.size(spans) == 0, none).otherwise(F.transform(heads, one)))
    return x.drop("_t", "_hits", "_parts", "_strong", "_spans", "_heads")
