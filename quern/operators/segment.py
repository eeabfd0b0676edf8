"""Segmented tokens of scripts that are written without spaces (Han, kana, Hangul), for keyword recall.

A run of such characters is cut into the longest terms of a lexicon, from left to right, and what no term covers into pairs
of neighbouring characters (a single character stays one), so that text outside the lexicon is still found by its parts.
Other scripts keep their words. Texts and queries are cut alike, so a query's tokens are those of every text that holds it between
the same neighbours.

The lexicon goes to every task as a trie, so its size is checked first: beyond MAX_CHARS characters it is refused.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.curation import checkpointed
from quern.operators.ranking import top_k

#: Han, hiragana and katakana, Hangul syllables, as in the language tests of functions.text.
SCRIPTS = "一-鿿぀-ヿ가-힯"
#: Words of other scripts, or runs of these.
PIECE = rf"[a-z0-9]+|[{SCRIPTS}]+"
MAX_CHARS = 1 << 24
END = ""
#: Texts that a task cuts at once.
TEXTS = 64


def lexicon(terms: DataFrame, column: str = "term", least: int = 2) -> list[str]:
    """The different terms of at least `least` characters that consist of the scripts; their size is checked before they are
    read."""
    t = terms.select(F.col(column).alias("t")).where(F.col("t").rlike(f"^[{SCRIPTS}]{{{least},}}$")).distinct()
    size = t.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > MAX_CHARS:
        raise ValueError(f"a lexicon of {size} characters is too large for every task")
    return sorted(r["t"] for r in t.collect())


def trie(terms: list[str]) -> dict:
    """Nested dicts of characters; END marks a term."""
    root: dict = {}
    for t in terms:
        at = root
        for c in t:
            at = at.setdefault(c, {})
        at[END] = True
    return root


def cut(run: str, root: dict) -> list[str]:
    """Longest terms from left to right; what lies between them in pairs of characters."""
    out, loose, i, n = [], 0, 0, len(run)

    def pairs(a: int, z: int) -> None:
        if z - a == 1:
            out.append(run[a])
        else:
            out.extend(run[k : k + 2] for k in range(a, z - 1))

    while i < n:
        at, j, end = root, i, 0
        while j < n and (at := at.get(run[j])) is not None:
            j += 1
            if END in at:
                end = j
        if end:
            if loose < i:
                pairs(loose, i)
            out.append(run[i:end])
            i = loose = end
        else:
            i += 1
    if loose < n:
        pairs(loose, n)
    return out


def segmented(text: Column, terms: list[str]) -> Column:
    """C8/R6. The tokens of a text, lower-cased, in order; none for null. Runs of the scripts are cut by the lexicon in Arrow batches;
    of other texts only an empty array goes there."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(PIECE), F.lit(0))
    root: dict = {}

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if terms and not root:
            root.update(trie(terms))
        for s in batches:
            yield s.map(lambda ws: [t for w in ws for t in (cut(w, root) if w[0] > "　" else (w,))])

    has = F.coalesce(text, F.lit("")).rlike(f"[{SCRIPTS}]")
    return F.when(has, run(F.when(has, words).otherwise(F.array().cast("array<string>")))).otherwise(words)


def content_search(chunks: DataFrame, terms: list[str], column: str = "content") -> DataFrame:
    """C8. chunks with content_search: the tokens of a chunk that holds such scripts, joined by spaces; null for others, which are
    searched as they are."""
    has = F.coalesce(F.col(column).rlike(f"[{SCRIPTS}]"), F.lit(False))
    return chunks.withColumn("content_search", F.when(has, F.array_join(segmented(F.col(column), terms), " ")))


def token_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, token and tf of each document (id, text). A task cuts a few texts at once, so that the tokens of a whole batch are never held."""
    root: dict = {}

    def run(batches):
        find = re.compile(PIECE).findall
        if terms and not root:
            root.update(trie(terms))
        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                part = b.slice(k, TEXTS)
                got = [Counter(t for w in find(text) for t in (cut(w, root) if w[0] > "　" else (w,))) for text in part.column("text").to_pylist()]
                ids = part.column("id").take(pa.array(np.repeat(np.arange(len(got)), [len(c) for c in got])))
                yield pa.RecordBatch.from_arrays([ids, pa.array([t for c in got for t in c], pa.string()), pa.array([n for c in got for n in c.values()], pa.int64())], names=["id", "token", "tf"])

    text = F.lower(F.coalesce("text", F.lit(""))).alias("text")
    return docs.select("id", text).mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, token string, tf long")


def segmented_recall(docs: DataFrame, queries: DataFrame, terms: list[str], k: int) -> DataFrame:
    """R6. The k best documents (id, text) that hold all tokens of each query (query_id, text): query_id, id, score, rank.

    A query's rarest token finds its candidates, so a common token's texts are only met where a query has no rarer one; the
    other tokens are then looked up in the candidate's token counts. score is the sum over the query's tokens of
    tf / (tf + 1), rounded; ties go to the smaller id. Queries without tokens find nothing.
    """
    q = queries.select("query_id", F.array_distinct(segmented(F.col("text"), terms)).alias("need")).where("size(need) > 0")
    wanted = q.select(F.explode("need").alias("token")).distinct()
    tf = checkpointed(token_counts(docs, terms).join(wanted, "token", "left_semi").groupBy("id", "token").agg(F.sum("tf").alias("tf")))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    need = q.select("query_id", F.explode("need").alias("token"), F.size("need").alias("n"))
    rare = need.join(df, "token").groupBy("query_id", "n").agg(F.count("*").alias("known"), F.min(F.struct("df", "token"))["token"].alias("token")).where("known = n")
    hits = rare.select("query_id", "n", "token").join(tf.select("id", "token"), "token").select("query_id", "n", "id")
    full = hits.join(need.select("query_id", "token"), "query_id").join(tf, ["id", "token"])
    score = F.round(F.sum(F.col("tf") / (F.col("tf") + 1)), 6)
    got = full.groupBy("query_id", "id", "n").agg(F.count("*").alias("found"), score.alias("score")).where("found = n")
    return top_k(got.select("query_id", "id", "score"), ["query_id"], [F.desc("score"), F.col("id")], k)
