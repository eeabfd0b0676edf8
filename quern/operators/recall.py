"""Recall over whole sets of queries: exact cosine, BM25, token conjunction, exact phrases."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import folded
from quern.operators.curation import checkpointed, shared_counts
from quern.operators.ranking import top_k

#: Queries whose vectors a task holds at once, and rows that it multiplies with them at once.
QUERY_BLOCK, ROWS = 4096, 1024
#: Scores, and postings of query terms, that a task holds at once.
CELLS = 1 << 20
#: Terms of a vocabulary that is broadcast, some tens of megabytes at most.
VOCABULARY = 500_000
#: Fixed pattern of a keyword token.
TOKEN = "[a-z0-9一-鿿]+"


def cosine(a: str, b: str) -> Column:
    """R3/R4. Cosine of two array columns; 0 if a norm is 0; unequal lengths are an error, never cut."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    safe = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double"))
    return safe.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def cosine_top_k(corpus: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, decimals: int = 6) -> DataFrame:
    """R2/T1/R26/K14. The k corpus rows (vec_id, embedding) nearest each query row (vec_id, embedding): query_id, id,
    score, rank from 1, equal scores by id.

    A task multiplies ROWS rows at a time with the query block and keeps k rows a query, so only k rows a query and task are
    shuffled. Null vectors are never recalled; zero vectors score 0. A query block is bounded by QUERY_BLOCK queries; more are
    more passes over the corpus.
    """
    spark = corpus.sparkSession
    qs = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = max(1, -(-qs.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = qs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        ids = part["query_id"].to_numpy(dtype=np.int64)
        mat = np.array([np.asarray(v, np.float64) for v in part["embedding"]]) if len(part) else np.zeros((0, 1))
        norm = np.linalg.norm(mat, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)))

        def run(frames, shared=shared):
            ids, q = shared.value
            for frame in frames:
                frame = frame[frame["embedding"].notna()]
                for at in range(0, len(frame) if len(ids) else 0, rows := _rows(len(ids))):
                    x = frame.iloc[at : at + rows]
                    m = np.array([np.asarray(v, np.float64) for v in x["embedding"]])
                    if m.shape[1] != q.shape[1]:
                        raise ValueError("vectors of unequal length")
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    own = x["vec_id"].to_numpy(np.int64)
                    s = np.round(q @ np.divide(m, norm, out=np.zeros_like(m), where=norm > 0).T, decimals)
                    if exclude_self:
                        s[ids[:, None] == own[None, :]] = -np.inf
                    if s.shape[1] > k:  # rows that reach the k-th score, ties and all; they are few
                        least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
                        i, j = np.nonzero((s >= least) & (s > -np.inf))
                    else:
                        i, j = np.nonzero(s > -np.inf)
                    order = np.lexsort((own[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[place < k], j[place < k]
                    yield pd.DataFrame({"query_id": ids[i], "id": own[j], "score": s[i, j]})

        hits = corpus.select("vec_id", "embedding").mapInPandas(run, "query_id long, id long, score double")
        out = hits if out is None else out.union(hits)
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def masked_top_k(corpus: DataFrame, queries: DataFrame, k: int, same: list[str] = (), own: str | None = None, exclude_self: bool = True, decimals: int = 6) -> DataFrame:
    """R11/R26/P13. As cosine_top_k, but a row is only near a query of equal values in the columns `same` (a null of the query asks for no
    value, a null of the row fits none that is asked for), and, where `own` is named, if its owner is the query's or nobody (null).

    Rows are multiplied with the query block and the mask is laid over the scores, so vectors never travel with pairs.
    """
    spark = corpus.sparkSession
    cols = [*same, *([own] if own else [])]
    qs = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), *cols, "embedding")
    blocks = max(1, -(-qs.count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = qs.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        codes = [{v: i for i, v in enumerate(part[c].dropna().unique())} for c in cols]
        wanted = [np.array([-1 if pd.isna(v) else code[v] for v in part[c]], np.int64) for c, code in zip(cols, codes)]
        shared = spark.sparkContext.broadcast((part["query_id"].to_numpy(np.int64), codes, wanted, _unit(part["embedding"])))

        def run(frames, shared=shared):
            ids, codes, wanted, q = shared.value
            for frame in frames:
                for at in range(0, len(frame) if len(ids) else 0, rows := _rows(len(ids))):
                    x = frame.iloc[at : at + rows]
                    m = _unit(x["embedding"])
                    if m.shape[1] != q.shape[1]:
                        raise ValueError("vectors of unequal length")
                    s = np.round(q @ m.T, decimals)
                    fits = np.ones(s.shape, bool)
                    for c, code, want in zip(cols, codes, wanted):
                        # a row's null is -3, a value that no query has is -2, a query's null is -1
                        has = np.array([-3 if pd.isna(v) else code.get(v, -2) for v in x[c]], np.int64)[None, :]
                        fits &= (want[:, None] == has) | ((has == -3) if c == own else (want[:, None] == -1))
                    mine = x["vec_id"].to_numpy(np.int64)
                    if exclude_self:
                        fits &= ids[:, None] != mine[None, :]
                    s[~fits] = -np.inf
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.full((len(ids), 1), -np.inf)
                    i, j = np.nonzero((s >= least) & (s > -np.inf))
                    order = np.lexsort((mine[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j = i[place < k], j[place < k]
                    yield pd.DataFrame({"query_id": ids[i], "id": mine[j], "score": s[i, j]})

        hits = corpus.where("embedding is not null").select("vec_id", *cols, "embedding").mapInPandas(run, "query_id long, id long, score double")
        out = hits if out is None else out.union(hits)
    return top_k(out, ["query_id"], [F.desc("score"), F.col("id")], k)


def _rows(queries: int) -> int:
    """Rows whose scores for so many queries are at most CELLS, ROWS at most."""
    return max(1, min(ROWS, CELLS // max(1, queries)))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; zero vectors stay."""
    m = np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.zeros((0, 1))
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def scoped_top_k(corpus: DataFrame, queries: DataFrame, scope: str, k: int, decimals: int = 6) -> DataFrame:
    """R11. The k rows (vec_id, embedding) of a query's own scope nearest to it; rows and queries without one match nothing."""
    return masked_top_k(corpus.where(F.col(scope).isNotNull()), queries.where(F.col(scope).isNotNull()), k, [scope], decimals=decimals)


def rewritten(queries: DataFrame, rewrites: DataFrame, drafts: DataFrame, most: int) -> DataFrame:
    """R16. The texts that recall runs for each query (query_id, text): query_id, variant (0 is the query itself), text, and embed_text, what
    is embedded: the hypothetical answer of drafts (query_id, draft) where there is one, for the query itself only.

    rewrites: query_id, place, text; the first `most` of a query that are neither blank nor equal to another, whatever their case."""
    q = queries.select("query_id", F.lit(-1).cast("long").alias("place"), "text")
    both = q.unionByName(rewrites.select("query_id", F.col("place").cast("long").alias("place"), F.trim("text").alias("text")).where("text <> ''").join(queries.select("query_id"), "query_id", "left_semi"))
    same = Window.partitionBy("query_id", F.lower(F.trim("text"))).orderBy("place", "text")
    first = both.withColumn("_n", F.row_number().over(same)).where("_n = 1")
    v = first.withColumn("variant", (F.row_number().over(Window.partitionBy("query_id").orderBy("place", "text")) - 1).cast("int")).where(F.col("variant") <= most)
    d = drafts.where("trim(draft) <> ''").select("query_id", "draft").dropDuplicates(["query_id"])
    j = v.join(d, "query_id", "left")
    return j.select("query_id", "variant", "text", F.when(F.col("variant") == 0, F.coalesce("draft", "text")).otherwise(F.col("text")).alias("embed_text"))


def eligible_chunks(chunks: DataFrame, assets: DataFrame, domain: str | None = None) -> DataFrame:
    """J1/P6/P7/P8. Leaf chunks (asset_id, chunk_kind) without a file, or of a file (asset_id, file_status, domain_id) that is READY
    and, where a domain is asked for, in it; a domain that is no number matches no file."""
    a = assets.select("asset_id", "file_status", "domain_id")
    ok = F.col("asset_id").isNull() | (F.col("file_status") == "READY")
    if domain is not None:
        ok = ok & (F.col("asset_id").isNull() | F.coalesce(F.col("domain_id") == F.lit(domain).try_cast("long"), F.lit(False)))
    return chunks.where("chunk_kind = 'leaf'").join(a, "asset_id", "left").where(ok)


def admitted_capabilities(capabilities: DataFrame) -> DataFrame:
    """P18. Capabilities that may be a card: enabled, not research, not hidden."""
    return capabilities.where("enabled and not research and not hidden")


def two_lanes(standard: DataFrame, similar: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """R23/R36/W16. k nearest of both lanes (vec_id, capability, embedding) of each query, those of at least `least`, with their
    rank in the lane and, by score, lane and id, over both; a phrase in both lanes stays twice."""
    def lane(rows, name):
        hits = cosine_top_k(rows, queries, k).withColumnRenamed("rank", "lane_rank")
        return hits.join(rows.select(F.col("vec_id").alias("id"), "capability"), "id").withColumn("lane", F.lit(name))

    both = lane(standard, "standard").unionByName(lane(similar, "similar")).where(F.col("score") >= least)
    w = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "lane", "id"))
    return both.withColumn("global_rank", w).select("query_id", "lane", "id", "capability", "score", "lane_rank", "global_rank")


def routed(queries: DataFrame, matched: DataFrame, hits: DataFrame, capabilities: DataFrame, floor: float, k: int) -> DataFrame:
    """R24/R25/P20. Route of each query (query_id) by matched phrases (query_id, capability) and recall hits (query_id, capability,
    score): candidates (the k best capabilities by score), route and fallback_reason.

    One matched capability is a candidate of score 1.0, several are candidates of 0.0, and neither needs the floor; of recall
    a capability's best score does. A matched capability that the table lacks is a FAULT; one match that may be a card is
    TOOL; no candidate is AGENT; else a selector decides (SELECT).
    """
    n = matched.groupBy("query_id").agg(F.count("*").alias("n"))
    known = capabilities.select("capability", F.lit(True).alias("_known"))
    ghosts = matched.join(known, "capability", "left").groupBy("query_id").agg(F.max(F.col("_known").isNull()).alias("ghost"))
    cards = admitted_capabilities(capabilities).select("capability")
    of_match = matched.join(cards, "capability", "left_semi").join(n, "query_id").select("query_id", "capability", F.when(F.col("n") == 1, 1.0).otherwise(0.0).alias("score"), F.lit(True).alias("sure"))
    of_recall = hits.groupBy("query_id", "capability").agg(F.max("score").alias("score")).where(F.col("score") >= floor).join(cards, "capability", "left_semi").select("query_id", "capability", "score", F.lit(False).alias("sure"))
    c = of_match.unionByName(of_recall)
    best = top_k(c.groupBy("query_id", "capability").agg(F.max("score").alias("score")), ["query_id"], [F.desc("score"), F.col("capability")], k)
    lists = best.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "capability"))), lambda x: x["capability"].cast("string")), ",").alias("candidates"))
    sure = of_match.groupBy("query_id").agg(F.lit(True).alias("sure"))
    j = queries.join(n, "query_id", "left").join(ghosts, "query_id", "left").join(lists, "query_id", "left").join(sure, "query_id", "left")
    route = F.when(F.col("ghost"), "FAULT").when((F.col("n") == 1) & F.col("sure"), "TOOL").when(F.col("candidates").isNull(), "AGENT").otherwise("SELECT")
    reason = F.when(F.col("ghost"), "ghost_capability").when(F.col("candidates").isNull(), "no_candidate")
    return j.select("query_id", F.coalesce("candidates", F.lit("")).alias("candidates"), route.alias("route"), reason.alias("fallback_reason"))


def tokens(text: Column) -> Column:
    """F10. Lower-cased keyword tokens of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, decimals: int = 6, scope: str | None = None) -> DataFrame:
    """R8/A23/R10. BM25 of documents (id, text) for queries (query_id, text): query_id, id, score, rank. Query terms count with
    multiplicity; only positive scores are kept; equal rounded scores by id. With a scope column, which both sides have, a
    query takes documents of its own scope; term statistics are those of all documents.

    A text is tokenised once: into its length and its counts of query terms, which are kept while frequencies and lengths are
    summed from them. Where the queries' vocabulary is small (VOCABULARY terms) it goes to every task with the postings of its terms
    in the queries: rows are scored ROWS at a time against a block of queries and a task keeps k rows a query, so neither the
    postings of a common term nor its pairs are shuffled. Beyond that, tokens are joined with the vocabulary. The corpus's
    statistics are one row.
    """
    more = [scope] if scope else []
    terms = queries.select("query_id", *more, F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", *more, "term").agg(F.count("*").alias("q"))
    vocabulary = terms.select("term").distinct().limit(VOCABULARY + 1).toPandas()["term"].tolist()
    if len(vocabulary) <= VOCABULARY:
        scored = _scored_blocks(docs, terms, {t: i for i, t in enumerate(sorted(vocabulary))}, k, k1, b, decimals, scope)
    else:
        scored = _scored_joins(docs, terms, more, k1, b, decimals)
    return top_k(scored, ["query_id"], [F.desc("score"), F.col("id")], k)


def _scored_joins(docs: DataFrame, terms: DataFrame, more: list[str], k1: float, b: float, decimals: int) -> DataFrame:
    toks = docs.select("id", *more, tokens(F.col("text")).alias("t"))
    stats = toks.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avg_len"))
    tf = toks.select("id", *more, F.size("t").alias("len"), F.explode("t").alias("term")).join(terms.select("term").distinct(), "term", "left_semi").groupBy("id", *more, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("q") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = terms.join(df, "term").join(F.broadcast(stats))  # one row of statistics
    return tf.join(weighted, ["term", *more]).groupBy("query_id", "id").agg(F.round(F.sum(weight), decimals).alias("score")).where("score > 0")


def _scored_blocks(docs: DataFrame, terms: DataFrame, place: dict[str, int], k: int, k1: float, b: float, decimals: int, scope: str | None) -> DataFrame:
    spark = docs.sparkSession
    more = [scope] if scope else []
    kind = to_arrow_type(terms.schema["query_id"].dataType)
    shared = spark.sparkContext.broadcast(place)

    def counts(batches):
        find, at = re.compile(TOKEN).findall, shared.value
        for b in batches:
            for k in range(0, b.num_rows, 256):  # only so many texts are Python strings at once
                x = b.slice(k, 256)
                toks = [find((t or "").lower()) for t in x.column("text").to_pylist()]
                got = [Counter(at[w] for w in t if w in at) for t in toks]
                cols = [pa.array([len(t) for t in toks], pa.int64()), *(pa.array(v, pa.list_(pa.int32())) for v in ([list(c) for c in got], [list(c.values()) for c in got]))]
                yield pa.RecordBatch.from_arrays([*(x.column(c) for c in ["id", *more]), *cols], names=["id", *more, "len", "terms", "tfs"])

    columns = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ["id", *more])
    bags = checkpointed(docs.select("id", *more, "text").mapInArrow(counts, f"{columns}, len long, terms array<int>, tfs array<int>"))
    n, avg_len = bags.agg(F.count("*"), F.avg("len")).first()
    df = np.zeros(len(place))
    for r in bags.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect():  # at most the vocabulary
        df[r["t"]] = r["n"]
    idf = np.log(1 + ((n or 0) - df + 0.5) / (df + 0.5))
    blocks = max(1, -(-terms.select("query_id").distinct().count() // QUERY_BLOCK))
    out = None
    for block in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        ids, query = np.unique(part["query_id"].to_numpy(), return_inverse=True)
        term = np.array([place[t] for t in part["term"]], np.int64)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(place) + 1))
        weight = (part["q"].to_numpy(np.float64) * idf[term])[order] if len(part) else np.zeros(0)
        scopes = {q: v for q, v in zip(query, part[scope])} if scope else {}
        postings = spark.sparkContext.broadcast((ids, [scopes.get(i) for i in range(len(ids))], starts, query[order], weight))

        def run(batches, postings=postings):
            ids, scopes, starts, query, weight = postings.value
            scopes = np.array(scopes, object)
            many_of = np.diff(starts)
            for batch in batches:
                # rows are cut where their postings reach CELLS: a common term has one for every query
                sizes = np.asarray(batch.column("terms").value_lengths())
                terms, tfs = (np.asarray(batch.column(c).flatten()) for c in ("terms", "tfs"))
                ends = np.cumsum(sizes)
                held = np.concatenate(([0], np.cumsum(many_of[terms])))[ends]
                at, end = 0, 0
                while (at := end) < batch.num_rows and len(ids):
                    end = int(np.searchsorted(held, (held[at - 1] if at else 0) + CELLS, "right"))
                    end = min(max(end, at + 1), at + _rows(len(ids)), batch.num_rows)
                    x = batch.slice(at, end - at)
                    z0, z = ends[at - 1] if at else 0, ends[end - 1]
                    t, tf = terms[z0:z].astype(np.int64), tfs[z0:z].astype(np.float64)
                    row = np.repeat(np.arange(end - at), sizes[at:end])
                    sat = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.asarray(x.column("len")).astype(np.float64)[row] / (avg_len or 1)))
                    many = starts[t + 1] - starts[t]
                    to = np.repeat(starts[t] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum()) if len(t) else np.zeros(0, np.int64)
                    s = np.bincount(np.repeat(row, many) * len(ids) + query[to], np.repeat(sat, many) * weight[to], (end - at) * len(ids)).reshape(end - at, len(ids)).T
                    s = np.round(s, decimals)
                    if scope:
                        s[scopes[:, None] != np.array(x.column(scope).to_pylist(), object)[None, :]] = 0
                    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] if s.shape[1] > k else np.zeros((len(ids), 1))
                    i, j = np.nonzero((s >= least) & (s > 0))
                    mine = x.column("id").to_numpy(zero_copy_only=False)
                    by_id = np.empty(len(mine), np.int64)
                    by_id[np.argsort(mine, kind="stable")] = np.arange(len(mine))
                    order = np.lexsort((by_id[j], -s[i, j], i))
                    i, j = i[order], j[order]
                    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[keep], j[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i], kind), x.column("id").take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "id", "score"])

        hits = bags.mapInArrow(run, f"query_id {terms.schema['query_id'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double")
        out = hits if out is None else out.union(hits)
    return out


def all_tokens(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """R6. Documents (id, text) that hold every token of a query (query_id, text): query_id, id. Queries without a token match
    nothing. The queries' tokens are an index that tasks count their documents against; only hits leave them."""
    terms = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).distinct()
    need = terms.groupBy(F.col("query_id").alias("id")).agg(F.collect_list("term").alias("grams"))
    has = docs.select("id", F.array_distinct(tokens(F.col("text"))).alias("grams"))
    return shared_counts(has, need, None).select(F.col("test_id").alias("query_id"), F.col("train_id").alias("id"))


def exact_match(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """R22/F6. Queries (query_id, text) against phrases (owner, text), white space collapsed and case folded: query_id, verdict HIT, AMBIGUOUS
    or MISS, and the owner of a HIT."""
    norm = folded(F.col("text"))
    owners = corpus.select(norm.alias("k"), "owner").distinct().groupBy("k").agg(F.count("*").alias("n"), F.min("owner").alias("owner"))
    return queries.select("query_id", norm.alias("k")).join(owners, "k", "left").select("query_id", F.when(F.col("n").isNull(), "MISS").when(F.col("n") == 1, "HIT").otherwise("AMBIGUOUS").alias("verdict"), F.when(F.col("n") == 1, F.col("owner")).alias("owner"))


def fallback(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """R27. Keyword hits, and semantic hits of the queries that have no keyword hit."""
    return keyword.unionByName(semantic.join(keyword.select("query_id").distinct(), "query_id", "left_anti"))
