"""R18-R21. A retrieval pipeline as a declared list of nodes, checked and then compiled to one plan for a whole set of queries.

A node is a function of the frames so far. Recall nodes add their ranking under an ordinal of their own, so that the order of the
configuration, not that of execution, breaks ties; both are branches of one plan and run at once where Spark has room.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.operators import ranking, recall
from quern.operators.curation import checkpointed

Frames = dict[str, DataFrame]


@dataclass(frozen=True)
class Node:
    name: str
    enabled: bool = True
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Chunking:
    strategy: str = "fixed"
    chunk_chars: int = 900
    overlap: int = 150


@dataclass(frozen=True)
class Config:
    nodes: tuple[Node, ...]
    chunking: Chunking = Chunking()

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Config:
        d = json.loads(text)
        return Config(tuple(Node(**n) for n in d["nodes"]), Chunking(**d.get("chunking", {})))


#: name -> (function(frames, ordinal, **params), parameter types)
REGISTRY: dict[str, tuple[Callable, dict[str, type]]] = {}


def node(name: str, **types: type):
    def register(f: Callable) -> Callable:
        REGISTRY[name] = f, types
        return f

    return register


def _ranked(frames: Frames, hits: DataFrame, ordinal: int) -> Frames:
    new = hits.select("query_id", F.lit(ordinal * 1000).alias("ranking_id"), (F.col("rank") - 1).alias("rank"), F.col("id").cast("long").alias("id"))
    old = frames.get("rankings")
    return frames | {"rankings": new if old is None else old.unionByName(new)}


@node("vector_recall", top_k=int)
def vector_recall(frames: Frames, ordinal: int, top_k: int = 10) -> Frames:
    """Nearest vectors of frames corpus_vectors (vec_id, embedding) for query_vectors."""
    return _ranked(frames, recall.cosine_top_k(frames["corpus_vectors"], frames["query_vectors"], 2 * top_k), ordinal)


@node("keyword_recall", top_k=int)
def keyword_recall(frames: Frames, ordinal: int, top_k: int = 10) -> Frames:
    """BM25 over documents (id, text) for queries (query_id, text)."""
    return _ranked(frames, recall.bm25(frames["documents"], frames["queries"], 2 * top_k), ordinal)


@node("rrf_fusion", k=int)
def rrf_fusion(frames: Frames, ordinal: int, k: int = 60) -> Frames:
    fused = ranking.rrf(frames["rankings"], k)
    return frames | {"hits": fused.select("query_id", F.col("fused_rank").alias("rank"), "id", "score")}


@node("parent_expand")
def parent_expand(frames: Frames, ordinal: int) -> Frames:
    """Leaves to parents by frames parents (id, parent_id)."""
    got = ranking.expand_parents(frames["hits"], frames["parents"])
    return frames | {"hits": got.select("query_id", F.col("place").alias("rank"), F.col("node_id").alias("id"), "score")}


@node("verdict_gate")
def verdict_gate(frames: Frames, ordinal: int) -> Frames:
    """R17. Drops all hits of queries judged irrelevant in frames verdicts (query_id, verdict); a missing verdict keeps them."""
    bad = frames["verdicts"].where("verdict = 'irrelevant'").select("query_id").distinct()
    return frames | {"hits": frames["hits"].join(bad, "query_id", "left_anti")}


def validate(config: Config) -> list[str]:
    """R21. What is wrong with a configuration; nothing: an empty list."""
    out, seen = [], set()
    for n in config.nodes:
        if n.name not in REGISTRY:
            out.append(f"unknown node {n.name}")
            continue
        if n.name in seen:
            out.append(f"node {n.name} twice")
        seen.add(n.name)
        types = REGISTRY[n.name][1]
        out += [f"{n.name}: unknown parameter {p}" if p not in types else f"{n.name}: {p} is no {types[p].__name__}" for p, v in n.params.items() if p not in types or type(v) is not types[p]]
    on = [n.name for n in config.nodes if n.enabled]
    if any(n.endswith("_recall") for n in on) and "rrf_fusion" not in on:
        out.append("recall without rrf_fusion gives no hits")
    if config.chunking.strategy not in ("fixed", "paragraph", "sentence", "semantic"):
        out.append(f"unknown strategy {config.chunking.strategy}")
    if config.chunking.chunk_chars < 1:
        out.append("chunk_chars below 1")
    return out


def compiled(config: Config, frames: Frames, top_k: int = 10) -> DataFrame:
    """query_id, rank, id, score of the configured pipeline, at most top_k a query."""
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))
    for i, n in enumerate(config.nodes):
        if n.enabled:
            frames = REGISTRY[n.name][0](frames, i, **n.params)
    return frames["hits"].where(F.col("rank") <= top_k)


class RetrievalUnavailable(RuntimeError):
    """No recall node gave a ranking, and at least one failed."""


#: Nodes that ask a language model, in other jobs' columns; the fast lane leaves them out.
SLOW = ("query_rewrite", "verdict_gate")


@dataclass(frozen=True)
class Trace:
    """R18. What became of a node: ok, failed or skipped, the rows it gave, for how many queries, and the seconds it took."""

    node: str
    status: str
    rows: int = 0
    queries: int = 0
    seconds: float = 0.0
    error: str | None = None


def _observed(name: str, df: DataFrame) -> tuple[DataFrame, int, int]:
    """df written to the shared folder, with its rows and queries, which are counted on the way."""
    seen = Observation(name)
    out = checkpointed(df.observe(seen, F.count("*").alias("rows"), F.approx_count_distinct("query_id").alias("queries")))
    got = seen.get
    return out, got["rows"], got["queries"]


def _run(n: Node, ordinal: int, frames: Frames) -> tuple[Trace, dict[str, DataFrame]]:
    """A node run to its end, and the frame it made; a failure gives no frame and stops nothing."""
    began = time.perf_counter()
    key = "rankings" if n.name.endswith("_recall") else "hits"
    try:
        before = {k: v for k, v in frames.items() if k != "rankings"} if key == "rankings" else frames
        df, rows, queries = _observed(f"{n.name}-{ordinal}", REGISTRY[n.name][0](before, ordinal, **n.params)[key])
        return Trace(n.name, "ok", rows, queries, round(time.perf_counter() - began, 3)), {key: df}
    except Exception as e:  # whatever a node's plan or run throws, the others go on
        return Trace(n.name, "failed", seconds=round(time.perf_counter() - began, 3), error=f"{type(e).__name__}: {e}"[:300]), {}


def traced(config: Config, frames: Frames, top_k: int = 10, fast: bool = False) -> tuple[DataFrame, list[Trace]]:
    """R18/R19/R20. The hits of the configured pipeline and what became of each node, node by node: a recall that fails gives an empty
    ranking, another node that fails leaves the hits as they were. Recalls that stand beside each other run at once, and are
    put together in the order of the configuration. fast leaves out the nodes that ask a model.

    Each node's result is written once to the shared folder, where its rows are counted on the way, so a trace costs no second
    pass. If no recall gave a ranking and one failed, retrieval is unavailable.
    """
    if wrong := validate(config):
        raise ValueError("; ".join(wrong))
    out: list[Trace] = []
    todo = list(enumerate(config.nodes))
    while todo:
        i, n = todo.pop(0)
        if not n.enabled or (fast and n.name in SLOW):
            out.append(Trace(n.name, "skipped"))
            continue
        group = [(i, n)]
        while n.name.endswith("_recall") and todo and todo[0][1].enabled and todo[0][1].name.endswith("_recall"):
            group.append(todo.pop(0))
        with ThreadPoolExecutor(len(group)) as pool:
            done = list(pool.map(lambda g: _run(g[1], g[0], frames), group))
        for t, made in done:
            out.append(t)
            if "rankings" in made and "rankings" in frames:
                made = {"rankings": frames["rankings"].unionByName(made["rankings"])}
            frames = frames | made
    if "rankings" not in frames and any(t.status == "failed" for t in out):
        raise RetrievalUnavailable("; ".join(f"{t.node}: {t.error}" for t in out if t.error))
    return frames["hits"].where(F.col("rank") <= top_k), out
