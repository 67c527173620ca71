"""Retriever specifications and their evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.encoders import ENCODERS
from lodeseek.operators import evaluation as ev
from lodeseek.operators import retrieval as r
from lodeseek.plans.stages import Stages

Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
#: Pair scorers by name; a learned one is registered here by its user, see retrieval.batch_scorer.
SCORERS: dict[str, Callable] = {"overlap": r.overlap_scorer}


def _vectors(df: DataFrame, p: dict) -> DataFrame:
    return df if "embedding" in df.columns else r.encode(df, ENCODERS[p.get("encoder", "hashing")](p))


def combine(spec: dict, parts: list[Retriever]) -> Retriever:
    """The retriever of a specification's top level over the retrievers of the levels below."""
    kind, p = spec.get("retriever"), dict(spec.get("parameters") or {})
    if kind == "bm25":
        return lambda c, q, k: r.bm25(c, q, k, p.get("k1", 1.2), p.get("b", 0.75))
    if kind == "dense":
        return lambda c, q, k: r.dense_search(_vectors(c, p), _vectors(q, p), k)
    if kind == "approximate":
        return lambda c, q, k: r.vector_search(_vectors(c, p), _vectors(q, p), k, p.get("exact", False), p.get("cells", 256), p.get("nprobe", 8))
    if kind == "hybrid":
        depth = p.get("depth", 100)
        return lambda c, q, k: r.fuse([f(c, q, max(k, depth)) for f in parts], k, p.get("rrf_k", 60), depth, p.get("weights"))
    if kind == "rerank":
        depth, scorer = p.get("depth", 50), SCORERS[p.get("scorer", "overlap")]
        return lambda c, q, k: r.rerank(parts[0](c, q, max(k, depth)), q, c, scorer, k, depth)
    raise ValueError(f"unknown retriever {kind!r}")


def build_retriever(spec: dict) -> Retriever:
    """{retriever, parameters} to a function (corpus, queries, k) -> run; nested for hybrid (retrievers) and rerank (base).
    The specification is not changed."""
    kind, p = spec.get("retriever"), spec.get("parameters") or {}
    below = p["retrievers"] if kind == "hybrid" else [p["base"]] if kind == "rerank" else []
    return combine(spec, [build_retriever(s) for s in below])


def evaluate(spec: dict, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, split: str = "val", k: int = 100) -> tuple[dict, DataFrame]:
    """(metrics, timing and counts; metrics per query) of the queries of a split, all in one plan."""
    if k < 100:
        raise ValueError("k must be 100 or more")
    q = queries.filter(F.col("split") == split)
    if q.isEmpty():
        raise ValueError(f"no queries in split {split!r}")
    st, began = Stages(corpus.sparkSession), time.perf_counter()
    plan = build_retriever(spec)(corpus, q, k)
    indexed = time.perf_counter() - began
    run = st.keep(plan, "run")
    searched = time.perf_counter() - began - indexed
    judged = qrels.join(q.select("query_id"), "query_id", "left_semi")
    if not q.join(judged, "query_id", "left_anti").isEmpty():
        raise ValueError("a query has no judgement")
    per = st.keep(ev.per_query_metrics(run, judged), "per_query")
    n = per.count()
    # a batch is one plan: its time by query stands for the latency
    timing = {"index_seconds": round(indexed, 3), "search_seconds": round(searched, 3), "search_ms_per_query_p50": round(1000 * searched / n, 3)}
    means = ev.mean_metrics(per).first().asDict()
    return {"metrics": {m: means[m] for m in ev.METRICS}, "timing": timing, "counts": {"documents": corpus.count(), "queries": n, "max_results": k}}, per
