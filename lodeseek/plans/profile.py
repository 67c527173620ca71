"""Where the time of a retriever goes: every level of a specification timed on its own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from lodeseek.operators.evaluation import latency_summary
from lodeseek.plans import pipeline
from lodeseek.plans.stages import Stages


class Stopwatch:
    """Milliseconds by label. A batch is one plan, so a call is a batch; times of children are part of their parents'."""

    def __init__(self) -> None:
        self.samples: list[tuple[str, float, int]] = []

    def record(self, label: str, seconds: float, queries: int) -> None:
        self.samples.append((label, seconds * 1000, queries))

    def report(self, spark) -> dict[str, dict]:
        """Of every label: calls, median and 95 % quantile of a batch, total, and the mean of a query."""
        if not self.samples:
            return {}
        df = spark.createDataFrame(self.samples, "stage string, ms double, queries long")
        per = {s: sum(q for x, _, q in self.samples if x == s) for s, _, _ in self.samples}
        return {r["stage"]: {"calls": r["calls"], "p50_ms": round(r["p50"], 3), "p95_ms": round(r["p95"], 3), "total_ms": round(r["total"], 1), "ms_per_query": round(r["total"] / max(1, per[r["stage"]]), 3)} for r in latency_summary(df).orderBy("stage").collect()}


def instrumented(spec: dict, watch: Stopwatch, label: str | None = None) -> Callable[[DataFrame, DataFrame, int], DataFrame]:
    """The retriever of a specification whose levels are written and timed one by one. Labels go down the tree:
    rerank, rerank.base:hybrid, rerank.base:hybrid.child0:bm25, and rerank.scorer for the scoring alone."""
    kind, p = spec.get("retriever"), dict(spec.get("parameters") or {})
    label = label or str(kind)
    if kind == "hybrid":
        parts = [instrumented(s, watch, f"{label}.child{i}:{s['retriever']}") for i, s in enumerate(p["retrievers"])]
    elif kind == "rerank":
        parts = [instrumented(p["base"], watch, f"{label}.base:{p['base']['retriever']}")]
    else:
        parts = []

    def run(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        n, began, inner = queries.count(), time.perf_counter(), 0.0
        if kind == "rerank":
            def base(c, q, depth):
                nonlocal inner
                at = time.perf_counter()
                out = parts[0](c, q, depth)
                inner = time.perf_counter() - at
                return out

            plan = pipeline.combine(spec, [base])(corpus, queries, k)
        else:
            plan = pipeline.combine(spec, parts)(corpus, queries, k)
        out = Stages(corpus.sparkSession).keep(plan, "run")
        seconds = time.perf_counter() - began
        watch.record(label, seconds, n)
        if kind == "rerank":
            watch.record(f"{label}.scorer", seconds - inner, n)
        return out

    return run


def profile(spec: dict, corpus: DataFrame, queries: DataFrame, k: int = 100) -> dict:
    """The report of one batch: documents, queries, seconds and the stages."""
    watch, began = Stopwatch(), time.perf_counter()
    instrumented(spec, watch)(corpus, queries, k)
    return {"queries": queries.count(), "max_results": k, "corpus_documents": corpus.count(), "seconds": round(time.perf_counter() - began, 3), "stages": watch.report(corpus.sparkSession)}
