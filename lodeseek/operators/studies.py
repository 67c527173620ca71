"""Studies of size and quality: nested corpora, the sweep of an approximate index, the probe of a scorer."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.operators import retrieval as r
from lodeseek.plans.stages import Stages, numbered


def nested_corpora(base: DataFrame, pool: DataFrame, sizes: list[int], key: str = "doc_id", seed: int = 17) -> dict[int, DataFrame]:
    """For each size the whole base and the first pool documents of one seeded shuffle that fill it, so smaller corpora are
    part of larger ones. Pool documents whose id the base has are left out; sizes below the base or beyond the pool are
    left out of the result."""
    have = base.count()
    extra = pool.dropDuplicates([key]).join(base.select(key), key, "left_anti")
    extra = numbered(extra.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))), "_h", key).drop("_h")
    most = have + extra.count()
    return {n: base.unionByName(extra.filter(F.col("_pos") < n - have).select(*base.columns)) for n in sorted(set(sizes)) if have <= n <= most}


def sweep(corpora: dict[int, DataFrame], queries: DataFrame, k: int = 10, probes: tuple[int, ...] = (1, 2, 4, 8, 16, 32), cells: int = 256, repeats: int = 3, seed: int = 17) -> list[dict]:
    """A record for the exact search and for each number of probed cells at each size: recall_at_k against the exact run,
    seconds to build, and p50 and p95 of the milliseconds a query over `repeats` batches."""
    spark, n, out = queries.sparkSession, queries.count(), []

    def timed(plan: Callable[[], DataFrame], st: Stages, name: str) -> tuple[DataFrame, dict]:
        times, kept = [], None
        for i in range(repeats):
            began = time.perf_counter()
            kept = st.keep(plan(), f"{name}_{i}")
            times.append((1000 * (time.perf_counter() - began) / max(1, n),))
        p = spark.createDataFrame(times, "ms double").agg(*[F.percentile("ms", F.lit(x)).alias(c) for c, x in (("p50_ms", 0.5), ("p95_ms", 0.95))]).first()
        return kept, {c: round(p[c], 3) for c in ("p50_ms", "p95_ms")}

    for size, corpus in sorted(corpora.items()):
        st = Stages(spark)
        vectors = st.keep(corpus.select("doc_id", "embedding"), "vectors")
        exact, times = timed(lambda: r.dense_search(vectors, queries, k), st, "exact")
        out.append({"documents": size, "index": "exact", "nprobe": None, "recall_at_k": 1.0, **times})
        began = time.perf_counter()
        centers = st.keep(r.ivf_centroids(vectors, min(cells, size), seed=seed), "centers")
        index = st.keep(r.ivf_index(vectors, centers), "index")
        built = round(time.perf_counter() - began, 1)
        for p in probes:
            run, times = timed(lambda p=p: r.ivf_search(index, centers, queries, k, p), st, f"probe{p}")
            recall = r.recall_against(run, exact).agg(F.avg("recall")).first()[0]
            out.append({"documents": size, "index": "ivf", "nprobe": p, "cells": cells, "recall_at_k": round(recall or 0.0, 4), "build_seconds": built, **times})
    return out


def fastest(runs: DataFrame, least: float = 0.95) -> DataFrame:
    """(documents, nprobe, p50_ms, exact_p50_ms, approximate_wins) of sweep records: at each size the fastest setting of at
    least that recall, ties by the fewer probes; null where none reached it."""
    exact = runs.filter("index = 'exact'").groupBy("documents").agg(F.min("p50_ms").alias("exact_p50_ms"))
    good = runs.filter((F.col("index") != "exact") & (F.col("recall_at_k") >= least)).groupBy("documents").agg(F.min(F.struct("p50_ms", "nprobe")).alias("z"))
    return exact.join(good, "documents", "left").select("documents", F.col("z.nprobe").alias("nprobe"), F.col("z.p50_ms").alias("p50_ms"), "exact_p50_ms", F.coalesce(F.col("z.p50_ms") < F.col("exact_p50_ms"), F.lit(False)).alias("approximate_wins"))


def probe_scores(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, scorer: Callable[[Column, Column], Column], questions: int | None = None, distractors: int = 4, seed: int = 17) -> DataFrame:
    """(question_id, offset, score): the primary answer at offset 0 and `distractors` documents drawn by hashed slots
    behind it; the draw does not leave out the primary answer. With `questions`, the first of them by id."""
    st = Stages(queries.sparkSession)
    docs = st.keep(numbered(corpus.select("answer_id").distinct(), "answer_id"), "positions")
    n = docs.count()
    if n < distractors:
        raise ValueError("fewer documents than distractors")
    gold = qrels.filter("grade = 2").groupBy("question_id").agg(F.min("answer_id").alias("answer_id")).join(corpus.select("answer_id"), "answer_id", "left_semi").join(queries.select("question_id"), "question_id", "left_semi")
    gold = gold if questions is None else gold.orderBy("question_id").limit(questions)
    text = lambda *v: F.conv(F.substring(F.md5(F.concat_ws(":", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in v])), 1, 8), 16, 10).cast("long")
    drawn = gold.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(8 * distractors + 7))).alias("slot")).withColumn("_pos", text(str(seed), F.col("question_id"), F.col("slot")) % n)
    drawn = drawn.join(docs, "_pos").groupBy("question_id", "answer_id").agg(F.min("slot").alias("slot"))
    drawn = drawn.withColumn("offset", F.row_number().over(W.partitionBy("question_id").orderBy("slot"))).filter(F.col("offset") <= distractors)
    rows = gold.withColumn("offset", F.lit(0)).unionByName(drawn.select("question_id", "answer_id", "offset"))
    rows = rows.join(queries.select("question_id", F.col("text").alias("_q")), "question_id").join(corpus.select("answer_id", F.col("text").alias("_d")), "answer_id")
    return rows.select("question_id", "offset", F.round(scorer(F.col("_q"), F.col("_d")), 9).alias("score"))


def probe_summary(scores: DataFrame, distractors: int = 4) -> DataFrame:
    """One row (questions, top_one_accuracy, chance, median_margin): how often the answer scores at least as high as all
    distractors, and by how much in the middle; rounded to four decimals."""
    each = scores.groupBy("question_id").agg(F.max(F.when(F.col("offset") == 0, F.col("score"))).alias("own"), F.max(F.when(F.col("offset") > 0, F.col("score"))).alias("best"))
    win = (F.col("own") >= F.col("best")).cast("double")
    return each.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(win), 4).alias("top_one_accuracy"), F.lit(round(1 / (distractors + 1), 4)).alias("chance"), F.round(F.percentile(F.col("own") - F.col("best"), F.lit(0.5)), 4).alias("median_margin"))
