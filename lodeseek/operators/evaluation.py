"""Ranking metrics, paired bootstrap and descriptive statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import word_count
from lodeseek.plans.stages import numbered

METRICS = ("ndcg_at_10", "mrr_at_10", "recall_at_10", "recall_at_100", "graded_ndcg_at_10")


def per_query_metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row per judged query, zeros where nothing was found. qrels: query_id, doc_id, grade; unique pairs. Strict metrics
    count grades from 2 as relevant."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    disc = lambda r: F.log2(r + 1.0)
    q = qrels.withColumn("strict", (F.col("grade") >= 2).cast("int"))
    ideal_rank = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "doc_id"))
    q = q.withColumn("_i", ideal_rank("grade")).join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    rank, top = F.col("rank"), F.col("rank") <= 10
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    g = q.groupBy("query_id").agg(
        F.sum("strict").alias("n"),
        total(F.when(top, F.col("strict") / disc(rank))).alias("dcg"),
        total(F.when(F.col("_i") <= 10, F.col("strict") / disc(F.col("_i")))).alias("idcg"),
        total(F.when(top, gain(F.col("grade")) / disc(rank))).alias("gdcg"),
        total(F.when(F.col("_i") <= 10, gain(F.col("grade")) / disc(F.col("_i")))).alias("gidcg"),
        F.min(F.when(top & (F.col("strict") == 1), rank)).alias("first"),
        F.count(F.when(top & (F.col("strict") == 1), 1)).alias("h10"),
        F.count(F.when((rank <= 100) & (F.col("strict") == 1), 1)).alias("h100"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return g.select("query_id", share("dcg", "idcg").alias("ndcg_at_10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_at_10"), share("h10", "n").alias("recall_at_10"), share("h100", "n").alias("recall_at_100"), share("gdcg", "gidcg").alias("graded_ndcg_at_10"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(*[F.round(F.avg(m), 9).alias(m) for m in METRICS], F.count(F.lit(1)).alias("queries"))


def _check(iterations: int, confidence: float) -> None:
    if iterations < 1 or not 0 < confidence < 1:
        raise ValueError("iterations must be positive and confidence between 0 and 1")


def _paired(baseline: DataFrame, candidate: DataFrame, metric: str) -> DataFrame:
    return baseline.select("query_id", F.col(metric).alias("a")).join(candidate.select("query_id", F.col(metric).alias("b")), "query_id", "full")


def paired_bootstrap(baseline: DataFrame, candidate: DataFrame, metric: str, iterations: int = 10_000, seed: int = 17, confidence: float = 0.95, most: int = 10_000_000) -> dict:
    """Interval and p-value of the mean difference; both runs must judge the same queries. The resamples are centred on their
    own mean for the p-value. Draws are numpy's for a seed, so a number a query goes to the driver, `most` at most; see
    bootstrap_table for more."""
    _check(iterations, confidence)
    pairs = _paired(baseline, candidate, metric)
    if pairs.count() > most:
        raise ValueError("more queries than the driver takes: use bootstrap_table")
    both = pairs.orderBy("query_id").toPandas()
    if not len(both) or both[["a", "b"]].isna().to_numpy().any():
        raise ValueError("the runs cover different queries or none")
    d = (both["b"] - both["a"]).to_numpy()
    rng = np.random.default_rng(seed)
    step = max(1, 2**24 // len(d))
    means = np.concatenate([d[rng.integers(0, len(d), (min(step, iterations - s), len(d)))].mean(1) for s in range(0, iterations, step)])
    lo, hi = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    p = float((np.abs(means - means.mean()) >= abs(d.mean())).mean())
    return {"metric": metric, "baseline_mean": float(both["a"].mean()), "candidate_mean": float(both["b"].mean()), "mean_difference": float(d.mean()), "confidence": confidence, "ci_low": float(lo), "ci_high": float(hi), "p_value": p, "iterations": iterations, "queries": len(d), "significant": bool(lo > 0 or hi < 0)}


def bootstrap_table(baseline: DataFrame, candidate: DataFrame, metric: str, iterations: int = 10_000, seed: int = 17, confidence: float = 0.95) -> DataFrame:
    """The same as one row, for any number of queries: resampled positions come from hashes, nothing is collected. Numbers
    are rounded to 9 decimals."""
    _check(iterations, confidence)
    pairs = numbered(_paired(baseline, candidate, metric), "query_id")
    total = pairs.agg(F.count(F.lit(1)).alias("n"), F.count(F.col("a") + F.col("b")).alias("whole")).first()
    if not total["n"] or total["whole"] < total["n"]:
        raise ValueError("the runs cover different queries or none")
    n, spark = total["n"], baseline.sparkSession
    d = pairs.select(F.col("_pos").alias("pos"), (F.col("b") - F.col("a")).alias("d"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % n
    draws = spark.range(iterations).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("id", draw.alias("pos"))
    means = draws.join(F.broadcast(d) if n <= 1_000_000 else d, "pos").groupBy("id").agg(F.avg("d").alias("m"))
    seen = pairs.agg(F.avg("a").alias("baseline_mean"), F.avg("b").alias("candidate_mean"), F.avg(F.col("b") - F.col("a")).alias("mean_difference"))
    stats = means.agg(F.avg("m").alias("center"), *[F.percentile("m", F.lit(x)).alias(c) for c, x in (("ci_low", (1 - confidence) / 2), ("ci_high", (1 + confidence) / 2))])
    row = means.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(seen))  # a row each
    away = F.round(F.abs(F.col("m") - F.col("center")), 12) >= F.round(F.abs(F.col("mean_difference")), 12)
    names = ("baseline_mean", "candidate_mean", "mean_difference", "ci_low", "ci_high")
    out = row.groupBy(*names).agg(F.avg(away.cast("double")).alias("p_value"))
    return out.select(*[(F.round(c, 9) + 0.0).alias(c) for c in names], F.round("p_value", 9).alias("p_value"), F.lit(n).cast("long").alias("queries"), ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"))


def text_stats(df: DataFrame, column: str) -> DataFrame:
    """Count, median and 90 % quantile of characters and words, cut to integers."""
    c: Column = F.coalesce(F.col(column), F.lit(""))
    d = df.select(F.length(c).alias("chars"), word_count(c).alias("words"))
    # values with their counts first, so that no task gets a row per text
    sizes = d.select(F.explode(F.array(F.struct(F.lit("chars").alias("k"), F.col("chars").alias("v")), F.struct(F.lit("words").alias("k"), F.col("words").alias("v")))).alias("z")).groupBy("z.k", "z.v").agg(F.count(F.lit(1)).alias("n"))
    q = lambda x, p: F.percentile(F.when(F.col("k") == x, F.col("v")), F.lit(p), F.col("n")).cast("int")
    count = F.coalesce(F.sum(F.when(F.col("k") == "chars", F.col("n"))), F.lit(0))
    return sizes.agg(count.alias("count"), q("chars", 0.5).alias("chars_p50"), q("chars", 0.9).alias("chars_p90"), q("words", 0.5).alias("words_p50"), q("words", 0.9).alias("words_p90"))


def count_summary(rows: DataFrame, key: str) -> DataFrame:
    """One row (rows, groups, least, median, most): how many rows a group has; the median cut to an integer."""
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("groups"), F.min("c").alias("least"), F.percentile("c", F.lit(0.5), F.col("n")).cast("long").alias("median"), F.max("c").alias("most"))


def latency_summary(times: DataFrame) -> DataFrame:
    """(stage, p50, p95, total, calls) of (stage, ms)."""
    return times.groupBy("stage").agg(F.percentile("ms", F.lit(0.5)).alias("p50"), F.percentile("ms", F.lit(0.95)).alias("p95"), F.sum("ms").alias("total"), F.count(F.lit(1)).alias("calls"))
