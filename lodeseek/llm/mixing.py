"""Problem 8: mixing sources to target weights by hash-seeded Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.tokens import DEFAULT, token_counts
from lodeseek.plans.stages import Stages, parts

#: Seeds tried with each of FACTORS x the rate; of each source the draw counts that comes nearest to the target. Where a few
#: long documents hold most tokens, draws at the mean's rate mostly lack them and fall short, which a larger rate makes up for.
DRAWS, FACTORS = 20, tuple(2 ** (k / 6) for k in range(-3, 7))


def distribution(rate: float, top: int) -> list[float]:
    """P(X <= 0), P(X <= 1), ... of a Poisson number, at most `top` values and none after one that is 1 in double."""
    term, acc, out = math.exp(-rate), 0.0, []
    for j in range(top):
        acc += term
        term *= rate / (j + 1)
        out.append(min(acc, 1.0))
        if j > rate and term < 1e-18:
            break
    return out


def mean_uses(rate: float, top: int) -> float:
    """The mean of a Poisson number that is cut at `top`."""
    return sum(1 - p for p in distribution(rate, top))


def rate_for(mean: float, top: int) -> float:
    """The rate whose mean of uses is `mean`, below `top`."""
    lo, hi = 0.0, 64.0 + 8.0 * top
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean_uses(mid, top) < mean else (lo, mid)
    return hi


def uses(draw: Column) -> Column:
    """How often a document is used: its uniform number, a hash of its id and the draw, inverted through its source's
    distribution. JVM-side; needs doc_id, cdf, full, max_repeats."""
    u = (F.pmod(F.xxhash64("doc_id", draw), F.lit(2**52)) + F.lit(0.5)) / F.lit(float(2**52))
    return F.when(F.col("full"), F.col("max_repeats")).otherwise(F.size(F.filter("cdf", lambda p: u > p)))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str = DEFAULT, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows, shares). rows: doc_id, source, copy, n_tokens, in globally shuffled order (position_key ascending).
    shares: source, target_share, actual_share, documents, copies, tokens, available_tokens, max_repeats.

    A document's uniform number is a hash of its id and a seed; inverted through the Poisson distribution, cut at
    max_repeats, it says how often the document is used. A source's rate is one for all its documents, near the one at which
    the mean of uses times its tokens is its target, so a document's chance does not depend on its length. Of DRAWS seeds
    and FACTORS of that rate each source takes the draw that has the tokens nearest to the target. Uses are counted
    before documents are repeated. The target total is
    total_tokens or, by default, the most at which every source with documents can meet its weight within max_repeats.
    With a larger total, sources at their cap use each document max_repeats times and fall short, which the shares show.
    Sources without documents or weight contribute nothing and the weights of the others are rescaled. Documents with null
    id, null source, an unlisted source or no token are left out; repeated ids count once. Null or non-positive weights
    and repeats exclude a source; of repeated targets the largest weight counts.
    """
    spark = documents.sparkSession
    st = Stages(spark)
    t = targets.filter("source is not null and target_weight > 0 and not isnan(target_weight) and max_repeats > 0").groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("m")).select("source", "m.*")
    few = t.count() <= 100_000
    small = F.broadcast if few else (lambda df: df)
    d = documents.filter("doc_id is not null and text <> ''").select("doc_id", "source", "text").join(small(t.select("source")), "source", "left_semi")
    d = d.mapInPandas(token_counts(tokenizer), "doc_id long, source string, n_tokens long").filter("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", "m.source", "m.n_tokens")
    d = st.keep(d, "sized")
    have = d.groupBy("source").agg(F.sum("n_tokens").alias("available")).join(small(t), "source").collect()  # a row per listed source
    weight = sum(r["target_weight"] for r in have)
    total = total_tokens if total_tokens is not None else min([r["available"] * r["max_repeats"] / (r["target_weight"] / weight) for r in have], default=0)
    plan = []
    for r in have:
        want, top = total * r["target_weight"] / weight, int(r["max_repeats"])
        whole = want >= r["available"] * top * (1 - 1e-12)
        rate = 0.0 if whole else rate_for(want / r["available"], top)
        cdfs = [] if whole else [distribution(rate * f, top) for f in FACTORS]
        plan.append((r["source"], float(want), whole, cdfs, top, r["target_weight"] / weight, int(r["available"])))
    plan = st.keep(spark.createDataFrame(plan, "source string, want double, full boolean, cdfs array<array<double>>, max_repeats int, target_share double, available_tokens long"), "plan")
    # sized rows are few bytes, trying them is work: spread over all tasks
    sized = d.repartition(parts(spark), "doc_id").join(small(plan), "source")
    tried = sized.filter("not full").select("source", "want", "n_tokens", "doc_id", "full", "max_repeats", F.posexplode("cdfs").alias("factor", "cdf"))
    tried = tried.withColumn("draw", F.explode(F.sequence(F.lit(seed), F.lit(seed + DRAWS - 1))))
    tokens = tried.groupBy("source", "want", "factor", "draw").agg(F.sum(F.col("n_tokens") * uses(F.col("draw"))).alias("n"))
    nearest = tokens.groupBy("source").agg(F.min(F.struct(F.abs(F.col("n") - F.col("want")).alias("off"), "draw", "factor")).alias("m")).select("source", F.col("m.draw").alias("draw"), F.col("m.factor").alias("factor"))
    plan = plan.join(nearest, "source", "left").fillna(seed, ["draw"]).withColumn("cdf", F.coalesce(F.get("cdfs", F.col("factor")), F.array().cast("array<double>"))).drop("cdfs", "factor")
    plan = st.keep(plan, "drawn")
    chosen = d.join(small(plan), "source").withColumn("uses", uses(F.col("draw"))).filter("uses > 0").select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"))
    chosen = chosen.withColumn("position_key", F.xxhash64("doc_id", "copy", F.lit(seed - 1)))
    chosen = st.keep(chosen.select("doc_id", "source", "copy", "n_tokens", "position_key").repartitionByRange("position_key").sortWithinPartitions("position_key", "doc_id", "copy"), "chosen")
    got = chosen.groupBy("source").agg(F.sum((F.col("copy") == 1).cast("int")).alias("documents"), F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"))
    all_tokens = chosen.agg(F.sum("n_tokens")).first()[0] or 0
    shares = plan.select("source", "target_share", "available_tokens", "max_repeats").join(got, "source", "left").fillna(0, ["documents", "copies", "tokens"])
    ratio = F.col("tokens") / F.lit(float(all_tokens)) if all_tokens else F.lit(0.0)
    return chosen, shares.withColumn("actual_share", ratio)


def mixing_checks(rows: DataFrame, shares: DataFrame, most: float = 0.01) -> DataFrame:
    """(name, n): what must hold of a mixture whose total every source can meet, counted."""
    used = rows.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("used"), F.max("copy").alias("last"))
    used = used.join(F.broadcast(shares.select("source", "max_repeats")) if shares.limit(100_001).count() <= 100_000 else shares.select("source", "max_repeats"), "source", "left")
    parts = {"sources": shares, "documents used too often": used.filter("max_repeats is null or used > max_repeats"), "documents with copies numbered wrongly": used.filter("used <> last"), "sources off their share": shares.filter(F.abs(F.col("actual_share") - F.col("target_share")) > most)}
    out = None
    for name, d in parts.items():
        row = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
