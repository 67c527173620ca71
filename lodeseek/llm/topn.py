"""Problem 5: the top N items of every group by a hot-cold split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.plans.stages import hot_keys, parts


def top_per_group(rows: DataFrame, keys: list[str], item: str, score: str, n: int = 10, least: int = 10_000) -> DataFrame:
    """keys, item, score, rank of the n best distinct items of each group: highest score first, then the smaller item.

    Exact group counts name the heavy groups (over `least` rows; see hot_keys for their bound). Their rows are salted,
    range-sorted by (group, salt), cut to n a salt and merged; light groups take one window. Null and NaN scores and null
    items do not count; an item counts once with its highest score; null keys form a group like any other; an empty
    table gives an empty result; other columns are left out.
    """
    spark = rows.sparkSession
    ok = rows.filter(F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(*keys, item, score)
    hot = hot_keys(ok, keys, least)
    order = [F.desc(score), F.asc(item)]

    def cut(df: DataFrame, by: list[str]) -> DataFrame:
        return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= n)

    best = lambda df, by: df.groupBy(*by, item).agg(F.max(score).alias(score))
    if hot:
        named = F.broadcast(spark.createDataFrame(hot, ok.select(*keys).schema).select(*[F.col(k).alias(f"_h{k}") for k in keys]))
        match = [F.col(k).eqNullSafe(F.col(f"_h{k}")) for k in keys]
        salts = parts(spark)
        h = ok.join(named, match, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)).cast("int"))
        h = h.repartitionByRange(salts, *keys, "_salt")
        h = cut(best(h, [*keys, "_salt"]), [*keys, "_salt"]).drop("_r", "_salt")
        light = ok.join(named, match, "left_anti")
        out = cut(best(light.repartition(*keys), keys), keys).unionByName(cut(h, keys))
    else:
        out = cut(best(ok.repartition(*keys), keys), keys)
    return out.withColumnRenamed("_r", "rank")
