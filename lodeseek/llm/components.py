"""Problem 2: connected groups by seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.plans.stages import Stages, hot_cold_join


def connected_groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group_id, member) for every id in at least one pair; group_id is the smallest id linked directly or indirectly.

    Each round every vertex offers the minimum of its closed neighbourhood to that neighbourhood. A vertex that nobody
    offers is not a local minimum: it leaves the graph as a child of the smallest offer. The offers to one vertex are
    linked among each other and go on. Seeds that stay flow down the forest, youngest children first.

    Null ids and pairs of an id with itself join nothing; repeated and reversed pairs count once; an empty table gives
    an empty result. Other columns of pairs are ignored. Ids are cast to long.
    """
    spark = pairs.sparkSession
    st = Stages(spark)
    e = pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    g = st.keep(e.union(e.select("v", "u")).distinct(), "g0")
    forests: list[DataFrame] = []
    r = 0
    while not g.isEmpty():
        low = st.keep(g.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("s")), f"low{r}")
        offers = hot_cold_join(g, low, "u").select(F.col("v").alias("x"), "s").union(low.select("u", "s"))
        offers = st.keep(offers.distinct(), f"offers{r}")
        best = st.keep(offers.groupBy("x").agg(F.min("s").alias("r"), F.max((F.col("s") == F.col("x")).cast("int")).alias("own")), f"best{r}")
        forests.append(best.filter("own = 0").select("x", "r"))
        left = hot_cold_join(offers, best.select("x", "r"), "x").filter("s <> r").select(F.col("s").alias("u"), F.col("r").alias("v"))
        r += 1
        g = st.keep(left.union(left.select("v", "u")).distinct(), f"g{r}")
        st.drop(f"low{r - 1}", f"offers{r - 1}", f"g{r - 1}")
    known = None
    for k, f in reversed(list(enumerate(forests))):
        if known is None:
            found = f.select("x", F.col("r").alias("g"))
        else:
            found = hot_cold_join(f, known.select(F.col("x").alias("r"), "g"), "r", "left").select("x", F.coalesce("g", "r").alias("g"))
        found = st.keep(found, f"found{k}")
        known = found if known is None else known.unionByName(found)
        st.drop(f"best{k}")
    if known is None:
        return spark.createDataFrame([], "group_id long, member long")
    seeds = known.select("g").distinct()
    return known.select(F.col("g").alias("group_id"), F.col("x").alias("member")).union(seeds.select("g", "g"))


def duplicate_groups(links: DataFrame, questions: DataFrame) -> DataFrame:
    """(group_id, post_id) of questions joined by links of type 3 between existing questions. Null ids or types join nothing."""
    known = questions.select(F.col("question_id")).filter("question_id is not null").distinct()
    e = links.filter("link_type_id = 3 and post_id <> related_post_id").select("post_id", "related_post_id").distinct()
    e = e.join(known.select(F.col("question_id").alias("post_id")), "post_id", "left_semi")
    e = e.join(known.select(F.col("question_id").alias("related_post_id")), "related_post_id", "left_semi")
    return connected_groups(e, "post_id", "related_post_id").select("group_id", F.col("member").alias("post_id"))
