"""Problem 6: near-duplicate groups by fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.llm.components import connected_groups
from lodeseek.llm.sketch import fingerprints, shingle_sets
from lodeseek.plans.stages import Stages, block_join, hot_cold_join, hot_keys

#: 40 bands of 4 bins: a pair of similarity 0.6 is a candidate with probability 0.996, one of 0.7 with 0.99999.
BANDS, ROWS = 40, 4
#: Ids up to this number are broadcast to filter the texts (16 MB), more are joined.
BROADCAST_IDS = 1_000_000
#: A band with more classes than HOT in a 1/SAMPLE part of them takes its center from a broadcast, others from a window.
SAMPLE, HOT = 64, 20_000
#: Bands in different groups get a further star while the pairs left are more than DENSE x their rows, STARS times at most.
DENSE, STARS = 64, 8


def fingerprint_table(texts: DataFrame, width: int, least: int) -> DataFrame:
    t = texts.filter("id is not null and text is not null").select(F.col("id").cast("long"), "text")
    return t.mapInPandas(fingerprints(width, least, BANDS, ROWS), "id long, code long, bands array<long>")


def verified(st: Stages, name: str, pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of ids whose shingle sets have an intersection of at least num/den of the union."""
    ids = st.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}_ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    t = texts.filter("text is not null").select(F.col("id").cast("long"), "text").join(ids, "id", "left_semi")
    sets = t.mapInPandas(shingle_sets(width), "id long, items array<long>").groupBy("id").agg(F.first("items").alias("items"))
    sets = st.keep(sets, f"{name}_sets")
    # the smaller id of many pairs is the center of a star, whose set must not be copied into one task
    half = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    half = st.keep(half, f"{name}_half")
    both = hot_cold_join(half, sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a", least=10_000)
    n = F.size(F.array_intersect("x", "y"))
    return both.filter(n * den >= (F.size("x") + F.size("y") - n) * num).select("a", "b")


def near_duplicate_groups(texts: DataFrame, width: int = 5, num: int = 4, den: int = 5, least: int | None = None) -> DataFrame:
    """(group_id, record_id) of every record whose text is near another's, also indirectly; group_id is the smallest id.

    texts: id, text; other columns are ignored. Two texts are near if both have at least `least` words (width by default)
    and their sets of `width` successive words have a Jaccard similarity of num/den or more. Texts with the same words
    become one class first. Classes that share a band are candidates: every class of a band is verified against the
    band's smallest class; bands whose members are then in different groups get further centers while many pairs are
    left, then verify all pairs across those groups in blocks, so no pair that shares a band is lost. Null ids and null, empty or short texts have no row; repeated rows
    count once; an empty table gives an empty result; long texts are read whole.
    """
    st = Stages(texts.sparkSession)
    prints = st.keep(fingerprint_table(texts, width, width if least is None else least), "prints")
    ids = prints.select("id", "code").distinct()
    classes = st.keep(ids.groupBy("code").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")

    rows = prints.select("code", F.explode("bands").alias("band"))
    sample = prints.filter(F.pmod(F.xxhash64("code"), F.lit(SAMPLE)) == 0).select(F.explode("bands").alias("band"))
    hot = [b for (b,) in hot_keys(sample, ["band"], HOT)]
    is_hot = F.col("band").isin(hot) if hot else F.lit(False)
    w = W.partitionBy("band").orderBy("code")
    cold = rows.filter(~is_hot).withColumn("center", F.first("code").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("before", F.lag("code").over(w))
    mates = cold.filter("code <> center and code <> before").select("band", "center", "code")
    if hot:
        centers = rows.filter(is_hot).groupBy("band").agg(F.min("code").alias("center"))
        mates = mates.unionByName(rows.filter(is_hot).join(F.broadcast(centers), "band").filter("code <> center").select("band", "center", "code").distinct())
    mates = st.keep(mates, "mates")

    def ids_of(pairs: DataFrame) -> DataFrame:
        c = classes.select("code", "rep")
        p = pairs.join(c.select(F.col("code").alias("c1"), F.col("rep").alias("a")), "c1")
        return p.join(c.select(F.col("code").alias("c2"), F.col("rep").alias("b")), "c2").select("a", "b")

    stars = st.keep(ids_of(mates.select(F.col("center").alias("c1"), F.col("code").alias("c2")).distinct()), "stars")
    edges = st.keep(verified(st, "star", stars, texts, width, num, den), "edges")
    groups = st.keep(connected_groups(edges, "a", "b"), "groups")
    members = mates.select("band", "code").unionByName(mates.select("band", F.col("center").alias("code")).distinct())
    members = st.keep(members, "members")
    for r in range(STARS + 1):
        # bands with members in different groups
        side = classes.select("code", "rep").join(groups.withColumnRenamed("member", "rep"), "rep", "left").select("code", F.coalesce("group_id", "rep").alias("g"))
        named = st.keep(members.join(side, "code"), f"named{r}")
        mixed = named.groupBy("band").agg((F.min("g") != F.max("g")).alias("mixed")).filter("mixed").select("band")
        members = st.keep(hot_cold_join(named, mixed, "band"), f"open{r}")
        st.drop(f"named{r}", *([f"open{r - 1}"] if r else []))
        n, pairs = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not n:
            break
        last = r == STARS or pairs <= DENSE * n
        if last:  # all pairs across groups
            x, y = members.select("band", F.col("code").alias("c1"), F.col("g").alias("g1")), members.select("band", F.col("code").alias("c2"), F.col("g").alias("g2"))
            rest = block_join(x, y, "band").filter("c1 < c2 and g1 <> g2").select("c1", "c2").distinct()
        else:  # a new center, compared with all other groups
            centers = members.groupBy("band").agg(F.min_by(F.struct("code", "g"), F.xxhash64("code", F.lit(r))).alias("z")).select("band", F.col("z.code").alias("c2"), F.col("z.g").alias("g2"))
            rest = hot_cold_join(members, centers, "band").filter("g <> g2").select(F.col("c2").alias("c1"), F.col("code").alias("c2")).distinct()
        rest = st.keep(ids_of(rest), f"rest{r}")
        more = st.keep(verified(st, f"rest{r}", rest, texts, width, num, den), f"more{r}") if not rest.isEmpty() else None
        if more is not None and not more.isEmpty():
            edges = edges.unionByName(more)
            groups = st.keep(connected_groups(edges, "a", "b"), f"groups{r}")
        if last:
            break
        members = members.select("band", "code")
    found = hot_cold_join(ids, classes, "code").join(groups.withColumnRenamed("member", "rep"), "rep", "left")
    return found.filter("n > 1 or group_id is not null").select(F.coalesce("group_id", "rep").alias("group_id"), F.col("id").alias("record_id"))
