"""Problem 1: splits that keep related records together, by grouped iterative stratification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.components import connected_groups
from lodeseek.llm.overlap import unified_split
from lodeseek.plans.stages import Stages, hot_cold_join

SPLITS = ("train", "val", "test")
#: Components in a block that one task places.
BLOCK = 2048
#: Labels with at most FIRST outstanding records are placed in the first round, with STEP times as many in each further one.
FIRST, STEP = 16, 4
#: The label that every record has.
ALL = "*"


def whole(total: float, shares: np.ndarray, seed: str) -> np.ndarray:
    """Whole numbers near total x shares that sum to total; the hashed offset makes them right on average over blocks."""
    u = xxhash.xxh3_64_intdigest(seed) / 2**64
    edges = np.floor(np.concatenate([[0.0], np.cumsum(shares) * total]) + u)
    edges[-1] = edges[0] + total
    return np.diff(edges)


def place(pdf: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas of a block of a label's components (comp, n of the label, size; f: shares that the splits still need of
    the label, g: of all records): the largest first, each to the split that needs the label most, then records most. Of
    the splits whose need it does not exceed the largest share of the target still open counts, so that large components
    do not all go to the largest split; if it exceeds all needs, the largest need counts."""
    pdf = pdf.sort_values(["n", "size", "comp"], ascending=[False, False, True], ignore_index=True)
    row, seed = pdf.iloc[0], f"{pdf['label'].iloc[0]}:{pdf['block'].iloc[0]}"
    need = whole(float(pdf["n"].sum()), np.array([row["f0"], row["f1"], row["f2"]]), seed)
    records = float(pdf["size"].sum()) * np.array([row["g0"], row["g1"], row["g2"]])
    target, wanted, out = need.clip(min=1e-9), records.clip(min=1e-9), []
    for n, size in zip(pdf["n"], pdf["size"]):
        fits = [i for i in range(3) if need[i] >= n]
        if fits:
            k = max(fits, key=lambda i: (need[i] / target[i], records[i] / wanted[i], need[i], -i))
        else:
            k = max(range(3), key=lambda i: (need[i], records[i], -i))
        out.append(SPLITS[k])
        need[k] -= n
        records[k] -= size
    return pd.DataFrame({"comp": pdf["comp"], "split": out})


def _needs(totals: DataFrame, taken: DataFrame, shares: tuple[float, float, float]) -> DataFrame:
    """(label, f0, f1, f2): what each split still needs of a label, as shares."""
    d = totals.join(taken, "label", "left")
    for k, s in enumerate(shares):
        d = d.withColumn(f"w{k}", F.greatest(F.lit(0.0), F.col("total") * F.lit(s / sum(shares)) - F.coalesce(F.col(SPLITS[k]), F.lit(0))))
    w = F.col("w0") + F.col("w1") + F.col("w2")
    return d.select("label", *[F.when(w > 0, F.col(f"w{k}") / w).otherwise(F.lit(s / sum(shares))).alias(f"f{k}") for k, s in enumerate(shares)])


def stratified(st: Stages, vectors: DataFrame, shares: tuple[float, float, float]) -> DataFrame:
    """(comp, split) of components with label vectors (comp, label, n), label ALL counting their records.

    Iterative stratification in rounds that run in parallel: round by round the labels of the next frequency class, by
    the records outstanding, place the components that hold one, each for its rarest label; what they take of every label
    is known before the next round. A label's components are placed in blocks of about BLOCK, whose whole-number targets
    are drawn by hash so that they are right over all blocks. Components so large that a few fill a split go first, to
    the split that needs records most."""
    vectors = st.keep(vectors, "vectors0")
    totals = st.keep(vectors.groupBy("label").agg(F.sum("n").alias("total")), "totals")
    all_n = totals.filter(F.col("label") == ALL).select("total").first()
    if all_n is None:
        return vectors.select("comp", F.lit(None).cast("string").alias("split")).limit(0)
    schema = "comp long, split string"
    taken = vectors.sparkSession.createDataFrame([], "label string, train long, val long, test long")
    done: list[DataFrame] = []
    largest = totals.filter(F.col("label") != ALL).agg(F.max("total")).first()[0] or 0
    limits = [0]  # the round of the largest components
    while limits[-1] < largest:
        limits.append(FIRST if len(limits) == 1 else limits[-1] * STEP)
    sizes = vectors.filter(F.col("label") == ALL).select("comp", F.col("n").alias("size"))
    for r, limit in enumerate([*limits, None]):  # the last round takes components without a label
        needs = st.keep(_needs(totals, taken, shares), f"needs{r}")
        over = needs.filter(F.col("label") == ALL).first()
        if r == 0:  # at most 64 / the least share components
            least = max(2, all_n[0] * min(x for x in shares if x > 0) / sum(shares) / 64)
            group = sizes.filter(F.col("size") >= least).select("comp", F.lit(ALL).alias("label"), F.col("size").alias("n"), "size").withColumn("block", F.lit(0).cast("long"))
        else:
            if limit is None:
                held = vectors.filter(F.col("label") == ALL).select("comp", "label", "n")
            else:
                rare = vectors.filter(F.col("label") != ALL).groupBy("label").agg(F.sum("n").alias("left")).filter(F.col("left") <= limit)
                held = hot_cold_join(vectors, rare, "label").groupBy("comp").agg(F.min(F.struct("left", F.xxhash64("label"), "label", "n")).alias("z")).select("comp", "z.label", "z.n")
            held = st.keep(held.join(vectors.filter(F.col("label") == ALL).select("comp", F.col("n").alias("size")), "comp"), f"held{r}")
            blocks = held.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
            group = hot_cold_join(held, blocks, "label").withColumn("block", F.pmod(F.xxhash64("comp"), F.col("blocks"))).drop("blocks")
        group = hot_cold_join(group, needs, "label")
        for k in range(3):
            group = group.withColumn(f"g{k}", F.lit(float(over[f"f{k}"])))
        placed = st.keep(group.groupBy("label", "block").applyInPandas(place, schema), f"placed{r}")
        done.append(placed)
        both = st.keep(vectors.join(placed, "comp", "left"), f"round{r}")
        now = both.filter("split is not null").groupBy("label").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in SPLITS])
        taken = st.keep(taken.unionByName(now).groupBy("label").agg(*[F.sum(s).alias(s) for s in SPLITS]), f"taken{r}")
        vectors = both.filter("split is null").drop("split")
        st.drop(f"needs{r}", *([f"round{r - 1}", f"taken{r - 1}"] if r else []), *([f"held{r}"] if r else []))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def grouped_split(records: DataFrame, owners: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(record, component, split, delivered, labels): a split for every record, the same for all records linked through owners.

    records: record, labels array<string>, delivered; owners: record, owner. Records that share an owner, also indirectly,
    form a component; see stratified for their placement. Repeated rows count once; null records are left out; null
    owners link nothing; null labels count as none; an empty table gives no rows.
    """
    st = Stages(records.sparkSession)
    recs = st.keep(records.filter("record is not null").groupBy("record").agg(F.first("labels", True).alias("labels"), F.first("delivered", True).alias("delivered")), "records")
    pairs = st.keep(owners.filter("record is not null and owner is not null").select("record", "owner").distinct().join(recs.select("record"), "record", "left_semi"), "pairs")
    heads = pairs.groupBy("owner").agg(F.min("record").alias("head"))
    groups = connected_groups(hot_cold_join(pairs, heads, "owner"), "record", "head")
    recs = recs.join(groups.withColumnRenamed("member", "record"), "record", "left").withColumn("comp", F.coalesce("group_id", "record")).drop("group_id")
    recs = st.keep(recs.withColumn("labels", F.array_distinct(F.coalesce(F.array_compact("labels"), F.array().cast("array<string>")))), "grouped")
    labels = F.array_distinct(F.concat(F.array(F.lit(ALL)), "labels"))
    vectors = recs.select("comp", F.explode(labels).alias("label")).groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    out = hot_cold_join(recs, stratified(st, vectors, shares), "comp")
    return st.keep(out.select("record", F.col("comp").alias("component"), "split", "delivered", "labels"), "split")


def question_split(queries: DataFrame, questions: DataFrame) -> DataFrame:
    labels = F.concat(F.coalesce(F.transform("tags", lambda t: F.concat(F.lit("tag:"), t)), F.array().cast("array<string>")), F.array(F.concat(F.lit("src:"), F.col("label_source"))))
    recs = queries.select(F.col("question_id").alias("record"), labels.alias("labels"), unified_split(F.col("split")).alias("delivered"))
    return grouped_split(recs, questions.select(F.col("question_id").alias("record"), F.col("owner_user_id").alias("owner")))


def split_shares(split: DataFrame) -> DataFrame:
    """(split, records, components, share)."""
    n = split.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("component").alias("components"))
    return n.crossJoin(F.broadcast(split.agg(F.count(F.lit(1)).alias("_all")))).select("split", "records", "components", (F.col("records") / F.col("_all")).alias("share"))  # one row


def label_shares(split: DataFrame) -> DataFrame:
    """(label, records, train, val, test): of every label its records and the share of each split in them."""
    d = split.select("split", F.explode("labels").alias("label"))
    return d.groupBy("label").agg(F.count(F.lit(1)).alias("records"), *[F.avg((F.col("split") == s).cast("int")).alias(s) for s in SPLITS])


def owner_audit(split: DataFrame, owners: DataFrame) -> DataFrame:
    """(owner, delivered_splits, assigned_splits) of every owner (record, owner) with a delivered record: in how many splits
    its records were delivered and in how many they are now."""
    own = owners.filter("record is not null and owner is not null").select("record", "owner").distinct()
    d = own.join(split.filter("delivered is not null").select("record", "split", "delivered"), "record")
    n = lambda c: F.size(F.collect_set(c))  # noqa: E731 - of three at most
    return d.groupBy("owner").agg(n("delivered").alias("delivered_splits"), n("split").alias("assigned_splits"))


def torn_owners(split: DataFrame, questions: DataFrame) -> DataFrame:
    """(owner_user_id): owners whose records were delivered in two or more splits and are in one now, by the audit."""
    audit = owner_audit(split, questions.select(F.col("question_id").alias("record"), F.col("owner_user_id").alias("owner")))
    return audit.filter("delivered_splits >= 2 and assigned_splits = 1").select(F.col("owner").alias("owner_user_id"))


def split_checks(split: DataFrame, questions: DataFrame, shares: tuple[float, float, float] = (0.8, 0.1, 0.1), bound: float = 0.02) -> DataFrame:
    """(name, n): what must hold of an assignment, counted."""
    audit = owner_audit(split.withColumn("delivered", F.coalesce("delivered", F.lit("none"))), questions.select(F.col("question_id").alias("record"), F.col("owner_user_id").alias("owner")))
    target = F.create_map(*[F.lit(x) for s, v in zip(SPLITS, shares) for x in (s, v / sum(shares))])
    n = F.count(F.lit(1)).alias("n")
    off = split_shares(split).filter(F.abs(F.col("share") - target[F.col("split")]) > bound)
    # of frequent labels the deviation of a share is bounded, rare ones have too few records for it
    labels = label_shares(split).filter("records >= 1000").filter(" or ".join(f"abs({s} - {v / sum(shares)}) > {bound}" for s, v in zip(SPLITS, shares)))
    parts = {"records": split, "records without a split": split.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))), "owners in several splits": audit.filter("assigned_splits > 1"), "splits off their share": off, "labels off their shares": labels}
    out = None
    for name, d in parts.items():
        row = d.agg(n).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
