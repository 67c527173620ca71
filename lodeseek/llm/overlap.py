"""Problem 3: records of evaluation splits that recur in the training split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.neardup import fingerprint_table, verified
from lodeseek.llm.sketch import codes_of
from lodeseek.plans.stages import Stages, block_join, hot_cold_join


def unified_split(c: Column) -> Column:
    """train, val or test whatever the spelling; null for anything else."""
    s = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(s.isin("train", "training"), "train").when(s.isin("val", "validation", "valid", "dev"), "val").when(s.isin("test", "testing"), "test")


def canonical(c: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one blank, outer blanks removed; null if nothing is left."""
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    return F.when(s != "", s)


IS_TRAIN, IS_EVAL = "split = 'train'", "split <> 'train'"


class Overlaps:
    """What the pairs and their counts rest on. records: id, title, text, split, label_source, distinct; titles: (id, split,
    label_source, h, t); reps: (id, split, label_source, code, rep) of texts, rep the smallest id of equal words; class_pairs
    (a, b): classes of evaluation and training texts that are near-same, or one class of both."""

    def __init__(self, queries: DataFrame, width: int, num: int, den: int, least: int):
        st = self.stages = Stages(queries.sparkSession)
        q = queries.select(F.col("question_id").cast("long").alias("id"), "title", "text", unified_split(F.col("split")).alias("split"), "label_source").filter("id is not null and split is not null")
        q = self.records = st.keep(q.dropDuplicates(), "records")
        self.titles = q.select("id", "split", "label_source", canonical(F.col("title")).alias("t")).filter("t is not null").withColumn("h", F.xxhash64("t"))
        prints = st.keep(fingerprint_table(q.select("id", "text").distinct(), width, least), "prints")
        held = prints.select("id", "code").distinct().join(q.select("id", "split", "label_source").distinct(), "id")
        held = st.keep(held, "held")
        kinds = held.groupBy("code").agg(F.min("id").alias("rep"), F.max(F.expr(f"int({IS_EVAL})")).alias("ev"), F.max(F.expr(f"int({IS_TRAIN})")).alias("tr"))
        kinds = st.keep(kinds, "kinds")
        bands = hot_cold_join(prints, kinds, "code").filter("id = rep").select("rep", "ev", "tr", F.explode("bands").alias("band"))
        bands = st.keep(bands, "bands")
        cand = block_join(bands.filter("ev = 1").select("band", F.col("rep").alias("a")), bands.filter("tr = 1").select("band", F.col("rep").alias("b")), "band").filter("a <> b").select("a", "b").distinct()
        near = verified(st, "near", st.keep(cand, "cand"), q.select("id", "text"), width, num, den)
        same = kinds.filter("ev = 1 and tr = 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
        self.class_pairs = st.keep(near.union(same), "class_pairs")
        self.reps = st.keep(hot_cold_join(held, kinds.select("code", "rep"), "code"), "reps")


def split_overlaps(queries: DataFrame, width: int = 3, num: int = 3, den: int = 5, least: int = 20) -> DataFrame:
    """(eval_id, train_id, eval_split, label_source, kind): pairs across the splits with equal titles or near-same texts.

    Titles and texts are hashed after normalisation of case, punctuation and blanks; evaluation hashes meet training
    hashes and equality is checked on what was hashed. Texts with small edits have no equal hash, so the bands of their
    shingle sketches are joined as well and verified exactly. label_source is the evaluation record's. A record with
    null split, title or text takes no part in what needs it; repeated rows count once; an empty table gives no rows.
    """
    o = Overlaps(queries, width, num, den, least)
    ev = o.titles.filter(IS_EVAL).select(F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), "label_source", "h", F.col("t").alias("t1"))
    tr = o.titles.filter(IS_TRAIN).select(F.col("id").alias("train_id"), "h", F.col("t").alias("t2")).distinct()
    titles = block_join(ev, tr, "h").filter("t1 = t2").select("eval_id", "train_id", "eval_split", "label_source", F.lit("title").alias("kind"))
    left = o.reps.filter(IS_EVAL).select(F.col("rep").alias("a"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), "label_source")
    right = o.reps.filter(IS_TRAIN).select(F.col("rep").alias("b"), F.col("id").alias("train_id"))
    some = o.stages.keep(block_join(o.class_pairs, left, "a"), "eval_pairs")
    texts = block_join(some, right, "b").select("eval_id", "train_id", "eval_split", "label_source", F.lit("text").alias("kind"))
    return titles.union(texts).filter("eval_id <> train_id").distinct()


def found(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(F.least("eval_id", "train_id").alias("question_id_a"), F.greatest("eval_id", "train_id").alias("question_id_b")).distinct()


def overlap_counts(queries: DataFrame, width: int = 3, num: int = 3, den: int = 5, least: int = 20) -> DataFrame:
    """(eval_split, label_source, records, pairs): evaluation records with an overlap and overlapping pairs, by split and
    source, without listing the pairs: a group of records of one title and text class has as many partners as training
    records have its title, or a text near its own, less those with both. An id with several different rows in a split
    counts for each in pairs. Equal titles are taken from a 128-bit hash."""
    o = Overlaps(queries, width, num, den, least)
    st, n = o.stages, F.count(F.lit(1))
    title = F.md5(canonical(F.col("title")))
    rows = o.records.select("id", "split", "label_source", title.alias("h"), "text")
    codes = o.records.select("id", F.xxhash64("text").alias("text_key"), "text").distinct().filter("text is not null").mapInPandas(codes_of(width, least), "id long, text_key long, code long")
    rows = rows.withColumn("text_key", F.xxhash64("text")).join(codes.distinct(), ["id", "text_key"], "left").drop("text", "text_key")
    classes = o.reps.select("code", "rep").distinct()
    rows = st.keep(rows.join(classes, "code", "left").select("id", "split", "label_source", "h", "rep").distinct(), "rows")
    ev = rows.filter(IS_EVAL).select("id", "split", "label_source", "h", F.col("rep").alias("a"))
    tr = st.keep(rows.filter(IS_TRAIN).select("id", "h", F.col("rep").alias("b")).distinct(), "train")
    groups = ev.select("h", "a").distinct()
    by_h = tr.filter("h is not null").groupBy("h").agg(n.alias("n_h"))
    by_b = tr.filter("b is not null").groupBy("b").agg(n.alias("n_b"))
    by_both = tr.filter("h is not null and b is not null").groupBy("b", "h").agg(n.alias("n_bh"))
    near = o.class_pairs.join(by_b, "b").groupBy("a").agg(F.sum("n_b").alias("n_a"))
    both = groups.filter("h is not null and a is not null").join(o.class_pairs, "a").join(by_both, ["b", "h"]).groupBy("a", "h").agg(F.sum("n_bh").alias("n_ah"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    partners = groups.join(by_h, "h", "left").join(near, "a", "left").join(both, ["a", "h"], "left").select("h", "a", (zero("n_h") + zero("n_a") - zero("n_ah")).alias("n"))
    partners = st.keep(partners.filter("n > 0"), "partners")
    # a record that lies in both splits is no partner of itself
    self_rows = ev.join(tr.select("id", F.col("h").alias("h2"), "b"), "id").join(o.class_pairs.withColumn("near", F.lit(True)), ["a", "b"], "left")
    self_rows = self_rows.filter("h = h2 or near").groupBy("id", "split", "label_source", "h", "a").agg(n.alias("own"))
    same = lambda x, y, cols: [x[c].eqNullSafe(y[c]) for c in cols]
    e = ev.join(partners, same(ev, partners, ("h", "a"))).select(ev["id"], "split", "label_source", ev["h"], ev["a"], "n")
    e = e.join(self_rows, same(e, self_rows, ("id", "split", "label_source", "h", "a")), "left").select(e["id"], e["split"], e["label_source"], (F.col("n") - zero("own")).alias("n")).filter("n > 0")
    return e.groupBy(F.col("split").alias("eval_split"), "label_source").agg(F.countDistinct("id").alias("records"), F.sum("n").alias("pairs"))
