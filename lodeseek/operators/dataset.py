"""Corpus, queries, judgements, time splits and removal of duplicates across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions.text import html_to_text, normalize_title, query_text
from lodeseek.operators.evaluation import text_stats
from lodeseek.plans.stages import Stages, hot_cold_join, numbered

PRIORITY = {"train": 0, "val": 1, "test": 2}


def build_corpus(answers: DataFrame) -> DataFrame:
    return answers.select("answer_id", "question_id", "score", html_to_text("body_html").alias("text")).filter(F.length("text") > 0)


def build_queries(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "creation_date", "title", "tags", query_text(F.col("title"), html_to_text("body_html")).alias("text"))


def build_qrels(questions: DataFrame, answers: DataFrame, least: int = 2) -> DataFrame:
    """(question_id, answer_id, grade, label_source). Grade 2: the accepted answer, or the best answer of a question
    without one if it has `least` points or more and more than the runner-up. Grade 1: other answers of these questions.
    An accepted answer that no longer exists has no row, its siblings have."""
    acc = questions.filter("accepted_answer_id is not null").select("question_id", F.col("accepted_answer_id").alias("answer_id"), F.lit("accepted").alias("label_source"))
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "answer_id")
    free = answers.join(acc.select("question_id"), "question_id", "left_anti").join(questions.select("question_id"), "question_id", "left_semi")
    best = free.withColumn("r", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).filter("r = 1")
    top = best.filter((F.col("score") >= least) & (F.col("score") > F.coalesce("next", F.lit(-999)))).select("question_id", "answer_id", F.lit("top_voted").alias("label_source"))
    primary = acc.unionByName(top).withColumn("grade", F.lit(2))
    sib = answers.select("question_id", "answer_id").join(primary.select("question_id"), "question_id", "left_semi").join(primary.select("question_id", "answer_id"), ["question_id", "answer_id"], "left_anti")
    sib = sib.select("question_id", "answer_id", F.lit("sibling").alias("label_source"), F.lit(1).alias("grade"))
    return primary.join(answers.select("answer_id"), "answer_id", "left_semi").unionByName(sib).select("question_id", "answer_id", "grade", "label_source")


def time_split(queries: DataFrame, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds split: the latest share is test, the one before val, the rest train, by (creation_date, question_id).

    Rows with equal date and id have no order of their own, so ids must be unique."""
    if not 0 < val + test < 1:
        raise ValueError("val + test must be between 0 and 1")
    q = numbered(queries, "creation_date", "question_id")
    n = q.count()
    n_test, n_val = round(n * test), round(n * val)
    pos = F.col("_pos") + 1
    split = F.when(pos > n - n_test, "test").when(pos > n - n_test - n_val, "val").otherwise("train")
    return q.withColumn("split", split).drop("_pos")


def split_bounds(queries: DataFrame) -> DataFrame:
    return queries.groupBy("split").agg(F.min("creation_date").cast("string").alias("first"), F.max("creation_date").cast("string").alias("last"), F.count(F.lit(1)).alias("n"))


def duplicate_edges(queries: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b) of queries joined by a duplicate link (type 3) or an equal normalised title; an empty title equals none."""
    ids = queries.select("question_id").distinct()
    l = links.filter("link_type_id = 3 and post_id <> related_post_id").select(F.col("post_id").alias("a"), F.col("related_post_id").alias("b")).distinct()  # noqa: E741
    l = l.join(ids.withColumnRenamed("question_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("question_id", "b"), "b", "left_semi")  # noqa: E741
    t = queries.select("question_id", normalize_title(F.col("title")).alias("t")).filter("t <> ''")
    hubs = t.groupBy("t").agg(F.min("question_id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return l.unionByName(t.join(hubs, "t").filter("question_id <> a").select("a", F.col("question_id").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(member, component) of the ids in edges (a, b): labels take the least of their neighbours' and jump to their label's label."""
    st = Stages(edges.sparkSession)
    e = st.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    lab = st.keep(e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")), "l0")
    # no key has more rows than there are members: up to 100,000 none is hot
    few, r = lab.count() <= 100_000, 0
    while True:
        near = lab.select(F.col("a").alias("b"), "c")
        low = (e.join(near, "b") if few else hot_cold_join(e, near, "b")).groupBy("a").agg(F.min("c").alias("m"))
        new = lab.join(low, "a").select("a", F.least("c", "m").alias("n"), F.col("c").alias("old"))
        jump = lab.select(F.col("a").alias("n"), F.col("c").alias("j"))
        r += 1
        new = new.join(jump, "n") if few else hot_cold_join(st.keep(new, f"n{r}"), jump, "n")
        both = st.keep(new.select("a", F.least("n", "j").alias("c"), "old"), f"l{r}")
        st.drop(f"l{r - 1}", *([] if few else [f"n{r}"]))
        done = both.filter("c <> old").isEmpty()
        lab = both.select("a", "c")
        if done:
            return lab.select(F.col("a").alias("member"), F.col("c").alias("component"))


def cross_split_duplicates(queries: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): of each component only the queries of its strongest split stay; dropped names that split."""
    names = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    back = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (v, k)])
    p = queries.withColumn("_p", names[F.col("split")])
    comp = components(duplicate_edges(queries, links)).withColumnRenamed("member", "question_id")
    strongest = p.join(comp, "question_id").groupBy("component").agg(F.max("_p").alias("_top"))
    weak = p.join(comp, "question_id").join(strongest, "component").filter("_p < _top")
    dropped = weak.select("question_id", "split", F.concat(F.lit("duplicate of a question in "), back[F.col("_top")]).alias("reason"))
    return queries.join(dropped.select("question_id"), "question_id", "left_anti"), dropped


def drop_noisy_held_out(queries: DataFrame) -> DataFrame:
    """Evaluation queries need an accepted answer."""
    return queries.filter(~(F.col("split").isin("val", "test") & (F.coalesce("label_source", F.lit("")) == "top_voted")))


def with_label_source(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds the label_source of a query's primary judgement, null without one."""
    return queries.drop("label_source").join(qrels.filter("grade = 2").select("question_id", "label_source"), "question_id", "left")


def check_invariants(corpus: DataFrame, queries: DataFrame, qrels: DataFrame) -> None:
    """Raises AssertionError, naming what does not hold, instead of training on a broken dataset."""

    def empty(df: DataFrame, what: str) -> None:
        if not df.isEmpty():
            raise AssertionError(what)

    empty(queries.select("question_id", "split").distinct().groupBy("question_id").count().filter("count > 1"), "splits share questions")
    empty(queries.groupBy("question_id").count().filter("count > 1"), "a query occurs twice")
    empty(qrels.join(queries, "question_id", "left_anti"), "a judgement has no query")
    empty(qrels.join(corpus, "answer_id", "left_anti"), "a judged answer is missing from the corpus")
    primary = qrels.filter("grade = 2")
    empty(primary.groupBy("question_id").count().filter("count > 1"), "a question has two primary judgements")
    empty(queries.join(primary, "question_id", "left_anti"), "a query has no primary judgement")
    empty(queries.filter("split in ('val', 'test') and not (label_source <=> 'accepted')"), "a held-out query has no accepted answer")


def judgements_per_query(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row (judgements, queries, ratio), the ratio rounded half-even to two decimals."""
    n = queries.agg(F.count(F.lit(1)).alias("queries"))
    return qrels.agg(F.count(F.lit(1)).alias("judgements")).crossJoin(n).withColumn("ratio", F.bround(F.col("judgements") / F.col("queries"), 2))  # a row each


def build_dataset(questions: DataFrame, answers: DataFrame, links: DataFrame, val: float = 0.1, test: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels, dropped) of a dump: texts cleaned, answers judged, questions with a primary judgement split by
    date, duplicates across splits dropped, then held-out questions without an accepted answer. The result is checked."""
    st = Stages(questions.sparkSession)
    corpus = st.keep(build_corpus(answers), "corpus")
    qrels = st.keep(build_qrels(questions, answers.join(corpus.select("answer_id"), "answer_id", "left_semi")), "judged")
    queries = build_queries(questions).join(qrels.filter("grade = 2").select("question_id"), "question_id", "left_semi")
    kept, dropped = cross_split_duplicates(st.keep(time_split(queries, val, test), "split"), links)
    queries = st.keep(drop_noisy_held_out(with_label_source(kept, qrels)), "queries")
    qrels = st.keep(qrels.join(queries.select("question_id"), "question_id", "left_semi"), "qrels")
    check_invariants(corpus, queries, qrels)
    return corpus, queries, qrels, st.keep(dropped, "dropped")


def dataset_stats(questions: DataFrame, answers: DataFrame, corpus: DataFrame, queries: DataFrame, qrels: DataFrame, dropped: DataFrame) -> dict:
    """The record that goes with a built dataset; aggregates of a few rows each are collected."""
    rows = lambda df, key, value: {str(r[key]): r[value] for r in df.collect()}
    splits = [r["split"] for r in queries.select("split").distinct().orderBy("split").collect()]  # three
    return {
        "posts": {"questions": questions.count(), "answers": answers.count()},
        "corpus": text_stats(corpus, "text").first().asDict(),
        "queries_by_split": {s: text_stats(queries.filter(F.col("split") == s), "text").first().asDict() for s in splits},
        "split_boundaries": {r["split"]: {"first": r["first"], "last": r["last"], "count": r["n"]} for r in split_bounds(queries).collect()},
        "label_sources": rows(queries.groupBy("label_source").count(), "label_source", "count"),
        "qrels_by_grade": rows(qrels.groupBy("grade").count(), "grade", "count"),
        "judgements_per_query": judgements_per_query(queries, qrels).first()["ratio"],
        "dropped_as_cross_split_duplicates": dropped.count(),
    }
