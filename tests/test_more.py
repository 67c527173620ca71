"""Filters, invariants, statistics, searches with fewer probes than cells, negatives, collation and losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import dataset as ds
from lodeseek.operators import encoder as en
from lodeseek.operators import evaluation as ev
from lodeseek.operators import retrieval as r
from lodeseek.operators import training as tr
from lodeseek.plans import pipeline, records
from lodeseek.plans.stages import Stages, numbered


def test_held_out_filter_and_label_source(spark):
    q = spark.createDataFrame([(1, "train"), (2, "val"), (3, "test"), (4, "val")], "question_id long, split string")
    rel = spark.createDataFrame([(1, 2, "top_voted"), (2, 2, "top_voted"), (3, 2, "accepted"), (3, 1, "sibling")], "question_id long, grade int, label_source string")
    got = ds.with_label_source(q, rel)
    assert {x[0]: x["label_source"] for x in got.collect()} == {1: "top_voted", 2: "top_voted", 3: "accepted", 4: None}
    assert sorted(x[0] for x in ds.drop_noisy_held_out(got).collect()) == [1, 3, 4]


@pytest.mark.parametrize("what", ["splits share", "judgement has no query", "missing from the corpus", "two primary", "no primary", "no accepted", None])
def test_invariants(spark, what):
    corpus, queries, qrels = [(10,), (11,), (20,)], [(1, "train", "top_voted"), (2, "val", "accepted")], [(1, 10, 2), (1, 11, 1), (2, 20, 2)]
    if what == "splits share":
        queries.append((1, "test", "accepted"))
    if what == "judgement has no query":
        qrels.append((9, 10, 1))
    if what == "missing from the corpus":
        qrels.append((1, 99, 1))
    if what == "two primary":
        qrels.append((1, 20, 2))
    if what == "no primary":
        queries.append((3, "train", None))
    if what == "no accepted":
        queries[1] = (2, "val", "top_voted")
    tables = spark.createDataFrame(corpus, "answer_id long"), spark.createDataFrame(queries, "question_id long, split string, label_source string"), spark.createDataFrame(qrels, "question_id long, answer_id long, grade int")
    if what is None:
        ds.check_invariants(*tables)
    else:
        with pytest.raises(AssertionError, match=what):
            ds.check_invariants(*tables)


def test_statistics(spark):
    t = spark.createDataFrame([("a", float(x)) for x in range(1, 101)] + [("b", 4.0)], "stage string, ms double")
    got = {x["stage"]: x for x in ev.latency_summary(t).collect()}
    assert got["a"]["p50"] == 50.5 and got["a"]["p95"] == pytest.approx(np.percentile(range(1, 101), 95)) and got["b"]["calls"] == 1 and got["b"]["total"] == 4.0
    texts = ["a", "b c", " d  e f ", None, "ééé"]
    s = ev.text_stats(spark.createDataFrame([(x,) for x in texts], "text string"), "text").first()
    assert list(s) == [5, int(np.percentile([1, 3, 8, 0, 3], 50)), int(np.percentile([1, 3, 8, 0, 3], 90)), int(np.percentile([1, 2, 3, 0, 1], 50)), int(np.percentile([1, 2, 3, 0, 1], 90))]
    n = spark.createDataFrame([(1,)] * 4 + [(2,)] + [(3,)] * 3, "question_id long")
    assert list(ev.count_summary(n, "question_id").first()) == [8, 3, 1, 3, 4]
    assert ev.count_summary(n.filter("false"), "question_id").first()["groups"] == 0


def test_bootstrap_both_ways(spark):
    r_ = np.random.default_rng(1)
    a, d = r_.random(60), r_.normal(0.02, 0.1, 60)
    one = spark.createDataFrame([(i, float(x)) for i, x in enumerate(a)], "query_id long, m double")
    two = spark.createDataFrame([(i, float(x + y)) for i, (x, y) in enumerate(zip(a, d))], "query_id long, m double")
    rec = ev.paired_bootstrap(one, two, "m", 2000)
    draws = np.random.default_rng(17).integers(0, 60, (2000, 60))
    diff = (a + d) - a
    means = diff[draws].mean(1)
    assert rec["ci_low"] == pytest.approx(np.quantile(means, 0.025)) and rec["p_value"] == pytest.approx((np.abs(means - means.mean()) >= abs(diff.mean())).mean())
    row = ev.bootstrap_table(one, two, "m", 2000).first()
    assert row["mean_difference"] == pytest.approx(rec["mean_difference"], abs=1e-8) and abs(row["ci_low"] - rec["ci_low"]) < 0.01 and abs(row["p_value"] - rec["p_value"]) < 0.05
    assert ev.bootstrap_table(one, one, "m", 50).first()["p_value"] == 1.0
    for bad in ({"iterations": 0}, {"confidence": 1.0}):
        for f in (ev.paired_bootstrap, ev.bootstrap_table):
            with pytest.raises(ValueError):
                f(one, two, "m", **bad)
    with pytest.raises(ValueError):
        ev.bootstrap_table(one, two.filter("query_id > 3"), "m", 10)


def test_inverted_file(spark):
    g = np.random.default_rng(0)
    x = g.random((400, 32), np.float32)
    c = spark.createDataFrame([(1000 + 3 * i, v) for i, v in enumerate(x.tolist())], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "query_id long, embedding array<float>")
    exact = r.dense_search(c, q, 5)
    assert {(z["query_id"], z["doc_id"]) for z in exact.filter("rank = 1").collect()} == {(i, 1000 + 3 * i) for i in range(20)}
    recall = [r.recall_against(r.vector_search(c, q, 5, cells=8, nprobe=n), exact).agg(F.avg("recall")).first()[0] for n in (1, 4, 8)]
    assert recall[0] < 1 and recall[0] <= recall[1] <= recall[2] == 1.0
    assert sorted(map(tuple, r.vector_search(c, q, 5, exact=True).collect())) == sorted(map(tuple, exact.collect()))
    for bad in ({"k": 0}, {"cells": 0}, {"nprobe": 0}):
        with pytest.raises(ValueError):
            r.vector_search(c, q, **({"k": 5} | bad))
    with pytest.raises(ValueError):
        r.vector_search(c.union(c), q, 5)
    assert r.dense_search(c, q.filter("false"), 5).count() == 0


def test_dense_over_batches(spark):
    """Ties and k-best lists that change from batch to batch."""
    g = np.random.default_rng(5)
    x = g.integers(-2, 3, (3000, 4)).astype(np.float64)
    run = r._best_of(np.array([7]), r.unit(np.ones((1, 4))), 9)
    import pandas as pd

    got = list(run(iter([pd.DataFrame({"doc_id": range(s, s + 500), "embedding": list(x[s : s + 500])}) for s in range(0, 3000, 500)])))[0]
    sims = np.round(r.unit(x) @ r.unit(np.ones((1, 4)))[0], 9)
    assert got["doc_id"].tolist() == np.lexsort((np.arange(3000), -sims))[:9].tolist()


def test_negatives_until_filled(spark, monkeypatch):
    monkeypatch.setattr(tr, "DRAWS", 1)
    corpus = spark.createDataFrame([(i, 1 if i < 40 else 2) for i in range(50)], "answer_id long, question_id long")
    rel = spark.createDataFrame([(1, 45, 2)], "question_id long, answer_id long, grade int")
    got = tr.random_negatives(spark.createDataFrame([(1,), (2,), (3,)], "question_id long"), corpus, rel, 5).collect()
    by = {}
    for x in got:
        by.setdefault(x["question_id"], []).append((x["rank"], x["answer_id"]))
    assert all(sorted(k for k, _ in v) == [10_000 + i for i in range(5)] for v in by.values()) and len(by) == 3
    assert {a for _, a in by[1]} <= set(range(40, 50)) - {45}
    with pytest.raises(ValueError):
        tr.random_negatives(spark.createDataFrame([(1,)], "question_id long"), corpus, rel, 12)


def test_collation_and_batches(spark):
    pairs = spark.createDataFrame([(1, 10, [20, 21]), (2, 11, [22, 23])], "question_id long, answer_id long, negatives array<long>")
    q, c = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, text string"), spark.createDataFrame([(i, str(i)) for i in (10, 11, 20, 21, 22, 23)], "answer_id long, text string")
    assert [x["text"] for x in tr.collate(pairs, q, c).orderBy("question_id", "offset").collect()] == ["10", "20", "21", "11", "22", "23"]
    with pytest.raises(ValueError):
        tr.collate(pairs.union(spark.createDataFrame([(1, 10, [20])], pairs.schema)), q, c)
    with pytest.raises(ValueError):
        tr.collate(pairs, q, c.filter("answer_id < 23"))
    many = spark.range(10).selectExpr("id as question_id", "id as answer_id")
    got = tr.batches(many, 4).groupBy("batch").count().collect()
    assert sorted(map(tuple, got)) == [(0, 4), (1, 4)]
    with pytest.raises(ValueError):
        tr.batches(many, 11)
    assert [x[0] for x in tr.limit_pairs(many, 3).collect()] == [0, 1, 2] and tr.limit_pairs(many, None).count() == 10
    with pytest.raises(ValueError):
        tr.training_pairs(q.withColumn("split", F.lit("val")), c.withColumn("question_id", F.lit(0)), spark.createDataFrame([(1, 10, 2)], "question_id long, answer_id long, grade int"))
    assert tr.parameter_groups({"w": 2, "w.bias": 2, "b": 1}, 0.1) == [{"names": ["w"], "weight_decay": 0.1}, {"names": ["w.bias", "b"], "weight_decay": 0.0}]


def test_info_nce_with_negatives(spark):
    e = [[1.0, 0.0], [0.0, 1.0]]
    rows = [(0, i, e[i], e[i], [[-1.0, 0.0]]) for i in range(2)]
    got = tr.info_nce(spark.createDataFrame(rows, "batch long, item long, query array<double>, positive array<double>, negatives array<array<double>>"), 1.0).first()
    # every query against both positives and both negatives
    want = np.mean([math.log(math.e + 1 + 2 / math.e) - 1, math.log(math.e + 1 + 2) - 1])
    assert got["loss"] == pytest.approx(want)


def test_gradients():
    """The gradients of both training steps against differences."""
    g = np.random.default_rng(2)
    table = g.standard_normal((30, 5))
    bags = [np.unique(g.integers(0, 30, 4)) for _ in range(9)]
    for step in (lambda t: en.contrastive_step(t, bags[:3], bags[3:6], bags[6:], 0.5), lambda t: en.ranking_step(t, bags[:3], [bags[3:5], bags[5:7], bags[7:9]], 0.5)):
        _, _, grad = step(table)
        for i, j in ((bags[0][0], 0), (bags[4][1], 3), (bags[8][0], 2)):
            up, down = table.copy(), table.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert grad[i, j] == pytest.approx((step(up)[0] - step(down)[0]) / 2e-6, abs=1e-5)


def test_scorer_and_encoder(spark):
    df = spark.createDataFrame([("delta hedge", "delta hedge"), ("delta", "bond"), ("", None)], "q string, t string")
    score = r.batch_scorer(lambda: lambda q, t: np.array([float(a == b) for a, b in zip(q, t)]))
    assert [x[0] for x in df.select(score(F.col("q"), F.col("t"))).collect()] == [1.0, 0.0, 0.0]
    rows = r.encode(df.withColumnRenamed("t", "text"), pipeline.ENCODERS["hashing"]({"dimensions": 8})).collect()
    assert np.linalg.norm(rows[0]["embedding"]) == pytest.approx(1, abs=1e-6) and list(rows[2]["embedding"]) == [0.0] * 8


def test_numbered_and_stages(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    assert {(x["k"], x["_pos"]) for x in numbered(df, "k").collect()} == {(i, i) for i in range(1000)}
    assert numbered(df.filter("false"), "k").count() == 0
    st = Stages(spark)
    kept = st.keep(df, "x")
    assert kept.count() == 1000
    st.close()
    with pytest.raises(Exception):
        spark.read.parquet(f"{st.root}/x")


def test_evaluation_errors(spark):
    c = spark.createDataFrame([(1, "alpha")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha", "val"), (2, "alpha", "val")], "query_id long, text string, split string")
    rel = spark.createDataFrame([(1, 1, 2)], "query_id long, doc_id long, grade int")
    for more in ({"k": 10}, {"split": "test"}, {}):  # too few results, an empty split, a query without judgement
        with pytest.raises(ValueError):
            pipeline.evaluate({"retriever": "bm25"}, c, q, rel, **more)
    with pytest.raises(ValueError):
        records.scores_of({"run_name": "x"}, "m")
    with pytest.raises(ValueError):
        records.scores_of({"run_name": "x", "per_query": {"1": {"n": 1.0}}}, "m")


@pytest.mark.parametrize("block", [64 << 20, 400])
def test_cells_are_searched_without_a_join(spark, monkeypatch, block):
    """Documents of the probed cells meet all their queries in tasks, in one turn or several; no pair is a row of a join."""
    monkeypatch.setattr(r, "BLOCK_BYTES", block)
    g = np.random.default_rng(3)
    x = np.round(g.normal(size=(400, 4)), 1)
    x[200:250] = x[:50]  # ties
    s = "doc_id long, embedding array<double>"
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], s)
    centers = spark.createDataFrame([(i + 70, v.tolist()) for i, v in enumerate(x[:9])], "cell long, center array<double>")
    asked = docs.filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    run = r.ivf_search(r.ivf_index(docs, centers), centers, asked, 7, 3)
    assert "Join" not in run._jdf.queryExecution().toString()
    u = r.unit(x)
    near = np.round(u @ u[:9].T, 9)
    cell, want = (u @ u[:9].T).argmax(1), set()
    for q in range(0, 400, 20):
        probed = sorted(range(9), key=lambda c: (-near[q, c], c))[:3]
        score = np.round(u[q] @ u.T, 9)
        found = sorted((i for i in range(400) if cell[i] in probed), key=lambda i: (-score[i], i))[:7]
        want |= {(q, i, k + 1) for k, i in enumerate(found)}
    assert {(y["query_id"], y["doc_id"], y["rank"]) for y in run.collect()} == want
