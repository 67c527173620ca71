# The literals of small inputs and their results, as published for these functions.
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions.text import clean_html, normalize_title, parse_tags, tokenize
from lodeseek.operators import dataset as ds
from lodeseek.operators import evaluation as ev
from lodeseek.operators import retrieval as r
from lodeseek.operators import training as tr
from lodeseek.plans.pipeline import build_retriever, evaluate
from lodeseek.plans.stages import block_join, hot_cold_join
from lodeseek.sources.posts import id_offset, read_npy, read_post_links, read_posts


def ids(run):
    return [x["doc_id"] for x in run.orderBy("query_id", "rank").collect()]


def test_text_functions(spark):
    row = spark.sql("select 'S&P 500, 3.14 and numpy.linalg' a, '  What is  VaR? ' b, '<x><y-z>' c, '|m|n|' d, '' e")
    got = row.select(tokenize(F.col("a")), normalize_title(F.col("b")), *[parse_tags(F.col(c)) for c in "cde"]).first()
    assert list(got) == [["s", "p", "500", "3.14", "and", "numpy.linalg"], "what is var", ["x", "y-z"], ["m", "n"], []]


def test_html():
    assert clean_html("<p>a &amp; b</p><p>c <code>x</code></p>") == "a & b\n\nc `x`"
    assert clean_html("<pre><code>a = 1\nb = 2\n</code></pre>") == "```\na = 1\nb = 2\n```"
    assert clean_html("<ul><li>one</li><li>two</li></ul><script>no()</script><img src=x>") == "one\ntwo"
    assert clean_html(None) == "" and clean_html("<img src=x>") == ""


def test_posts_xml(spark, tmp_path):
    p = tmp_path / "Posts.xml"
    p.write_text('<?xml version="1.0"?>\n<posts>\n<row Id="1" PostTypeId="1" AcceptedAnswerId="2" CreationDate="2011-01-01T00:00:00.000" Score="3" Body="&lt;p&gt;q&lt;/p&gt;" Title="T" Tags="|a|b|" AnswerCount="1" />\n<row Id="2" PostTypeId="2" ParentId="1" CreationDate="2011-01-02T00:00:00.000" Score="5" Body="x" OwnerUserId="9" />\n<row Id="3" PostTypeId="5" CreationDate="2011-01-02T00:00:00.000" Score="0" Body="wiki" />\n</posts>\n')
    q, a = read_posts(spark, str(p))
    assert q.select("question_id", "tags", "owner_user_id", "accepted_answer_id", "body_html").collect() == [(1, ["a", "b"], None, 2, "<p>q</p>")]
    assert a.select("answer_id", "question_id", "score").collect() == [(2, 1, 5)]
    links = tmp_path / "PostLinks.xml"
    links.write_text('<postlinks>\n<row Id="1" CreationDate="2011-01-01T00:00:00.000" PostId="4" RelatedPostId="1" LinkTypeId="3" />\n</postlinks>\n')
    assert read_post_links(spark, str(links)).collect() == [(4, 1, 3)]
    assert id_offset("quant") % 10_000_000 == 0


def test_npy(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    assert [list(x["embedding"]) for x in read_npy(spark, str(tmp_path / "v.npy")).orderBy("position").collect()] == [[0, 1], [2, 3], [4, 5]]


def test_bm25(spark):
    c = spark.createDataFrame([(30, "delta delta gamma"), (10, "delta"), (20, "gamma")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "delta delta unknown")], "query_id long, text string")
    run = r.bm25(c, q, 10, 1.2, 0.0).orderBy("rank").collect()
    idf = math.log(1 + 1.5 / 2.5)
    assert [x["doc_id"] for x in run] == [30, 10]
    assert run[0]["score"] == pytest.approx(idf * 2 * 2.2 / 3.2, abs=1e-8) and run[1]["score"] == pytest.approx(idf, abs=1e-8)
    with pytest.raises(ValueError):
        r.bm25(c, q, 10, 0)
    with pytest.raises(ValueError):
        r.bm25(c, q, 10, 1, 2)


@pytest.mark.parametrize("held, turn", [(250_000, 64 << 20), (250_000, 600), (0, 64 << 20)])
def test_bm25_ways(spark, monkeypatch, held, turn):
    """Terms held by the tasks, in one turn or several, and terms joined with the postings give the same run."""
    monkeypatch.setattr(r, "BROADCAST_TERMS", held)
    monkeypatch.setattr(r, "BLOCK_BYTES", turn)
    g = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in np.minimum(g.zipf(1.5, n), 60))
    docs = [(i, text(g.integers(0, 40))) for i in range(200)] + [(500, None), (501, "")]
    asked = [(i, text(6)) for i in range(12)] + [(90, "unknown"), (91, None), (92, "")]
    got = r.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"), 7).collect()
    tokens = {i: (t or "").split() for i, t in docs}
    mean, want = np.mean([len(t) for t in tokens.values()]), set()
    df = {}
    for t in tokens.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    for q, t in asked:
        scores = {}
        for i, d in tokens.items():
            for w in set((t or "").split()) & set(d):
                f = d.count(w)
                scores[i] = scores.get(i, 0) + math.log(1 + (202 - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(d) / mean))
        want |= {(q, i, k + 1) for k, i in enumerate(sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:7])}
    assert {(x["query_id"], x["doc_id"], x["rank"]) for x in got} == want


def test_dense_and_ivf(spark):
    c = spark.createDataFrame([(30, [1.0, 0.0]), (10, [0.0, 1.0]), (20, [0.8, 0.6]), (40, [0.0, 0.0])], "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert ids(r.dense_search(c, q, 2)) == [30, 20]
    cent = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell long, center array<float>")
    run = r.ivf_search(r.ivf_index(c, cent), cent, q, 2, 2)
    assert ids(run) == [30, 20]
    assert r.recall_against(run, r.dense_search(c, q, 2)).first()["recall"] == 1.0


def test_fusion_and_rerank(spark):
    s = "query_id long, doc_id long, rank int, score double"
    a, b = spark.createDataFrame([(1, 1, 1, 2.0), (1, 2, 2, 1.0)], s), spark.createDataFrame([(1, 3, 1, 2.0), (1, 2, 2, 1.0)], s)
    assert ids(r.fuse([a, b], 3)) == [2, 1, 3]
    with pytest.raises(ValueError):
        r.fuse([a], 3)
    run = spark.createDataFrame([(1, 1, 1, 9.0), (1, 2, 2, 8.0), (1, 3, 3, 7.0)], s)
    docs = spark.createDataFrame([(1, "0.1"), (2, "0.2"), (3, "0.9")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "")], "query_id long, text string")
    assert ids(r.rerank(run, q, docs, lambda _, t: t.cast("double"), 3, 3)) == [3, 2, 1]
    assert ids(r.rerank(run, q, docs, lambda _, t: t.cast("double"), 3, 2)) == [2, 1, 3]


def test_metrics(spark):
    run = spark.createDataFrame([(1, 12, 1, 2.0), (1, 11, 2, 1.0), (2, 99, 1, 2.0), (2, 21, 2, 1.0)], "query_id long, doc_id long, rank int, score double")
    rel = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (2, 21, 2), (3, 5, 2)], "query_id long, doc_id long, grade int")
    m = {x["query_id"]: x for x in ev.per_query_metrics(run, rel).collect()}
    assert m[1]["mrr_at_10"] == 0.5 and m[2]["recall_at_10"] == 1.0 and m[3]["ndcg_at_10"] == 0.0
    assert m[2]["ndcg_at_10"] == pytest.approx(1 / math.log2(3)) and m[1]["graded_ndcg_at_10"] > m[1]["ndcg_at_10"]


def test_bootstrap(spark):
    s = "query_id long, x double"
    a = spark.createDataFrame([(i, i / 40) for i in range(40)], s)
    assert ev.paired_bootstrap(a, a, "x", 500)["p_value"] == 1.0
    assert ev.paired_bootstrap(a, a.withColumn("x", F.col("x") + 0.1), "x", 500)["significant"]
    with pytest.raises(ValueError):
        ev.paired_bootstrap(a, a.filter("query_id < 5"), "x", 10)


def test_qrels(spark):
    q = spark.createDataFrame([(1, 30), (2, None), (3, None), (4, None), (5, 999)], "question_id long, accepted_answer_id long")
    a = spark.createDataFrame([(30, 1, 0), (31, 1, 9), (40, 2, 5), (41, 2, 1), (50, 3, 4), (51, 3, 4), (60, 4, 1), (70, 5, 1)], "answer_id long, question_id long, score int")
    got = {(x[0], x[1]): (x[2], x[3]) for x in ds.build_qrels(q, a).collect()}
    assert got == {(1, 30): (2, "accepted"), (1, 31): (1, "sibling"), (2, 40): (2, "top_voted"), (2, 41): (1, "sibling"), (5, 70): (1, "sibling")}


def test_split_and_duplicates(spark):
    q = spark.range(1, 101).selectExpr("id as question_id", "timestamp_ntz'2011-01-01' + make_dt_interval(cast(id as int)) as creation_date", "concat('title ', id) as title")
    s = ds.time_split(q)
    assert {x["split"]: x["n"] for x in ds.split_bounds(s).collect()} == {"train": 80, "val": 10, "test": 10}
    links = spark.createDataFrame([(1, 85, 3), (85, 95, 3), (2, 3, 1)], "post_id long, related_post_id long, link_type_id int")
    kept, dropped = ds.cross_split_duplicates(s, links)
    assert {x["question_id"]: x["reason"] for x in dropped.collect()} == {1: "duplicate of a question in test", 85: "duplicate of a question in test"}
    assert kept.count() == 98


def test_components_chain(spark):
    e = spark.range(30).selectExpr("id as a", "id + 1 as b")
    assert {x["component"] for x in ds.components(e).collect()} == {0}


def test_negatives_and_pairs(spark):
    corpus = spark.createDataFrame([(10, 1), (11, 1), (20, 2), (21, 2), (22, 2), (23, 2)], "answer_id long, question_id long")
    rel = spark.createDataFrame([(1, 10, 2), (1, 20, 1)], "question_id long, answer_id long, grade int")
    run = spark.createDataFrame([(1, d, k + 1, 1.0) for k, d in enumerate([23, 10, 20, 11, 21, 22])], "query_id long, doc_id long, rank int, score double")
    mined = tr.mine_negatives(run, corpus, rel, 2, 1)
    assert sorted((x["answer_id"], x["rank"]) for x in mined.collect()) == [(21, 4), (22, 5)]
    rnd = tr.random_negatives(spark.createDataFrame([(1,)], "question_id long"), corpus, rel, 2)
    assert {x["answer_id"] for x in rnd.collect()} <= {21, 22, 23} and rnd.count() == 2
    both = tr.combine_negatives([mined, rnd])
    assert both.count() == both.select("answer_id").distinct().count()
    q = spark.createDataFrame([(1, "train")], "question_id long, split string")
    neg = spark.createDataFrame([(1, 21, 1, "bm25"), (1, 22, 2, "dense"), (1, 23, 10000, "random")], "question_id long, answer_id long, rank int, source string")
    assert tr.training_pairs(q, corpus, rel, neg, 1, 1).first()["negatives"] == [21, 23]
    assert tr.training_pairs(q, corpus, rel, neg, 1, 2).count() == 0
    with pytest.raises(ValueError):
        tr.training_pairs(q, corpus, rel, None, 1, 0)


def test_losses(spark):
    b = spark.createDataFrame([(0, 1, [1.0, 0.0], [1.0, 0.0]), (0, 2, [0.0, 1.0], [0.0, 1.0])], "batch long, item long, query array<double>, positive array<double>")
    row = tr.info_nce(b, 1.0).first()
    assert row["loss"] == pytest.approx(math.log(math.e + 1) - 1) and row["accuracy"] == 1.0
    g = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "group long, offset int, score double")
    assert tr.grouped_cross_entropy(g).first()["loss"] == pytest.approx(math.log(2))
    t = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert t.select(tr.mean_pool("t", "m")).first()[0] == [2.0, 3.0]
    assert [x[0] for x in spark.range(4).select(tr.warmup_decay(F.col("id"), 2, 4)).collect()] == [0.5, 1.0, 1.0, 0.5]


def test_factory(spark):
    with pytest.raises(ValueError):
        build_retriever({"retriever": "nope"})
    c = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "alpha", "val")], "query_id long, text string, split string")
    rel = spark.createDataFrame([(1, 1, 2)], "query_id long, doc_id long, grade int")
    spec = {"retriever": "rerank", "parameters": {"base": {"retriever": "bm25"}, "depth": 5}}
    record, _ = evaluate(spec, c, q, rel)
    assert record["metrics"]["mrr_at_10"] == 1.0


def test_hot_cold_join(spark):
    left = spark.range(1000).selectExpr("if(id < 600, 1, id) as k", "id as v")
    right = spark.range(900).selectExpr("id as k", "id * 2 as w")
    for how in ("inner", "left"):
        assert sorted(hot_cold_join(left, right, "k", how, 100).collect(), key=str) == sorted(left.join(right, "k", how).collect(), key=str)


@pytest.mark.parametrize("sample", [1, 4])
def test_block_join(spark, sample):
    left = spark.range(900).selectExpr("if(id < 600, 1, id % 7) as k", "id as v").unionByName(spark.sql("select cast(null as long) as k, 5L as v"))
    right = spark.range(500).selectExpr("if(id < 300, 1, id % 11) as k", "id as w").unionByName(spark.sql("select cast(null as long) as k, 6L as w"))
    assert sorted(block_join(left, right, "k", 20, sample).collect()) == sorted(left.join(right, "k").collect())
