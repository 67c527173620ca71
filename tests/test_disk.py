"""What the searches write to disk: texts of answers that occur once are not shuffled, and the rows stay the same; all that a
query writes is within four times its input."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek import catalog
from lodeseek.operators import retrieval as r
from lodeseek.plans.stages import one_each, shared_dir

NAMES = ["combined_negatives", "rrf_hybrid", "metrics_mean", "mined_negatives", "negatives_summary"]
WITHIN = ["mined_negatives", "rrf_hybrid", "metrics_mean", "negatives_summary"]


def shuffled(spark, action):
    """What an action returns, and the bytes that it wrote to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        known = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
        return {x.stageId(): x.shuffleWriteBytes() for x in (known.apply(i) for i in range(known.size()))}

    before = stages()
    out = action()
    return out, sum(n for k, n in stages().items() if k not in before)


def texts(g, n):
    """Texts that don't compress well: a few common words and many others."""
    return [" ".join([*(f"w{x}" for x in np.minimum(g.zipf(1.4, 9), 60)), *(f"{x:x}" for x in g.integers(0, 1 << 60, 60))]) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    g, path = np.random.default_rng(5), str(tmp_path_factory.mktemp("posts"))
    rows = [(i, i % 700, i % 5, t) for i, t in enumerate(texts(g, 4000))]
    rows += [(i, i % 700, 7, t) for i, t in zip((3, 3, 50, 51, 99), texts(g, 5))] + [(3, 3, 7, None), (4001, 9, 0, None), (4002, 9, 0, "")]
    spark.createDataFrame(rows, "answer_id long, question_id long, score int, text string").repartition(4).write.parquet(f"{path}/corpus.parquet")
    asked = [(i, f"w{i % 7 + 1} w{i % 11 + 2} w{i // 50}") for i in range(0, 700, 10)]
    queries = spark.createDataFrame(asked, "question_id long, text string").selectExpr("question_id", "timestamp'2020-01-01' as creation_date", "text as title", "text", "'accepted' as label_source")
    queries.write.parquet(f"{path}/queries.parquet")
    spark.createDataFrame([(i, i + 700 * j, j, "accepted") for i in range(0, 700, 10) for j in (1, 2)], "question_id long, answer_id long, grade int, label_source string").write.parquet(f"{path}/qrels.parquet")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_texts_are_not_shuffled(spark, monkeypatch, folder, name):
    size = spark.read.parquet(f"{folder}/corpus.parquet").agg(F.sum(F.length("text"))).first()[0]
    got, n = shuffled(spark, lambda: sorted(catalog.queries()[name](spark, folder).collect()))
    monkeypatch.setattr(catalog, "_texts", catalog._corpus, raising=False)
    want, most = shuffled(spark, lambda: sorted(catalog.queries()[name](spark, folder).collect()))
    assert want and got == want
    assert n < most - 0.5 * size


@pytest.mark.parametrize("most", [500_000, 3, 2])
def test_one_each(spark, most):
    """Repeated, null and single keys, with more repeated keys than are broadcast and with fewer."""
    rows = [(i, i % 3, f"t{i}") for i in range(20)] + [(1, 9, "a"), (1, 8, None), (4, 0, "z"), (19, 5, None), (None, 1, "b"), (None, 2, "a"), (30, None, None)]
    df = spark.createDataFrame(rows, "k long, a int, t string")
    for some in (df, df.filter("k is not null"), df.filter("k = 2 or k is null and a = 1"), df.filter("false")):
        want = some.groupBy("k").agg(F.max("a").alias("a"), F.min("t").alias("t"))
        got = one_each(some, "k", {"a": F.max, "t": F.min}, most)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Posts in few words: a long question shares many terms with nearly every answer."""
    g, path = np.random.default_rng(6), str(tmp_path_factory.mktemp("alike"))
    words = lambda n: " ".join(f"w{x}" for x in np.minimum(g.zipf(1.2, n), 400))
    spark.createDataFrame([(i, i % 3000, i % 5, words(60)) for i in range(6000)], "answer_id long, question_id long, score int, text string").repartition(4).write.parquet(f"{path}/corpus.parquet")
    queries = spark.createDataFrame([(i, words(60)) for i in range(0, 3000, 50)], "question_id long, text string").selectExpr("question_id", "timestamp'2020-01-01' as creation_date", "text as title", "text", "'accepted' as label_source")
    queries.write.parquet(f"{path}/queries.parquet")
    spark.createDataFrame([(i, i + 3000 * j, j + 1, "accepted") for i in range(0, 3000, 50) for j in (0, 1)], "question_id long, answer_id long, grade int, label_source string").write.parquet(f"{path}/qrels.parquet")
    return path


@pytest.mark.parametrize("name", WITHIN)
def test_disk_is_within_the_budget(spark, monkeypatch, alike, name):
    """More query terms than are held at once: shuffles and written stages take less than four times the input."""

    def size(folder):
        return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet") if p.is_file())

    monkeypatch.setattr(r, "BROADCAST_TERMS", 500)
    stages = shared_dir(spark).removeprefix("file:")
    before = size(stages)
    rows, n = shuffled(spark, lambda: catalog.queries()[name](spark, alike).collect())
    assert rows and n + size(stages) - before < 4 * size(alike)
