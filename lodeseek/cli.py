"""Commands over the library: python -m lodeseek COMMAND --help.

Configurations are YAML files with the keys run_name, retriever, parameters, split, max_results, seed, display_name,
display_order and output; tables lie in a folder as corpus.parquet, queries.parquet and qrels.parquet.
"""

from __future__ import annotations

import argparse
import json
import random
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators import dataset as ds
from lodeseek.operators import encoder as en
from lodeseek.operators import evaluation as ev
from lodeseek.operators import retrieval as r
from lodeseek.operators import studies
from lodeseek.operators import training as tr
from lodeseek.plans import pipeline, records
from lodeseek.plans.profile import profile
from lodeseek.sources import posts, site

# Fixed value: where the dump lies.
DUMP = "https://archive.org/download/stackexchange/quant.stackexchange.com.7z"


def session() -> SparkSession:
    """The running session, or one with the settings of spark-submit; all cores of this machine where none is named."""
    spark = SparkSession.builder.appName("lodeseek").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return spark


def set_seed(seed: int) -> None:
    """For driver-side draws; distributed ones take their seed as a parameter."""
    random.seed(seed)
    np.random.seed(seed)


def choose_device(wanted: str = "auto", usable: tuple[str, ...] = ("cpu",)) -> str:
    """The first of mps, cuda and cpu that is usable, or the one wanted; an encoder's loader decides what is usable."""
    if wanted != "auto":
        return wanted
    return next((d for d in ("mps", "cuda", "cpu") if d in usable), "cpu")


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(posts.read_table(spark, folder, n) for n in ("corpus", "queries", "qrels"))


def _corpus(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("answer_id", "doc_id")


def _queries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("question_id", "query_id")


def _qrels(df: DataFrame) -> DataFrame:
    return df.select(F.col("question_id").alias("query_id"), F.col("answer_id").alias("doc_id"), "grade")


def _say(record) -> None:
    print(json.dumps(record, indent=2, sort_keys=True, default=str))


def download_data(a) -> None:
    info = site.download(a.url, f"{a.out}/{Path(a.url).name}", a.force)
    site.extract(f"{a.out}/{Path(a.url).name}", a.out)
    _say(info)


def build_dataset(a) -> None:
    spark = session()
    questions, answers = posts.read_posts(spark, f"{a.raw}/Posts.xml")
    corpus, queries, qrels, dropped = ds.build_dataset(questions, answers, posts.read_post_links(spark, f"{a.raw}/PostLinks.xml"), a.val_frac, a.test_frac)
    for name, df in (("corpus", corpus), ("queries", queries), ("qrels", qrels)):
        posts.write_table(df, a.out, name)
    info = Path(a.raw) / "dump_info.json"
    stats = {"raw": json.loads(info.read_text()) if info.exists() else None} | ds.dataset_stats(questions, answers, corpus, queries, qrels, dropped)
    records.write_record(stats, a.stats)
    _say(stats)


def evaluate(a) -> None:
    config, spark = records.read_config(a.config), session()
    set_seed(int(config.get("seed", 17)))
    corpus, queries, qrels = _tables(spark, a.data)
    split, k = config.get("split", "val"), int(config.get("max_results", 100))
    found, per = pipeline.evaluate(config, _corpus(corpus), _queries(queries), _qrels(qrels), split, k)
    record = records.result_record(config["run_name"], config["retriever"], split, config, found["metrics"], found["timing"], found["counts"], per)
    records.write_record(record, config.get("output", f"results/{config['run_name']}.json"))
    _say({k: record[k] for k in ("run_name", "metrics", "timing", "counts")})


def compare_runs(a) -> None:
    spark, s = session(), f"query_id long, {a.metric} double"
    one, two = (spark.createDataFrame(records.scores_of(records.read_record(p), a.metric), s) for p in (a.baseline, a.candidate))
    record = {"baseline": Path(a.baseline).stem, "candidate": Path(a.candidate).stem} | ev.paired_bootstrap(one, two, a.metric, a.iterations, a.seed)
    records.write_record(record, f"{a.out}/{record['baseline']}_vs_{record['candidate']}_{a.metric}.json")
    print(records.difference(record), "significant" if record["significant"] else "not significant")


def mine_negatives(a) -> None:
    config, spark = records.read_config(a.config), session()
    seed, mining = int(config.get("seed", 17)), config.get("mining", {})
    corpus, queries, qrels = _tables(spark, a.data)
    asked = queries.filter(F.col("split") == config.get("split", "train"))
    depth, tables = mining.get("depth", 50), []
    for s in config["sources"]:
        run = pipeline.build_retriever(s)(_corpus(corpus), _queries(asked), depth)
        tables.append(tr.mine_negatives(run, corpus, qrels, mining.get("per_query", 4), mining.get("skip_top", 1), depth, s["name"]))
    if config.get("random_per_query"):
        tables.append(tr.random_negatives(asked, corpus, qrels, int(config["random_per_query"]), seed))
    path = config.get("output", f"{a.data}/negatives.parquet")
    tr.combine_negatives(tables).write.mode("overwrite").parquet(path)
    got = spark.read.parquet(path)
    _say(ev.count_summary(got, "question_id").first().asDict() | {"training_queries": asked.count(), "by_source": {x["source"]: x["count"] for x in got.groupBy("source").count().collect()}})


def _train(a, kind: str) -> None:
    config, spark = records.read_config(a.config), session()
    corpus, queries, qrels = _tables(spark, a.data)
    hard, rand = int(config.get("negatives_per_query", 0)), int(config.get("random_negatives_per_query", 0))
    path = config.get("negatives_path", f"{a.data}/negatives.parquet")
    negatives = spark.read.parquet(path) if hard or rand else None
    pairs = tr.training_pairs(queries, corpus, qrels, negatives, hard, rand)
    known = set(en.TrainingConfig.__dataclass_fields__)
    settings = {k: v for k, v in config.items() if k in known and v is not None} | {"hard": hard, "random": rand}
    _say(en.train(pairs, queries, corpus, en.TrainingConfig(**settings), kind, a.resume)["epochs"])


def train(a) -> None:
    _train(a, "encoder")


def train_reranker(a) -> None:
    _train(a, "scorer")


def probe_reranker(a) -> None:
    spark = session()
    corpus, queries, qrels = _tables(spark, a.data)
    scorer = r.batch_scorer(en.table_scorer(a.checkpoint)) if a.checkpoint else pipeline.SCORERS["overlap"]
    out = []
    for split in ("val", "train"):
        scores = studies.probe_scores(queries.filter(F.col("split") == split), corpus, qrels, scorer, a.questions, a.distractors, a.seed)
        out.append({"split": split, "distractors": a.distractors} | studies.probe_summary(scores, a.distractors).first().asDict())
    records.write_record({"checkpoint": a.checkpoint, "splits": out}, a.output)
    _say(out)


def profile_pipeline(a) -> None:
    config, spark = records.read_config(a.config), session()
    corpus, queries, _ = _tables(spark, a.data)
    some = _queries(queries).filter(F.col("split") == config.get("split", "val")).orderBy("query_id").limit(a.queries)
    report = {"config": a.config} | profile(config, _corpus(corpus), some, int(config.get("max_results", 100)))
    records.write_record(report, a.output or f"results/{Path(a.config).stem}_profile.json")
    _say(report)


def export_index(a) -> None:
    spark = session()
    path = a.corpus or f"{a.data}/corpus.parquet"
    load = pipeline.ENCODERS["trained" if a.checkpoint else "hashing"]({"model_name": a.checkpoint, "seed": a.seed})
    vectors = r.encode(_corpus(spark.read.parquet(path)).select("doc_id", "text"), load)
    _say(posts.write_vectors(vectors, a.out, {"checkpoint": a.checkpoint, "corpus": path, "commit": records.current_commit()}))


def ann_sweep(a) -> None:
    spark = session()
    load = pipeline.ENCODERS["trained" if a.checkpoint else "hashing"]({"model_name": a.checkpoint, "seed": a.seed})
    asked = _queries(posts.read_table(spark, a.data, "queries")).filter("split = 'val'").orderBy("query_id").limit(a.queries)
    corpora = {}
    for folder in a.embeddings:
        vectors = posts.read_vectors(spark, folder)
        corpora[vectors.count()] = vectors
    runs = studies.sweep(corpora, r.encode(asked.select("query_id", "text"), load), a.k, tuple(a.nprobe), a.cells, seed=a.seed)
    records.write_record({"k": a.k, "queries": asked.count(), "runs": runs}, a.output)
    rows = [(x["documents"], x["index"], x["nprobe"], x["recall_at_k"], x["p50_ms"]) for x in runs]
    studies.fastest(spark.createDataFrame(rows, "documents long, index string, nprobe int, recall_at_k double, p50_ms double")).orderBy("documents").show()


def build_scaling_corpus(a) -> None:
    spark = session()
    base, pool = posts.read_table(spark, a.data, "corpus"), None
    for name in a.sites:
        one = site.load_site(spark, name, a.raw).select(*base.columns)
        pool = one if pool is None else pool.unionByName(one)
    pool = base.limit(0) if pool is None else pool
    made = {}
    for n, df in studies.nested_corpora(base, pool, a.sizes, "answer_id", a.seed).items():
        posts.write_table(df, a.out, f"scaling_corpus_{n}")
        made[str(n)] = f"{a.out}/scaling_corpus_{n}.parquet"
    summary = {"base_documents": base.count(), "pool_documents": pool.count(), "corpora": made}
    records.write_record(summary, f"{a.out}/scaling_corpora.json")
    _say(summary)


def make_results_table(a) -> None:
    sections = records.read_config(a.sections)["sections"] if a.sections else None
    text = records.report(records.evaluations(a.results, a.split), records.comparisons(a.results), sections)
    Path(a.output).write_text(text)
    print(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodeseek", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> None:
        c = sub.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        c.set_defaults(run=run)
        for name, value in options:
            if value is bool:
                c.add_argument(name, action="store_true")
            elif value is str:
                c.add_argument(name, required=True)
            elif isinstance(value, list):
                c.add_argument(name, nargs="*", default=value, type=type(value[0]) if value else str)
            else:
                c.add_argument(name, default=value, type=type(value) if value is not None else str)

    data, seed = ("--data", "data/processed"), ("--seed", 17)
    command(download_data, ("--out", "data/raw"), ("--url", DUMP), ("--force", bool))
    command(build_dataset, ("--raw", "data/raw"), ("--out", "data/processed"), ("--stats", "results/dataset_stats.json"), ("--val-frac", 0.1), ("--test-frac", 0.1))
    command(evaluate, ("--config", str), data)
    command(compare_runs, ("--baseline", str), ("--candidate", str), ("--metric", "ndcg_at_10"), ("--iterations", 10_000), seed, ("--out", "results/comparisons"))
    command(mine_negatives, ("--config", str), data)
    command(train, ("--config", str), data, ("--resume", bool))
    command(train_reranker, ("--config", str), data, ("--resume", bool))
    command(probe_reranker, ("--checkpoint", None), data, ("--questions", 100), ("--distractors", 4), seed, ("--output", "results/probe.json"))
    command(profile_pipeline, ("--config", str), data, ("--queries", 100), ("--output", None))
    command(export_index, ("--checkpoint", None), data, ("--corpus", None), ("--out", "artifacts"), seed)
    command(ann_sweep, ("--embeddings", ["artifacts"]), data, ("--checkpoint", None), ("--queries", 200), ("--k", 10), ("--nprobe", [1, 2, 4, 8, 16, 32]), ("--cells", 256), seed, ("--output", "results/ann_scaling.json"))
    command(build_scaling_corpus, data, ("--raw", "data/raw/scaling"), ("--out", "artifacts"), ("--sites", []), ("--sizes", [100_000, 400_000]), seed)
    command(make_results_table, ("--results", "results"), ("--output", "RESULTS.md"), ("--split", "val"), ("--sections", None))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(sys.argv[1:] if argv is None else argv)
    a.run(a)
