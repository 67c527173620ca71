"""Every command on a small dump, one after the other."""

import functools
import http.server
import json
import threading

import numpy as np
import pytest
import yaml

from lodeseek import cli
from lodeseek.operators import studies
from lodeseek.plans import records
from lodeseek.sources import posts, site

WORDS = ["delta", "gamma", "swap", "curve", "vol", "rate", "bond", "option", "drift", "hedge", "tenor", "smile"]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    folder = tmp_path_factory.mktemp("raw")
    rows = []
    for i in range(60):
        topic = f"{WORDS[i % 12]} {WORDS[(i * 5 + 1) % 12]} term{i}"
        rows.append(f'<row Id="{1000 + i}" PostTypeId="1" AcceptedAnswerId="{2000 + i}" CreationDate="2011-01-{1 + i % 28:02d}T00:{i:02d}:00.000" Score="1" Body="&lt;p&gt;How does {topic} work?&lt;/p&gt;" Title="On {topic} {i}" Tags="|a|" AnswerCount="1" />')
        rows.append(f'<row Id="{2000 + i}" PostTypeId="2" ParentId="{1000 + i}" CreationDate="2011-02-01T00:00:00.000" Score="{i % 5}" Body="&lt;p&gt;The {topic} works like this.&lt;/p&gt;" />')
    (folder / "Posts.xml").write_text('<?xml version="1.0"?>\n<posts>\n' + "\n".join(rows) + "\n</posts>\n")
    (folder / "PostLinks.xml").write_text('<postlinks>\n<row Id="1" CreationDate="2011-01-01T00:00:00.000" PostId="1000" RelatedPostId="1027" LinkTypeId="3" />\n</postlinks>\n')
    return folder


def config(path, **values):
    path.write_text(yaml.safe_dump(values))
    return str(path)


def test_commands(spark, raw, tmp_path, capsys):
    d, res = str(tmp_path / "data"), str(tmp_path / "results")
    cli.main(["build-dataset", "--raw", str(raw), "--out", d, "--stats", f"{res}/stats.json"])
    stats = json.loads((tmp_path / "results/stats.json").read_text())
    assert stats["posts"] == {"questions": 60, "answers": 60} and stats["dropped_as_cross_split_duplicates"] == 1
    assert stats["judgements_per_query"] == 1.0 and set(stats["queries_by_split"]) == {"train", "val", "test"}

    bm25 = {"retriever": "bm25", "parameters": {"k1": 1.2, "b": 0.75}}
    dense = {"retriever": "dense", "parameters": {"encoder": "hashing", "dimensions": 32}}
    runs = {
        "bm25_val": bm25,
        "hybrid_val": {"retriever": "hybrid", "parameters": {"retrievers": [bm25, dense]}},
        "rerank_val": {"retriever": "rerank", "parameters": {"base": bm25, "depth": 10}},
    }
    for k, (name, spec) in enumerate(runs.items()):
        before = json.dumps(spec)
        cli.main(["evaluate", "--config", config(tmp_path / f"{name}.yaml", run_name=name, split="val", display_order=9 - k, output=f"{res}/{name}.json", **spec), "--data", d])
        assert json.dumps(spec) == before
    record = records.read_record(f"{res}/bm25_val.json")
    assert set(record) == {"run_name", "retriever", "split", "commit", "created_at", "config", "metrics", "timing", "counts", "per_query", "environment"}
    assert record["counts"]["documents"] == 60 and list(record["per_query"]) == sorted(record["per_query"]) and record["metrics"]["recall_at_100"] == 1.0
    cli.main(["compare-runs", "--baseline", f"{res}/bm25_val.json", "--candidate", f"{res}/hybrid_val.json", "--iterations", "200", "--out", f"{res}/comparisons"])
    sections = config(tmp_path / "sections.yaml", sections=[{"title": "Fusion", "baseline": "bm25_val", "candidates": ["hybrid_val"]}, {"title": "None", "baseline": "absent", "candidates": ["hybrid_val"]}])
    cli.main(["make-results-table", "--results", res, "--output", str(tmp_path / "R.md"), "--sections", sections])
    text = (tmp_path / "R.md").read_text()
    assert text.index("| Rerank Val") < text.index("| Hybrid Val") < text.index("| BM25 ") and "## Fusion" in text and "## None" not in text and "p = " in text

    cli.main(["profile-pipeline", "--config", str(tmp_path / "rerank_val.yaml"), "--data", d, "--queries", "3", "--output", f"{res}/p/profile.json"])
    assert set(records.read_record(f"{res}/p/profile.json")["stages"]) == {"rerank", "rerank.base:bm25", "rerank.scorer"}

    mine = config(tmp_path / "mine.yaml", sources=[{"name": "bm25", **bm25}], mining={"depth": 20, "per_query": 2, "skip_top": 1}, random_per_query=3, output=f"{d}/negatives.parquet")
    cli.main(["mine-negatives", "--config", mine, "--data", d])
    settings = {"batch_size": 8, "epochs": 2, "slots": 4096, "dimensions": 16, "negatives_per_query": 1, "random_negatives_per_query": 1, "limit_pairs": 40, "log_every": 2}
    for command, name in (("train", "enc"), ("train-reranker", "sc")):
        out = str(tmp_path / name)
        cli.main([command, "--config", config(tmp_path / f"{name}.yaml", output_dir=out, **settings), "--data", d])
        losses = [e["loss"] for e in records.read_record(f"{out}/history.json")["epochs"]]
        assert losses[1] < losses[0]
    # one epoch and resuming give the same table as two at once
    half = str(tmp_path / "half")
    for epochs, more in ((2, ["--resume"]),):
        (tmp_path / "half").mkdir()
        (tmp_path / "half/epoch-1").mkdir()
        for f in ("table.npy", "state.npz"):
            (tmp_path / "half/epoch-1" / f).write_bytes((tmp_path / "enc/epoch-1" / f).read_bytes())
        first = records.read_record(str(tmp_path / "enc/history.json"))
        records.write_record(first | {"epochs": first["epochs"][:1]}, f"{half}/history.json")
        cli.main(["train", "--config", config(tmp_path / "half.yaml", output_dir=half, **(settings | {"epochs": epochs})), "--data", d, *more])
    assert np.allclose(np.load(f"{half}/epoch-2/table.npy"), np.load(tmp_path / "enc/epoch-2/table.npy"))

    cli.main(["probe-reranker", "--checkpoint", str(tmp_path / "sc/epoch-2"), "--data", d, "--questions", "20", "--output", f"{res}/p/probe.json"])
    probe = records.read_record(f"{res}/p/probe.json")["splits"]
    assert [x["split"] for x in probe] == ["val", "train"] and probe[1]["top_one_accuracy"] > 0.5

    art = str(tmp_path / "art")
    cli.main(["export-index", "--checkpoint", str(tmp_path / "enc/epoch-2"), "--data", d, "--out", art])
    assert records.read_record(f"{art}/manifest.json")["documents"] == 60
    cli.main(["ann-sweep", "--embeddings", art, "--data", d, "--checkpoint", str(tmp_path / "enc/epoch-2"), "--queries", "5", "--nprobe", "1", "4", "--cells", "4", "--output", f"{res}/p/ann.json"])
    sweep = records.read_record(f"{res}/p/ann.json")["runs"]
    assert [x["recall_at_k"] for x in sweep if x["nprobe"] in (None, 4)] == [1.0, 1.0] and sweep[1]["recall_at_k"] <= 1.0

    (tmp_path / "sites/other").mkdir(parents=True)
    (tmp_path / "sites/other/Posts.xml").write_bytes((raw / "Posts.xml").read_bytes())
    cli.main(["build-scaling-corpus", "--data", d, "--raw", str(tmp_path / "sites"), "--out", art, "--sites", "other", "--sizes", "70", "80", "10", "9999"])
    small, large = (spark.read.parquet(f"{art}/scaling_corpus_{n}.parquet").select("answer_id") for n in (70, 80))
    assert small.count() == 70 and large.count() == 80 and small.join(large, "answer_id", "left_anti").count() == 0
    assert set(records.read_record(f"{art}/scaling_corpora.json")["corpora"]) == {"70", "80"}


def test_vectors_in_and_out(spark, tmp_path):
    df = spark.createDataFrame([(7, [1.0, 0.5]), (3, [0.25, 2.0])], "doc_id long, embedding array<float>")
    m = posts.write_vectors(df, str(tmp_path), {"commit": "x"})
    assert m["documents"] == 2 and m["dimensions"] == 2 and m["commit"] == "x"
    for p in ("fp32", "fp16"):
        assert sorted((x[0], list(x[1])) for x in posts.read_vectors(spark, str(tmp_path), p).collect()) == [(3, [0.25, 2.0]), (7, [1.0, 0.5])]
    np.save(tmp_path / "answer_ids.npy", np.arange(3))
    with pytest.raises(ValueError):
        posts.read_vectors(spark, str(tmp_path))
    with pytest.raises(ValueError):
        posts.write_vectors(df.union(df), str(tmp_path))


def test_download(tmp_path):
    (tmp_path / "www").mkdir()
    (tmp_path / "www/dump.bin").write_bytes(b"x" * 5000)

    class Quiet(http.server.SimpleHTTPRequestHandler):
        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(Quiet, directory=str(tmp_path / "www")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url, target = f"http://127.0.0.1:{server.server_port}/dump.bin", str(tmp_path / "in/dump.bin")
        assert [site.download(url, target)["fetched"], site.download(url, target)["fetched"], site.download(url, target, True)["fetched"]] == [True, False, True]
        assert records.read_record(str(tmp_path / "in/dump_info.json"))["bytes_downloaded"] == 5000
    finally:
        server.shutdown()


def test_extract(tmp_path):
    import shutil

    (tmp_path / "a").mkdir()
    (tmp_path / "a/Posts.xml").write_text("<posts/>")
    archive = shutil.make_archive(str(tmp_path / "dump"), "zip", tmp_path / "a")
    assert site.extract(archive, str(tmp_path / "b"), ("Posts.xml",)) == [str(tmp_path / "b/Posts.xml")]
    with pytest.raises(KeyError):
        site.extract(archive, str(tmp_path / "b"))


def test_fastest(spark):
    s = "documents long, index string, nprobe int, recall_at_k double, p50_ms double"
    runs = spark.createDataFrame([(10, "exact", None, 1.0, 5.0), (10, "ivf", 1, 0.5, 1.0), (10, "ivf", 4, 0.96, 3.0), (10, "ivf", 8, 0.99, 3.0), (20, "exact", None, 1.0, 2.0), (20, "ivf", 1, 0.9, 1.0)], s)
    assert sorted(map(tuple, studies.fastest(runs).collect())) == [(10, 4, 3.0, 5.0, True), (20, None, None, 2.0, False)]
    assert cli.choose_device() == "cpu" and cli.choose_device("auto", ("cuda", "cpu")) == "cuda" and cli.choose_device("mps") == "mps"
