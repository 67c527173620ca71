"""Result records, comparisons, configurations and the results table."""

from __future__ import annotations

import glob
import json
import platform
import subprocess
from datetime import UTC, datetime
from pathlib import Path

import yaml
from pyspark.sql import DataFrame

from lodeseek.operators.evaluation import METRICS

# Column titles of the metrics, and the place of runs without one of their own.
TITLES = {"ndcg_at_10": "nDCG@10", "mrr_at_10": "MRR@10", "recall_at_10": "Recall@10", "recall_at_100": "Recall@100", "graded_ndcg_at_10": "Graded nDCG@10"}
LAST = 999


def current_commit(folder: str = ".") -> str:
    """The revision of the work tree, or unknown outside of one."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], check=True, capture_output=True, text=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return "unknown"


def result_record(name: str, retriever: str, split: str, config: dict, metrics: dict, timing: dict, counts: dict, per_query: DataFrame | None = None, commit: str | None = None) -> dict:
    """The record of an evaluation with its configuration, revision and environment. per_query: query_id and METRICS, a row a
    judged query; numbers of six decimals under sorted ids."""
    each = {}
    if per_query is not None:
        for r in per_query.select("query_id", *METRICS).orderBy("query_id").toLocalIterator():
            each[str(r["query_id"])] = {m: round(r[m], 6) for m in METRICS}
    where = {"python": platform.python_version(), "platform": platform.platform(), "machine": platform.machine()}
    return {"run_name": name, "retriever": retriever, "split": split, "commit": commit or current_commit(), "created_at": datetime.now(UTC).isoformat(), "config": config, "metrics": metrics, "timing": timing, "counts": counts, "per_query": each, "environment": where}


def write_record(record: dict, path: str) -> str:
    """JSON with sorted keys; missing folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(record, indent=2, sort_keys=True, default=str) + "\n")
    return path


def read_record(path: str) -> dict:
    return json.loads(Path(path).read_text())


def read_records(pattern: str) -> list[dict]:
    """All records of a glob, by path."""
    return [read_record(p) for p in sorted(glob.glob(pattern))]


def evaluations(folder: str, split: str = "val") -> list[dict]:
    """The records of a folder that hold metrics of a split."""
    return [r for r in read_records(f"{folder}/*.json") if r.get("split") == split and "metrics" in r]


def comparisons(folder: str) -> dict[tuple[str, str, str], dict]:
    return {(r["baseline"], r["candidate"], r["metric"]): r for r in read_records(f"{folder}/comparisons/*.json")}


def read_config(path: str) -> dict:
    """A YAML file that holds one mapping."""
    config = yaml.safe_load(Path(path).read_text())
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    return config


def scores_of(record: dict, metric: str) -> list[tuple[int, float]]:
    """(query_id, score) of a record; a record without scores by query, or without the metric, is an error."""
    each = record.get("per_query")
    if not each:
        raise ValueError(f"{record.get('run_name')} has no scores by query")
    lacking = [q for q, s in each.items() if metric not in s]
    if lacking:
        raise ValueError(f"{record.get('run_name')} has no {metric} of query {lacking[0]}")
    return [(int(q), float(s[metric])) for q, s in each.items()]


def difference(d: dict) -> str:
    return f"{d['mean_difference']:+.4f} [{d['ci_low']:+.4f}, {d['ci_high']:+.4f}], p = {d['p_value']:.3f}"


def verdict(found: dict, baseline: str, candidate: str, metric: str = "ndcg_at_10") -> str:
    """The interval of a comparison in brackets and whether it excludes zero; empty if it was not made."""
    d = found.get((baseline, candidate, metric))
    if d is None:
        return ""
    span = f"[{d['ci_low']:+.4f}, {d['ci_high']:+.4f}]"
    return f" ({span}, p = {d['p_value']:.3f})" if d["significant"] else f" ({span}, p = {d['p_value']:.2f}, not distinguishable from noise)"


def display_name(record: dict) -> str:
    """The configured name; else BM25, or the run's name in words."""
    named = record["config"].get("display_name")
    return named or ("BM25" if record["retriever"] == "bm25" else record["run_name"].replace("_", " ").title())


def in_order(records: list[dict]) -> list[dict]:
    return sorted(records, key=lambda r: (r["config"].get("display_order", LAST), r["run_name"]))


def results_table(records: list[dict]) -> str:
    """Markdown, a row a run in display order."""
    lines = ["| Retriever | " + " | ".join(TITLES[m] for m in METRICS) + " | Index time (s) | Search p50 (ms) |", "| --- |" + " ---: |" * (len(METRICS) + 2)]
    for r in in_order(records):
        lines.append(f"| {display_name(r)} | " + " | ".join(f"{r['metrics'][m]:.4f}" for m in METRICS) + f" | {r['timing']['index_seconds']:.2f} | {r['timing']['search_ms_per_query_p50']:.2f} |")
    return "\n".join(lines) + "\n"


def report(records: list[dict], found: dict, sections: list[dict] | None = None) -> str:
    """The table, the best run, and a section per ablation. sections: title, baseline, candidates (run names) and metrics; a
    section without any of its runs is left out. Every difference carries its comparison, if one was made."""
    by_name = {r["run_name"]: r for r in records}
    out = ["# Results", "", results_table(records)]
    if records:
        best = max(in_order(records), key=lambda r: r["metrics"]["ndcg_at_10"])
        out += [f"{display_name(best)} has the highest nDCG@10 of {len(records)} runs, {best['metrics']['ndcg_at_10']:.4f}.", ""]
    for s in sections or []:
        base, lines = by_name.get(s["baseline"]), []
        for name in s["candidates"]:
            for m in s.get("metrics", ["ndcg_at_10"]):
                if base and name in by_name:
                    gain = by_name[name]["metrics"][m] - base["metrics"][m]
                    lines.append(f"- {display_name(by_name[name])} against {display_name(base)}: {gain:+.4f} {TITLES[m]}{verdict(found, s['baseline'], name, m)}")
        if lines:
            out += [f"## {s['title']}", "", *lines, ""]
    return "\n".join(out)
