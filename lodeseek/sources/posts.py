"""Readers and writers: post dumps in XML, Parquet tables, vectors in .npy, JSON records."""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import parse_tags

# Attributes of the dump, post types 1 and 2, and the ranges of foreign ids.
_POST = "_Id long, _PostTypeId string, _AcceptedAnswerId long, _ParentId long, _CreationDate string, _Score int, _ViewCount int, _Body string, _OwnerUserId long, _Title string, _Tags string, _AnswerCount int"
_LINK = "_Id long, _CreationDate string, _PostId long, _RelatedPostId long, _LinkTypeId int"


def _rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "row").schema(schema).load(path)


def read_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, answers); post types other than 1 and 2 are dropped."""
    x = _rows(spark, path, _POST)
    date = F.to_timestamp_ntz("_CreationDate").alias("creation_date")
    text = lambda c: F.coalesce(c, F.lit(""))
    num = lambda c: F.coalesce(c, F.lit(0))
    q = x.filter("_PostTypeId = '1'").select(
        F.col("_Id").alias("question_id"), text("_Title").alias("title"), text("_Body").alias("body_html"), parse_tags(F.col("_Tags")).alias("tags"), num("_Score").alias("score"),
        F.col("_ViewCount").alias("view_count"), num("_AnswerCount").alias("answer_count"), F.col("_AcceptedAnswerId").alias("accepted_answer_id"), date, F.col("_OwnerUserId").alias("owner_user_id"),
    )
    a = x.filter("_PostTypeId = '2'").select(
        F.col("_Id").alias("answer_id"), F.col("_ParentId").alias("question_id"), text("_Body").alias("body_html"), num("_Score").alias("score"), date, F.col("_OwnerUserId").alias("owner_user_id")
    )
    return q, a


def read_post_links(spark: SparkSession, path: str) -> DataFrame:
    return _rows(spark, path, _LINK).select(F.col("_PostId").alias("post_id"), F.col("_RelatedPostId").alias("related_post_id"), F.col("_LinkTypeId").alias("link_type_id"))


def id_offset(site: str) -> int:
    return (zlib.crc32(site.encode()) % 900 + 100) * 10_000_000


def shift_ids(df: DataFrame, site: str, columns: list[str]) -> DataFrame:
    """Ids of a foreign site moved into a range of their own."""
    return df.withColumns({c: F.col(c) + F.lit(id_offset(site)) for c in columns})


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(position, embedding) of two-dimensional .npy files, a row per vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                x = np.load(io.BytesIO(raw)).astype(np.float32)
                for s in range(0, len(x), 4096):
                    yield pd.DataFrame({"position": range(s, min(len(x), s + 4096)), "embedding": list(x[s : s + 4096])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "position long, embedding array<float>")


def read_vectors(spark: SparkSession, folder: str, precision: str = "fp32") -> DataFrame:
    """(doc_id, embedding) of a folder written by write_vectors; ids and vectors must be equally many."""
    ids = np.load(f"{folder}/answer_ids.npy")
    count = int(np.load(f"{folder}/embeddings_{precision}.npy", mmap_mode="r").shape[0])
    if len(ids) != count:
        raise ValueError(f"{len(ids)} ids for {count} vectors")
    by = spark.createDataFrame(pd.DataFrame({"position": np.arange(count), "doc_id": ids.astype(np.int64)}), "position long, doc_id long")
    return read_npy(spark, f"{folder}/embeddings_{precision}.npy").join(by, "position").select("doc_id", "embedding")


def write_vectors(vectors: DataFrame, folder: str, manifest: dict | None = None) -> dict:
    """Writes (doc_id, embedding) by id as embeddings_fp32.npy and embeddings_fp16.npy beside answer_ids.npy and
    manifest.json, and gives the manifest. One file each, as the format has it: rows stream through the driver, and the
    arrays lie on disk while they are filled. At scale keep vectors in Parquet."""
    path = Path(folder)
    path.mkdir(parents=True, exist_ok=True)
    n = vectors.count()
    first = vectors.select(F.size("embedding").alias("d")).first()
    d = first["d"] if first else 0
    if not vectors.filter((F.size("embedding") != d) | F.col("embedding").isNull()).isEmpty() or vectors.select("doc_id").distinct().count() < n:
        raise ValueError("vectors must have one length and unique ids")
    types = {"embeddings_fp32": (np.float32, (n, d)), "embeddings_fp16": (np.float16, (n, d)), "answer_ids": (np.int64, (n,))}
    out = {k: np.lib.format.open_memmap(path / f"{k}.npy", "w+", t, shape) for k, (t, shape) in types.items()} if n else {}
    for k, (t, shape) in types.items() if not n else ():
        np.save(path / f"{k}.npy", np.zeros(shape, t))
    for i, r in enumerate(vectors.select("doc_id", "embedding").orderBy("doc_id").toLocalIterator()):
        out["answer_ids"][i] = r["doc_id"]
        out["embeddings_fp32"][i] = out["embeddings_fp16"][i] = r["embedding"]
    for x in out.values():
        x.flush()
    record = {**(manifest or {}), "documents": n, "dimensions": d, "bytes": {p: (path / f"embeddings_{p}.npy").stat().st_size for p in ("fp32", "fp16")}}
    (path / "manifest.json").write_text(json.dumps(record, indent=2, sort_keys=True) + "\n")
    return record
