"""Written stages: tables that cut lineage in the shared checkpoint folder, and joins that withstand hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders to remove when the process ends: stages of live sessions, and the own folder where none is named.
_STAGES: list[tuple[SparkSession, str]] = []
_OWN: list[str] = []


def _remove(spark: SparkSession, path: str) -> None:
    """Removes a folder on whatever file system it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _STAGES:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session ended before: what is on a local path can still go
            shutil.rmtree(path.removeprefix("file:").replace("//", "/", 1), ignore_errors=True)
    for path in _OWN:
        shutil.rmtree(path, ignore_errors=True)


atexit.register(_sweep)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode, an error elsewhere."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = getattr(shared_dir, "own", None)
    if path is None:
        path = shared_dir.own = tempfile.mkdtemp(prefix="lodeseek-")
        _OWN.append(path)
    return path


class Stages:
    """Tables written by one run of an operator. A lost executor costs nothing: the files are in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodeseek-{uuid.uuid4().hex}"
        _STAGES.append((spark, self.root))

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes stages that nothing reads any more."""
        for name in names:
            _remove(self.spark, f"{self.root}/{name}")

    def close(self) -> None:
        """Removes all stages, once no result is read any more; else it happens when the process ends."""
        _remove(self.spark, self.root)
        _STAGES.remove((self.spark, self.root))


def one_each(df: DataFrame, key: str, by: dict[str, Callable[[str], Column]], most: int = 500_000) -> DataFrame:
    """df.groupBy(key).agg(...) of functions that return a single value as it is (min, max), for wide rows whose keys seldom
    repeat: only keys and the rows of repeated or null keys are shuffled. With more than `most` repeated keys all rows are."""
    twice = Stages(df.sparkSession).keep(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(key), "twice")
    again, n = df, twice.limit(most + 1).count()
    if n <= most:
        again = df.join(F.broadcast(twice), key, "left_semi").unionByName(df.filter(F.col(key).isNull()))  # at most `most` keys
    each = again.groupBy(key).agg(*[f(c).alias(c) for c, f in by.items()])
    if n > most:
        return each
    return df.filter(F.col(key).isNotNull()).join(F.broadcast(twice), key, "left_anti").select(key, *by).unionByName(each)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order) -> DataFrame:
    """The rows with their 0-based position `_pos` in an order without ties: a range-partitioned sort and the counts of
    its partitions, a row each on the driver, instead of a window over the whole table."""
    spark = df.sparkSession
    by = df.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    by = Stages(spark).keep(by, "sorted")
    piece, n, starts = F.shiftright("_at", 33), 0, []
    for r in sorted(by.groupBy(piece.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["p"], n - (r["p"] << 33)))
        n += r["n"]
    starts = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))
    return by.withColumn("_p", piece).join(starts, "_p").withColumn("_pos", F.col("_at") + F.col("_start")).drop("_p", "_at", "_start")


#: Hot keys a partition. What is beyond has at most 1/SHARES of a fair partition's rows a key, so it needs no split.
SHARES = 32


def hot_keys(df: DataFrame, keys: list[str], least: int = 100_000) -> list:
    """Keys with more than `least` rows, the SHARES x partitions largest: a bounded list for the driver."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
    top = counts.orderBy(F.desc("_n")).limit(SHARES * parts(df.sparkSession)).collect()
    return [tuple(r[k] for k in keys) for r in top]


def hot_cold_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = 100_000) -> DataFrame:
    """Joins left with right, whose key is unique. Hot keys of left meet a broadcast of their few rows of right and are not
    shuffled; all others take an ordinary join. how: inner or left. Null keys count as unmatched."""
    some = left.filter(F.col(key).isNotNull())
    hot = [] if some.limit(least + 1).count() <= least else [k for (k,) in hot_keys(some, [key], least)]
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how).unionByName(left.filter(~is_hot).join(right.filter(~is_hot), key, how))


def block_join(left: DataFrame, right: DataFrame, key: str, size: int = 4096, sample: int = 64) -> DataFrame:
    """The inner join on a key that both sides may repeat. Keys with more than `size` rows of a side, or 1/SHARES of a fair
    partition if that is more, are cut into blocks by hash, and every pair of blocks is a join key of its own: no task
    gets a whole hot key. Keys are counted in a 1/sample part of the rows (a key that it should miss is joined whole: the
    result is right at any rate). At most SHARES x partitions keys are that large, so their table can be broadcast."""
    spark = left.sparkSession
    sides = [(df.select(key), left_n, right_n) for df, left_n, right_n in ((left, 1, 0), (right, 0, 1))]
    if sample > 1:
        sides = [(df.filter(F.rand(7) < 1 / sample), x, y) for df, x, y in sides]
    one, two = (df.select(key, F.lit(x * sample).alias("_l"), F.lit(y * sample).alias("_r")) for df, x, y in sides)
    counts = one.unionByName(two).groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    size = F.greatest(F.lit(size // 2 if sample > 1 else size), F.col("_t") / F.lit(SHARES * parts(spark)))
    large = counts.crossJoin(F.broadcast(counts.agg(F.sum(F.col("_l") + F.col("_r")).alias("_t")))).filter((F.greatest("_l", "_r") > size) & F.col(key).isNotNull())  # one row
    large = large.select(key, F.greatest(F.lit(1), F.ceil(F.col("_l") / size)).alias("_bl"), F.greatest(F.lit(1), F.ceil(F.col("_r") / size)).alias("_br"))
    rows = large.collect()  # at most SHARES x partitions
    if not rows:
        return left.join(right, key)
    large = F.broadcast(spark.createDataFrame(rows, large.schema))

    def cut(df: DataFrame, own: str, other: str) -> DataFrame:
        names = df.columns
        df = df.join(large, key, "left").fillna(1, ["_bl", "_br"])
        df = df.withColumn(own, F.pmod(F.xxhash64(*names), F.col("_bl" if own == "_i" else "_br")))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_br" if own == "_i" else "_bl") - 1))).select(*names, "_i", "_j")

    return cut(left, "_i", "_j").join(cut(right, "_j", "_i"), [key, "_i", "_j"]).drop("_i", "_j")
