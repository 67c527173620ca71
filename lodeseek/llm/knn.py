"""Problem 4: the k most similar vectors of every vector by shifted Hilbert curves."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.plans.stages import Stages, hot_cold_join, parts

#: Classes in a block of a curve that one task compares, beside the windows on both sides.
BLOCK = 8192
#: Classes whose exact neighbours measure the recall.
PROBES = 512
#: Above the error of a float32 scalar product of unit vectors of 64 numbers.
SLACK = 2e-5


def hilbert_keys(q: np.ndarray, bits: int) -> np.ndarray:
    """Positions of lattice points (n x d, `bits` bits each) on the Hilbert curve, by the transposed-bits method: byte
    strings of d x bits bits, whose leading bits are the positions on the coarser curves."""
    assert 1 <= bits <= 31
    x = q.astype(np.uint32).T.copy()
    d = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = np.uint32(step - 1)
        for i in range(d):
            high = (x[i] & step) != 0
            swap = np.where(high, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        t = np.where((x[d - 1] & step) != 0, t ^ np.uint32(step - 1), t)
        step >>= 1
    x ^= t
    planes = np.empty((x.shape[1], bits, d), np.uint8)
    for b in range(bits):
        planes[:, b] = ((x >> np.uint32(bits - 1 - b)) & 1).T
    packed = np.packbits(planes.reshape(x.shape[1], bits * d), axis=1)
    whole, width = packed.tobytes(), packed.shape[1]
    return np.array([whole[i : i + width] for i in range(0, len(whole), width)], object)


def unit_rows(raw, size: int) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), "<f4").reshape(-1, size).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(size: int):
    """mapInPandas: (answer_id, embedding) of `size` elements to (answer_id, raw, code) where all are finite and one is not 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, np.float32) for v in pdf["embedding"]], np.float32).reshape(len(pdf), size)
                ok = np.isfinite(x).all(1) & (x != 0).any(1)
                x, ids = np.where(x == 0, np.float32(0), x)[ok], pdf["answer_id"].to_numpy()[ok]  # one kind of zero
                y = x.astype(np.float64)
                # 1e-13 is above the error of a direction in double and below what tells two float vectors apart in a cosine
                lattice = np.floor(y / np.sqrt((y * y).sum(1))[:, None] * 1e13 + 0.5).astype("<i8")
                code = np.array([xxhash.xxh3_64_intdigest(row) for row in lattice], np.uint64).view(np.int64)
                yield pd.DataFrame({"answer_id": ids, "raw": [row.tobytes() for row in x.astype("<f4")], "code": code})

    return run


def curve_keys(curves: range, dims: int, bits: int, size: int):
    """mapInPandas: a row (curve, key, code) per curve: random orthogonal projection, random shift, Hilbert key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit_rows(pdf["raw"], size)
                for c in curves:
                    r = np.random.default_rng(1000 + c)
                    y = x @ np.linalg.qr(r.standard_normal((size, size)))[0][:, :dims]
                    q = np.clip((y / 1.1 + 0.5 + r.uniform(-0.1, 0.1, dims)) * (1 << bits), 0, (1 << bits) - 1)
                    yield pd.DataFrame({"curve": c, "key": hilbert_keys(q, bits), "code": pdf["code"]})

    return run


def _exact(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for s in range(0, len(a), 1 << 16):
        e = s + (1 << 16)
        out[s:e] = np.einsum("ij,ij->i", x[a[s:e]], x[b[s:e]])
    return np.round(out, 12)


def _least(sims: np.ndarray, k: int, width: int = 48) -> np.ndarray:
    """A lower bound of the k-th largest of each row: the k-th largest of the largest of `width` columns each."""
    cols = sims.shape[1] // width
    if cols <= 2 * k:
        return np.partition(sims, -k, axis=1)[:, -k] if sims.shape[1] > k else np.full(len(sims), -3, sims.dtype)
    tops = sims[:, : cols * width].reshape(len(sims), cols, width).max(2)
    return np.partition(tops, -k, axis=1)[:, -k]


def window_best(k: int, window: int, size: int):
    """applyInPandas of a block of a curve: for each of its own rows what the `window` rows before and after, at least, add
    to the k best known. Neighbours are chosen in float32 with a margin for its error and measured in double."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        x, code, low = unit_rows(pdf["raw"], size), pdf["code"].to_numpy(), pdf["low"].to_numpy()
        f, own, known = x.astype(np.float32), np.flatnonzero(pdf["own"].to_numpy()), pdf["least"].to_numpy()
        out = []
        for s in range(own[0], own[-1] + 1, 256) if len(own) else ():
            e = min(own[-1] + 1, s + 256)
            lo, hi = max(0, s - window), min(len(x), e + window)
            sims = f[s:e] @ f[lo:hi].T
            sims[np.arange(e - s), np.arange(s, e) - lo] = -3  # itself
            bound = np.maximum(np.maximum(known[s:e], _least(sims, k)) - SLACK, -2)
            row, col = np.divmod(np.flatnonzero(sims >= bound.astype(np.float32)[:, None]), hi - lo)
            cos = _exact(x, s + row, lo + col)
            good = cos >= known[s + row]
            row, col, cos = row[good], col[good] + lo, cos[good]
            order = np.lexsort((low[col], -cos, row))
            row, col, cos = row[order], col[order], cos[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, cos = row[best], col[best], cos[best]
            out.append(pd.DataFrame({"code": code[s + row], "other": code[col], "low": low[col], "s": -cos}))
        return pd.concat(out) if out else pd.DataFrame({"code": [], "other": [], "low": [], "s": []})

    return run


def all_best(codes: np.ndarray, raws: list[bytes], k: int, size: int):
    """mapInPandas over all classes: the k largest cosines that a partition has for each of the given classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, top = unit_rows(raws, size), np.full((len(codes), k), -2.0)
        for pdf in batches:
            if len(pdf):
                sims = np.round(q @ unit_rows(pdf["raw"], size).T, 12)
                sims[codes[:, None] == pdf["code"].to_numpy()[None]] = -2
                both = np.concatenate([top, sims], axis=1)
                top = np.partition(both, -k, axis=1)[:, -k:]
        yield pd.DataFrame({"code": np.repeat(codes, k), "cos": top.ravel()})

    return run


def class_neighbours(st: Stages, classes: DataFrame, k: int, size: int, dims: int, bits: int, window: int, curves: int, rounds: int, recall: float) -> DataFrame:
    """(code, list of (s, low, other)): the k classes of the largest cosine -s of every class (code, low, raw), nearly always.

    A round orders the classes along `curves` further curves and ranks them exactly: a range-partitioned sort and the
    counts of its partitions give every class its position. Blocks of BLOCK positions with `window` rows of both
    neighbouring blocks are compared, so no pair is lost at a border and the result does not depend on the number of
    partitions. Only what improves on the k best known goes on. Rounds end when the exact neighbours of
    PROBES classes chosen by hash, found against all classes, are known to the share `recall`."""
    spark = classes.sparkSession
    probes = classes.orderBy(F.xxhash64("code", F.lit(5)), "code").limit(PROBES).select("code", "raw").collect()
    codes = np.array([r["code"] for r in probes], np.int64)
    exact = classes.select("code", "raw").mapInPandas(all_best(codes, [bytes(r["raw"]) for r in probes], k, size), "code long, cos double")
    exact = exact.groupBy("code").agg(F.slice(F.sort_array(F.collect_list("cos"), asc=False), 1, k).alias("c")).collect()  # PROBES rows
    want = {r["code"]: [c for c in r["c"] if c > -2] for r in exact}
    best = None
    for r in range(rounds):
        which = range(r * curves, (r + 1) * curves)
        keyed = classes.select("code", "raw").mapInPandas(curve_keys(which, dims, bits, size), "curve int, key binary, code long")
        order = ["curve", "key", F.xxhash64("curve", "code")]
        ranked = keyed.repartitionByRange(max(parts(spark), curves), *order).sortWithinPartitions(*order)
        ranked = st.keep(ranked.select("curve", "code", F.monotonically_increasing_id().alias("at")), f"ranked{r}")
        piece = F.shiftright("at", 33)
        starts, done = [], {}
        for z in sorted(ranked.groupBy("curve", piece.alias("p")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).collect()):  # partitions + curves rows
            starts.append((z["curve"], z["p"], z["first"], done.get(z["curve"], 0)))
            done[z["curve"]] = done.get(z["curve"], 0) + z["n"]
        starts = spark.createDataFrame(starts, "curve int, p long, first long, start long")
        ranked = ranked.withColumn("p", piece).join(F.broadcast(starts), ["curve", "p"]).select("curve", "code", (F.col("at") - F.col("first") + F.col("start")).alias("pos"))
        known = classes.withColumn("least", F.lit(-2.0))
        if best is not None:
            at_k = F.when(F.size("list") >= k, -F.element_at("list", k)["s"]).otherwise(-2.0)
            known = classes.join(best.select("code", at_k.alias("least")), "code", "left").fillna(-2.0, ["least"])
        block, edge = F.floor(F.col("pos") / BLOCK), F.col("pos") % BLOCK
        near = F.filter(F.array(F.lit(0), F.when(edge < window, -1), F.when(edge >= BLOCK - window, 1)), lambda z: z.isNotNull())
        rows = ranked.join(known, "code").select("curve", "code", "low", "raw", "least", "pos", block.alias("home"), F.explode(near).alias("to"))
        rows = rows.select("curve", (F.col("home") + F.col("to")).alias("block"), "code", "low", "raw", "least", "pos", (F.col("to") == 0).alias("own"))
        groups = curves * -(-max(done.values(), default=1) // BLOCK)
        rows = rows.repartition(max(parts(spark), min(groups, 8 * parts(spark))), "curve", "block")  # work of seconds a group: not for AQE to coalesce
        found = rows.groupBy("curve", "block").applyInPandas(window_best(k, window, size), "code long, other long, low long, s double").select("code", "s", "low", "other")
        if best is not None:
            found = found.unionByName(best.select("code", F.explode("list").alias("z")).select("code", "z.*"))
        merged = F.slice(F.sort_array(F.collect_set(F.struct("s", "low", "other"))), 1, k)
        best = st.keep(found.groupBy("code").agg(merged.alias("list")), f"best{r}")
        st.drop(f"ranked{r}")
        if r:
            st.drop(f"best{r - 1}")
        mine = spark.createDataFrame([(int(c),) for c in codes], "code long") if len(codes) else classes.select("code").limit(0)
        got = {z["code"]: z["list"] for z in best.join(F.broadcast(mine), "code").collect()}  # PROBES rows
        hits = sum(min(len(c), sum(-z["s"] >= c[-1] for z in got.get(code, []))) for code, c in want.items() if c)
        reached = hits / max(1, sum(map(len, want.values())))
        if reached >= recall or not any(want.values()):
            return best
    warnings.warn(f"recall {reached:.3f} after {rounds * curves} curves", stacklevel=2)
    return best


def nearest_vectors(vectors: DataFrame, k: int = 10, size: int = 64, dims: int = 12, bits: int = 20, window: int = 1024, curves: int = 8, rounds: int = 16, recall: float = 0.98) -> DataFrame:
    """(answer_id, neighbour_id, cosine, rank): for each usable vector the k others of the highest cosine, nearly always.

    Usable: `size` finite numbers, not all zero. Vectors of one direction form one class that keeps its k + 1 smallest ids, so a
    large group of copies costs no more than one vector. Randomly projected and shifted classes are ordered along Hilbert
    curves and compared with `window` rows on both sides, in rounds of `curves` curves until the measured recall is
    `recall` (see class_neighbours); a pair is missed only if it is apart on every curve. If `rounds` rounds do not
    reach it, a warning gives the recall. Cosines are double, rounded to 12 decimals; ties go to the smaller id. Null ids
    are left out; of repeated ids one vector counts; other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= window <= BLOCK:
        raise ValueError(f"window must be between 1 and {BLOCK}")
    st = Stages(vectors.sparkSession)
    v = vectors.filter(F.col("answer_id").isNotNull() & (F.size("embedding") == size)).select(F.col("answer_id").cast("long"), F.col("embedding").cast("array<float>"))
    v = v.mapInPandas(usable(size), "answer_id long, raw binary, code long")
    v = st.keep(v.groupBy("answer_id").agg(F.min(F.struct("raw", "code")).alias("m")).select("answer_id", "m.*"), "usable")
    low = v.select("code", "answer_id").withColumn("r", F.row_number().over(W.partitionBy("code").orderBy("answer_id"))).filter(F.col("r") <= k + 1)
    low = st.keep(low.select("code", "answer_id"), "low")
    classes = st.keep(v.groupBy("code").agg(F.min("answer_id").alias("low"), F.min("raw").alias("raw")), "classes")
    best = class_neighbours(st, classes, k, size, dims, bits, window, curves, rounds, recall)
    near = best.select("code", F.explode("list").alias("z")).select("code", F.col("z.other").alias("other"), (-F.col("z.s")).alias("cosine"))
    ids = near.join(low.select(F.col("code").alias("other"), F.col("answer_id").alias("neighbour_id")), "other").select("code", "neighbour_id", "cosine")
    own = low.select("code", F.col("answer_id").alias("neighbour_id"), F.lit(1.0).alias("cosine"))
    by = W.partitionBy("code").orderBy(F.desc("cosine"), "neighbour_id")
    top = ids.unionByName(own).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1)
    lists = top.groupBy("code").agg(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("s"), "neighbour_id"))).alias("list"))
    out = hot_cold_join(v.select("answer_id", "code"), lists, "code")
    out = out.select("answer_id", F.posexplode(F.slice(F.filter("list", lambda z: z["neighbour_id"] != F.col("answer_id")), 1, k)).alias("p", "z"))
    return out.select("answer_id", F.col("z.neighbour_id").alias("neighbour_id"), (-F.col("z.s")).alias("cosine"), (F.col("p") + 1).alias("rank"))
