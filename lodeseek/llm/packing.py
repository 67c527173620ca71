"""Problem 7: filling fixed-capacity containers by lexical retrieval packing."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.tokens import DEFAULT, encoding
from lodeseek.plans.stages import Stages

K1, B = 1.2, 0.75
#: Items in a shard, each with its own index.
SHARD = 3000
#: A term of 1/COMMON of a shard's items or more is a row of a matrix.
COMMON = 8


def items_of(capacities: list[int], path: str):
    """mapInPandas: documents to items. An item row holds, for the capacities in `caps`, the part of a document left
    after its full containers: start, size and its distinct tokens with frequencies (packed as bytes). A capacity is in one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            out = []
            for doc, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                ids = np.array(enc.encode_ordinary(text), np.uint32)
                n = len(ids)
                if n == 0:
                    continue
                mark = xxhash.xxh3_64_intdigest(ids.tobytes()) - 2**63
                tails: dict[int, list[int]] = {}
                for c in capacities:
                    tails.setdefault(n - n % c if n > c else 0, []).append(c)
                for start, caps in tails.items():
                    terms, tf = np.unique(ids[start:], return_counts=True)
                    out.append((doc, source, n, mark, start, n - start, caps, terms.astype("<u4").tobytes(), tf.astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "mark", "start", "size", "caps", "terms", "tf"])

    return run


class Sizes:
    """Unused items by size, for best fit."""

    def __init__(self, sizes: np.ndarray):
        self.order = sorted(zip(sizes.tolist(), range(len(sizes))))

    def largest(self, room: int) -> int | None:
        k = bisect.bisect_right(self.order, (room, 1 << 60)) - 1
        return self.order[k][1] if k >= 0 else None

    def take(self, size: int, i: int) -> None:
        del self.order[bisect.bisect_left(self.order, (size, i))]


def term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas: (term, items) of a partition, at most a row per token of the vocabulary."""
    acc = np.zeros(0, np.int64)
    for pdf in batches:
        if len(pdf):
            part = np.bincount(np.frombuffer(b"".join(pdf["terms"]), "<u4").astype(np.int64))
            if len(part) < len(acc):
                part, acc = acc, part
            part = part.astype(np.int64)
            part[: len(acc)] += acc
            acc = part
    t = np.flatnonzero(acc)
    yield pd.DataFrame({"term": t, "items": acc[t]})


class Statistics:
    """Counts over all items: of items, mean size, and items by token."""

    def __init__(self, items: int, mean: float, by_term: np.ndarray):
        self.items, self.mean, self.by_term = items, max(mean, 1.0), by_term


def statistics(items: DataFrame) -> Statistics:
    n, mean = items.agg(F.count(F.lit(1)), F.avg("size")).first()
    rows = items.select("terms").mapInPandas(term_counts, "term long, items long").groupBy("term").agg(F.sum("items").alias("items")).toPandas()  # the vocabulary at most
    by_term = np.zeros(int(rows["term"].max()) + 1 if len(rows) else 1, np.int64)
    by_term[rows["term"].to_numpy(np.int64)] = rows["items"].to_numpy(np.int64)
    return Statistics(n, float(mean or 0), by_term)


class Index:
    """BM25 weights of the items in order of size, so that the items that fit a room are a prefix of it. Postings go by
    term, so a seed reads those of its own terms only: a row of a matrix for a term of many items (1/COMMON of all or
    more), else a list of rows."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], stats: Statistics):
        n = len(sizes)
        self.items = np.lexsort((np.arange(n), sizes))
        self.sizes = sizes[self.items]
        row = np.repeat(np.arange(n), [len(terms[i]) for i in self.items])
        self.vocab, term, times = np.unique(np.concatenate([terms[i] for i in self.items]), return_inverse=True, return_counts=True)
        whole = stats.by_term[self.vocab]
        idf = np.log(1 + (stats.items - whole + 0.5) / (whole + 0.5))
        norm = K1 * (1 - B + B * np.maximum(self.sizes, 1) / stats.mean)
        freq = np.concatenate([tfs[i] for i in self.items]).astype(np.float64)
        weight = idf[term] * freq * (K1 + 1) / (freq + norm[row])
        common = times * COMMON >= n
        self.place = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), n))
        on = common[term]
        self.matrix[self.place[term[on]], row[on]] = weight[on]
        term, row, weight = term[~on], row[~on], weight[~on]
        order = np.argsort(term * n + row)
        self.term, self.row, self.weight = term[order], row[order], weight[order]
        self._key()

    def _key(self) -> None:
        self.key = self.term * len(self.items) + self.row
        self.first = np.searchsorted(self.term, np.arange(len(self.vocab)))

    def keep(self, stay: np.ndarray) -> None:
        """Leaves out the rows where `stay` is false."""
        on = stay[self.row]
        self.items, self.sizes, self.matrix = self.items[stay], self.sizes[stay], self.matrix[:, stay]
        self.term, self.row, self.weight = self.term[on], (np.cumsum(stay) - 1)[self.row[on]], self.weight[on]
        self._key()

    def scores(self, terms: np.ndarray, room: int) -> np.ndarray:
        """Scores by all of `terms`, of the rows of at most `room`; items of equal terms have equal scores."""
        m = int(np.searchsorted(self.sizes, room, "right"))
        t = np.searchsorted(self.vocab, terms)
        place, score = self.place[t], np.zeros(m)
        for row in place[place >= 0].tolist():
            score += self.matrix[row, :m]
        t = t[place < 0]
        first = self.first[t]
        times = np.searchsorted(self.key, t * len(self.items) + m) - first
        at = np.repeat(first - np.cumsum(times) + times, times)
        if len(at):
            at += np.arange(len(at))
            score += np.bincount(self.row[at], self.weight[at], m)
        return score


def fill(sizes: np.ndarray, terms: list[np.ndarray], tfs: list[np.ndarray], capacity: int, stats: Statistics) -> list[list[int]]:
    """Containers as lists of items. The largest unused item is the seed; its unused BM25 neighbours that fit follow by
    score; then, while any item fits, the largest that does."""
    n = len(sizes)
    if not n:
        return []
    free = Sizes(sizes)
    used = np.zeros(n, bool)
    index = Index(sizes, terms, tfs, stats)
    boxes = []
    while free.order:
        seed = free.order[-1][1]
        box, room = [seed], capacity - int(sizes[seed])
        used[seed] = True
        free.take(int(sizes[seed]), seed)
        if free.order and free.order[0][0] <= room:
            if len(free.order) < len(index.items) * 3 // 4:
                index.keep(~used[index.items])
            score = index.scores(terms[seed], room)
            score[used[index.items[: len(score)]]] = 0
            while len(score) and (best := score.max()) > 0:
                rows = np.flatnonzero(score == best)
                row = int(rows[np.argmin(index.items[rows])])  # equal scores: the earlier item
                i = int(index.items[row])
                box.append(i)
                used[i] = True
                free.take(int(sizes[i]), i)
                room -= int(sizes[i])
                score[row] = 0
                score = score[: np.searchsorted(index.sizes, room, "right")]
            while (i := free.largest(room)) is not None:
                box.append(i)
                used[i] = True
                free.take(int(sizes[i]), i)
                room -= int(sizes[i])
        boxes.append(box)
    return boxes


def _pack(names: dict[int, list[str]], stats: Statistics):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start"], ignore_index=True)
        shard, rows = str(pdf["shard"].iloc[0]), []
        caps = [set(c) for c in pdf["caps"]]
        terms = [np.frombuffer(b, "<u4") for b in pdf["terms"]]
        tfs = [np.frombuffer(b, "<u4") for b in pdf["tf"]]
        doc, start = pdf["doc_id"].to_numpy(), pdf["start"].to_numpy()
        for cap, called in names.items():
            own = [i for i, c in enumerate(caps) if cap in c]
            sizes = pdf["size"].to_numpy()[own]
            for k, box in enumerate(fill(sizes, [terms[i] for i in own], [tfs[i] for i in own], cap, stats)):
                for p, j in enumerate(box):
                    for name in called:
                        rows.append((name, f"{shard}:{k}", p, doc[own[j]], start[own[j]], sizes[j]))
        return pd.DataFrame(rows, columns=["container_name", "container_id", "position", "doc_id", "start_token", "n_tokens"])

    return run


def pack(documents: DataFrame, containers: DataFrame, tokenizer: str = DEFAULT) -> DataFrame:
    """(container_name, container_id, position, doc_id, start_token, n_tokens): every token of every document once per kind
    of container.

    A document longer than the capacity gives full containers of its own and its rest as an item; no other is divided.
    Items are sharded by source and hash into about SHARD items; a shard indexes its items
    and packs them; term counts and mean size are of all items. Null or
    empty texts and null ids have no row; of a repeated id the text of most tokens counts, of equal sizes any one; capacities that are null or below 1 are left out.
    """
    st = Stages(documents.sparkSession)
    names: dict[int, list[str]] = {}
    for r in containers.filter("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct().orderBy("container_name").collect():  # parameters
        names.setdefault(int(r[1]), []).append(r[0])
    schema = "container_name string, container_id string, position int, doc_id long, start_token long, n_tokens long"
    if not names:
        return documents.sparkSession.createDataFrame([], schema)
    d = documents.filter("doc_id is not null and text <> ''").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    items = d.mapInPandas(items_of(sorted(names), tokenizer), "doc_id long, source string, n_tokens long, mark long, start long, size long, caps array<int>, terms binary, tf binary")
    items = st.keep(items, "items")
    whole = items.filter(F.array_contains("caps", min(names))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("n_tokens", "mark", "source")).alias("best"))
    again = st.keep(whole.filter("rows > 1").select("doc_id", "best"), "again")
    if not again.isEmpty():
        best = F.struct("n_tokens", "mark", "source")
        one = items.join(again, "doc_id").filter(best == F.col("best")).drop("best").dropDuplicates(["doc_id", "start"])
        items = st.keep(items.join(again, "doc_id", "left_anti").unionByName(one), "once")
    counts = items.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    few = counts.count() <= 100_000
    counts = F.broadcast(counts) if few else counts
    items = items.join(counts, "source")
    salt = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / SHARD))
    # small sources share shards by hash
    total = items.select("doc_id").count()
    shared = F.concat(F.lit("*"), F.pmod(F.xxhash64("source"), F.lit(max(1, total // (8 * SHARD)))).cast("string"))
    shard = F.when(F.col("n") < SHARD // 4, shared).otherwise(F.concat_ws("/", "source", salt.cast("string")))
    packed = items.withColumn("shard", shard).drop("source", "n").groupBy("shard").applyInPandas(_pack(names, statistics(items)), schema)
    full = items.filter("start > 0").select("doc_id", "start", F.explode("caps").alias("cap"))
    full = full.select("doc_id", "cap", F.explode(F.sequence(F.lit(0), F.col("start") - 1, F.col("cap").cast("long"))).alias("s"))
    kinds = F.create_map(*[x for c, ns in names.items() for x in (F.lit(c), F.array(*[F.lit(n) for n in ns]))])
    full = full.select(F.explode(kinds[F.col("cap")]).alias("container_name"), F.concat_ws("@", "doc_id", "s").alias("container_id"), F.lit(0).alias("position"), "doc_id", F.col("s").alias("start_token"), F.col("cap").cast("long").alias("n_tokens"))
    return packed.unionByName(full).filter("n_tokens > 0")


def filling(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_name, container_id, capacity_tokens, documents, used_tokens, unused_tokens) of every container."""
    one = packed.groupBy("container_name", "container_id").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("used_tokens"))
    c = F.broadcast(containers.filter("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct())
    return one.join(c, "container_name").withColumn("unused_tokens", F.col("capacity_tokens") - F.col("used_tokens"))


def packing_checks(packed: DataFrame, containers: DataFrame, least: float = 0.98) -> DataFrame:
    """(name, n): what must hold of a packing, counted."""
    st = Stages(packed.sparkSession)
    packed = st.keep(packed, "packed")
    boxes = filling(packed, containers)
    caps = F.broadcast(containers.filter("capacity_tokens > 0").select("container_name", "capacity_tokens").distinct())
    each = packed.groupBy("container_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end")).join(caps, "container_name")
    kinds = boxes.groupBy("container_name").agg((F.sum("used_tokens") / F.sum("capacity_tokens")).alias("fill"))
    parts = {
        "documents": each.select("doc_id").distinct(),
        "containers over their capacity": boxes.filter("unused_tokens < 0"),
        "documents divided though they fit": each.filter("pieces > 1 and tokens <= capacity_tokens"),
        "documents in more pieces than needed": each.filter(F.col("pieces") > F.ceil(F.col("tokens") / F.col("capacity_tokens"))),
        "documents with tokens lost or doubled": each.groupBy("doc_id").agg(F.count_distinct("tokens").alias("sums"), F.count(F.lit(1)).alias("kinds"), F.max(F.abs(F.col("tokens") - F.col("end"))).alias("gap")).crossJoin(F.broadcast(caps.agg(F.count_distinct("container_name").alias("all")))).filter("sums > 1 or kinds < all or gap > 0"),  # one row
        "kinds filled less": kinds.filter(F.col("fill") < least),
    }
    out = None
    for name, d in parts.items():
        row = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
