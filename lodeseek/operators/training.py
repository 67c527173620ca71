"""Negatives, training pairs, batches, losses, pooling and the learning-rate schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.plans.stages import Stages, numbered

RANDOM_RANK = 10_000
#: Slots a question draws at once.
DRAWS = 32


def _allowed(cand: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """Without judged pairs and answers of the same question. cand: question_id, answer_id, ..."""
    parent = corpus.select("answer_id", F.col("question_id").alias("_parent")).distinct()
    return cand.join(qrels.select("question_id", "answer_id"), ["question_id", "answer_id"], "left_anti").join(parent, "answer_id").filter("_parent <> question_id").drop("_parent")


def mine_negatives(run: DataFrame, corpus: DataFrame, qrels: DataFrame, per_query: int = 4, skip_top: int = 1, depth: int = 50, source: str = "bm25") -> DataFrame:
    """(question_id, answer_id, rank from 0, source): the first allowed documents of a run after skip_top."""
    if depth <= skip_top or per_query < 1:
        raise ValueError("depth must exceed skip_top and per_query be positive")
    c = run.filter((F.col("rank") > skip_top) & (F.col("rank") <= depth)).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("answer_id"), (F.col("rank") - 1).alias("rank"))
    w = W.partitionBy("question_id").orderBy("rank")
    return _allowed(c, corpus, qrels).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_query).select("question_id", "answer_id", "rank", F.lit(source).alias("source"))


def random_negatives(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, per_query: int = 2, seed: int = 17) -> DataFrame:
    """per_query allowed documents per question, drawn by hashed slots: slot -> md5 -> position in the corpus by answer_id.
    Questions that DRAWS slots leave short draw twice as many more, again and again; if a question is still short after
    64 slots a document, ValueError says that too few documents are allowed."""
    st = Stages(queries.sparkSession)
    pos = st.keep(numbered(corpus.select("answer_id").distinct(), "answer_id"), "positions")
    n = pos.count()
    if n <= per_query:
        raise ValueError("the corpus must exceed per_query")
    slot = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("question_id").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("long") % n
    left, out, first, r = queries.select("question_id").distinct(), None, 0, 0
    while True:
        end = 2 * first + DRAWS
        # a short question draws its earlier slots again, so that ranks go by slot throughout
        c = left.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(end - 1)))).withColumn("_pos", slot)
        c = c.join(pos, "_pos").groupBy("question_id", "answer_id").agg(F.min("slot").alias("slot"))
        w = W.partitionBy("question_id").orderBy("slot")
        ok = st.keep(_allowed(c, corpus, qrels).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_query), f"drawn{r}")
        full = ok.filter(F.col("_r") == per_query).select("question_id")
        part = ok.join(full, "question_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        left = st.keep(left.join(full, "question_id", "left_anti"), f"short{r}")
        if left.isEmpty():
            return out.select("question_id", "answer_id", (F.col("_r") + RANDOM_RANK - 1).alias("rank"), F.lit("random").alias("source"))
        if end > 64 * n + DRAWS:
            raise ValueError("a question has fewer allowed documents than per_query")
        first, r = end, r + 1


def combine_negatives(tables: list[DataFrame]) -> DataFrame:
    """One row per pair, of the lowest rank; of equal ranks the earlier table's."""
    out = None
    for k, t in enumerate(tables):
        t = t.withColumn("_k", F.lit(k))
        out = t if out is None else out.unionByName(t)
    w = W.partitionBy("question_id", "answer_id").orderBy("rank", "_k")
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_k")


def training_pairs(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, negatives: DataFrame | None = None, hard: int = 0, random: int = 0, split: str = "train") -> DataFrame:
    """(question_id, answer_id, negatives array<long>): primary pairs of a split with exactly hard + random negatives, mined ones
    first; questions that fall short are dropped."""
    if (hard or random) and negatives is None:
        raise ValueError("negatives were asked for without a table")
    if queries.filter(F.col("split") == split).isEmpty():
        raise ValueError(f"no queries in split {split!r}")
    pairs = qrels.filter("grade = 2").join(queries.filter(F.col("split") == split).select("question_id"), "question_id", "left_semi").join(corpus.select("answer_id").distinct(), "answer_id", "left_semi").select("question_id", "answer_id")
    if not hard and not random:
        return pairs.withColumn("negatives", F.array().cast("array<long>"))
    neg = negatives.join(corpus.select("answer_id").distinct(), "answer_id", "left_semi").withColumn("is_random", (F.col("source") == "random").cast("int"))
    w = W.partitionBy("question_id", "is_random").orderBy("rank", "answer_id")
    neg = neg.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.when(F.col("is_random") == 1, random).otherwise(hard))
    lists = neg.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("is_random", "rank", "answer_id"))).alias("l")).filter(F.size("l") == hard + random)
    return pairs.join(lists, "question_id").select("question_id", "answer_id", F.transform("l", lambda x: x["answer_id"]).alias("negatives"))


def candidates(pairs: DataFrame) -> DataFrame:
    """(question_id, offset, answer_id): the positive at offset 0, then the negatives."""
    return pairs.select("question_id", F.posexplode(F.concat(F.array("answer_id"), "negatives")).alias("offset", "answer_id"))


def batches(pairs: DataFrame, size: int, seed: int = 17) -> DataFrame:
    """Adds batch: full batches of a seeded shuffle; the rest is left out, fewer than one batch is an error."""
    order = numbered(pairs.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("question_id").cast("string"), F.col("answer_id").cast("string")))), "_h", "question_id", "answer_id")
    n = order.count()
    if n < size:
        raise ValueError("fewer pairs than one batch")
    return order.withColumn("batch", F.floor(F.col("_pos") / size)).filter(F.col("batch") < n // size).drop("_pos", "_h")


def collate(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(question_id, offset, query, text): what a scorer reads of each pair, the positive at offset 0. Questions must have
    equally many negatives, and every text must exist."""
    sizes = pairs.select(F.size("negatives").alias("n")).distinct().limit(2).count()
    if sizes > 1:
        raise ValueError("questions have different numbers of negatives")
    q, c = queries.select("question_id", F.col("text").alias("query")), corpus.select("answer_id", "text")
    out = candidates(pairs).join(q, "question_id", "left").join(c, "answer_id", "left")
    if not out.filter("query is null or text is null").isEmpty():
        raise ValueError("a question or an answer has no text")
    return out.select("question_id", "offset", "query", "text")


def _dot(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, z: s + z)


def info_nce(batch: DataFrame, temperature: float = 0.05) -> DataFrame:
    """(batch, loss, accuracy) of rows (batch, item, query, positive [, negatives]): every query against all positives of
    its own batch, a bounded set, by cosine. Ties count for the positive."""
    cand = batch.select("batch", F.col("item").alias("other"), F.col("positive").alias("c"))
    if "negatives" in batch.columns:
        cand = cand.union(batch.select("batch", F.lit(None).cast("long"), F.explode("negatives")))
    cos = _dot("query", "c") / F.greatest(F.sqrt(_dot("query", "query") * _dot("c", "c")), F.lit(1e-12)) / temperature
    s = batch.select("batch", "item", "query").join(cand, "batch").select("batch", "item", "other", cos.alias("s"))
    own = F.max(F.when(F.col("other") == F.col("item"), F.col("s")))
    rows = s.groupBy("batch", "item").agg(own.alias("own"), F.max("s").alias("top"), F.collect_list("s").alias("all"))
    lse = F.col("top") + F.log(F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    return rows.groupBy("batch").agg(F.avg(lse - F.col("own")).alias("loss"), F.avg((F.col("own") >= F.col("top")).cast("double")).alias("accuracy"))


def grouped_cross_entropy(scores: DataFrame) -> DataFrame:
    """One row (loss, top_one) of (group, offset, score) with the positive at offset 0."""
    g = scores.groupBy("group").agg(F.max(F.when(F.col("offset") == 0, F.col("score"))).alias("own"), F.max("score").alias("top"), F.sum(F.exp("score")).alias("z"))
    return g.agg(F.avg(F.log("z") - F.col("own")).alias("loss"), F.avg((F.col("own") >= F.col("top")).cast("double")).alias("top_one"))


def mean_pool(tokens: str, mask: str) -> Column:
    """Masked mean of an array of vectors."""
    used = F.filter(F.arrays_zip(F.col(tokens).alias("t"), F.col(mask).alias("m")), lambda z: z["m"] > 0)
    n = F.greatest(F.size(used).cast("double"), F.lit(1e-9))
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0))
    total = F.aggregate(used, zero, lambda acc, z: F.zip_with(acc, z["t"], lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / n)


def cls_pool(tokens: str) -> Column:
    return F.element_at(tokens, 1)


def warmup_decay(step: Column, warmup: int, total: int) -> Column:
    """(step + 1) / warmup, then a line down to 0 at the last step."""
    down = F.greatest(F.lit(0.0), (F.lit(total) - step) / F.lit(max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / F.lit(max(1, warmup))).otherwise(down)


def limit_pairs(pairs: DataFrame, n: int | None) -> DataFrame:
    """The first n pairs by question and answer; all without n."""
    return pairs if n is None else pairs.orderBy("question_id", "answer_id").limit(n)


def parameter_groups(parameters: dict[str, int], weight_decay: float) -> list[dict]:
    """Names of parameters (name -> number of dimensions) with and without weight decay: biases and vectors take none."""
    plain = [n for n, dims in parameters.items() if dims <= 1 or n.endswith("bias")]
    return [{"names": [n for n in parameters if n not in plain], "weight_decay": weight_decay}, {"names": plain, "weight_decay": 0.0}]
