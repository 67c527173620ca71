"""The registered queries of the core and SQL that gives the same rows.

The searches ask with every query and vector whose id is divisible by 50 against all rows. Answers come from corpus (one row
per answer: largest score), questions from questions (one row per question: smallest values), dates and texts from queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.operators import dataset as ds
from lodeseek.operators import evaluation as ev
from lodeseek.operators import retrieval as r
from lodeseek.operators import studies
from lodeseek.operators import training as tr
from lodeseek.plans.stages import Stages, one_each
from lodeseek.sources.posts import id_offset, read_table, shift_ids


def _corpus(s: SparkSession, d: str) -> DataFrame:
    return read_table(s, d, "corpus").groupBy(F.col("answer_id").alias("doc_id")).agg(F.min("question_id").alias("question_id"), F.max("score").alias("score"), F.min("text").alias("text"))


def _texts(s, d):
    """(doc_id, text) of _corpus, for searches, without a shuffle of the texts."""
    return one_each(read_table(s, d, "corpus").select(F.col("answer_id").alias("doc_id"), "text"), "doc_id", {"text": F.min})


def _answers(s, d):
    return _corpus(s, d).withColumnRenamed("doc_id", "answer_id")


def _queries(s, d):
    g = read_table(s, d, "queries").groupBy("question_id")
    return g.agg(*[F.min(c).alias(c) for c in ("creation_date", "title", "text", "label_source")])


def _asked(s, d):
    return _queries(s, d).filter("question_id % 50 = 0").select(F.col("question_id").alias("query_id"), "text")


def _bm25(s, d, k, k1=1.2, b=0.75):
    return r.bm25(_texts(s, d), _asked(s, d), k, k1, b)


def _qrels(s, d):
    g = read_table(s, d, "qrels").groupBy(F.col("question_id").alias("query_id"), F.col("answer_id").alias("doc_id"))
    return g.agg(F.max("grade").alias("grade"))


def _vectors(s, d):
    good = "size(embedding) = 64 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('inf'))"
    return read_table(s, d, "answer_vectors").filter(good).groupBy(F.col("answer_id").alias("doc_id")).agg(F.min("embedding").alias("embedding"))


def _vq(s, d):
    return _vectors(s, d).filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def bm25_topk(s, d):
    return _bm25(s, d, 10)


def dense_topk(s, d):
    return r.dense_search(_vectors(s, d), _vq(s, d), 10)


def rrf_hybrid(s, d):
    both = r.Bm25Index(_texts(s, d)).matches(_asked(s, d))
    return r.fuse([both.search(100), both.search(100, 0.9, 0.4)], 10)


def rerank_tail(s, d):
    return r.rerank(_bm25(s, d, 10), _asked(s, d), _corpus(s, d), r.overlap_scorer, 10, 5)


def _centroids(s, d):
    """A documented sample: the 64 usable vectors of the smallest ids."""
    return _vectors(s, d).orderBy("doc_id").limit(64).select(F.col("doc_id").alias("cell"), F.col("embedding").alias("center"))


def ann_recall(s, d):
    c = _centroids(s, d)
    run = r.ivf_search(r.ivf_index(_vectors(s, d), c), c, _vq(s, d), 10, 16)
    return r.recall_against(run, r.dense_search(_vectors(s, d), _vq(s, d), 10))


def metrics_per_query(s, d):
    judged = _qrels(s, d).join(_asked(s, d), "query_id", "left_semi")
    m = ev.per_query_metrics(_bm25(s, d, 100), judged)
    return m.select("query_id", *[F.round(c, 9).alias(c) for c in ev.METRICS])


def metrics_mean(s, d):
    return ev.mean_metrics(metrics_per_query(s, d))


def _questions(s, d):
    return read_table(s, d, "questions").groupBy("question_id").agg(F.min("accepted_answer_id").alias("accepted_answer_id"))


def qrels_build(s, d):
    return ds.build_qrels(_questions(s, d), _answers(s, d))


def _split(s, d):
    return ds.time_split(_queries(s, d))


def time_split(s, d):
    return _split(s, d).select("question_id", "split")


def split_bounds(s, d):
    return ds.split_bounds(_split(s, d))


def dup_components(s, d):
    return ds.components(ds.duplicate_edges(_queries(s, d), read_table(s, d, "post_links")))


def dup_drop(s, d):
    return ds.cross_split_duplicates(_split(s, d), read_table(s, d, "post_links"))[1]


def _pairs_qrels(s, d):
    return _qrels(s, d).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("answer_id"), "grade")


def mined_negatives(s, d):
    return tr.mine_negatives(_bm25(s, d, 50), _answers(s, d), _pairs_qrels(s, d))


def random_negatives(s, d):
    return tr.random_negatives(_queries(s, d), _answers(s, d), _pairs_qrels(s, d))


def combined_negatives(s, d):
    mined = mined_negatives(s, d)
    asked = _queries(s, d).filter("question_id % 50 = 0")
    return tr.combine_negatives([mined, tr.random_negatives(asked, _answers(s, d), _pairs_qrels(s, d), 3)])


def training_pairs(s, d):
    p = tr.training_pairs(_split(s, d), _answers(s, d), _pairs_qrels(s, d), random_negatives(s, d), 0, 2)
    return p.select("question_id", "answer_id", F.array_join(F.transform("negatives", lambda x: x.cast("string")), ",").alias("negatives"))


def text_stats(s, d):
    return ev.text_stats(_corpus(s, d), "text")


def value_counts(s, d):
    return read_table(s, d, "qrels").groupBy("label_source", "grade").agg(F.count(F.lit(1)).alias("n"))


def bootstrap_compare(s, d):
    judged = _qrels(s, d).join(_asked(s, d), "query_id", "left_semi")
    both = r.Bm25Index(_texts(s, d)).matches(_asked(s, d))
    a, b = (ev.per_query_metrics(both.search(100, *p), judged) for p in ((1.2, 0.75), (0.9, 0.4)))
    return ev.bootstrap_table(a, b, "graded_ndcg_at_10", 1000)


def ann_grid(s, d):
    """Mean recall of the inverted file by the number of probed cells."""
    st = Stages(s)
    v, c = st.keep(_vectors(s, d), "vectors"), st.keep(_centroids(s, d), "centers")
    q = v.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    index, exact, out = st.keep(r.ivf_index(v, c), "index"), st.keep(r.dense_search(v, q, 10), "exact"), None
    for n in (1, 4, 16, 64):
        row = r.recall_against(r.ivf_search(index, c, q, 10, n), exact).agg(F.lit(n).alias("nprobe"), F.round(F.avg("recall"), 9).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def _grade2(s, d):
    return read_table(s, d, "qrels").filter("grade = 2").groupBy("question_id").agg(F.min("answer_id").alias("answer_id"), F.min("label_source").alias("label_source"), F.lit(2).alias("grade"))


def label_sources(s, d):
    return ds.with_label_source(_split(s, d), _grade2(s, d)).select("question_id", "split", "label_source")


def held_out_filter(s, d):
    return ds.drop_noisy_held_out(ds.with_label_source(_split(s, d), _grade2(s, d))).select("question_id", "split")


def judgement_ratio(s, d):
    return ds.judgements_per_query(_queries(s, d), _qrels(s, d))


def negatives_summary(s, d):
    return ev.count_summary(mined_negatives(s, d), "question_id")


def latencies(s, d):
    t = ev.latency_summary(read_table(s, d, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))
    return t.select("stage", "calls", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "total")])


def nested_sizes(s, d):
    """The judged documents as base and all others as pool, at the sizes of half and all of the pool."""
    c = Stages(s).keep(_corpus(s, d).select("doc_id"), "corpus")
    base = c.join(_qrels(s, d).select("doc_id"), "doc_id", "left_semi")
    n, have = c.count(), base.count()
    out = None
    for size, df in studies.nested_corpora(base, c, [have + (n - have) // 2, n, n + 1]).items():
        part = df.select("doc_id", F.lit(size).cast("long").alias("size"))
        out = part if out is None else out.unionByName(part)
    return out


def _probe(s, d):
    return studies.probe_scores(_queries(s, d), _answers(s, d), _grade2(s, d), r.overlap_scorer)


def probe(s, d):
    return studies.probe_summary(_probe(s, d))


def grouped_loss(s, d):
    g = tr.grouped_cross_entropy(_probe(s, d).withColumnRenamed("question_id", "group"))
    return g.select(F.round("loss", 9).alias("loss"), F.round("top_one", 9).alias("top_one"))


def _pairs(s, d):
    return tr.training_pairs(_split(s, d), _answers(s, d), _pairs_qrels(s, d), random_negatives(s, d), 0, 2)


def training_batches(s, d):
    return tr.batches(_pairs(s, d), 8).select("question_id", "answer_id", "batch")


def pair_texts(s, d):
    return tr.collate(_pairs(s, d).filter("answer_id is not null"), _queries(s, d).fillna("", ["text"]), _answers(s, d).fillna("", ["text"])).select("question_id", "offset", "query", "text")


def query_texts(s, d):
    q = read_table(s, d, "questions")
    return q.select("question_id", tx.query_text(F.col("title"), F.col("body_html")).alias("text"), F.array_join(tx.parse_tags(F.concat(F.lit("|"), F.array_join("tags", "|"), F.lit("|"))), ",").alias("tags")).distinct()


def shifted_ids(s, d):
    return shift_ids(_answers(s, d).select("answer_id", "question_id"), "stats", ["answer_id", "question_id"])


def html_text(s, d):
    return read_table(s, d, "questions").select("question_id", tx.html_to_text("body_html").alias("text")).distinct()


def titles(s, d):
    return read_table(s, d, "questions").select("question_id", tx.normalize_title(F.col("title")).alias("title")).distinct()


def token_counts(s, d):
    return _corpus(s, d).select("doc_id", F.size(tx.tokenize(F.coalesce("text", F.lit("")))).alias("tokens"))


def infonce_loss(s, d):
    v = _vectors(s, d)
    n = v.withColumn("next", F.lead("embedding").over(W.partitionBy(F.pmod("doc_id", F.lit(997))).orderBy("doc_id"))).filter("next is not null")
    b = n.select(F.pmod("doc_id", F.lit(997)).alias("batch"), F.col("doc_id").alias("item"), F.col("embedding").alias("query"), F.col("next").alias("positive"))
    return tr.info_nce(b, 1.0).select("batch", (F.round("loss", 9) + 0.0).alias("loss"), "accuracy")


def queries() -> dict:
    fs = (bm25_topk, dense_topk, rrf_hybrid, rerank_tail, ann_recall, metrics_per_query, metrics_mean, qrels_build, time_split, split_bounds, dup_components, dup_drop, mined_negatives, random_negatives, combined_negatives, training_pairs, text_stats, value_counts, bootstrap_compare, html_text, titles, token_counts, infonce_loss, ann_grid, label_sources, held_out_filter, judgement_ratio, negatives_summary, latencies, nested_sizes, probe, grouped_loss, training_batches, pair_texts, query_texts, shifted_ids)
    return {f.__name__: f for f in fs}


_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+(?:[._][a-z0-9]+)*')"
_DOCS = """docs as (select answer_id as doc_id, min(question_id) as question_id, max(score) as score, min(text) as text from corpus group by 1),
qs as (select question_id, min(creation_date) as creation_date, min(title) as title, min(text) as text, min(label_source) as label_source from queries group by 1),
asked as (select question_id as query_id, text from qs where question_id % 50 = 0),
rel as (select question_id as query_id, answer_id as doc_id, max(grade) as grade from qrels group by 1, 2)"""


def _bm25_sql(name: str, k: int, k1: float = 1.2, b: float = 0.75) -> str:
    return f"""
{name}_t as (select doc_id, len(ts) as n, unnest(ts) as term from (select doc_id, {_TOK} as ts from docs)),
{name}_f as (select doc_id, n, term, count(*) as f from {name}_t group by 1, 2, 3),
{name}_s as (select count(*) as n, avg(len({_TOK})) as mean from docs),
{name}_d as (select term, count(*) as df from {name}_f group by 1),
{name}_q as (select distinct query_id, unnest({_TOK}) as term from asked),
{name}_r as (select query_id, doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * f * ({k1} + 1) / (f + {k1} * (1 - {b} + {b} * t.n / s.mean))), 9) as score
from {name}_q join {name}_f t using (term) join {name}_d using (term) cross join {name}_s s group by 1, 2),
{name} as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, score from {name}_r) where rank <= {k})"""


_VEC = """v as (select answer_id as doc_id, min(embedding)::double[] as e from answer_vectors where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 group by 1),
u as (select doc_id, e, greatest(sqrt(list_dot_product(e, e)), 1e-12) as n from v)"""
_METRICS = f"""
j as (select rel.*, (grade >= 2)::int as st, row_number() over (partition by query_id order by grade desc, doc_id) as i from rel join asked using (query_id)),
m as (select j.*, rank as rk from j left join run using (query_id, doc_id)),
g as (select query_id, sum(st) as n, coalesce(sum(case when rk <= 10 then st / log2(rk + 1) end), 0) as a, coalesce(sum(case when i <= 10 then st / log2(i + 1) end), 0) as b,
coalesce(sum(case when rk <= 10 then (pow(2, grade) - 1) / log2(rk + 1) end), 0) as c, coalesce(sum(case when i <= 10 then (pow(2, grade) - 1) / log2(i + 1) end), 0) as e,
min(case when rk <= 10 and st = 1 then rk end) as f, count(case when rk <= 10 and st = 1 then 1 end) as h, count(case when rk <= 100 and st = 1 then 1 end) as hh from m group by 1),
per as (select query_id, round(case when b > 0 then a / b else 0 end, 9) as ndcg_at_10, round(coalesce(1.0 / f, 0), 9) as mrr_at_10, round(case when n > 0 then h / n else 0 end, 9) as recall_at_10,
round(case when n > 0 then hh / n else 0 end, 9) as recall_at_100, round(case when e > 0 then c / e else 0 end, 9) as graded_ndcg_at_10 from g)"""
_SPLIT = """sp as (select *, case when p > n - round_even(n * 0.1, 0) then 'test' when p > n - round_even(n * 0.1, 0) - round_even(n * 0.1, 0) then 'val' else 'train' end as split
from (select *, row_number() over (order by creation_date, question_id) as p, count(*) over () as n from qs))"""
_COMP = """l as (select post_id as a, related_post_id as b from post_links where link_type_id = 3 and post_id <> related_post_id and post_id in (select question_id from qs) and related_post_id in (select question_id from qs)),
t as (select question_id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) as t from qs),
h as (select t, min(question_id) as a from t where t <> '' group by 1),
e0 as (select a, b from l union select h.a, question_id from t join h using (t) where question_id <> h.a),
ee as (select a, b from e0 union select b, a from e0),
reach as (select a as root, a as x from ee union select r.root, e.b from reach r join ee e on e.a = r.x),
comp as (select x as member, min(root) as component from reach group by 1)"""
_MINED = """mn as (select question_id, answer_id, rank, 'bm25' as source from (select run.query_id as question_id, run.doc_id as answer_id, rank - 1 as rank, row_number() over (partition by run.query_id order by rank) as r
from run join docs on docs.doc_id = run.doc_id left join rel on rel.query_id = run.query_id and rel.doc_id = run.doc_id where rank > 1 and rank <= 50 and rel.grade is null and docs.question_id <> run.query_id) where r <= 4)"""


def _random_sql(per: int, source: str, name: str = "rn") -> str:
    return f"""{name} as (select question_id, answer_id, (r + 9999) as rank, 'random' as source from (select c.question_id, c.answer_id, row_number() over (partition by c.question_id order by slot) as r
from (select q.question_id, p.doc_id as answer_id, min(slot) as slot from (select question_id, unnest(range(32)) as slot from {source}) q
join (select doc_id, row_number() over (order by doc_id) - 1 as pos from docs) p on p.pos = ('0x' || substr(md5('17:' || q.question_id || ':' || slot), 1, 8))::bigint % (select count(*) from docs) group by 1, 2) c
join docs on docs.doc_id = c.answer_id left join rel on rel.query_id = c.question_id and rel.doc_id = c.answer_id where rel.grade is null and docs.question_id <> c.question_id) where r <= {per})"""


_MD5 = "('0x' || substr(md5({}), 1, 8))::bigint"
#: The usable vectors u of catalog, the first 64 as centers, every vector's cell, every question's cells by rank, exact lists.
_CELLS = """cs as (select doc_id as cell, e, n from u order by doc_id limit 64),
cell as (select doc_id, e, n, cell from (select u.*, cs.cell, row_number() over (partition by u.doc_id order by list_dot_product(u.e, cs.e) / u.n / cs.n desc, cs.cell) as r from u cross join cs) where r = 1),
pr as (select u.doc_id as query_id, cs.cell, row_number() over (partition by u.doc_id order by round(list_dot_product(u.e, cs.e) / u.n / cs.n, 9) desc, cs.cell) as p from u cross join cs where u.doc_id % 50 = 0),
sc as (select q.doc_id as query_id, d.doc_id, d.cell, round(list_dot_product(q.e, d.e) / q.n / d.n, 9) as s from u q cross join cell d where q.doc_id % 50 = 0),
ex as (select * from (select query_id, doc_id, row_number() over (partition by query_id order by s desc, doc_id) as r from sc) where r <= 10)"""
_GOLD = "gold as (select question_id, min(answer_id) as answer_id, min(label_source) as label_source from qrels where grade = 2 group by 1)"
_PROBE = f"""{_GOLD},
gq as (select gold.* from gold join qs using (question_id) where answer_id in (select doc_id from docs)),
dr as (select question_id, answer_id, row_number() over (partition by question_id order by slot) as o from (select g.question_id, p.doc_id as answer_id, min(slot) as slot from (select question_id, unnest(range(40)) as slot from gq) g
join (select doc_id, row_number() over (order by doc_id) - 1 as pos from docs) p on p.pos = {_MD5.format("'17:' || g.question_id || ':' || slot")} % (select count(*) from docs) group by 1, 2)),
pa as (select question_id, answer_id, 0 as o from gq union all select question_id, answer_id, o from dr where o <= 4),
ps as (select pa.question_id, o, list_distinct({_TOK.replace('text', 'qs.text')}) as a, list_distinct({_TOK.replace('text', 'docs.text')}) as b from pa join qs using (question_id) join docs on docs.doc_id = pa.answer_id),
sc as (select question_id, o, round(case when len(list_distinct(list_concat(a, b))) > 0 then len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) else 0 end, 9) as s from ps)"""
_TRAINING = f"""{_SPLIT}, {_random_sql(2, 'qs')}, ls as (select question_id, list(answer_id order by rank) as negatives from rn group by 1 having count(*) = 2),
tp as (select rel.query_id as question_id, rel.doc_id as answer_id, negatives from rel join docs using (doc_id) join ls on ls.question_id = rel.query_id join sp on sp.question_id = rel.query_id where grade = 2 and split = 'train')"""


def _bootstrap_sql() -> str:
    two = ", ".join(f"{_bm25_sql(n, 100, *p)}, {_METRICS.replace('left join run', f'left join {n}').replace(' as (', f'_{n} as (')}" for n, p in (("x", (1.2, 0.75)), ("y", (0.9, 0.4))))
    for n in "xy":
        for t in "jmg":
            two = two.replace(f"from {t} left join {n} ", f"from {t}_{n} left join {n} ").replace(f"select {t}.*, rank as rk from {t}_{n}", f"select {t}_{n}.*, rank as rk from {t}_{n}")
        head, tail = two.split(f"j_{n} as (", 1)
        part, sep, rest = tail.partition("), y_t as" if n == "x" else "\0")
        two = head + f"j_{n} as (" + part.replace(" from m)", f" from m_{n})").replace(" from m group", f" from m_{n} group").replace(" from g)", f" from g_{n})") + sep + rest
    draw = _MD5.format("'17:' || i || ':' || slot")
    return f"""with {_DOCS}, {two}, pd as (select row_number() over (order by query_id) - 1 as pos, per_x.graded_ndcg_at_10 as a, per_y.graded_ndcg_at_10 as b from per_x join per_y using (query_id)),
ms as (select i, avg(b - a) as m from (select i, unnest(range((select count(*) from pd))) as slot from range(1000) t(i)) z join pd on pd.pos = {draw} % (select count(*) from pd) group by 1),
se as (select avg(a) as baseline_mean, avg(b) as candidate_mean, avg(b - a) as mean_difference, count(*) as queries from pd),
ss as (select avg(m) as c, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from ms)
select round(baseline_mean, 9) as baseline_mean, round(candidate_mean, 9) as candidate_mean, round(mean_difference, 9) + 0.0 as mean_difference, round(lo, 9) + 0.0 as ci_low, round(hi, 9) + 0.0 as ci_high,
round((select avg((round(abs(m - c), 12) >= round(abs(mean_difference), 12))::int::double) from ms), 9) as p_value, queries, (lo > 0 or hi < 0) as significant from se cross join ss"""


def oracle_sql() -> dict[str, str]:
    top = "select query_id, doc_id, rank, score from"
    return {
        "bm25_topk": f"with {_DOCS}, {_bm25_sql('run', 10)} {top} run",
        "dense_topk": f"with {_VEC} {top} (select q.doc_id as query_id, d.doc_id, row_number() over (partition by q.doc_id order by round(list_dot_product(q.e, d.e) / q.n / d.n, 9) desc, d.doc_id) as rank, round(list_dot_product(q.e, d.e) / q.n / d.n, 9) as score from u q cross join u d where q.doc_id % 50 = 0) where rank <= 10",
        "rrf_hybrid": f"with {_DOCS}, {_bm25_sql('x', 100)}, {_bm25_sql('y', 100, 0.9, 0.4)}, f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 12) as score from (select * from x union all select * from y) group by 1, 2) {top} (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from f) where rank <= 10",
        "rerank_tail": f"""with {_DOCS}, {_bm25_sql('run', 10)}, c as (select query_id, doc_id, rank, run.score, list_distinct({_TOK.replace('text', 'asked.text')}) as a, list_distinct({_TOK.replace('text', 'docs.text')}) as b from run join asked using (query_id) join docs using (doc_id)),
n as (select query_id, doc_id, rank, score, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) as s from c)
{top} (select query_id, doc_id, row_number() over (partition by query_id order by s desc, doc_id) as rank, s as score from n where rank <= 5 union all select query_id, doc_id, rank, score from n where rank > 5)""",
        "metrics_per_query": f"with {_DOCS}, {_bm25_sql('run', 100)}, {_METRICS} select * from per",
        "metrics_mean": f"with {_DOCS}, {_bm25_sql('run', 100)}, {_METRICS} select {', '.join(f'round(avg({m}), 9) as {m}' for m in ev.METRICS)}, count(*) as queries from per",
        "qrels_build": f"""with {_DOCS}, qu as (select question_id, min(accepted_answer_id) as acc from questions group by 1),
fr as (select d.question_id, doc_id, d.score, row_number() over w as r, lead(d.score) over w as nx from docs d join qu on qu.question_id = d.question_id where acc is null window w as (partition by d.question_id order by d.score desc, doc_id)),
pr as (select question_id, acc as answer_id, 2 as grade, 'accepted' as label_source from qu where acc is not null union all select question_id, doc_id, 2, 'top_voted' from fr where r = 1 and score >= 2 and score > coalesce(nx, -999))
select pr.* from pr where answer_id in (select doc_id from docs) union all select d.question_id, doc_id, 1, 'sibling' from docs d where d.question_id in (select question_id from pr) and not exists (select 1 from pr where pr.question_id = d.question_id and pr.answer_id = doc_id)""",
        "time_split": f"with {_DOCS}, {_SPLIT} select question_id, split from sp",
        "split_bounds": f"with {_DOCS}, {_SPLIT} select split, min(creation_date)::varchar as first, max(creation_date)::varchar as last, count(*) as n from sp group by 1",
        "dup_components": f"with recursive {_DOCS}, {_COMP} select * from comp",
        "dup_drop": f"""with recursive {_DOCS}, {_SPLIT}, {_COMP}, pp as (select question_id, split, component, case split when 'train' then 0 when 'val' then 1 else 2 end as p from sp join comp on member = question_id),
mx as (select component, max(p) as m from pp group by 1) select question_id, split, 'duplicate of a question in ' || case m when 1 then 'val' else 'test' end as reason from pp join mx using (component) where p < m""",
        "mined_negatives": f"with {_DOCS}, {_bm25_sql('run', 50)}, {_MINED} select * from mn",
        "random_negatives": f"with {_DOCS}, {_random_sql(2, 'qs')} select * from rn",
        "combined_negatives": f"with {_DOCS}, {_bm25_sql('run', 50)}, {_MINED}, {_random_sql(3, '(select query_id as question_id from asked)')} select question_id, answer_id, rank, source from (select *, row_number() over (partition by question_id, answer_id order by rank, k) as r from (select *, 0 as k from mn union all select *, 1 from rn)) where r = 1",
        "training_pairs": f"with {_DOCS}, {_SPLIT}, {_random_sql(2, 'qs')}, ls as (select question_id, string_agg(answer_id::varchar, ',' order by rank) as negatives from rn group by 1 having count(*) = 2) select question_id, doc_id as answer_id, negatives from rel join docs using (doc_id) join ls on ls.question_id = query_id join sp on sp.question_id = query_id where grade = 2 and split = 'train'".replace("select question_id, doc_id as answer_id", "select query_id as question_id, doc_id as answer_id"),
        "text_stats": f"with {_DOCS}, c as (select length(coalesce(text, '')) as c, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\pZ]+')) as w from docs) select count(*) as count, floor(quantile_cont(c, 0.5))::int as chars_p50, floor(quantile_cont(c, 0.9))::int as chars_p90, floor(quantile_cont(w, 0.5))::int as words_p50, floor(quantile_cont(w, 0.9))::int as words_p90 from c",
        "ann_recall": f"""with {_VEC}, {_CELLS}, ap as (select * from (select sc.query_id, sc.doc_id, row_number() over (partition by sc.query_id order by s desc, doc_id) as r from sc join pr on pr.query_id = sc.query_id and pr.cell = sc.cell where p <= 16) where r <= 10)
select ex.query_id, count(ap.doc_id) / count(*) as recall from ex left join ap on ap.query_id = ex.query_id and ap.doc_id = ex.doc_id group by 1""",
        "ann_grid": f"""with {_VEC}, {_CELLS}, np as (select unnest([1, 4, 16, 64]) as nprobe),
ap as (select * from (select nprobe, sc.query_id, sc.doc_id, row_number() over (partition by nprobe, sc.query_id order by s desc, doc_id) as r from sc join pr on pr.query_id = sc.query_id and pr.cell = sc.cell join np on p <= nprobe) where r <= 10),
rc as (select np.nprobe, ex.query_id, count(ap.doc_id) / count(*) as recall from np cross join ex left join ap on ap.nprobe = np.nprobe and ap.query_id = ex.query_id and ap.doc_id = ex.doc_id group by 1, 2)
select nprobe, round(avg(recall), 9) as recall from rc group by 1""",
        "bootstrap_compare": _bootstrap_sql(),
        "html_text": r"""with a as (select question_id, regexp_replace(coalesce(body_html, ''), '<pre><code>\s*(.*?)\s*</code></pre>', chr(10) || '```' || chr(10) || '\1' || chr(10) || '```' || chr(10), 'gs') as t from questions),
b as (select question_id, replace(replace(replace(replace(replace(replace(replace(t, '<p>', chr(10)), '</p>', chr(10)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as t from a),
c as (select question_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+\n', chr(10), 'g'), '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') as t from b)
select distinct question_id, trim(t, ' ' || chr(9) || chr(10) || chr(13)) as text from c""",
        "label_sources": f"with {_DOCS}, {_SPLIT}, {_GOLD} select sp.question_id, split, gold.label_source from sp left join gold using (question_id)",
        "held_out_filter": f"with {_DOCS}, {_SPLIT}, {_GOLD} select sp.question_id, split from sp left join gold using (question_id) where not (split in ('val', 'test') and coalesce(gold.label_source, '') = 'top_voted')",
        "judgement_ratio": f"with {_DOCS} select (select count(*) from rel) as judgements, (select count(*) from qs) as queries, round_even((select count(*) from rel) / (select count(*) from qs), 2) as ratio",
        "negatives_summary": f"with {_DOCS}, {_bm25_sql('run', 50)}, {_MINED}, c as (select question_id, count(*) as c from mn group by 1) select sum(c)::bigint as rows, count(*) as groups, min(c) as least, floor(quantile_cont(c, 0.5))::bigint as median, max(c) as most from c",
        "latencies": "select event_type as stage, count(*) as calls, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(sum(value), 6) as total from events group by 1",
        "nested_sizes": f"""with {_DOCS}, jd as (select doc_id from docs where doc_id in (select doc_id from rel)), po as (select doc_id, row_number() over (order by md5('17:' || doc_id), doc_id) - 1 as pos from docs where doc_id not in (select doc_id from jd)),
z as (select unnest([(select count(*) from jd) + (select count(*) from po) // 2, (select count(*) from docs)]) as size) select distinct * from (select doc_id, size from jd cross join z union all select doc_id, size from po join z on pos < size - (select count(*) from jd))""",
        "probe": f"""with {_DOCS}, {_PROBE}, e as (select question_id, max(case when o = 0 then s end) as own, max(case when o > 0 then s end) as best from sc group by 1)
select count(*) as questions, round(avg((own >= best)::int::double), 4) as top_one_accuracy, 0.2::double as chance, round(quantile_cont(own - best, 0.5), 4) as median_margin from e""",
        "grouped_loss": f"""with {_DOCS}, {_PROBE}, e as (select question_id, max(case when o = 0 then s end) as own, max(s) as top, sum(exp(s)) as z from sc group by 1) select round(avg(ln(z) - own), 9) as loss, round(avg((own >= top)::int::double), 9) as top_one from e""",
        "training_batches": f"with {_DOCS}, {_TRAINING}, o as (select question_id, answer_id, row_number() over (order by md5('17:' || question_id || ':' || answer_id), question_id, answer_id) - 1 as p from tp) select question_id, answer_id, p // 8 as batch from o where p // 8 < (select count(*) from tp) // 8",
        "pair_texts": f"""with {_DOCS}, {_TRAINING}, c as (select question_id, 0 as o, answer_id from tp union all select question_id, unnest(range(1, 3)), unnest(negatives) from tp)
select c.question_id, o::int as "offset", coalesce(qs.text, '') as query, coalesce(docs.text, '') as text from c join qs using (question_id) join docs on docs.doc_id = c.answer_id""",
        "query_texts": "select distinct question_id, case when coalesce(body_html, '') = '' then trim(coalesce(title, ''), ' ') else trim(coalesce(title, ''), ' ') || chr(10) || chr(10) || body_html end as text, array_to_string(tags, ',') as tags from questions",
        "shifted_ids": f"with {_DOCS} select doc_id + {id_offset('stats')} as answer_id, question_id + {id_offset('stats')} as question_id from docs",
        "value_counts": "select label_source, grade, count(*) as n from qrels group by 1, 2",
        "titles": "select distinct question_id, trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g')) as title from questions",
        "token_counts": f"with {_DOCS} select doc_id, len({_TOK}) as tokens from docs",
        "infonce_loss": f"""with {_VEC}, b as (select doc_id % 997 as batch, doc_id as item, e, n, lead(e) over w as pe, lead(n) over w as pn from u window w as (partition by doc_id % 997 order by doc_id)),
s as (select x.batch, x.item, y.item as other, list_dot_product(x.e, y.pe) / x.n / y.pn as s from b x join b y using (batch) where x.pe is not null and y.pe is not null),
g as (select batch, item, max(case when other = item then s end) as own, max(s) as top, ln(sum(exp(s))) as z from s group by 1, 2) select batch, round(avg(z - own), 9) + 0.0 as loss, avg((own >= top)::int::double) as accuracy from g group by 1""",
    }
