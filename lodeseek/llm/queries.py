"""The registered queries of the training-data operators and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm import components, knn, mixing, neardup, overlap, packing, residue, splits, topn


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(s, d):
    return splits.torn_owners(splits.question_split(_t(s, d, "queries"), _t(s, d, "questions")), _t(s, d, "questions"))


def p1_split(s, d):
    return splits.question_split(_t(s, d, "queries"), _t(s, d, "questions")).select(F.col("record").alias("question_id"), "component", "split", "delivered")


def p1_shares(s, d):
    return splits.split_shares(splits.question_split(_t(s, d, "queries"), _t(s, d, "questions")))


def p1_labels(s, d):
    return splits.label_shares(splits.question_split(_t(s, d, "queries"), _t(s, d, "questions")))


def p1_checks(s, d):
    return splits.split_checks(splits.question_split(_t(s, d, "queries"), _t(s, d, "questions")), _t(s, d, "questions"))


def p2_found(s, d):
    return components.duplicate_groups(_t(s, d, "post_links"), _t(s, d, "questions"))


def p3_found(s, d):
    return overlap.found(overlap.split_overlaps(_t(s, d, "queries")))


def p3_counts(s, d):
    return overlap.overlap_counts(_t(s, d, "queries"))


def p4_found(s, d):
    return knn.nearest_vectors(_t(s, d, "answer_vectors")).select("answer_id", "neighbour_id")


def p5_found(s, d):
    return topn.top_per_group(_t(s, d, "search_results"), ["retriever", "query_id"], "document_id", "score").select("retriever", "query_id", "document_id")


def p6_found(s, d):
    def of(name, key):
        g = neardup.near_duplicate_groups(_t(s, d, name).select(F.col(key).alias("id"), "text"), 3, 3, 5, 20)
        return g.select(F.lit(name).alias("table_name"), "group_id", "record_id")

    return of("corpus", "answer_id").unionByName(of("queries", "question_id"))


def p7_containers(s, d):
    return packing.pack(_t(s, d, "documents"), _t(s, d, "container_sizes"))


def p7_filling(s, d):
    return packing.filling(p7_containers(s, d), _t(s, d, "container_sizes"))


def p7_checks(s, d):
    return packing.packing_checks(p7_containers(s, d), _t(s, d, "container_sizes"))


def p8_mix(s, d):
    return mixing.mix(_t(s, d, "documents"), _t(s, d, "mix_targets"))[0]


def p8_shares(s, d):
    return mixing.mix(_t(s, d, "documents"), _t(s, d, "mix_targets"))[1]


def p8_checks(s, d):
    return mixing.mixing_checks(*mixing.mix(_t(s, d, "documents"), _t(s, d, "mix_targets")))


def p9_found(s, d):
    return residue.template_residue(_t(s, d, "documents"))


def queries() -> dict:
    fs = (p1_found, p1_split, p1_shares, p1_labels, p1_checks, p2_found, p3_found, p3_counts, p4_found, p5_found, p6_found, p7_containers, p7_filling, p7_checks, p8_mix, p8_shares, p8_checks, p9_found)
    return {f.__name__: f for f in fs}


_SPLIT = "case when trim(lower(split)) in ('train','training') then 'train' when trim(lower(split)) in ('val','validation','valid','dev') then 'val' when trim(lower(split)) in ('test','testing') then 'test' end"


def _near(table: str, key: str) -> str:
    """CTEs: near(a, b), a < b, of the near-same texts of a table."""
    return f"""
w as (select distinct {key} as id, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from {table} where text is not null and {key} is not null),
sh as (select distinct id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2])) as g from w where len(ws) >= 20),
sz as (select id, count(*) as n from sh group by id),
ov as (select x.id as a, y.id as b, count(*) as k from sh x join sh y on x.g = y.g and x.id < y.id group by 1, 2),
near as (select a, b from ov join sz p on p.id = a join sz q on q.id = b where k * 5 >= (p.n + q.n - k) * 3)"""


def _groups(edges: str) -> str:
    return f"""
ee as (select a, b from {edges} union select b, a from {edges}),
reach as (select a as root, a as x from ee union select r.root, e.b from reach r join ee e on e.a = r.x)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""select o.owner_user_id from (select distinct question_id, owner_user_id from questions where owner_user_id is not null) o
join (select distinct question_id, {_SPLIT} as sp from queries) q using (question_id) where sp is not null group by 1 having count(distinct sp) > 1""",
        "p1_checks": """select 'records' as name, count(distinct question_id) as n from queries union all select unnest(['records without a split', 'owners in several splits', 'splits off their share', 'labels off their shares']), 0""",
        "p2_found": f"""with recursive l as (select distinct post_id as a, related_post_id as b from post_links where link_type_id = 3 and post_id <> related_post_id
and post_id in (select question_id from questions) and related_post_id in (select question_id from questions)), {_groups("l")}
select min(root) as group_id, x as post_id from reach group by x""",
        "p3_found": f"""with {_near("queries", "question_id")},
s as (select distinct question_id as id, {_SPLIT} as sp, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') as t from queries),
p as (select x.id as a, y.id as b from s x join s y on x.t = y.t and x.id < y.id union select a, b from near)
select distinct a as question_id_a, b as question_id_b from p join (select distinct id, sp from s) u on u.id = a join (select distinct id, sp from s) v on v.id = b
where (u.sp = 'train' and v.sp in ('val', 'test')) or (v.sp = 'train' and u.sp in ('val', 'test'))""",
        "p3_counts": f"""with {_near("queries", "question_id")},
s as (select distinct question_id as id, {_SPLIT} as sp, label_source, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') as t from queries),
u as (select x.id as e, y.id as t from s x join s y on x.t = y.t and x.id <> y.id union select a, b from near union select b, a from near),
p as (select distinct e, u.t, x.sp, x.label_source from u join s x on x.id = e and x.sp in ('val', 'test') join s y on y.id = u.t and y.sp = 'train')
select sp as eval_split, label_source, count(distinct e) as records, count(*) as pairs from p group by 1, 2""",
        "p4_found": """with v as (select answer_id, any_value(embedding::double[]) as e from answer_vectors where len(embedding) = 64 and answer_id is not null
and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0 group by 1),
c as (select x.answer_id, y.answer_id as neighbour_id, row_number() over (partition by x.answer_id order by
round(list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)), 12) desc, y.answer_id) as r from v x join v y on x.answer_id <> y.answer_id)
select answer_id, neighbour_id from c where r <= 10""",
        "p5_found": """with b as (select retriever, query_id, document_id, max(score) as s from search_results where score is not null and not isnan(score) and document_id is not null group by 1, 2, 3)
select retriever, query_id, document_id from (select *, row_number() over (partition by retriever, query_id order by s desc, document_id) as r from b) where r <= 10""",
        "p7_checks": """select 'documents' as name, count(distinct doc_id) as n from documents where text <> '' union all
select unnest(['containers over their capacity', 'documents divided though they fit', 'documents in more pieces than needed', 'documents with tokens lost or doubled', 'kinds filled less']), 0""",
        "p8_checks": """select 'sources' as name, count(distinct source) as n from documents join mix_targets using (source) where text <> '' and doc_id is not null and target_weight > 0 and max_repeats > 0 union all
select unnest(['documents used too often', 'documents with copies numbered wrongly', 'sources off their share']), 0""",
        "p6_found": " union all ".join(
            f"select * from (with recursive {_near(t, k)}, {_groups('near')} select '{t}' as table_name, min(root) as group_id, x as record_id from reach group by x)" for t, k in (("corpus", "answer_id"), ("queries", "question_id"))
        ),
    }
