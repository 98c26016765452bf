"""Queries on ``documents``: near copies, repeated passages, toxicity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldnote.llm.jaccard_join import near_copies
from fieldnote.llm.registry import query
from fieldnote.llm.substring_dedup import without_repeats
from fieldnote.llm.toxicity import toxicity

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x20\x09-\x0D]+"


@query(
    "op1_jaccard_join",
    f"""
    with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ABC}', '{ABC.lower()}'), '{WORD}') as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
            else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as sh from d),
    x as (select doc_id, len(sh) as n, unnest(sh) as e from s),
    common as (select a.doc_id as u, b.doc_id as v, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
               from x a join x b on a.e = b.e and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by 1, 2),
    links as (select u, v from common where 100 * c >= 85 * (n + m - c)),
    edges as (select u, v from links union all select v, u from links),
    reach as (select doc_id as id, doc_id as to_id from documents union select r.id, e.v from reach r join edges e on r.to_id = e.u)
    select s.doc_id, len(sh)::bigint as n_shingles, c.component_id
    from s join (select id, min(to_id) as component_id from reach group by id) c on c.id = s.doc_id
    """,
)
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


@query(
    "op6_substring_dedup",
    f"""
    with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
    win as (select doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
    firsts as (select k, min(doc_id) as f from win group by k),
    gone as (select distinct doc_id, i + unnest(range(50)) as i from (select doc_id, i from win join firsts using (k) where f < doc_id)),
    each as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from d),
    kept as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from each anti join gone using (doc_id, i) group by doc_id)
    select d.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join kept using (doc_id)
    """,
)
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept", "sources", "row_hash")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("evidence")
