"""Queries on ``documents``: periodic runs, quality by pairs, collocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldnote.llm.collocations import collocations
from fieldnote.llm.pairwise_quality import quality_scores
from fieldnote.llm.periodic_runs import digest, periodic_runs, planted
from fieldnote.llm.queries_text import ABC, WORD
from fieldnote.llm.registry import query


@query(
    "op11_periodic_runs",
    f"""
    with crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t),
    d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w,
            case when doc_id is null then null else xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint),
              lambda c, x: xor(t[(xor(c, x) % 256) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) end as h from documents, crc),
    g as (select *, len(w) as n, (h // 10) as g, (h // 10) % greatest(len(w), 1) as a from d),
    planted as (select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: w[1 + case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) else w end as w from g),
    word as (select doc_id, n, unnest(w) as x, unnest(range(n)) as i from planted),
    eight as (select doc_id, n, unnest(range(n - 7)) as i, unnest(list_transform(range(n - 7), lambda i: array_to_string(w[i + 1:i + 8], ' '))) as x from planted where n >= 24),
    due as (select distinct a.doc_id, b.i - a.i as p from eight a join eight b on a.doc_id = b.doc_id and a.x = b.x and a.i % 8 = 0 and b.i > a.i and 3 * (b.i - a.i) <= a.n),
    same as (select due.doc_id, p, a.i from due join word a on a.doc_id = due.doc_id join word b on b.doc_id = due.doc_id and b.i = a.i + p and a.x = b.x),
    island as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as k from same),
    stretch as (select doc_id, p, min(i) as start, count(*) + p as length from island group by doc_id, p, k),
    run as (select doc_id, start, length, min(p) as period from stretch where length >= 24 and length >= 3 * p group by doc_id, start, length),
    best as (select *, row_number() over (partition by doc_id order by length / period desc, start, period) as k from run),
    per as (select doc_id, count(*) as n_runs, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period)) as s from run group by doc_id),
    gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
    kept as (select doc_id, string_agg(x, ' ' order by i) as t from word anti join gone using (doc_id, i) group by doc_id)
    select p.doc_id, coalesce(per.n_runs, 0) as n_runs, b.start, b.length, b.period, (1000 * b.length) // b.period as exponent_milli,
      coalesce(per.s, sha256('')) as runs_sha256, sha256(coalesce(kept.t, '')) as collapsed_sha256
    from planted p left join per using (doc_id) left join best b on b.doc_id = p.doc_id and b.k = 1 left join kept on kept.doc_id = p.doc_id
    """,
)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


@query("op12_pairwise_quality")
def op12_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("latent")


@query(
    "op13_collocations",
    rf"""
    with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), '{ABC}', '{ABC.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
    total as (select lang, sum(len(w))::bigint as n from w group by lang),
    place as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
    each as (select lang, w, i, unnest(range(1, 6)) as k from place),
    f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from each where i + k - 1 <= len(w) group by 1, 2, 3 having count(*) >= 100),
    c as (select * from f where k >= 2),
    held as (select distinct x.lang, x.phrase from c x join c y on x.lang = y.lang and y.k > x.k and y.f >= x.f and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ')),
    cut as (select *, unnest(range(1, k)) as j, string_split(phrase, ' ') as ws from c anti join held using (lang, phrase)),
    parts as (select cut.*, array_to_string(ws[:j], ' ') as lp, array_to_string(ws[j + 1:], ' ') as rp from cut),
    scored as (select s.lang, s.phrase, s.f as a, l.f as l, r.f as r, n, j, (1000::hugeint * s.f * n // (l.f::hugeint * r.f))::bigint as score
               from parts s join f l on l.lang = s.lang and l.phrase = s.lp join f r on r.lang = s.lang and r.phrase = s.rp join total on total.lang = s.lang),
    one as (select * from scored qualify row_number() over (partition by lang, phrase order by score, j) = 1),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from one)
    select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
