"""Queries of exact dedup (11), the source divergence audit (12) and hard-negative mining (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, hard_negatives


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal normalised texts of all documents."""
    return exact_dedup.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of a language, and the terms that set each source apart, over all documents."""
    return divergence.audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows whose vec_id is divisible by 100; labels of rows whose vec_id is divisible by 7 are moved by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


QUERIES = {"op11_exact_dedup": op11_exact_dedup, "op12_divergence": op12_divergence, "op13_hard_negatives": op13_hard_negatives}

SQL = {
    "op11_exact_dedup": r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, sha256(t) as text_sha256
from d window g as (partition by t)""",
    "op12_divergence": r"""
with d as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
w as (select lang, source, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as lang_n from w group by all having count(distinct doc_id) >= 10),
c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
l as (select lang, count(*) as v, sum(lang_n)::hugeint as total from k group by all),
g as (select g.lang, g.source, coalesce(l.v, 0) as v, coalesce(l.total, 0) as lang_total, coalesce((select sum(n) from c where c.lang = g.lang and c.source = g.source), 0)::hugeint as total
      from (select distinct lang, source from d) g left join l using (lang)),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::hugeint) // (g.total + 2 * g.v) as p, 1 + (1000000000 * (k.lang_n + 2)::hugeint) // (g.lang_total + 2 * g.v) as q
      from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
f as (select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0)::bigint as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
terms as (select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from p where n > 0 and p > q)
select * from (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from (select * from pairs union all select * from terms))
where part = 'pair' or rank <= 10""",
    "op13_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as e
      from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.e, r.e)::bigint as score from v a join v r on a.vec_id <> r.vec_id and a.vec_id % 100 = 0 and len(a.e) = len(r.e)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over w)::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id) qualify row_number() over w <= 10""",
}
