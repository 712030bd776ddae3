"""The queries of this package for the driver's entry file."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, hard_negatives, katz, licenses, ngram_join, periodic_runs, pieces, quality, secrets, token_counts, toxicity, url_rules, warc
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark, 128)
    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("target_uri")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return licenses.licenses(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.repetition(_table(spark, sf_dir, "documents"))


def id_remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n; null ids count as the text "null"."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % n


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.similar_groups(_table(spark, sf_dir, "documents"))


OP6_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) as i from w where len(ws) > 0)
), n as (select doc_id, count(*) as n from s group by doc_id
), o as (
  select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), e as (
  select x, y from o join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 85 * (p.n + q.n - k)
), r(d, c) as (
  select doc_id, doc_id from documents union select r.d, e.y from r join e on r.c = e.x
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id
from documents d left join n using (doc_id) join (select d as doc_id, min(c) as component_id from r group by d) c using (doc_id)
"""


#: The rules of op7, as (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules)


OP7_SQL = """
with u as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), p as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u
), r(h, q, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), m as (
  select page_id, host, path, h || q as rule, v, row_number() over (partition by page_id order by length(h || q) desc nulls last, h || q) as n
  from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1
"""


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return katz.scores(_table(spark, sf_dir, "documents"), id_remainder(10) == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(id_remainder(3) != 1))
    return toxicity.score(docs, model).withColumn("held_out", id_remainder(3) == 1)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of every tenth hash of an id, periodic from a word on that the hash chooses too."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, a = F.size("words"), F.col("g") % F.size("words")
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    chosen = (
        docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
        .withColumn("a", F.when(n > 0, a))
        .withColumn("p", p)
    )
    picked = F.expr("array_join(transform(words, (x, i) -> if(i < a, x, element_at(words, int(a + (i - a) % p) + 1))), ' ')")
    return chosen.select("doc_id", F.when(F.col("a").isNotNull(), picked).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    found = periodic_runs.periodic_runs(_with_planted_runs(_table(spark, sf_dir, "documents")))
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as before, -r.period as p)))")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.before")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("best.length * 1000 div -best.p").alias("exponent_milli"),
        F.sha2(F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").filter("not exists(embedding, x -> isnan(x) or abs(x) = double('inf'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.expr("transform(embedding, x -> double(floor(256 * double(x))))")
    found = hard_negatives.hard_negatives(rows.select("vec_id", label.alias("label"), whole.alias("vec")), F.col("vec_id") % 50 == 0)
    return found.withColumns({x: F.col(x).cast("long") for x in ("positive_score", "negative_score")})


OP12_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as z
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_dot_product(a.z, b.z)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, positive_id, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id))::int as rank,
  s.id as negative_id, positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 50 * positive_score and 95 * positive_score
qualify rank <= 3
"""


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    return found.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(F.expr(joined.format("filter(spans, s -> s.kind <> 'crf')")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_licenses": op3_licenses,
    "op4_token_counts": op4_token_counts,
    "op5_repetition": op5_repetition,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_rules": op7_url_rules,
    "op8_katz": op8_katz,
    "op9_toxicity": op9_toxicity,
    "op10_pieces": op10_pieces,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_secrets": op13_secrets,
}
ORACLE_SQL: dict[str, str] = {
    "op6_ngram_join": OP6_SQL,
    "op7_url_rules": OP7_SQL,
    "op12_hard_negatives": OP12_SQL,
}
