"""Queries of re-ranking, slots, fallback and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import tokens
from docketry.operators import retrieval
from docketry.plans.base import query, table
from docketry.plans.core import BM25, _benchmark_hits

_SHARE = (
    "case when len({a}) > 0 then coalesce(list_sum(list_transform(list_filter({a}, lambda x: contains(content, x)), lambda x: length(x))), 0)::double"
    " / list_sum(list_transform({a}, lambda x: length(x)))::double end"
)


@query(
    "with " + BM25.format(k=15) + f""", a as (
  select item_id as query_id, list_filter(w, lambda x: length(x) >= 9) as exact, list_filter(w, lambda x: length(x) >= 12) as required,
    list_filter(w, lambda x: x in ('not', 'no', 'nicht', 'pas')) as negation, list_filter(w, lambda x: length(x) >= 10) as near
  from (select item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from benchmark)),
c as (
  select query_id, doc_id, lower(text) as content, exact, required, negation,
    case when n <= 1 then 1.0::double else 1.0::double - (lexical_rank - 1)::double / (n - 1) end as x0,
    list_sort(list_distinct(list_filter(list_transform(near, lambda x: instr(lower(text), x)), lambda p: p > 0))) as places
  from (select *, count(*) over (partition by query_id) as n from lex) join a using (query_id) join documents using (doc_id)),
x as (
  select query_id, doc_id, x0, {_SHARE.format(a='exact')} as x1, {_SHARE.format(a='required')} as x2, {_SHARE.format(a='negation')} as x3,
    case when len(places) >= 2 then greatest(0.0::double, 1.0::double - list_min(list_transform(range(1, len(places)), lambda i: places[i + 1] - places[i]))::double / 80.0::double) end as x4
  from c),
scored as (
  select query_id, doc_id, round((0.2::double * x0 + coalesce(0.25::double * x1, 0) + coalesce(0.3::double * x2, 0) + coalesce(0.15::double * x3, 0) + coalesce(0.1::double * x4, 0))
    / (0.2::double + case when x1 is null then 0 else 0.25::double end + case when x2 is null then 0 else 0.3::double end + case when x3 is null then 0 else 0.15::double end + case when x4 is null then 0 else 0.1::double end), 6) as rerank_score
  from x)
select query_id, doc_id, rerank_score, cast(r as int) as rerank_rank from (
  select *, row_number() over (partition by query_id order by rerank_score desc, doc_id) as r from scored) where r <= 5"""
)
def reranked_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), retrieval.pool_size(5), "lexical_rank")
    some = lambda test: F.filter("w", test)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(tokens(F.col("text"))).alias("w"))
    anchors = items.select(
        "query_id",
        some(lambda x: F.length(x) >= 9).alias("exact"),
        some(lambda x: F.length(x) >= 12).alias("required"),
        F.array().cast("array<string>").alias("numeric"),
        some(lambda x: x.isin("not", "no", "nicht", "pas")).alias("negation"),
        some(lambda x: F.length(x) >= 10).alias("near"),
    )
    return retrieval.rerank(hits, table(spark, sf_dir, "documents"), anchors, "lexical_rank", 5)


@query(
    "with " + BM25.format(k=20) + """, t as (
  select query_id, doc_id, score, case when source = 'src0' then 0 when n_chars >= 300 then 1 else 2 end as tier0 from lex join documents using (doc_id)),
u as (select *, case when tier0 = 0 and row_number() over (partition by query_id, tier0 order by score desc, doc_id) > 1 then 2 else tier0 end as tier from t)
select query_id, doc_id, score, cast(slot as int) as slot from (
  select *, row_number() over (partition by query_id order by tier, score desc, doc_id) as slot from u) where slot <= 6"""
)
def hit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slot for the best hit of a preferred source, then longer documents, the rest last."""
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 20, "lexical_rank")
    known = hits.join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    out = retrieval.slots(known, F.col("source") == "src0", F.col("n_chars") >= 300, 6)
    return out.select("query_id", "doc_id", "score", "slot")


@query(
    "with " + BM25.format(k=3) + """, v as (select * from lex where doc_id in (select doc_id from labels)), hits as (
  select query_id, doc_id, lexical_rank, 'first' as origin from v
  union all select query_id, doc_id, lexical_rank, 'fallback' from lex where query_id not in (select query_id from v))
select query_id, doc_id, lexical_rank, origin from hits"""
)
def fallback_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries without hits of the first retriever, which sees labelled documents only, take those of the second."""
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 3, "lexical_rank").select("query_id", "doc_id", "lexical_rank")
    first = hits.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return retrieval.with_fallback(first.select(hits.columns), hits)


@query(
    "with " + BM25.format(k=10) + """, c as (
  select query_id, lexical_rank, contains(lower(d.text), lower(b.text)) as met from lex join documents d using (doc_id) join benchmark b on b.item_id = query_id),
p as (select query_id, query_id % 2 as half, max(lexical_rank) >= 10 as full_pool, bool_or(met and lexical_rank <= 5) as at5, bool_or(met) as at10, count_if(not met) as wrong, count(*) as n from c group by query_id)
select coalesce(cast(half as varchar), 'all') as half, coalesce(cast(full_pool as varchar), 'all') as full_pool, count(*) as n_queries,
  round(count_if(at5)::double / count(*), 6) as recall5, round(count_if(at10)::double / count(*), 6) as recall10, round(sum(wrong)::double / sum(n)::double, 6) as error_rate
from p group by cube (half, full_pool)"""
)
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the whole text of the item is among its best 5 and 10 hits, by slices and over all of them."""
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 10, "lexical_rank")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("phrase"))
    c = hits.join(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("content")), "doc_id").join(items, "query_id")
    met, rank = F.contains("content", F.col("phrase")), F.col("lexical_rank")
    per = c.groupBy("query_id", (F.col("query_id") % 2).cast("string").alias("half")).agg(
        (F.max(rank) >= 10).cast("string").alias("full_pool"),
        F.bool_or(met & (rank <= 5)).alias("at5"),
        F.bool_or(met).alias("at10"),
        F.count_if(~met).alias("wrong"),
        F.count("*").alias("n"),
    )
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    out = per.cube("half", "full_pool").agg(
        F.count("*").alias("n_queries"), share(F.col("at5")).alias("recall5"), share(F.col("at10")).alias("recall10"), F.round(F.sum("wrong") / F.sum("n"), 6).alias("error_rate")
    )
    return out.withColumns({c: F.coalesce(c, F.lit("all")) for c in ("half", "full_pool")})
