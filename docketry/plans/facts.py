"""Queries of facts read from texts and of the checks over facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import checks, facts
from docketry.plans.base import query, table

CONTEXT = ("token", "key", "license", "phone", "id")
LEXICON = {"credential": ("password", "secret", "token"), "licence": ("license", "copyright"), "contact": ("@", "phone", "tel")}
FIELDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "long_number": "[0-9]{5,}", "capital": "[A-Z][a-z]{11,}"}
RULES = [(["password|secret"], "BLOCK"), (["license", "copyright|granted|permission"], "PASS"), (["license|token|key"], "WARN")]


@query(
    f"""with n as (select doc_id, text, string_split_regex(text, '[0-9]+') as gaps, regexp_extract_all(text, '[0-9]+') as ms from documents),
m as (select doc_id, text, ms[i] as says, coalesce(length(list_aggregate(gaps[1:i], 'string_agg', '')), 0) + coalesce(length(list_aggregate(ms[1:i - 1], 'string_agg', '')), 0) as begins
  from (select *, unnest(range(1, len(ms) + 1)) as i from n)),
w as (select doc_id, begins, says, substr(text, greatest(begins - 10, 0) + 1, begins + length(says) + 10 - greatest(begins - 10, 0)) as near from m)
select doc_id, cast(begins as int) as begins, says from w where {' or '.join(f"contains(near, '{w}')" for w in CONTEXT)}"""
)
def numbers_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.figures_in_context(table(spark, sf_dir, "documents"), "doc_id", "[0-9]+", CONTEXT)


@query(
    "select doc_id, kind, keyword, sha256(substr(text, greatest(least(strpos(lower(text), keyword) - 1000, length(text) - 1999), 1), 2000)) as excerpt_sha256 from ("
    + " union all ".join(
        f"select doc_id, text, '{kind}' as kind, case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in words) + " end as keyword from documents"
        for kind, words in LEXICON.items()
    )
    + ") where keyword is not null"
)
def first_keyword_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first keyword of each kind, with the hash of the 2,000 characters around it."""
    return facts.first_keywords(table(spark, sf_dir, "documents"), "doc_id", LEXICON)


@query(
    "with f as ("
    + " union all ".join(f"select doc_id, '{f}' as field, regexp_extract_all(text, '{p}') as v from documents where text is not null" for f, p in FIELDS.items())
    + """), o as (select doc_id, field, v[i] as value, i from (select *, unnest(range(1, len(v) + 1)) as i from f)),
d as (select doc_id, field, value, min(i) as i from o group by all)
select doc_id, field, value, cast(nth as int) as nth from (select *, row_number() over (partition by doc_id, field order by i) as nth from d) where nth <= 5"""
)
def element_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.field_values(table(spark, sf_dir, "documents"), "doc_id", FIELDS)


@query(
    "with f as ("
    + " union all ".join(f"select doc_id, '{f}' as field, regexp_extract_all(text, '{p}') as v from documents where text is not null" for f, p in FIELDS.items())
    + """), o as (select doc_id, field, v[i] as value, i from (select *, unnest(range(1, len(v) + 1)) as i from f)),
d as (select doc_id, field, value, min(i) as i from o group by all)
select doc_id, field, value, cast(row_number() over (partition by doc_id, field order by i) as int) as nth from d"""
)
def element_values_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct value of whole documents; element_values keeps five, the reference's limit for one chunk."""
    return facts.field_values(table(spark, sf_dir, "documents"), "doc_id", FIELDS, most=None)


@query(
    """with r as (
  select doc_id, 'email' as field, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+') as value from documents
  union all select doc_id, 'capital', regexp_extract(text, '[A-Z][a-z]{11,}') from documents),
rules as (select * from r where value <> ''),
ai as (select doc_id, case when toxic = 1 then 'toxic' else 'capital' end as field, case when quality = 1 then 'yes' else 'no' end as value from labels),
best as (select doc_id, field, max(value) as value from ai group by all),
added as (select * from best b where not exists (select 1 from rules r where r.doc_id = b.doc_id and r.field = b.field)),
grid as (select doc_id, f.field, f.required from (select distinct doc_id from documents), (values ('email', true), ('capital', false)) f(field, required)),
every as (select doc_id, field, value, 'rule' as origin from rules union all select *, 'ai' from added)
select doc_id, field, coalesce(origin, 'empty') as source, coalesce(value, '') as value, coalesce(required, false) and origin is null as missing
from grid full outer join every using (doc_id, field)"""
)
def element_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's form: fields by rule, then by model items (labels stand for them), and what is missing."""
    docs = table(spark, sf_dir, "documents")
    patterns = {f: FIELDS[f] for f in ("email", "capital")}
    rules = facts.field_values(docs, "doc_id", patterns, most=1)
    items = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "toxic").otherwise("capital").alias("field"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("value"),
        F.lit(0.8).alias("confidence"),
    )
    merged = facts.merge_completions(rules, items, "doc_id")
    form = facts.element_form(merged, {"email": True, "capital": False}, docs, "doc_id")
    return form.select("doc_id", "field", "source", F.coalesce(F.get("values", F.lit(0)), F.lit("")).alias("value"), "missing")


@query(
    """with u as (
  select doc_id % 100 as package, doc_id as chunk_id,
    (length(t) - length(replace(t, 'token', ''))) // 5 + (length(t) - length(replace(t, 'the ', ''))) // 4 as score from (select doc_id, lower(text) as t from documents))
select package, chunk_id, cast(score as bigint) as score, cast(r as int) as rank from (
  select *, row_number() over (partition by package order by score desc, chunk_id) as r from u where score > 0) where r <= 3"""
)
def completion_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 100).alias("package"), F.col("doc_id").alias("chunk_id"), "text")
    return facts.completion_candidates(docs, "package", ("token", "the "), 3)


@query(
    """with t as (select doc_id, text, string_split_regex(lower(text), '[.;\\n]') as parts from documents)
select doc_id, case when text is null or trim(text) = '' then 'UNKNOWN' """
    + " ".join(f"when len(list_filter(parts, lambda x: {' and '.join(f'regexp_matches(x, {p!r})' for p in ps)})) > 0 then '{status}'" for ps, status in RULES)
    + " else 'NOT_APPLICABLE' end as status from t"
)
def term_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences decide, the gravest rule first."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", checks.term_status(F.col("text"), RULES, "NOT_APPLICABLE", ends=r"[.;\n]").alias("status"))


@query(
    """with i as (select l_orderkey as k, cast(sum(cast(l_extendedprice as decimal(20,2))) as decimal(30,2)) as paid, cast(sum(cast(l_discount as decimal(26,6)) * 3) as decimal(38,6)) as ratio,
  cast(sum(case when l_returnflag <> 'N' then cast(l_extendedprice as decimal(20,2)) end) as decimal(30,2)) as invoiced,
  case when min(l_tax) = max(l_tax) then cast(min(l_tax) as decimal(12,6)) end as rate, max(abs(cast(l_tax as decimal(26,6)) - 0.05)) as apart from lineitem group by 1),
w as (select o_orderkey as k, cast(o_totalprice as decimal(20,2)) as amount, i.* exclude (k), case when o_orderkey % 2 = 0 then cast(o_totalprice as decimal(20,2)) else cast(1 as decimal(20,2)) end as upper,
  o_orderkey % 3 = 0 as untaxed, round(cast(o_totalprice as decimal(20,2)) * cast(0.025 as decimal(12,6)), 2) * 2 as tax from orders left join i on o_orderkey = i.k)
select k as o_orderkey, checker, status from (
  select k, 'amount_case' as checker, case when amount = upper then 'PASS' else 'WARN' end as status from w
  union all select k, 'tax_rate', case when apart is null then 'UNKNOWN' when apart <= 0.000000001 then 'PASS' else 'WARN' end from w
  union all select k, 'tax_amount', case when rate is null or not untaxed then 'UNKNOWN' when tax = round(amount * rate, 2) then 'PASS' else 'WARN' end from w
  union all select k, 'payment_total', case when paid is null then 'UNKNOWN' when paid = amount then 'PASS' else 'WARN' end from w
  union all select k, 'invoice_total', case when invoiced is null then 'UNKNOWN' when invoiced = amount then 'PASS' else 'WARN' end from w
  union all select k, 'payment_ratio', case when ratio is null then 'UNKNOWN' when ratio <= 1.000001 then 'PASS' else 'WARN' end from w)"""
)
def money_check_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their items as the financial facts of contracts; a third of them say that amounts are untaxed."""
    o, i = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    total = F.col("o_totalprice").cast("decimal(20,2)")
    fact = lambda kind, v: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), v.cast("decimal(26,6)").alias("value"))
    stated = F.array(
        fact("amount", total),
        fact("upper", F.when(F.col("o_orderkey") % 2 == 0, total).otherwise(F.lit(1))),
        fact("tax", F.round(total * F.lit("0.025").cast("decimal(12,6)"), 2)),
        fact("tax", F.round(total * F.lit("0.025").cast("decimal(12,6)"), 2)),
        fact(F.when(F.col("o_orderkey") % 3 == 0, "untaxed").otherwise("other"), F.lit(1)),
    )
    billed = F.when(F.col("l_returnflag") != "N", "invoice").otherwise("other")
    parts = F.array(fact(billed, F.col("l_extendedprice").cast("decimal(20,2)")), fact("payment", F.col("l_extendedprice").cast("decimal(20,2)")), fact("rate", F.col("l_tax")), fact("ratio", F.col("l_discount").cast("decimal(26,6)") * 3))
    rows = o.select("o_orderkey", F.explode(stated).alias("f")).union(i.select("o_orderkey", F.explode(parts).alias("f")))
    return checks.money_checks(rows.select("o_orderkey", "f.*"), "o_orderkey", 0.05)
