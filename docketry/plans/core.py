"""Queries of units, retrieval, rules, audit and events, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.functions.text import matches, tokens
from docketry.operators import compare, corpus, retrieval, review
from docketry.plans.base import query, table

# ---- corpus ------------------------------------------------------------------------------------

UNITS = """
units as (
  select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as unit, says from (
    select doc_id, i, trim(lines[i]) as says from (
      select doc_id, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, string_split(text, chr(10)) as lines from documents)))
  where says <> '')"""


@query(
    f"with {UNITS} select doc_id, unit, 'ev-' || substr(sha256(concat_ws(chr(31), doc_id, unit, says)), 1, 16) as evidence_id, "
    "sha256(says) as excerpt_sha256 from units"
)
def unit_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.evidence(corpus.line_units(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")


@query(
    f"""with {UNITS}, m as (
  select *, length(says) % 7 = 0 as numbered, length(says) % 7 = 0 or length(says) <= 40 as hard from units),
l as (select *, last_value(case when hard then numbered end ignore nulls) over (partition by doc_id order by unit) as last from m),
g as (select *, sum(case when hard or not coalesce(last, false) then 1 else 0 end) over (partition by doc_id order by unit) as clause from l)
select doc_id, cast(clause as bigint) as clause, count(*) as n_units, min(unit) as first_unit, sum(length(says)) as n_chars from g group by doc_id, clause"""
)
def clause_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by length stand in for numbered headings, which these tables lack."""
    units = corpus.line_units(table(spark, sf_dir, "documents"), "doc_id")
    grouped = corpus.clause_groups(units, "doc_id", F.length("says") % 7 == 0, F.length("says") <= 40)
    return grouped.groupBy("doc_id", "clause").agg(
        F.count("*").alias("n_units"), F.min("unit").alias("first_unit"), F.sum(F.length("says")).alias("n_chars")
    )


#: DuckDB has no look-around: runs of digits are taken whole, and neighbours doubled so that two matches can share one.
PII = {
    "mainland_id": """len(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda x: length(x) = 18))
      + len(regexp_extract_all(regexp_replace({t}, '([^0-9])', '\\1\\1', 'g'), '(^|[^0-9])[0-9]{{17}}(XX|xx)([^0-9]|$)'))""",
    "mainland_mobile": "len(list_filter(regexp_extract_all({t}, '[0-9]+'), lambda x: regexp_full_match(x, '1[3-9][0-9]{{9}}')))",
    "email": """len(regexp_extract_all(regexp_replace({t}, '([^\\pL\\pN_.%+@-])', '\\1\\1', 'g'),
      '(^|[^\\pL\\pN_.+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}([^\\pL\\pN_.-]|$)'))""",
    "unified_social_credit_code": "len(regexp_extract_all({t}, '(?i)统一社会信用代码[^\\n]{{0,16}}[：:]?\\s*([0-9A-Z]{{18}})'))",
    "bank_account": "len(regexp_extract_all({t}, '(?:银行卡|银行账号|开户账号|账号|卡号)[^\\n]{{0,16}}[：:]?\\s*(?:[0-9][ -]?){{12,24}}[0-9]'))",
}


@query(
    "select *, case when "
    + " + ".join(PII)
    + " > 0 then 'block' else 'pass' end as gate from (select doc_id, "
    + ", ".join(f"cast({p.format(t='t')} as bigint) as {k}" for k, p in PII.items())
    + " from (select doc_id, coalesce(text, '') as t from documents))"
)
def personal_data_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.personal_data(table(spark, sf_dir, "documents"), "doc_id")


@query(
    """with t as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
e as (select doc_id, len(t) as length, unnest(t) as term from t)
select term, count(distinct doc_id) as df, count(*) as cf from e group by term"""
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = retrieval.term_counts(table(spark, sf_dir, "documents"))
    return terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(
    """select doc_id, cast(m.i - 1 as bigint) as nth, cast(length(list_aggregate(list_transform(range(1, m.i + 1), lambda k: gaps[k]), 'string_agg', ''))
  + coalesce(length(list_aggregate(list_transform(range(1, m.i), lambda k: ms[k]), 'string_agg', '')), 0) as int) as begins, ms[m.i] as says
from (select doc_id, string_split_regex(text, '[0-9]+') as gaps, regexp_extract_all(text, '[0-9]+') as ms from documents) d,
  lateral (select unnest(range(1, len(ms) + 1)) as i) m"""
)
def number_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number in every text with its place."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(matches(F.coalesce("text", F.lit("")), "[0-9]+")).alias("nth", "m"))
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("m.start").alias("begins"), F.col("m.says").alias("says"))


@query(
    """select term, count(*) as n_documents, sum(hits) as n_hits from (
  select doc_id, t.term, len(string_split(lower(text), t.term)) - 1 as hits from documents, (values ('license'), ('secret'), ('password'), ('token'), ('email')) t(term)
  where contains(lower(text), t.term)) group by term"""
)
def keyword_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and occurrences of each keyword."""
    terms = F.array(*[F.lit(t) for t in ("license", "secret", "password", "token", "email")])
    low = table(spark, sf_dir, "documents").select(F.lower("text").alias("low"))
    hits = low.select("low", F.explode(F.filter(terms, lambda t: F.contains("low", t))).alias("term"))
    count = (F.length("low") - F.length(F.replace("low", F.col("term"), F.lit("")))) / F.length("term")
    return hits.groupBy("term").agg(F.count("*").alias("n_documents"), F.sum(count.cast("long")).alias("n_hits"))


# ---- retrieval ---------------------------------------------------------------------------------

BM25 = """
d as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents),
s as (select count(*) as n, greatest(avg(len(t)), 1.0) as mean from d),
tf as (select doc_id, length, term, count(*) as tf from (select doc_id, len(t) as length, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from tf group by term),
q as (select distinct item_id as query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from benchmark),
bm as (
  select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
  from q join tf using (term) join df using (term), s group by query_id, doc_id),
lex as (
  select * from (select *, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as lexical_rank from bm) where lexical_rank <= {k})"""


def _benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(table(spark, sf_dir, "documents"), queries, tokenizer=tokens)


@query("with " + BM25.format(k=5) + " select query_id, doc_id, score, lexical_rank from lex")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_k(_benchmark_hits(spark, sf_dir), 5, "lexical_rank")


@query(
    "with " + BM25.format(k=5) + """, gate as (select *, max(score) over (partition by query_id) as best from lex)
select query_id, doc_id, score from gate where score >= 4.0 and score >= 0.55 * best"""
)
def gated_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute gate, then the gate relative to the query's best hit."""
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 5, "lexical_rank")
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("best", best).where((F.col("score") >= 4.0) & (F.col("score") >= 0.55 * F.col("best"))).select("query_id", "doc_id", "score")


@query(
    "with " + BM25.format(k=20) + """, len_rank as (
  select query_id, doc_id, cast(row_number() over (partition by query_id order by len(t), doc_id) as int) as length_rank from lex join d using (doc_id)),
l10 as (select * from lex where lexical_rank <= 10), r10 as (select * from len_rank where length_rank <= 10)
select coalesce(l10.query_id, r10.query_id) as query_id, coalesce(l10.doc_id, r10.doc_id) as doc_id, coalesce(lexical_rank, 0) as lexical_rank, coalesce(length_rank, 0) as length_rank,
  round(coalesce(1.0::double / (60 + lexical_rank), 0) + coalesce(1.0::double / (60 + length_rank), 0), 12) as score
from l10 full outer join r10 on l10.query_id = r10.query_id and l10.doc_id = r10.doc_id"""
)
def fused_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal-rank fusion of the BM25 order and the order by length among the best 20."""
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 20, "lexical_rank")
    sized = table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("size"))
    second = retrieval.top_k(hits.join(sized, "doc_id").withColumn("score", -F.col("size")), 10, "length_rank")
    return retrieval.fuse(hits.where("lexical_rank <= 10"), second, ("lexical_rank", "length_rank")).fillna(0)


@query(
    "with " + BM25.format(k=5) + """, a as (
  select item_id as query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 9)) as anchors from benchmark),
c as (
  select query_id, doc_id, cast(len(list_filter(anchors, lambda x: contains(lower(text), x))) as bigint) as n_matched
  from lex join a using (query_id) join documents using (doc_id))
select 'cand-' || substr(sha256(concat_ws(chr(31), query_id, doc_id)), 1, 16) as candidate_id, query_id, doc_id, n_matched,
  case when n_matched > 0 then 'ACCEPT' else 'INSUFFICIENT' end as outcome from c"""
)
def assessed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.top_k(_benchmark_hits(spark, sf_dir), 5, "lexical_rank")
    anchors = F.array_distinct(F.filter(tokens(F.col("text")), lambda x: F.length(x) >= 9))
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), anchors.alias("anchors"))
    return retrieval.assess(hits, table(spark, sf_dir, "documents"), rules)


@query(
    """with s as (
  select a.vec_id as query_id, b.vec_id as doc_id, round(greatest(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 0), 2) as score
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, doc_id, score, cast(r as int) as vector_rank from (
  select *, row_number() over (partition by query_id order by score desc, doc_id) as r from s) where r <= 5"""
)
def cosine_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return retrieval.cosine_top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


# ---- rules -------------------------------------------------------------------------------------


@query(
    """select o_orderkey, o_totalprice as declared_total, coalesce(cast(detail_total as double), -1) as detail_total,
  case when detail_total is null then 'UNKNOWN' when detail_total = cast(o_totalprice as decimal(20,2)) then 'PASS' else 'WARN' end as status
from orders left join (select l_orderkey as o_orderkey, cast(sum(cast(l_extendedprice as decimal(20,2))) as decimal(30,2)) as detail_total
  from lineitem group by l_orderkey) using (o_orderkey)"""
)
def declared_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    out = review.total_check(table(spark, sf_dir, "orders"), items, "o_orderkey", "o_totalprice", "l_extendedprice")
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0)) for c in ("declared_total", "detail_total")})


THRESHOLDS = [("t1", "o_totalprice", ">", 400_000.0, "ESCALATE"), ("t2", "acctbal", "<", 0.0, "REJECT"), ("t3", "o_totalprice", ">=", 250_000.0, "REVISE")]


@query(
    """select o_orderkey, case when o_totalprice > 400000 then 't1' when b < 0 then 't2' when o_totalprice >= 250000 then 't3' end as threshold_id,
  case when o_totalprice > 400000 then 'ESCALATE' when b < 0 then 'REJECT' when o_totalprice >= 250000 then 'REVISE'
       when b is null then 'UNKNOWN' else 'NONE' end as action
from (select o_orderkey, o_totalprice, case when c_acctbal < 9000 then c_acctbal end as b from orders left join customer on o_custkey = c_custkey)"""
)
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr("case when c_acctbal < 9000 then c_acctbal end").alias("acctbal"))
    return review.first_triggered(table(spark, sf_dir, "orders").join(known, "o_custkey", "left"), "o_orderkey", THRESHOLDS)


@query(
    """with r as (select * from (values ('r1', ['BUILDING', 'MACHINERY'], ['nation_1', 'nation_2'], null, null), ('r2', []::varchar[], []::varchar[], 1000, null),
  ('r3', ['HOUSEHOLD'], []::varchar[], null, 5000)) t(rule_id, parties, places, low, high)),
c as (select c_custkey, case when c_custkey % 11 <> 0 then c_mktsegment end as party, n_name as place, case when c_custkey % 7 <> 0 then c_acctbal end as amount
  from customer join nation on c_nationkey = n_nationkey),
f as (select *, case when len(parties) = 0 then true else list_contains(parties, party) end as f1, party is null and len(parties) > 0 as n1,
  case when len(places) = 0 then true else list_contains(places, lower(place)) end as f2,
  case when low is null and high is null then true else (low is null or amount >= low) and (high is null or amount <= high) end as f3 from r, c)
select rule_id, c_custkey, coalesce(cast(a as varchar), 'unknown') as applies from (select rule_id, c_custkey, case when n1 then null when not f1 then false when f2 is null then null when not f2 then false
  when f3 is null then null else f3 end as a from f)"""
)
def applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules against every customer; missing context gives NULL unless an earlier field decides."""
    rules = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("rule_id"), F.lit(p).cast("array<string>").alias("parties"), F.lit(s).cast("array<string>").alias("places"),
                    F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"),
                )
                for i, p, s, low, high in [("r1", ["BUILDING", "MACHINERY"], ["nation_1", "nation_2"], None, None), ("r2", [], [], 1000, None), ("r3", ["HOUSEHOLD"], [], None, 5000)]
            ]
        )
    )
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("place"))
    c = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        "c_custkey", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("party"), "place", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("amount"), rules.alias("r")
    )
    r = lambda n: F.col(f"r.{n}")
    met = review.condition(r("parties"), F.col("party"), r("places"), F.col("place"), r("low"), r("high"), F.col("amount"))
    return c.select("r.rule_id", "c_custkey", F.coalesce(met.cast("string"), F.lit("unknown")).alias("applies"))


@query(
    """select l_partkey, n_documents, n_values, case when n_values = 1 then 'PASS' else 'WARN' end as status from (
  select l_partkey, count(distinct l_orderkey) as n_documents, count(distinct lower(trim(l_returnflag))) as n_values from lineitem group by l_partkey)
where n_documents >= 2"""
)
def cross_document_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "lineitem").withColumn("kind", F.lit("return"))
    return review.consistency(facts, "l_partkey", "kind", "l_returnflag", "l_orderkey").drop("kind")


@query(
    """select l_orderkey, l_linenumber, round(cast(l_extendedprice as decimal(20,2)) * cast(l_tax as decimal(12,6)), 2)::double as expected_tax,
  case when l_tax is null then 'UNKNOWN' when l_tax <= 0.08 then 'PASS' else 'WARN' end as status from lineitem"""
)
def tax_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tax = F.round(F.col("l_extendedprice").cast("decimal(20,2)") * F.col("l_tax").cast("decimal(12,6)"), 2).cast("double")
    status = F.when(F.col("l_tax").isNull(), "UNKNOWN").when(F.col("l_tax") <= 0.08, "PASS").otherwise("WARN")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tax.alias("expected_tax"), status.alias("status"))


# ---- audit and evaluation ----------------------------------------------------------------------


@query("select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def dangling_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.dangling(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), items, "o_orderkey")


@query(
    """select case when l.doc_id is null then 'missing' when d.doc_id is null then 'unexpected' else 'covered' end as state, count(*) as n
from (select distinct doc_id from documents) d full outer join (select distinct doc_id from labels) l on d.doc_id = l.doc_id group by 1"""
)
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    """with c as (
  select source, count_if(q and s) as tp, count_if(not q and s) as fp, count_if(q and not s) as fn, count_if(not q and not s) as tn
  from (select source, quality = 1 as q, length(text) >= 300 and not contains(text, '%%%') as s from labels join documents using (doc_id)) group by source)
select source, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
  round(case when tp + fp > 0 then tp::double / (tp + fp) end, 6) as precision, round(case when tp + fn > 0 then tp::double / (tp + fn) end, 6) as recall,
  round(case when 2 * tp + fp + fn > 0 then (2 * tp)::double / (2 * tp + fp + fn) end, 6) as f1 from c"""
)
def quality_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain length and symbol rule against the labels, by source."""
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    said = (F.length("text") >= 300) & ~F.contains("text", F.lit("%%%"))
    return review.confusion(pairs, F.col("quality") == 1, said, "source")


@query(
    """select o_custkey, event, before, after from (
  select o_custkey, o_orderkey as event, o_orderstatus as after, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders)
where before is not null and (before, after) not in (('O', 'O'), ('F', 'O'), ('F', 'F'), ('O', 'P'), ('P', 'F'))"""
)
def status_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [("O", "O"), ("F", "O"), ("F", "F"), ("O", "P"), ("P", "F")]
    allowed = spark.createDataFrame(steps, "before string, after string")
    out = review.ledger_breaks(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", allowed)
    return out.select("o_custkey", F.col("o_orderkey").alias("event"), "before", "after")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r = 1")
def latest_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = review.latest(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
    return rows.select("user_id", "event_id", "event_type", "value")


@query(
    """select coalesce(panel, 'all') as panel, coalesce(verdict, 'all') as verdict, count(*) as n from (
  select substr(o_orderpriority, 1, 1) as panel, case when o_totalprice > 250000 then 'risk' when o_totalprice > 100000 then 'warn' else 'pass' end as verdict from orders)
group by rollup (panel, verdict)"""
)
def verdict_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    verdict = F.when(p > 250_000, "risk").when(p > 100_000, "warn").otherwise("pass")
    rows = table(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("panel"), verdict.alias("verdict"))
    out = rows.rollup("panel", "verdict").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("panel", F.lit("all")).alias("panel"), F.coalesce("verdict", F.lit("all")).alias("verdict"), "n")


@query(
    """with base as (select o_custkey as id, count(*) as weight from orders group by 1), gone as (select c_custkey as id from customer where c_acctbal < 0),
edit as (select c_custkey as id, c_nationkey as w from customer where c_mktsegment = 'BUILDING')
select base.id, cast(coalesce(w, weight) as bigint) as weight, w is not null as edited from base left join edit on base.id = edit.id where base.id not in (select id from gone)"""
)
def rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base set without what was removed, with edits laid over it."""
    c = table(spark, sf_dir, "customer")
    base = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("weight"))
    edits = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("w"))
    kept = base.join(c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "id", "left_anti").join(edits, "id", "left")
    return kept.select("id", F.coalesce("w", "weight").alias("weight"), F.col("w").isNotNull().alias("edited"))


@query()
def turn_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line changes between each turn of a conversation and the next of the same role."""
    turns = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id", "role").orderBy("turn")
    pairs = turns.withColumn("before", F.lag("text").over(order)).where("before is not null")
    return compare.unit_changes(pairs.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("pair_id"), "before", F.col("text").alias("after")))


@query(
    """with i as (select doc_id as item_id, 'r' || (doc_id % 3) as rule_id, case when quality = 1 then 'PASS' else 'WARN' end as status, doc_id % 10 / 10.0 as confidence from labels)
select item_id, rule_id, case when n_chars is null then 'REFUSED' when confidence < 0.5 then 'UNKNOWN' else status end as gated
from i left join (select doc_id as item_id, n_chars from documents where n_chars > 500) using (item_id)"""
)
def model_item_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as model items that cite their document; only longer documents are allowed as evidence."""
    rule = F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")).alias("rule_id")
    items = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"),
        rule,
        F.when(F.col("quality") == 1, "PASS").otherwise("WARN").alias("status"),
        F.array("doc_id").alias("evidence_ids"),
        (F.col("doc_id") % 10 / 10.0).alias("confidence"),
    )
    allowed = table(spark, sf_dir, "documents").where("n_chars > 500").select(rule, F.col("doc_id").alias("evidence_id"))
    return compare.gate_items(items, allowed).select("item_id", "rule_id", "gated")


# ---- events ------------------------------------------------------------------------------------

BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0)


@query(
    "select event_type, cast(cast(ts as date) as varchar) as day, "
    + ", ".join(f"cast(count_if(value <= {b}) as bigint) as le_{str(b).replace('.', '_')}" for b in BOUNDS)
    + ", round(sum(value), 4) as total, count(value) as n from events group by 1, 2"
)
def duration_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.histogram(table(spark, sf_dir, "events"), [F.col("event_type"), F.to_date("ts").cast("string").alias("day")], "value", BOUNDS)


@query(
    """select event_type, cast(day as varchar) as day, value as p95, n from (
  select event_type, cast(ts as date) as day, value, row_number() over w as r, count(*) over (partition by event_type, cast(ts as date)) as n
  from events where value is not null window w as (partition by event_type, cast(ts as date) order by value)) where r = (95 * n + 99) // 100"""
)
def daily_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile by nearest rank."""
    e = table(spark, sf_dir, "events").where("value is not null").select("event_type", F.to_date("ts").alias("day"), "value")
    group = Window.partitionBy("event_type", "day")
    ranked = e.withColumn("r", F.row_number().over(group.orderBy("value"))).withColumn("n", F.count("*").over(group))
    return ranked.where("r = (95 * n + 99) div 100").select("event_type", F.col("day").cast("string").alias("day"), F.col("value").alias("p95"), "n")


@query(
    """with e as (select user_id, event_id, cast(floor(epoch(ts)) as bigint) as t from events),
m as (select *, case when coalesce(t - lag(t) over w, 21600) >= 21600 then 1 else 0 end as new from e window w as (partition by user_id order by t, event_id)),
s as (select *, cast(sum(new) over (partition by user_id order by t, event_id) as bigint) as session from m)
select user_id, session, count(*) as n_events, min(t) as begins, max(t) as ends from s group by user_id, session"""
)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 6 * 3600)


@query(
    """select user_id, event_id, cast(sum(case event_type when 'signup' then 1 when 'view' then 1 when 'error' then -1 else 0 end)
  over (partition by user_id order by ts, event_id) as bigint) as depth from events"""
)
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.expr("case event_type when 'signup' then 1 when 'view' then 1 when 'error' then -1 else 0 end")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.sum(step).over(order).alias("depth"))


@query("select event_type, cast(date_trunc('hour', ts) as varchar) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream: repeated ids dropped, hourly counts kept as state, run to its end."""
    from docketry.streaming.ledger import hourly_counts

    return hourly_counts(spark, f"{sf_dir}/events.parquet")
