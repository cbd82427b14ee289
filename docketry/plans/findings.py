"""Queries of findings: branches, summaries, decisions, revisions, gates and the rule library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators import applicability, checks, compare, gates
from docketry.plans.base import query, table
from docketry.sources import packages

_STATUS = "case when l_tax is null then 'UNKNOWN' when l_tax <= 0.02 then 'PASS' when l_tax <= 0.06 then 'WARN' else 'BLOCK' end"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as findings of an order."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", F.expr(_STATUS).alias("status"))


@query(
    """select o_orderkey, coalesce(a, b, c, 'UNKNOWN') as status, case when a is not null then 'applicability' when b is not null then 'threshold' when c is not null then 'checker' else 'default' end as branch
from (select o_orderkey, case when c_mktsegment = 'BUILDING' then 'NOT_APPLICABLE' when c_acctbal < 0 then 'UNKNOWN' end as a, case when o_totalprice > 300000 then 'BLOCK' end as b,
  case when o_orderpriority like '1%' then 'WARN' when o_orderpriority like '5%' then 'PASS' end as c from orders join customer on o_custkey = c_custkey)"""
)
def rule_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule against every order: applicability first, then thresholds, then the checker."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    priority = F.col("o_orderpriority")
    status, branch = checks.first_branch(
        [
            ("applicability", F.when(F.col("c_mktsegment") == "BUILDING", "NOT_APPLICABLE").when(F.col("c_acctbal") < 0, "UNKNOWN")),
            ("threshold", F.when(F.col("o_totalprice") > 300_000, "BLOCK")),
            ("checker", F.when(priority.startswith("1"), "WARN").when(priority.startswith("5"), "PASS")),
        ]
    )
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", status.alias("status"), branch.alias("branch"))


@query(
    f"""with f as (select l_orderkey, {_STATUS} as status from lineitem), c as (
  select l_orderkey, count_if(status = 'BLOCK') as n_block, count_if(status = 'UNKNOWN') as n_unknown, count_if(status = 'WARN') as n_warn, count_if(status = 'PASS') as n_pass,
    count_if(status = 'NOT_APPLICABLE') as n_not_applicable from f group by 1)
select l_orderkey, cast(n_block as bigint) as n_block, cast(n_unknown as bigint) as n_unknown, cast(n_warn as bigint) as n_warn, cast(n_pass as bigint) as n_pass, cast(n_not_applicable as bigint) as n_not_applicable,
  case when n_block > 0 then 'BLOCK' when n_unknown > 0 then 'UNKNOWN' when n_warn > 0 then 'WARN' when n_pass > 0 then 'PASS' else 'NOT_APPLICABLE' end as overall from c"""
)
def overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.overall(_findings(spark, sf_dir), "l_orderkey")


@query(
    f"""with f as (select l_orderkey, l_linenumber, l_returnflag, l_shipdate, {_STATUS} as status from lineitem),
o as (select l_orderkey, l_linenumber, true as is_open from f where status in ('WARN', 'BLOCK', 'UNKNOWN')),
d as (select l_orderkey, l_linenumber, count(*) as n, arg_min(case l_returnflag when 'R' then 'DEFER' else 'ACCEPT' end, (l_shipdate, case l_returnflag when 'R' then 'DEFER' else 'ACCEPT' end)) as decision from f where l_linenumber <= 3 group by 1, 2),
b as (select coalesce(o.l_orderkey, d.l_orderkey) as l_orderkey, is_open, n, decision from o full outer join d on o.l_orderkey = d.l_orderkey and o.l_linenumber = d.l_linenumber),
s as (select l_orderkey, count(*) filter (is_open) as n_open, count(*) filter (is_open and n is null) as n_undecided, count(*) filter (is_open and decision = 'DEFER') as n_deferred,
  coalesce(sum(case when is_open then n - 1 else n end), 0) as n_refused from b group by 1)
select l_orderkey, cast(n_open as bigint) as n_open, cast(n_undecided as bigint) as n_undecided, cast(n_deferred as bigint) as n_deferred, cast(n_refused as bigint) as n_refused,
  case when n_undecided = 0 and n_deferred = 0 then 'FINAL' else 'HUMAN_REVIEW' end as state from s"""
)
def decision_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the decisions on an order's first three findings suffice to close it."""
    f = _findings(spark, sf_dir)
    decided = f.where("l_linenumber <= 3").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "DEFER").otherwise("ACCEPT").alias("decision"), F.col("l_shipdate").alias("decided_at")
    )
    return checks.decision_state(f, decided, "l_orderkey", "l_linenumber")


@query(
    f"""with f as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, {_STATUS} as status from lineitem),
c as (select distinct l_orderkey, l_linenumber as clause_id, l_suppkey as evidence_id from lineitem where l_linenumber % 2 = 1),
n as (select l_orderkey, evidence_id, min(clause_id) as near from c group by 1, 2)
select f.l_orderkey, f.l_linenumber as finding_id, coalesce(c.clause_id, near) as clause_id, case when status = 'BLOCK' and l_partkey % 2 = 0 then 'REPLACE' else 'COMMENT' end as operation
from f left join (select distinct l_orderkey, clause_id from c) c on c.l_orderkey = f.l_orderkey and c.clause_id = f.l_linenumber
  left join n on n.l_orderkey = f.l_orderkey and n.evidence_id = f.l_suppkey where status in ('WARN', 'BLOCK', 'UNKNOWN')"""
)
def revision_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _findings(spark, sf_dir).select(
        "l_orderkey",
        F.col("l_linenumber").alias("finding_id"),
        "status",
        F.when(F.col("status") == "BLOCK", "REVISE").otherwise("ESCALATE").alias("action"),
        F.when(F.col("l_partkey") % 2 == 0, "new text").alias("proposed"),
        F.col("l_linenumber").alias("clause_id"),
        F.col("l_suppkey").alias("evidence_id"),
    )
    clauses = f.where("clause_id % 2 = 1").select("l_orderkey", "clause_id", F.array("evidence_id").alias("evidence_ids")).distinct()
    return checks.revisions(f, clauses, "l_orderkey")


@query(
    f"""with f as (select l_orderkey, l_linenumber, {_STATUS} as status from lineitem)
select l_orderkey, l_linenumber, case when count_if(status = 'PASS') over (partition by l_orderkey) = 1 and status <> 'PASS' then 'NOT_APPLICABLE' else status end as status from f"""
)
def single_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.single_choice(_findings(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "status")


@query(
    """with i as (select doc_id as item_id, 'src' || (doc_id % 5) as src, case when doc_id % 7 = 0 then 'ODD' when quality = 1 then 'PASS' else 'WARN' end as level, doc_id % 13 / 10.0 as confidence from labels),
a as (select distinct source as src, doc_id as item_id from documents where n_chars > 500)
select item_id, src, round(least(greatest(confidence, 0), 1), 6)::double as confidence, case when level = 'ODD' then 'bad level' when level = 'WARN' and a.item_id is null then 'no evidence' else 'kept' end as state,
  cast(case when a.item_id is null then 0 else 1 end as int) as n_evidence from i left join a using (src, item_id)"""
)
def risk_item_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = F.concat(F.lit("src"), (F.col("doc_id") % 5).cast("string")).alias("src")
    level = F.when(F.col("doc_id") % 7 == 0, "ODD").when(F.col("quality") == 1, "PASS").otherwise("WARN")
    items = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("item_id"), src, level.alias("level"), F.array("doc_id").alias("evidence_ids"), (F.col("doc_id") % 13 / 10.0).cast("double").alias("confidence")
    )
    allowed = table(spark, sf_dir, "documents").where("n_chars > 500").select(F.col("source").alias("src"), F.col("doc_id").alias("evidence_id"))
    out = gates.risk_items(items, allowed, "src")
    return out.select("item_id", "src", F.round("confidence", 6).alias("confidence"), "state", F.size("evidence_ids").alias("n_evidence"))


@query(
    """with best as (select package, chunk_id, min(candidate_id) as candidate_id, arg_min(score, candidate_id) as score from (
  select l_suppkey as package, l_partkey as chunk_id, l_orderkey * 10 + l_linenumber as candidate_id, l_extendedprice as score from lineitem) group by 1, 2)
select package, chunk_id, candidate_id, score, cast(r as int) as rank from (select *, row_number() over (partition by package order by score desc, candidate_id) as r from best) where r <= 32"""
)
def risk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    c = i.select(F.col("l_suppkey").alias("package"), F.col("l_partkey").alias("chunk_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), F.col("l_extendedprice").alias("score"))
    return gates.risk_candidates(c, "package")


@query(
    """with t as (select lower(trim(p_name)) as title, count(distinct p_partkey) as n, min(p_partkey) as by_title from part group by 1),
i as (select l_orderkey, l_linenumber, l_partkey, case when l_linenumber % 2 = 0 then l_partkey end as given from lineitem)
select l_orderkey, l_linenumber, coalesce(given, case when n = 1 then by_title end, -1) as resolved_id
from i join part on l_partkey = p_partkey left join t on lower(trim(p_name)) = title"""
)
def resolved_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as model items that give a rule's id or only its title."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_name").alias("title"))
    i = table(spark, sf_dir, "lineitem").join(rules.withColumnRenamed("rule_id", "l_partkey"), "l_partkey")
    items = i.select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("rule_id"), "title")
    out = gates.resolved_rules(items, rules, F.lower(F.trim("title")))
    return out.select("l_orderkey", "l_linenumber", F.coalesce("resolved_id", F.lit(-1)).alias("resolved_id"))


@query(
    """with e as (select o_custkey as id, o_orderkey as seq, case when o_orderstatus = 'P' then 'remove' else 'upsert' end as action, o_orderpriority as v from orders),
l as (select id, arg_max(action, seq) as action, arg_max(v, seq) as v from e group by id)
select coalesce(c_custkey, id) as id, case when id is null then c_mktsegment else v end as v, id is not null as edited from customer full outer join l on c_custkey = id where action is distinct from 'remove'"""
)
def library_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments with the last edit, taken from orders, laid over them."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("v"))
    action = F.when(F.col("o_orderstatus") == "P", "remove").otherwise("upsert")
    edits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.col("o_orderpriority").alias("v"))
    return gates.overlay(base, edits, "id", "v")


@query(
    f"""with f as (select l_orderkey, l_linenumber, {_STATUS} as status from lineitem)
select l_orderkey, '# order ' || l_orderkey || ' (' || count(*) || ')' || chr(10) || string_agg(l_linenumber || '. ' || status, chr(10) order by l_linenumber, status) as report from f group by l_orderkey"""
)
def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), F.col("status"))
    return packages.report_text(_findings(spark, sf_dir), "l_orderkey", ["l_linenumber", "status"], line, "order")


@query(
    """select o_orderkey, 'no rule in scope' as issue from orders where o_orderkey % 5 in (3, 4)"""
)
def scopes_without_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as contexts whose scope names a brand (a rule's id), a type of part (its category), nothing, or what no rule has."""
    p = table(spark, sf_dir, "part")
    rules = p.select(F.col("p_brand").alias("rule_id"), F.col("p_type").alias("category")).distinct()
    first = p.agg(F.min("p_brand").alias("brand"), F.max("p_type").alias("type"))  # one row
    k = F.col("o_orderkey") % 5
    scope = F.when(k == 0, F.array("brand", F.lit("other"))).when(k == 1, F.array("type")).when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("other"), F.concat("brand", F.lit("x"))))
    contexts = table(spark, sf_dir, "orders").select("o_orderkey").join(F.broadcast(first)).select("o_orderkey", scope.alias("review_scope"))
    return applicability.scope_issues(rules, contexts, "o_orderkey")


@query(
    """with c as (select l_orderkey as pair_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as pos, ['added', 'deleted', 'modified'][l_linenumber % 3 + 1] as kind,
  case when l_linenumber % 3 > 0 then 'p' || l_partkey end as was, case when l_linenumber % 3 <> 1 then 's' || l_suppkey end as now from lineitem where l_quantity > 25),
p as (select o_orderkey as pair_id, o_orderkey % 101 as s, (select count(*) from c where pair_id = o_orderkey) as n, (select count(*) from c where pair_id = o_orderkey and kind = 'added') as a,
  (select count(*) from c where pair_id = o_orderkey and kind = 'deleted') as d, (select count(*) from c where pair_id = o_orderkey and kind = 'modified') as m from orders),
l as (
  select pair_id, 0 as n, '基准文档：base-' || pair_id as line from p union all select pair_id, 1, '比对文档：other-' || pair_id from p
  union all select pair_id, 2, '相似度：' || case when s >= 95 then '高度相似' when s >= 80 then '较为相似' when s >= 50 then '存在明显差异' else '差异较大' end || '（' || s || '%）' from p
  union all select pair_id, 3, '新增 ' || a || ' 处 / 删除 ' || d || ' 处 / 修改 ' || m || ' 处' from p union all select pair_id, 4, '' from p union all select pair_id, 5, '未发现差异。' from p where n = 0
  union all select pair_id, 5 + 3 * pos, (pos + 1) || '. [' || case kind when 'added' then '新增' when 'deleted' then '删除' else '修改' end || ']' from c
  union all select pair_id, 6 + 3 * pos, '   基准：' || was from c where was is not null union all select pair_id, 7 + 3 * pos, '   比对：' || now from c where now is not null)
select pair_id, cast(n as bigint) as n, line from l"""
)
def comparison_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of compared pairs, line by line: names, band of similarity, counts, numbered changes. Orders are pairs, lines are changes."""
    pairs = table(spark, sf_dir, "orders").selectExpr("o_orderkey as pair_id", "'base-' || o_orderkey as base", "'other-' || o_orderkey as other", "(o_orderkey % 101) / 100.0 as similarity")
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25").withColumn("pos", F.row_number().over(own) - 1)
    changes = lines.selectExpr(
        "l_orderkey as pair_id", "pos", "element_at(array('added', 'deleted', 'modified'), cast(l_linenumber % 3 + 1 as int)) as kind",
        "case when l_linenumber % 3 > 0 then 'p' || l_partkey end as before", "case when l_linenumber % 3 <> 1 then 's' || l_suppkey end as after",
    )
    return compare.report_lines(pairs, changes)
