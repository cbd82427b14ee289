"""Queries of phrases, version changes, requests, audits, metrics and contexts, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import metrics, phrases, playbooks, recheck, requests, versions
from docketry.plans.base import query, table
from docketry.sources import catalogs

#: What (?U)\s of Java means, for DuckDB.
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
SPELLINGS = {"secret": ("secret", "password", "token"), "the": ("the", "les", "die")}
TERMS = {"password": ("password", "secret", "token"), "api key": ("apikey",), "les": ("the", "les", "die")}
_GRADE = "case when l_tax <= 0.02 then 'PASS' when l_tax <= 0.06 then 'WARN' else 'BLOCK' end"


@query("select distinct doc_id, item_id from documents d join benchmark b on contains(d.text, b.text) where b.text <> ''")
def benchmark_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the whole text of a benchmark item."""
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "item")
    return phrases.containing(table(spark, sf_dir, "documents"), ["doc_id"], "text", items, "item", size=16).select("doc_id", "item_id").distinct()


@query(
    f"with f as (select distinct doc_id, lower(regexp_replace(text, '{SPACE}', '', 'g')) as t from documents) "
    + " union all ".join(f"select distinct doc_id, '{term}' as term from f where {' or '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in words)}" for term, words in TERMS.items())
)
def terms_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that documents use in one of their spellings."""
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, TERMS))).alias("term"))
    return phrases.alias_matches(table(spark, sf_dir, "documents"), ["doc_id"], "text", asked, "term", SPELLINGS)


@query(
    f"""with c as (select doc_id, coalesce(lang, '?') as lang, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) as t from documents),
s as (select item_id, lang, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) as said from benchmark, (values ('en'), ('fr')) l(lang) where text is not null)
select distinct item_id, doc_id from s join c on c.lang = s.lang and contains(t, said) where said <> ''"""
)
def clauses_of_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as changes between an English and a French version, bound to the documents that hold them."""
    text = F.col("text")
    change = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("change_id"), F.lit("en").alias("base_sha256"), F.lit("fr").alias("compare_sha256"), text.alias("before"), text.alias("after")
    )
    clauses = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clause_id"), F.coalesce("lang", F.lit("?")).alias("source_sha256"), "text")
    return versions.changed_clauses(change, clauses).select(F.col("change_id").alias("item_id"), F.col("clause_id").alias("doc_id"))


@query(
    """with p as (select p_size, p_type, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as plain, p_name as name from part),
r as (select distinct p_size, name, plain from p where p_type = 'PROMO'), f as (select distinct p_size, plain || 'pdf' as file from p where p_type <> 'PROMO')
select p_size, name from r where not exists (select 1 from f where f.p_size = r.p_size and contains(file, plain))"""
)
def attachments_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on promotion as names that a package of parts of one size refers to, the other parts as its files."""
    p = table(spark, sf_dir, "part")
    refs = p.where("p_type = 'PROMO'").select("p_size", F.col("p_name").alias("name")).distinct()
    files = p.where("p_type <> 'PROMO'").select("p_size", F.concat("p_name", F.lit(".pdf")).alias("filename"))
    return phrases.missing_attachments(refs, files, "p_size").select("p_size", "name")


@query(
    "with l as (select * from lineitem) "
    + " union all ".join(
        f"select l_orderkey, l_linenumber, '{n}' as issue from l where not coalesce({c}, false)"
        for n, c in {"quantity": "l_quantity >= 5", "discount": "l_discount <= 0.08", "price": "l_extendedprice > l_quantity * 1000", "open line": "l_linestatus = 'F' or l_returnflag <> 'R'"}.items()
    )
)
def row_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named constraints of line items, one row for each that a row fails."""
    c = F.col
    checks = {
        "quantity": c("l_quantity") >= 5,
        "discount": c("l_discount") <= 0.08,
        "price": c("l_extendedprice") > c("l_quantity") * 1000,
        "open line": (c("l_linestatus") == "F") | (c("l_returnflag") != "R"),
    }
    return playbooks.row_issues(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], checks)


@query(
    """with c as (select l_orderkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 3 as chunk, l_returnflag from lineitem)
select l_orderkey, cast(chunk as int) as chunk, count(*) as n_rules, count_if(l_returnflag = 'R')::bigint as n_items, 2 * count_if(l_returnflag = 'R') >= count(*) as covered from c group by all"""
)
def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rules of an order in chunks of three; the returned ones came back as items."""
    chunked = requests.rule_chunks(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3)
    return requests.chunk_coverage(chunked, chunked.where("l_returnflag = 'R'"), "l_orderkey")


@query(
    """with r as (select distinct l_orderkey, l_partkey from lineitem where l_returnflag <> 'A' and l_linestatus = 'O'),
c as (select distinct l_orderkey, l_partkey, l_suppkey from lineitem where l_quantity > 10)
select l_orderkey, l_partkey as rule_id, count(*)::bigint as n_candidates, cast(sum(cast('0x' || substr(sha256(length(l_suppkey::varchar) || '=' || l_suppkey), 1, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(sha256(length(l_suppkey::varchar) || '=' || l_suppkey), 14, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(sha256(length(l_suppkey::varchar) || '=' || l_suppkey), 27, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(sha256(length(l_suppkey::varchar) || '=' || l_suppkey), 40, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(sha256(length(l_suppkey::varchar) || '=' || l_suppkey), 53, 13) as bigint)) as varchar) as fingerprint
from r join c using (l_orderkey, l_partkey) group by all"""
)
def request_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as rules that ask a model, suppliers as candidates."""
    i = table(spark, sf_dir, "lineitem")
    rules = i.select("l_orderkey", F.col("l_partkey").alias("rule_id"), (F.col("l_returnflag") != "A").alias("judged_by_model"), (F.col("l_linestatus") == "O").alias("in_scope"), F.lit(True).alias("applicable"))
    kind = F.when(F.col("l_quantity") > 10, "contract").otherwise("rule").alias("source_kind")
    candidates = i.select("l_orderkey", F.col("l_partkey").alias("rule_id"), F.col("l_suppkey").alias("candidate_id"), kind)
    return requests.request_fingerprints(requests.model_requests(rules, candidates, "l_orderkey"), "l_orderkey", ["candidate_id"])


@query(
    """select coalesce(topic_order, 2147483647)::bigint as topic_order, c_nationkey as topic, cast(row_number() over (partition by c_nationkey order by c_custkey) as int) as pos, c_custkey as rule_id, c_name as title,
  count(*) over (partition by c_nationkey) as n_rules, count_if(c_acctbal > 0) over (partition by c_nationkey)::bigint as n_enabled
from customer left join (select n_nationkey, n_regionkey * 100 + n_nationkey as topic_order from nation where n_regionkey > 0) on c_nationkey = n_nationkey"""
)
def library_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rules grouped by nation, in the order of regions; those of one region have no place."""
    rules = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("topic"), (F.col("c_acctbal") > 0).alias("enabled"))
    topics = table(spark, sf_dir, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("topic"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).cast("long").alias("topic_order"))
    return playbooks.library_view(rules, topics)


@query(
    """with f as (select o_custkey, o_orderkey, o_orderpriority, case o_orderstatus when 'F' then 'PASS' when 'P' then 'WARN' else 'UNKNOWN' end as status, o_totalprice > 300000 as high, c_mktsegment from orders join customer on o_custkey = c_custkey),
g as (select *, case status when 'WARN' then 1 when 'UNKNOWN' then 2 else case when high then 0 else 3 end end as gravity from f where c_mktsegment in ('BUILDING', 'MACHINERY') or o_orderpriority = '1-URGENT')
select o_custkey, o_orderkey as finding_id, gravity, cast(row_number() over (partition by o_custkey order by gravity, o_orderpriority, o_orderkey) as int) as place from g"""
)
def party_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings about a customer, picked by words and ranked by gravity."""
    segment = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("category"))
    state = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "P", "WARN").otherwise("UNKNOWN")
    found = table(spark, sf_dir, "orders").join(segment, "o_custkey").select(
        "o_custkey",
        F.col("o_orderkey").alias("finding_id"),
        F.col("o_orderpriority").alias("rule_id"),
        "category",
        F.col("o_orderpriority").alias("title"),
        F.lit(None).cast("string").alias("reason"),
        state.alias("status"),
        F.when(F.col("o_totalprice") > 300_000, "high").otherwise("low").alias("risk_level"),
    )
    return requests.party_findings(found, "o_custkey", ["BUILDING", "MACHINERY", "URGENT"]).select("o_custkey", "finding_id", "gravity", "place")


@query(
    """select coalesce(c_custkey, user_id) as id, case when user_id is null then 'unfounded' else 'unstated' end as state
from (select distinct c_custkey from customer) full outer join (select distinct user_id from events) on c_custkey = user_id where user_id is null or c_custkey is null"""
)
def unaligned_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without events and users of events that are no customers."""
    return recheck.aligned(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), ["id"])


@query(
    """with h as (select l_orderkey as q, l_linenumber as c, case when l_returnflag <> 'N' then l_linenumber end as lr, case when l_linestatus = 'O' then l_suppkey + 1 end as vr, 1.0::double / (60 + l_linenumber) as score
  from (select * from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1)),
k as (select distinct o_orderkey as q, l as c from orders, (values (1), (2), (3), (4)) v(l) where o_orderstatus <> 'P'),
b as (select coalesce(h.q, k.q) as q, coalesce(h.c, k.c) as c, h.q is not null as hit, k.q is not null as cand, lr, vr, score from h full outer join k on h.q = k.q and h.c = k.c)
select q as query_id, c as chunk_id, issue from (
  select q, c, 'no hit' as issue from b where not hit union all select q, c, 'no chunk' from b where c > 5 union all select q, c, 'no candidate' from b where not cand
  union all select q, c, 'other sources' from b where hit and not (lr is not null and vr is null)
  union all select q, c, 'other score' from b where hit and not abs(score - coalesce(1.0::double / (60 + lr), 0) - coalesce(1.0::double / (60 + vr), 0)) <= 1e-12)"""
)
def retrieval_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as fused hits of an order that all claim a lexical source, against the candidates of orders."""
    i = table(spark, sf_dir, "lineitem")
    once = i.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("l_returnflag", "l_linestatus", "l_suppkey")]).where("n = 1")
    hits = once.select(
        F.col("l_orderkey").alias("query_id"),
        F.col("l_linenumber").alias("chunk_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("lexical_rank"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey") + 1).alias("vector_rank"),
        F.array(F.lit("lexical")).alias("sources"),
        (F.lit(1.0) / (60 + F.col("l_linenumber"))).alias("score"),
    )
    taken = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("chunk_id"))
    chunks = i.where("l_linenumber <= 5").select(F.col("l_linenumber").alias("chunk_id"))
    return recheck.retrieval_issues(hits, chunks, taken)


@query(
    """select o_custkey, r.o as o_orderkey, sha256(r.s) = sha256(case when r.p like '5%' then 'F' else r.s end) as intact from (
  select o_custkey, arg_max({'o': o_orderkey, 's': o_orderstatus, 'p': o_orderpriority}, (o_orderdate, sha256(case when o_orderpriority like '5%' then 'F' else o_orderstatus end), o_orderkey)) as r from orders group by 1)"""
)
def latest_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's last order as the last revision of a result; whether its payload is the stored one."""
    stored = F.sha2(F.when(F.col("o_orderpriority").startswith("5"), "F").otherwise(F.col("o_orderstatus")), 256)
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.struct("o_orderdate", stored.alias("sha"), "o_orderkey").alias("revision_ts"), stored.alias("payload_sha256"))
    return recheck.latest_result(rows, "o_custkey", F.col("o_orderstatus")).select("o_custkey", "o_orderkey", "intact")


@query(
    f"""with e as (select c_nationkey, c_custkey from customer where c_acctbal > 0), f as (select distinct c_nationkey, c_custkey from orders join customer on o_custkey = c_custkey where o_totalprice > 400000),
b as (select coalesce(e.c_nationkey, f.c_nationkey) as c_nationkey, e.c_custkey is not null as a, f.c_custkey is not null as b from e full outer join f on e.c_custkey = f.c_custkey),
c as (select c_nationkey, count_if(a and b)::bigint as tp, count_if(not a)::bigint as fp, count_if(not b)::bigint as fn from b group by 1)
select *, round(tp::double / nullif(tp + fp, 0), 6) as precision, round(tp::double / nullif(tp + fn, 0), 6) as recall, round((2 * tp)::double / nullif(2 * tp + fp + fn, 0), 6) as f1 from c"""
)
def changes_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with large orders against those with money, by nation."""
    c = table(spark, sf_dir, "customer")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return metrics.set_match(c.where("c_acctbal > 0"), c.join(large, "c_custkey", "left_semi"), ["c_nationkey", "c_custkey"], ["c_nationkey"])


@query(
    f"""with s as (select l_orderkey, l_linenumber, {_GRADE} as said, l_returnflag = 'N' as automatic, case when l_linestatus = 'O' then 'open' end as reason
  from (select * from lineitem qualify count(*) over (partition by l_orderkey, l_linenumber) = 1)),
e as (select o_orderkey, l, o_orderpriority, case when o_orderstatus = 'P' then 'PASS' else 'UNKNOWN' end as status, o_orderstatus = 'F' as due from orders, (values (1), (2)) v(l)),
b as (select o_orderpriority, coalesce(said = status and (not due or coalesce(reason, '') <> ''), false) as ok, coalesce(status = 'UNKNOWN' and said = 'PASS' and automatic, false) as bad from e left join s on o_orderkey = l_orderkey and l = l_linenumber)
select o_orderpriority, count(*) as n, count_if(ok)::bigint as correct, round(count_if(ok)::double / count(*), 6) as accuracy, count_if(bad)::bigint as false_pass from b group by 1"""
)
def conclusions_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders expect of their first two lines against the lines' grades, with false passes."""
    due = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"),
        F.explode(F.sequence(F.lit(1), F.lit(2))).alias("checker"),
        "o_orderpriority",
        F.when(F.col("o_orderstatus") == "P", "PASS").otherwise("UNKNOWN").alias("status"),
        (F.col("o_orderstatus") == "F").alias("reason_due"),
    )
    i = table(spark, sf_dir, "lineitem")
    once = i.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("l_tax", "l_returnflag", "l_linestatus")]).where("n = 1")
    said = once.select(
        F.col("l_orderkey").alias("case_id"),
        F.col("l_linenumber").alias("checker"),
        F.expr(_GRADE).alias("status"),
        (F.col("l_returnflag") == "N").alias("automatic"),
        F.when(F.col("l_linestatus") == "O", "open").alias("reason"),
    )
    return metrics.conclusions(due, said, ["o_orderpriority"])


@query(
    """with o as (select l_orderkey, case when min(l_extendedprice) = max(l_extendedprice) then min(l_extendedprice) end as v from lineitem group by 1)
select o_orderstatus, count(*) as n, count(v) as found, count_if(coalesce(abs(o_totalprice - v) <= 50000, false))::bigint as correct, round(count_if(coalesce(abs(o_totalprice - v) <= 50000, false))::double / count(*), 6) as accuracy
from orders left join o on o_orderkey = l_orderkey group by 1"""
)
def figures_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the one price that the lines of an order state."""
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), "o_orderstatus", F.col("o_totalprice").alias("value"))
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_extendedprice").alias("value"))
    return metrics.figures(want, have, ["case_id"], 50_000, ["o_orderstatus"])


@query(
    """select c_custkey, case c_mktsegment when 'BUILDING' then 'buyer' when 'FURNITURE' then 'unknown' end as party,
  array_to_string(list_distinct_in_order, '|') as tags, cast(cast(c_acctbal as decimal(12,2)) as varchar) as amount, concat_ws('|', case when c_mktsegment not in ('BUILDING', 'FURNITURE') then 'party' end, case when c_acctbal < 0 then 'amount' end) as issues
from (select *, case when c_mktsegment = n_name then [n_name] else [c_mktsegment, n_name] end as list_distinct_in_order from customer join nation on c_nationkey = n_nationkey)"""
)
def customer_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' columns as the text fields of review contexts."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    seg = F.col("c_mktsegment")
    raw = table(spark, sf_dir, "customer").join(n, "c_nationkey").select(
        "c_custkey",
        seg.alias("contract_type"),
        F.when(seg == "BUILDING", " Buyer ").when(seg != "FURNITURE", seg).alias("party_position"),
        F.col("n_name").alias("jurisdiction"),
        F.concat_ws("；", seg, F.concat(F.lit(" "), F.col("n_name")), seg).alias("transaction_tags"),
        F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("transaction_amount"),
        F.to_json(F.array(seg)).alias("review_scope"),
    )
    out = catalogs.review_contexts(raw, "c_custkey")
    return out.select("c_custkey", "party", F.array_join("tags", "|").alias("tags"), F.col("amount").cast("decimal(12,2)").cast("string").alias("amount"), F.array_join("issues", "|").alias("issues"))
