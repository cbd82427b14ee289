"""Queries of audits, fingerprints, replay and package manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.canonical import canonical_row
from docketry.operators import audit, corpus, references
from docketry.plans.base import query, table
from docketry.sources import appended, packages
from docketry.sources.shared import shared_folder


@query(
    """select text_sha256, cast(count(*) as bigint) as n, min(coalesce(source, '?')) <> max(coalesce(source, '?')) as conflict
from (select sha256(text) as text_sha256, source from documents where text is not null) group by 1 having count(*) > 1"""
)
def repeated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that occur twice or more; a conflict if sources differ."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("text_sha256"), "source")
    return audit.repeated_ids(docs, ["text_sha256"], F.coalesce("source", F.lit("?")))


@query(
    """select evidence_id, issue from (
  select l.doc_id as evidence_id, case when d.doc_id is null then 'no document' when l.doc_id % 5 = 0 then 'other version' when l.doc_id % 7 = 0 then 'excerpt changed'
    when length(substr(d.text, 11, 20)) = 0 and length(d.text) < 10 then 'outside' end as issue
  from labels l left join (select doc_id, text from documents where source is distinct from 'src0') d on l.doc_id = d.doc_id) where issue is not null"""
)
def provenance_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of labelled documents, some of them tampered with, against the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    cited = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id")
    excerpt = F.substring("text", 11, 20)
    evidence = cited.select(
        F.col("doc_id").alias("evidence_id"),
        "doc_id",
        F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("source_sha256"),
        F.lit(10).alias("begins"),
        excerpt.alias("excerpt"),
        F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat(excerpt, F.lit("!"))).otherwise(excerpt), 256).alias("excerpt_sha256"),
    )
    return audit.provenance(evidence, docs.where("source is distinct from 'src0'").drop("source"), "doc_id")


@query(
    """with h as (select source, sha256(coalesce(length(doc_id::varchar) || '=' || doc_id, '~') || coalesce(length(text) || '=' || text, '~') || coalesce(length(lang) || '=' || lang, '~')) as h from documents)
select coalesce(source, '?') as source, cast(count(*) as bigint) as n,
  cast(sum(cast('0x' || substr(h, 1, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(h, 14, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(h, 27, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(h, 40, 13) as bigint)) as varchar) || '-' || cast(sum(cast('0x' || substr(h, 53, 13) as bigint)) as varchar) as fingerprint from h group by source"""
)
def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the documents of each source, for equality between runs."""
    return audit.fingerprint(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang"], ["source"]).withColumn("source", F.coalesce("source", F.lit("?")))


@query(
    """with g as (select l_orderkey, l_linenumber, list_sort(list(l_tax) filter (l_quantity < 45)) as a,
  list_sort(list(case when l_linenumber = 2 then l_tax + 1 else l_tax end) filter (l_quantity >= 3)) as b from lineitem group by all)
select l_orderkey, l_linenumber, state from (
  select *, case when b is null then 'missing' when a is null then 'new' when a <> b then 'changed' end as state from g) where state is not null"""
)
def replay_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run against a second one that lacks rows, has new ones and rates one line otherwise."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    second = rows.where("l_quantity >= 3").withColumn("l_tax", F.when(F.col("l_linenumber") == 2, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    return audit.replay_differences(rows.where("l_quantity < 45"), second, ["l_orderkey", "l_linenumber"], ["l_tax"])


@query(
    """select o_custkey, cast(count(*) as bigint) as n_documents, sha256('[' || string_agg('{"document":' || o_orderkey || ',"sha":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']') as snapshot
from orders group by o_custkey"""
)
def package_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packages of orders."""
    out = packages.manifest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus")
    return out.select("o_custkey", F.size("documents").cast("long").alias("n_documents"), "snapshot")


@query("select doc_id, source from documents where sha256(text) not in (select sha256(text) from documents join labels using (doc_id) where text is not null) and text is not null")
def unseen_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text no document of an earlier run (the labelled ones) has."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("sha", F.sha2("text", 256))
    return packages.unseen(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), ["sha"]).select("doc_id", "source")


@query(
    r"""select o_orderkey, sha256('{"amounts":[' || regexp_replace(regexp_replace(cast(cast(o_totalprice as decimal(20,2)) as varchar), '0+$', ''), '\.$', '') || ',null],"key":' || o_orderkey
  || ',"notes":{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"},"z":{"a":' || (o_orderkey % 2 = 0) || '}}') as sha from orders"""
)
def canonical_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested values whose map entries come in either order and whose run times differ: one JSON text, one hash."""
    o = table(spark, sf_dir, "orders")
    priority, status = (F.lit("priority"), F.col("o_orderpriority")), (F.lit("status"), F.col("o_orderstatus"))
    notes = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(*priority, *status)).otherwise(F.create_map(*status, *priority))
    z = F.struct((F.col("o_orderkey") % 2 == 0).alias("a"), F.current_timestamp().alias("created_at"))
    price = F.col("o_totalprice").cast("decimal(20,2)")
    nested = o.select(z.alias("z"), F.col("o_orderkey").alias("key"), notes.alias("notes"), F.array(price, F.lit(None).cast("decimal(20,2)")).alias("amounts"), F.rand().alias("occurred_at"))
    return nested.select(F.col("key").alias("o_orderkey"), F.sha2(canonical_row(nested), 256).alias("sha"))


@query(
    """select event_type, count(*) as n, round(sum(value), 4) as total, min(ts)::varchar as first_at, cast(count(distinct event_id % 4) as bigint) as n_batches, cast(max(case when event_id % 4 = 2 then 1 else 0 end) as int) as revision
from events group by 1"""
)
def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended as JSON lines in four batches, one of them twice and one in a second revision, read back and checked."""
    folder = f"{shared_folder(spark, 'ledger')}/ledger-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    part = lambda i: events.where(F.pmod("event_id", F.lit(4)) == i)
    for i in range(4):
        appended.append(part(i), folder, f"b{i}")
    appended.append(part(1), folder, "b1")
    appended.append(part(2), folder, "b2", revision=1)
    rows, _ = appended.read(spark, folder, events.schema)
    return rows.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.min("ts").cast("string").alias("first_at"), F.count_distinct("batch").alias("n_batches"), F.max("revision").alias("revision")
    )


#: How the entities of each kind of reference hold their ids: plainly, or in a list of parts.
KINDS = [r.kind for r in references.REGISTRY]
CITES = f"array_compact(array('e-' || o_orderkey || '-1', case when o_orderkey % 3 = 0 then 'gone-' || o_orderkey end, case when o_orderkey % 5 = 0 then 'e-' || (o_orderkey + {len(KINDS)}) || '-1' end))"


@query(
    f"""with r as (select o_orderkey as package_id, ['{"', '".join(KINDS)}'][o_orderkey % {len(KINDS)} + 1] as kind, o_orderkey from orders),
c as (select package_id, kind, kind || '-' || o_orderkey as id, unnest(list_filter(['e-' || o_orderkey || '-1', case when o_orderkey % 3 = 0 then 'gone-' || o_orderkey end, case when o_orderkey % 5 = 0 then 'e-' || (o_orderkey + {len(KINDS)}) || '-1' end], lambda x: x is not null)) as evidence_id from r)
select c.* from c left join lineitem on l_orderkey = package_id and 'e-' || l_orderkey || '-' || l_linenumber = evidence_id where l_orderkey is null"""
)
def dangling_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages: an entity of one of seventeen kinds in each, that cites a line, nothing that exists, or another package's line."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    tables: dict[str, DataFrame] = {}
    for i, ref in enumerate(references.REGISTRY):
        name, _, inner = ref.path.partition(".")
        own = o.where(F.pmod("o_orderkey", F.lit(len(KINDS))) == i).withColumn("cites", F.expr(CITES))
        held = F.expr(f"transform(cites, x -> named_struct('{inner}', array(x)))") if inner else F.col("cites")
        rows = own.select(F.col("o_orderkey").alias("package_id"), F.concat(F.lit(f"{ref.kind}-"), "o_orderkey").alias(ref.id), held.alias(name))
        tables[ref.table] = tables[ref.table].unionByName(rows, allowMissingColumns=True) if ref.table in tables else rows
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("package_id"), F.concat_ws("-", F.lit("e"), "l_orderkey", "l_linenumber").alias("evidence_id"))
    return references.dangling_references(tables, lines, ["package_id"])


TYPES = "case i % 7 when 0 then 'header' when 1 then 'table_cell' when 2 then 'seal' else 'paragraph' end"


@query(
    f"""with l as (select doc_id, x[i] as says, i, (i - 1) // 20 as page from (select doc_id, string_split(text, chr(10)) as x, unnest(range(1, len(x) + 1)) as i from documents where text is not null)),
u as (
  select doc_id, page, i, 0 as j, says, case when doc_id % 5 = 0 then 'paragraph' else {TYPES} end as kind from l where doc_id % 5 = 0 or doc_id % 3 <> 0 or page % 2 = 0
  union all select doc_id, page, i, j, parts[j], 'paragraph' from (select *, string_split_regex(says, '\\r|[\\x0B\\f\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') as parts, unnest(range(1, len(parts) + 1)) as j from l where doc_id % 5 <> 0 and doc_id % 3 = 0 and page % 2 = 1))
select doc_id, cast(row_number() over (partition by doc_id order by page, i, j) - 1 as int) as unit, regexp_replace(says, '^[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+|[\\s\\x0B\\x1C-\\x1F\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '', 'g') as says, kind
from u where kind not in ('header', 'table_cell') and trim(says) <> ''"""
)
def parsed_document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parsed blocks: some with an outline, some with pages of which only the text is known; tables and headers ignored."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).selectExpr("doc_id", "at + 1 as i", "floor(at / 20) as page", "text")
    node = F.col("doc_id") % 5 == 0
    blocks = lines.where("doc_id % 5 = 0 or doc_id % 3 <> 0 or page % 2 = 0").select("doc_id", "page", F.col("i").alias("n"), node.alias("node"), F.when(node, "paragraph").otherwise(F.expr(TYPES)).alias("block_type"), "text")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "\n")
    pages = lines.groupBy("doc_id", "page").agg(said.alias("text"))  # twenty lines
    return corpus.parsed_units(blocks, pages, "doc_id", {"ignore_tables": True, "ignore_header_footer": True})
