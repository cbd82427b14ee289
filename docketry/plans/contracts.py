"""Queries over contract packages that Spark derives from the orders: each order is a package of one or two documents.

The given tables hold no contracts, so BLOCKS writes their text out of the columns of `orders`, one expression for each
block, the same for both engines. What the operators must find in it is therefore known from the columns: most of the
DuckDB SQL states it from them rather than repeating the operator's patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.text import DETECTORS, clause_number, clause_title, is_heading, stable_id
from docketry.operators import checks, corpus, elements, evidence, execution, facts, search, structure
from docketry.plans.base import query, table
from docketry.sources.shared import cut

K, TOTAL = "o_orderkey", "cast(o_totalprice as decimal(20,2))"
TAX = f"cast(round({TOTAL} * cast(0.13 as decimal(4,2)), 2) as decimal(20,2))"
DIGIT = f"substr('壹贰叁肆伍陆柒捌玖', cast({K} % 9 + 1 as int), 1)"
text_of = lambda x: f"cast({x} as string)"
#: (document, order, type, heading, text) of each block; a null text is no block.
BLOCKS = [
    ("c", 0, "paragraph", True, "'软件开发合同'"),
    ("c", 1, "paragraph", False, f"'合同编号：HT-' || {text_of(K)}"),
    ("c", 2, "paragraph", False, f"case when {K} % 13 = 0 then '甲方：是指委托本项目的一方' else '甲方：客户' || {text_of('o_custkey')} || '公司' end"),
    ("c", 3, "paragraph", False, f"case when {K} % 19 = 0 then '乙方：盖章' else '乙方：供应商' || {text_of(f'{K} % 100')} || '公司' end"),
    ("c", 4, "paragraph", True, "'第一条 合同金额'"),
    ("c", 5, "paragraph", False, f"'合同金额：小写' || {text_of(TOTAL)} || '元，大写：' || {DIGIT} || '佰万元整。'"),
    ("c", 6, "paragraph", False, f"case when {K} % 3 = 0 then '税率：13%；税额：' || {text_of(TAX)} || '元，以上为不含税金额口径。' else '税率：6%，价格含税。' end"),
    ("c", 7, "paragraph", True, "'第二条 付款'"),
    ("c", 8, "paragraph", False, f"case {K} % 4 when 0 then '验收合格后支付合同价款。' when 1 then '合同签订后一次性全额预付。' when 2 then '付款比例30%，尾款按月结算。' else '乙方应在验收后十个工作日内支付保证金。' end"),
    ("c", 9, "paragraph", False, "'2.1 甲方不得向第三方披露源代码；乙方提供测试报告。'"),
    ("c", 10, "paragraph", False, "'2.1.1 见第二条和第九条。'"),
    ("c", 11, "paragraph", True, "'第三条 验收'"),
    ("c", 12, "paragraph", False, f"case {K} % 3 when 0 then '验收标准以测试报告为准，期限10日内。' when 1 then '逾期视为验收合格。' else '验收另行约定。' end"),
    ("c", 13, "paragraph", False, "'本条所称“工作日”是指法定工作日。'"),
    ("c", 14, "table_cell", False, "'单价 | 100'"),
    ("c", 15, "paragraph", True, "'第四条 违约责任'"),
    ("c", 16, "paragraph", False, f"case {K} % 3 when 0 then '违约方赔偿损失，比例为合同金额的5%。' when 1 then '乙方不承担违约责任。' else '违约责任双方协商。' end"),
    ("a", 0, "paragraph", True, "'实施方案'"),
    ("a", 1, "paragraph", False, f"'合同金额：' || {text_of(f'case when {K} % 5 = 0 then {TOTAL} + 1 else {TOTAL} end')} || '元'"),
    ("a", 2, "paragraph", False, f"case when {K} % 14 = 0 then '账号：6222 0200 1234 5678 901' when {K} % 22 = 0 then '电话13800138000,13900139000' else '发票类型：增值税专用发票' end"),
]
HAS_ANNEX = f"{K} % 2 = 0"
KINDS = f"case when d = 'c' then 'main_contract' when {K} % 11 = 0 then 'unknown' else 'attachment' end"
PARSED = f"d = 'c' or {K} % 17 <> 0"
B = (
    "b as (select package_id, document_id, d, x.o as block_order, x.t as block_type, x.h as is_heading, x.s as content, document_kind, parsed from ("
    + " union all ".join(
        f"select {K} as package_id, '{d}-' || {text_of(K)} as document_id, '{d}' as d, {KINDS.replace(' d ', f' {chr(39)}{d}{chr(39)} ')} as document_kind, {PARSED.replace('d =', f'{chr(39)}{d}{chr(39)} =')} as parsed, "
        f"unnest([{', '.join(f'struct_pack(o := {o}, t := {chr(39)}{t}{chr(39)}, h := {str(h).lower()}, s := {s})' for doc, o, t, h, s in BLOCKS if doc == d)}]) as x from orders"
        + (f" where {HAS_ANNEX}" if d == "a" else "")
        for d in "ca"
    )
    + "))"
)
C = B + ", c as (select *, document_id || '-' || cast(block_order as string) as chunk_id, 'ev-' || substr(sha256(concat_ws(chr(31), document_id, block_order, content)), 1, 16) as evidence_id from b)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """package_id, document_id, document_kind, parsed, page_number, block_order, block_type, is_heading, content, chunk_id."""
    # an order's row becomes twenty blocks of text, so the narrow rows are spread first, by package
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").repartition(parts, "o_orderkey")
    listed = lambda doc: "array(" + ", ".join(f"named_struct('o', {o}, 't', '{t}', 'h', {str(h).lower()}, 's', {s})" for d, o, t, h, s in BLOCKS if d == doc) + ")"
    # joined, not exploded: Spark takes an exploded table to be no larger than the orders, and would broadcast all blocks
    documents = spark.sql("select * from values ('c'), ('a') as t(d)")
    out = orders.join(F.broadcast(documents)).where(f"d = 'c' or {HAS_ANNEX}")  # two rows
    out = out.selectExpr("*", f"explode(case d when 'c' then {listed('c')} else {listed('a')} end) as x")
    return out.selectExpr(
        f"{K} as package_id", f"d || '-' || {text_of(K)} as document_id", f"{KINDS} as document_kind", f"{PARSED} as parsed", "1 as page_number",
        "x.o as block_order", "x.t as block_type", "x.h as is_heading", "x.s as content", f"d || '-' || {text_of(K)} || '-' || x.o as chunk_id",
    )


KEY = ["package_id", "document_id"]


def block_evidence(b: DataFrame) -> DataFrame:
    return b.select(*KEY, "block_order", stable_id("ev-", F.col("document_id"), F.col("block_order"), F.col("content")).alias("evidence_id"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return b.withColumn("evidence_ids", F.array(stable_id("ev-", F.col("document_id"), F.col("block_order"), F.col("content")))).withColumn("source_kind", F.lit("contract"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.contract_clauses(chunks(spark, sf_dir), KEY)


#: The clause that each block of the main contract falls in, by its first block, and that clause's number and title.
CLAUSES = "(values (0, 0, null, '软件开发合同'), (1, 1, null, '合同编号'), (2, 2, null, '甲方'), (3, 3, null, '乙方'), (4, 4, '第一条', '合同金额'), (5, 4, '第一条', '合同金额'), (6, 4, '第一条', '合同金额'), (7, 7, '第二条', '付款'), (8, 7, '第二条', '付款'), (9, 9, '2.1', '甲方不得向第三方披露源代码'), (10, 10, '2.1.1', '见第二条和第九条'), (11, 11, '第三条', '验收'), (12, 11, '第三条', '验收'), (13, 11, '第三条', '验收'), (14, 14, null, '单价 | 100'), (15, 15, '第四条', '违约责任'), (16, 15, '第四条', '违约责任')) as g(block_order, first, number, title)"
ANNEX = "(values (0, 0, null, '实施方案'), (1, 1, null, '合同金额'), (2, 2, null, '')) as g(block_order, first, number, title)"
G = f"""{C}, g as (
  select c.*, g.first, g.number, g.title from c join {CLAUSES} using (block_order) where d = 'c'
  union all select c.*, g.first, g.number, case when block_order = 2 then case when content like '账号%' then '账号' when content like '电话%' then content else '发票类型' end else g.title end
  from c join {ANNEX} using (block_order) where d = 'a'),
cl as (select package_id, document_id, d, 'clause-' || substr(sha256(concat_ws(chr(31), package_id, document_id, document_id || '-' || cast(first as string))), 1, 16) as clause_id, first,
  any_value(number) as number, any_value(title) as title, string_agg(content, chr(10) order by block_order) as text, string_agg(chunk_id, ',' order by block_order) as chunk_ids
  from g group by package_id, document_id, d, first)"""


# ---- evidence, chunks, clauses ------------------------------------------------------------------


@query(
    f"""with {B}, d as (select package_id, document_id, sha256(string_agg(content, chr(10) order by block_order)) as sha from b group by all)
select package_id, 'package-' || substr(sha256(concat_ws(chr(31), package_id, string_agg(document_id || '=' || sha, chr(31) order by document_id))), 1, 16) as evidence_id, count(*) as n_documents,
  max(case when document_id like 'c-%' then sha end) as main_sha from d group by package_id"""
)
def package_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence row for each package, with the hash of each of its documents."""
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_order", "content"))), lambda x: x["content"]), "\n")
    docs = blocks(spark, sf_dir).groupBy(*KEY).agg(F.sha2(said, 256).alias("sha"))
    out = evidence.package_evidence(docs, "package_id", "document_id", "sha")
    main = F.element_at("source_sha256", F.concat(F.lit("c-"), F.col("package_id")))
    return out.select("package_id", "evidence_id", F.size("source_sha256").cast("long").alias("n_documents"), main.alias("main_sha"))


RULES = [
    ("amount", "1", "finance", "合同金额", None, "amount_case", ["financial.contract_amount_numeric"], ["合同金额"], None),
    ("payment", "1", "finance", "付款条件", "付款须与验收绑定", None, ["contract_term:payment"], ["付款"], ["验收合格后"]),
    ("acceptance", "2", "delivery", "验收标准", None, None, ["contract_term:acceptance"], [], None),
    ("breach", "1", "legal", "违约责任", None, None, [], ["违约责任"], None),
]
RULE_TYPE = (
    "rule_id string, version string, category string, title string, condition string, checker string, required_evidence array<string>, clause_types array<string>, positions array<string>"
)
BUNDLE = "rules-2"


def rules(spark: SparkSession) -> DataFrame:
    """The rules of the bundle: a table of few rows that its author fixes."""
    lit = lambda v: F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
    names = [c.split(" ")[0] for c in RULE_TYPE.split(", ")]
    rows = [F.struct(*[lit(v).cast("string" if not isinstance(v, list) and n != "positions" else "array<string>").alias(n) for n, v in zip(names, r, strict=True)]) for r in RULES]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*").withColumn("expected_value", F.lit(None).cast("string"))


RULE_TEXT = {
    "amount": "amount | 1\nfinance\n合同金额",
    "payment": 'payment | 1\nfinance\n付款条件\n付款须与验收绑定\nplaybook={"positions":["验收合格后"]}',
    "acceptance": "acceptance | 2\ndelivery\n验收标准",
    "breach": "breach | 1\nlegal\n违约责任",
}
VERSIONS = {r[0]: r[1] for r in RULES}
RULE_SQL = " union all ".join(
    f"select '{r}' as rule_id, '{BUNDLE}-{r}' as chunk_id, '{t}' as content, 'rule-evidence-' || substr(sha256(concat_ws(chr(31), '{BUNDLE}', '{r}', '{VERSIONS[r]}')), 1, 16) as evidence_id"
    for r, t in RULE_TEXT.items()
)


def rule_table(spark: SparkSession) -> DataFrame:
    playbook = F.when(F.col("positions").isNotNull(), F.struct("positions"))
    return evidence.rule_chunks(rules(spark).withColumn("playbook", playbook), BUNDLE)


@query(
    f"""with {C} select package_id, source_kind, count(*) as n_chunks, count(distinct evidence_id) as n_evidence, sha256(string_agg(chunk_id || content, chr(31) order by chunk_id)) as content_sha256 from (
  select package_id, 'contract' as source_kind, chunk_id, content, evidence_id from c
  union all select o_orderkey, 'rule', chunk_id, content, evidence_id from orders, ({RULE_SQL})) group by package_id, source_kind"""
)
def knowledge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract chunks with the place of their blocks, and the rules' own chunks, for each package."""
    b = blocks(spark, sf_dir)
    own = evidence.contract_chunks(block_evidence(b), b, [*KEY, "block_order"]).select("package_id", "source_kind", "chunk_id", "content", "evidence_ids")
    packages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"))
    both = own.unionByName(packages.join(F.broadcast(rule_table(spark).drop("rule_id"))))  # the bundle's rules, a fixed few
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))), lambda x: F.concat(x["chunk_id"], x["content"])), "\x1f")
    return both.groupBy("package_id", "source_kind").agg(F.count("*").alias("n_chunks"), F.count_distinct("evidence_ids").alias("n_evidence"), F.sha2(said, 256).alias("content_sha256"))


@query(f"with {G} select package_id, document_id, clause_id, number, title, text, chunk_ids from cl")
def contract_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered clauses with the blocks they take up, headings, table cells and the rest on their own."""
    return clauses(spark, sf_dir).withColumn("chunk_ids", F.array_join("chunk_ids", ","))


@query(f"with {G} select g.package_id, g.chunk_id, cl.clause_id from g join cl on g.document_id = cl.document_id and g.first = cl.first")
def clause_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the one clause that holds it."""
    bound, twice = evidence.bind_clauses(chunks(spark, sf_dir), clauses(spark, sf_dir), KEY)
    good = bound.join(twice, [*KEY, "chunk_id"], "left_anti")
    return good.select("package_id", "chunk_id", F.element_at("clause_ids", 1).alias("clause_id"))


@query(
    f"""with {G}, n as (select *, case number when '第一条' then '一' when '第二条' then '二' when '第三条' then '三' when '第四条' then '四' else number end as bare from cl where d = 'c')
select package_id, 'PARENT_OF' as kind, p.clause_id as src, q.clause_id as dst, '' as named from n p join n q using (package_id) where p.bare = '2.1' and q.bare = '2.1.1'
union all select package_id, 'REFERENCES', p.clause_id, q.clause_id, '二' from n p join n q using (package_id) where p.bare = '2.1.1' and q.bare = '二'
union all select package_id, 'REFERENCES', clause_id, null, '九' from n where bare = '2.1.1'
union all select package_id, 'DEFINES', clause_id, null, '工作日' from n where bare = '三'"""
)
def clause_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents by dotted number, references resolved or not, and definitions."""
    c = structure.numbered(clauses(spark, sf_dir)).select("package_id", F.col("document_id").alias("document"), F.col("clause_id").alias("clause"), "number", "text")
    package = F.regexp_extract("document", "-([0-9]+)$", 1).cast("long").alias("package_id")
    part = lambda df, dst, named: df.select(package, "kind", "src", dst.alias("dst"), named.alias("named"))
    out = part(structure.parents(c), F.col("dst"), F.lit(""))
    out = out.union(part(structure.references(c), F.col("dst"), F.col("number")))
    return out.union(part(structure.definitions(c), F.lit(None).cast("string"), F.col("term")))


@query(
    f"""with {G}, o as (
  select package_id, clause_id, '甲方' as subject, 'prohibited' as modality, '向第三方披露源代码' as action, null as deadline, 0.9::double as confidence from cl where d = 'c' and first = 9
  union all select package_id, clause_id, '乙方', 'required', '测试报告', null, 0.7::double from cl where d = 'c' and first = 9
  union all select package_id, clause_id, '乙方', 'required', '在验收后十个工作日内支付保证金', '在验收后十个工作日内', 0.8::double from cl where d = 'c' and first = 7 and package_id % 4 = 3)
select * from o"""
)
def contract_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who must do what, or must not, and by when."""
    c = clauses(spark, sf_dir).select(F.col("package_id").alias("document"), F.col("clause_id").alias("clause"), "number", "text")
    out = structure.obligations(c)
    return out.select(F.col("document").alias("package_id"), F.col("clause").alias("clause_id"), "subject", "modality", "action", "deadline", "confidence")


@query(
    f"""select package_id, rule_id, question, case when status = 'PASS' then 'SUPPORTED' when status in ('WARN', 'BLOCK') then 'CONTRADICTED' when rule_id = 'breach' then 'NOT_MENTIONED' else 'UNKNOWN' end as outcome from (
  select o_orderkey as package_id, rule_id, question, case (o_orderkey + len(rule_id)) % 4 when 0 then 'PASS' when 1 then 'WARN' when 2 then 'BLOCK' else 'UNKNOWN' end as status
  from orders, (values {', '.join(f"('{r[0]}', '{r[3] if not r[4] else r[3] + '：' + r[4]}')" for r in RULES)}) as q(rule_id, question))"""
)
def review_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question of each rule in each package and what its finding says to it."""
    packages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"))
    asked = structure.review_questions(packages.join(F.broadcast(rules(spark))), "package_id")  # the bundle's rules, a fixed few
    n = (F.col("package_id") + F.length("rule_id")) % 4
    status = F.when(n == 0, "PASS").when(n == 1, "WARN").when(n == 2, "BLOCK").otherwise("UNKNOWN")
    key = F.concat_ws("/", "package_id", "rule_id")
    found = asked.select(key.alias("rule_id"), status.alias("status"), F.concat(F.lit("e-"), key).alias("evidence_id"))
    missing = asked.where("rule_id = 'breach'").select(F.concat(F.lit("e-"), key).alias("evidence_id"))
    out = structure.question_outcomes(found, missing).withColumnRenamed("rule_id", "k")
    return asked.withColumn("k", key).join(out, "k").select("package_id", "rule_id", "question", "outcome")


@query(
    f"""with {B} select package_id, count_if(block_order in (4, 7, 9, 10, 11, 15) and d = 'c') as n_headings, count_if(not parsed) > 0 as unparsed,
  sum(case when content like '账号%' then 1 when content like '电话%' then 2 else 0 end)::bigint as n_found, count_if(not parsed) as n_unparsed,
  case when count_if(not parsed) > 0 or count_if(content like '账号%' or content like '电话%') > 0 then 'block' else 'allow' end as decision from b group by package_id"""
)
def package_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings by their number, unparsed documents, and the gate of personal and account data, for each package."""
    b = blocks(spark, sf_dir)
    heads = b.groupBy("package_id").agg(F.count_if(is_heading(F.col("content"))).alias("n_headings"), (~F.bool_and("parsed")).alias("unparsed"))
    assert len(DETECTORS) == 5
    return heads.join(corpus.package_gate(b, "package_id", "content", "parsed"), "package_id")


PHRASES = ("合同金额", "验收", "源代码")


@query(
    f"""with {B} select document_id, block_order, phrase, cast(strpos(content, phrase) - 1 as int) as "start", phrase as excerpt,
  'evidence-' || substr(sha256(concat_ws(chr(31), document_id, block_order, phrase, strpos(content, phrase) - 1)), 1, 16) as evidence_id
from b, (values {', '.join(f"('{p}')" for p in PHRASES)}) as p(phrase) where contains(content, phrase)"""
)
def phrase_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first place of each phrase in each block, as evidence."""
    out = evidence.phrase_evidence(blocks(spark, sf_dir), ["document_id", "block_order"], "content", PHRASES)
    return out.select("document_id", "block_order", "phrase", "start", "excerpt", "evidence_id")


# ---- facts, elements, checks --------------------------------------------------------------------

FACTS = f"""f as (
  select {K} as package_id, 'c' as d, 5 as block_order, 'amount' as kind, {TOTAL} as value from orders
  union all select {K}, 'c', 5, 'upper', cast(({K} % 9 + 1) * 1000000 as decimal(20,2)) from orders
  union all select {K}, 'c', 6, 'tax', {TAX} from orders where {K} % 3 = 0
  union all select {K}, 'c', 6, 'rate', case when {K} % 3 = 0 then 0.13 else 0.06 end from orders
  union all select {K}, 'c', 8, 'ratio', 0.3 from orders where {K} % 4 = 2
  union all select {K}, 'a', 1, 'amount', case when {K} % 5 = 0 then {TOTAL} + 1 else {TOTAL} end from orders where {HAS_ANNEX})"""


def block_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, kind, value of the figures that chunks state, each once for a chunk."""
    found = facts.financial_facts(blocks(spark, sf_dir), "chunk_id", "content")
    return found.select("chunk_id", "kind", F.col("value").cast("decimal(20,2)").alias("value")).distinct()


@query(f"with {FACTS} select d || '-' || cast(package_id as string) || '-' || cast(block_order as string) as chunk_id, kind, cast(value as double) as value from f")
def contract_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts in digits and words, taxes, rates and shares of contract chunks."""
    return block_facts(spark, sf_dir).withColumn("value", F.col("value").cast("double"))


@query(
    f"""select {K} as package_id, checker, status from (
  select *, case when {HAS_ANNEX} and {K} % 5 = 0 then null else {TOTAL} end as amount, {K} % 3 = 0 as taxed from orders), lateral (values
  ('amount_case', case when amount is null then 'UNKNOWN' when amount = ({K} % 9 + 1) * 1000000 then 'PASS' else 'WARN' end),
  ('tax_rate', case when taxed then 'PASS' else 'WARN' end),
  ('tax_amount', case when taxed and amount is not null then 'PASS' else 'UNKNOWN' end),
  ('payment_total', 'UNKNOWN'), ('invoice_total', 'UNKNOWN'),
  ('payment_ratio', case when {K} % 4 = 2 then 'PASS' else 'UNKNOWN' end),
  ('untaxed', case when not taxed then 'WARN' else 'PASS' end), ('guarantee', 'UNKNOWN'),
  ('invoice_type', case when {HAS_ANNEX} and {K} % 14 <> 0 and {K} % 22 <> 0 then 'PASS' else 'UNKNOWN' end), ('invoice_amount', 'UNKNOWN')) as v(checker, status)"""
)
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money and wording checks of each package over the figures and elements of its documents."""
    b = blocks(spark, sf_dir)
    package = F.regexp_extract("chunk_id", "-([0-9]+)-", 1).cast("long").alias("package_id")
    figures = block_facts(spark, sf_dir).select(package, "kind", F.col("value").cast("decimal(26,6)").alias("value"))
    untaxed = b.where(F.contains("content", F.lit("不含税"))).select("package_id", F.lit("untaxed").alias("kind"), F.lit(1).cast("decimal(26,6)").alias("value"))
    money = checks.money_checks(figures.union(untaxed), "package_id", 0.13)
    kinds = elements.element_facts(b, ["package_id", "chunk_id"], "content", fields=["invoice_type"]).select("package_id", F.lit("invoice_type").alias("kind"))
    return money.union(checks.wording_checks(b, kinds, b, "package_id"))


ELEMENTS = f"""e as (
  select {K} as package_id, 'contract_no' as field, 'HT-' || cast({K} as string) as value from orders where {K} >= 0
  union all select {K}, 'party_a', '客户' || cast(o_custkey as string) || '公司' from orders where {K} % 13 <> 0
  union all select {K}, 'party_b', '供应商' || cast({K} % 100 as string) || '公司' from orders where {K} % 19 <> 0
  union all select {K}, 'tax_rate', case when {K} % 3 = 0 then '13%' else '6%' end from orders
  union all select {K}, 'amount', cast(case when {K} % 5 = 0 then {TOTAL} + 1 else {TOTAL} end as string) || '元' from orders where {HAS_ANNEX}
  union all select {K}, 'amount', '小写' || cast({TOTAL} as string) || '元' from orders
  union all select {K}, 'invoice_type', '增值税专用发票' from orders where {HAS_ANNEX} and {K} % 14 <> 0 and {K} % 22 <> 0
  union all select {K}, 'invoice_type', '专用发票' from orders where false)"""


@query(f"with {ELEMENTS} select * from e")
def contract_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of contracts by pattern and alias, without definitions and remnants of signature blocks."""
    found = elements.element_facts(blocks(spark, sf_dir), ["package_id", "chunk_id"], "content")
    return elements.unique_facts(found, ["package_id"]).select("package_id", "field", "value")


@query(
    f"""with {ELEMENTS}, t as (select {K} as package_id, f.field from orders, (values {', '.join(f"('{f}')" for f in elements.ALIASES)}) as f(field)),
miss as (select package_id, field from t anti join e using (package_id, field)),
i as (select package_id, field, case when field = 'warranty' then 'v' || cast(package_id % 7 as string) else 'x' end as value, case when package_id % 5 = 0 and field = 'warranty' then 'foreign' else '' end as issue
  from miss where field in ('warranty', 'sign_date'))
select package_id, field, value, package_id % 5 = 0 as refused from i where package_id % 5 <> 0
union all select package_id, null, cast(count(*) as string), true from i where package_id % 5 = 0 and issue <> '' group by package_id"""
)
def element_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields without a fact, and model items for two of them; a package whose response cites foreign evidence is refused."""
    c = chunks(spark, sf_dir)
    found = elements.element_facts(c, ["package_id", "chunk_id"], "content")
    targets = elements.completion_targets(c, found, "package_id", list(elements.ALIASES))
    own = c.select("package_id", F.element_at("evidence_ids", 1).alias("evidence_id"))
    first = own.groupBy("package_id").agg(F.min("evidence_id").alias("evidence_id"))
    asked = targets.where("field in ('warranty', 'sign_date')").join(first, "package_id")
    cited = F.when((F.col("package_id") % 5 == 0) & (F.col("field") == "warranty"), "ev-none").otherwise(F.col("evidence_id"))
    value = F.when(F.col("field") == "warranty", F.concat(F.lit("v"), F.col("package_id") % 7)).otherwise(F.lit("x"))
    items = asked.select("package_id", F.lit("i1").alias("item_id"), F.lit("q").alias("request_id"), F.lit("q").alias("asked_request_id"), "field", value.alias("value"), cited.alias("evidence_id"), F.lit(0.8).alias("confidence"))
    weaker = items.withColumns({"item_id": F.lit("i2"), "value": F.lit("weaker"), "confidence": F.lit(0.5), "evidence_id": F.lit("ev-none")}).where("false")
    good, bad = elements.completion_gate(items.union(weaker), targets, own, "package_id")
    out = good.select("package_id", "field", "value", F.lit(False).alias("refused"))
    return out.union(bad.groupBy("package_id").agg(F.count("*").cast("string").alias("value")).select("package_id", F.lit(None).cast("string"), "value", F.lit(True)))


@query(
    f"""select package_id, term, status, reason from (select {K} as package_id, {HAS_ANNEX} and {K} % 17 = 0 as open, {K} % 4 as p, {K} % 3 as t from orders), lateral (values
  ('payment', case when p = 0 or t = 0 and false then 'PASS' when p = 1 then 'BLOCK' else 'WARN' end, 'stated'),
  ('acceptance', case t when 0 then 'PASS' when 1 then 'BLOCK' else 'WARN' end, 'stated'),
  ('renewal', case when open then 'UNKNOWN' when package_id % 2 = 0 then 'BLOCK' else 'WARN' end, case when open then 'unparsed' else 'missing' end),
  ('breach', case t when 0 then 'PASS' when 1 then 'BLOCK' else 'WARN' end, 'stated')) as v(term, status, reason)"""
)
def contract_term_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment, acceptance, renewal and breach terms by the sentences of the reference's own rules."""
    b = blocks(spark, sf_dir)
    parsed = b.groupBy("package_id").agg(F.bool_and("parsed").alias("all_parsed"))
    packages = parsed.withColumn("policy", F.when(F.col("package_id") % 2 == 0, "BLOCK").otherwise("WARN"))
    term = F.when(F.col("block_order") == 8, "payment").when(F.col("block_order") == 12, "acceptance").when(F.col("block_order") == 16, "breach")
    found = b.where(F.col("document_id").startswith("c")).select("package_id", term.alias("term"), F.col("content").alias("value")).where("term is not null")
    return checks.contract_terms(packages, found, ["payment", "acceptance", "renewal", "breach"], "package_id")


POLICY = f"case {K} % 3 when 0 then 'WARN' when 1 then 'BLOCK' else 'UNKNOWN' end"


@query(
    f"""select package_id, status, reason, reason not in ('no term', 'no date') and status <> 'UNKNOWN' as automatic, reason not in ('no term', 'no date') and (status <> 'UNKNOWN' or reason = 'missing') as sufficient from (
  select *, case when reason in ('missing', 'no term', 'no date') then policy when reason = 'complete' then 'PASS' when reason = 'no place' then 'WARN' else 'UNKNOWN' end as status from (
    select {K} as package_id, {POLICY} as policy, case when {K} % 6 = 0 and {K} % 5 = 0 then case when {K} % 17 = 0 then 'unparsed' else 'missing' end when {K} % 6 = 0 then 'no term' when {K} % 5 = 0 then 'no date'
      when {K} % 7 = 0 then 'other documents' when {K} % 4 = 0 then 'complete' else 'no place' end as reason from orders))"""
)
def delivery_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivery terms of packages: stated whole, in part, in several documents, or not at all under each policy."""
    o = table(spark, sf_dir, "orders").select(K)
    packages = o.selectExpr(f"{K} as package_id", f"{K} % 17 <> 0 as all_parsed", f"{POLICY} as policy")
    terms = o.where(f"{K} % 6 <> 0").selectExpr(f"{K} as package_id", "'term' as kind", "'c' as document", f"case when {K} % 4 = 0 then '交付地点为现场' else '按期交付' end as text")
    dates = o.where(f"{K} % 5 <> 0").selectExpr(f"{K} as package_id", "'date' as kind", f"case when {K} % 7 = 0 then 'a' else 'c' end as document", "'5月1日' as text")
    return checks.delivery_status(packages, terms.union(dates), "package_id")


# ---- search, candidates, findings ---------------------------------------------------------------


def rule_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Chunks of packages with those of the rules, the rules' queries, the queries of each package, and their limits."""
    asked = search.rule_queries(rules(spark))
    packages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"))
    own = rule_table(spark)
    names = ["package_id", "document_id", "document_kind", "chunk_id", "source_kind", "rule_id", "content", "evidence_ids"]
    contract = chunks(spark, sf_dir).withColumn("rule_id", F.lit(None).cast("string")).select(names)
    ruled = packages.join(F.broadcast(own)).withColumns({n: F.lit(None).cast("string") for n in ("document_id", "document_kind")}).select(names)  # a fixed few rules
    queries = packages.join(F.broadcast(asked))  # the same few rules
    filters = queries.select(
        "package_id", "query_id", F.array(F.lit("contract"), F.lit("rule")).alias("source_kinds"), F.array("rule_id").alias("rule_ids"),
        F.when(F.col("rule_id") == "payment", F.array(F.lit("main_contract"))).alias("document_kinds"),
    )
    return contract.unionByName(ruled), asked, queries, filters


def rule_hits(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of packages and rules, queries of rules in packages, and the best k hits of each."""
    every, asked, queries, filters = rule_inputs(spark, sf_dir)
    index = cut(search.index_chunks(every, asked, ["package_id"]))
    hits = cut(search.search(index, asked, filters, ["package_id"], k))
    return every, queries, hits.join(F.broadcast(asked.select("query_id", "rule_id")), "query_id")  # a fixed few rules


def rule_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of the hits, their assessments, and the queries."""
    c, queries, hits = rule_hits(spark, sf_dir)
    cited = hits.join(c.select("package_id", "chunk_id", "evidence_ids"), ["package_id", "chunk_id"])
    good, _ = evidence.build_candidates(cited, c.select("package_id", "chunk_id", "evidence_ids", "content", "source_kind"), ["package_id"])
    good = cut(evidence.candidates_by_rule(good, ["package_id"]))
    return good, evidence.assess_candidates(good, queries.drop("rule_id"), ["package_id"], search.found_terms), queries


TERM_SQL = r"[0-9][0-9,]*(?:\.[0-9]+)?%?|[a-z][a-z0-9]*(?:[._/-][a-z0-9]+)*|[\x{4e00}-\x{9fff}]+"
tokens_sql = lambda x: (
    f"flatten(list_transform(regexp_extract_all(lower({x}), '{TERM_SQL}'), lambda w: case when regexp_matches(w, '^[0-9]') then case when contains(w, ',') then [w, replace(w, ',', '')] else [w] end "
    "when regexp_matches(w, '^[a-z]') then [w] else list_concat(list_transform(range(1, length(w)), lambda i: substr(w, i, 2)), list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) end))"
)
#: What each rule asks, written out: its text, its expressions in all spellings, its anchors with their spellings.
ASKED = {
    "amount": (
        "合同金额；financial.contract_amount_numeric；金额；价款；小写", "合同金额 合同价款 financial.contract_amount_numeric 金额 价款 小写",
        [["合同金额", "合同价款"], ["financial.contract_amount_numeric"], ["金额", "价款"], ["价款", "金额"], ["小写"]], [["合同金额", "合同价款"], ["金额", "价款"], ["价款", "金额"], ["小写"]],
    ),
    "payment": (
        "付款条件；付款须与验收绑定；contract_term:payment；付款；支付；结算；预付款；尾款；验收合格后",
        "付款条件 付款条款 支付条件 支付条款 付款须与验收绑定 支付须与验收绑定 contract_term payment 付款 支付 结算 预付款 预支付 尾款 验收合格后",
        [["付款条件", "付款条款", "支付条件", "支付条款"], ["付款", "支付"], ["contract_term:payment"], ["支付", "付款"], ["结算"], ["预付款", "预支付"], ["尾款"]],
        [["付款", "支付"], ["支付", "付款"], ["结算"], ["预付款", "预支付"], ["尾款"]],
    ),
    "acceptance": (
        "验收标准；contract_term:acceptance；验收；验收方法", "验收标准 验收要求 contract_term acceptance 验收 验收方法 验收方式",
        [["验收标准", "验收要求"], ["contract_term:acceptance"], ["验收"], ["验收方法", "验收方式"]], [["验收"], ["验收标准", "验收要求"], ["验收方法", "验收方式"]],
    ),
    "breach": ("违约责任", "违约责任", [["违约责任"]], []),
}
PURPOSE = {r[0]: "playbook_position" if r[8] else "rule_review" for r in RULES}
_list = lambda v: "[" + ", ".join(_list(x) if isinstance(x, list) else f"'{x}'" for x in v) + "]"
Q = "q as (" + " union all ".join(
    f"select '{r}' as rule_id, 'query-' || substr(sha256(concat_ws(chr(31), '{r}', '{VERSIONS[r]}', '{t}')), 1, 20) as query_id, '{PURPOSE[r]}' as purpose, '{t}' as text, "
    f"list_distinct({tokens_sql(chr(39) + asked + chr(39))}) as terms, {_list(exact)}::varchar[][] as exact, {_list(required)}::varchar[][] as required"
    for r, (t, asked, exact, required) in ASKED.items()
) + ")"
HITS = f"""{G}, {Q}, ch as (
  select package_id, document_kind, chunk_id, 'contract' as source_kind, null as rule_id, content, evidence_id from c
  union all select o_orderkey, null, chunk_id, 'rule', rule_id, content, evidence_id from orders, ({RULE_SQL})),
t as (select *, lower(content) as low, regexp_replace(lower(content), '\\s', '', 'g') as folded, {tokens_sql('content')} as t from ch),
p as (select t.* exclude (rule_id), q.rule_id, q.query_id, q.text, terms, len(t) as length, list_filter(exact, lambda a: len(list_filter(a, lambda s: contains(folded, s))) > 0) as ex,
    list_filter(required, lambda a: len(list_filter(a, lambda s: contains(folded, s))) > 0) as rq, contains(low, q.text) as whole, length(q.text) >= 2 and contains(low, regexp_replace(q.text, '\\s', '', 'g')) as phrase,
    len(list_intersect(t, terms)) > 0 as any_term, len(required) > 0 as gated
  from t join q on t.rule_id is null or t.rule_id = q.rule_id where source_kind = 'rule' or q.rule_id <> 'payment' or document_kind = 'main_contract'),
s as (select package_id, rule_id, count(*) as n, greatest(avg(length), 1) as mean from p group by all),
tf as (select package_id, rule_id, chunk_id, term, count(*) as tf from (select package_id, rule_id, chunk_id, terms, unnest(t) as term from p) where list_contains(terms, term) group by all),
df as (select package_id, rule_id, term, count(*) as df from tf group by all),
bm as (select tf.package_id, tf.rule_id, tf.chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) as bm
  from tf join df using (package_id, rule_id, term) join s using (package_id, rule_id) join p using (package_id, rule_id, chunk_id) group by all),
sc as (select p.*, round(coalesce(bm, 0) + whole::int + len(ex) + 10 * len(rq), 6) as score, source_kind = 'rule' as free, phrase or len(list_filter(ex, lambda a: length(a[1]) >= 3)) > 0 as safe
  from p left join bm using (package_id, rule_id, chunk_id) where (any_term or len(ex) > 0) and (source_kind = 'rule' or not gated or len(rq) > 0)),
g1 as (select *, max(case when not free then score end) over (partition by package_id, rule_id) as best from sc where free or safe or score >= 4),
hits as (select * from (select *, row_number() over (partition by package_id, rule_id order by score desc, chunk_id) as lexical_rank from g1 where free or safe or score >= 0.55 * best) where lexical_rank <= 5),
cand as (select *, 'candidate-' || substr(sha256(concat_ws(chr(31), package_id, query_id, chunk_id)), 1, 20) as candidate_id,
  case when source_kind = 'rule' then 'REJECT' when case when rule_id = 'breach' then len(ex) > 0 else len(rq) > 0 end then 'ACCEPT' else 'INSUFFICIENT' end as outcome from hits)"""


@query(
    f"""with {Q} select o_orderkey as package_id, rule_id, query_id, purpose, text, cast(len(terms) as int) as n_terms, cast(len(exact) as int) as n_exact, cast(len(required) as int) as n_required from orders, q"""
)
def rule_query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query of each rule in each package: what its title, facts, checker and playbook ask for."""
    asked = search.rule_queries(rules(spark))
    packages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"))
    return packages.join(F.broadcast(asked)).select("package_id", "rule_id", "query_id", "purpose", "text", *[F.size(c).alias(f"n_{c}") for c in ("terms", "exact", "required")])  # a fixed few rules


@query(f"with {HITS} select package_id, rule_id, chunk_id, score, cast(lexical_rank as int) as lexical_rank from hits")
def rule_search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a package for each rule: statistics of what its filter leaves, boosts, gates, best five."""
    _, _, hits = rule_hits(spark, sf_dir)
    return hits.select("package_id", "rule_id", "chunk_id", "score", "lexical_rank")


@query(f"with {HITS} select package_id, candidate_id, rule_id, chunk_id, cast(lexical_rank as int) as rank, cast(len(ex) as int) as n_exact, cast(len(rq) as int) as n_required, outcome from cand")
def candidate_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the hits and whether their anchors make them evidence."""
    _, judged, _ = rule_candidates(spark, sf_dir)
    return judged.select("package_id", "candidate_id", "rule_id", "chunk_id", "rank", F.size("matched_exact").alias("n_exact"), F.size("matched_required").alias("n_required"), "outcome")


@query(
    f"""with {HITS} select cand.package_id, rule_id, count(*) as n_accepted, string_agg(distinct cand.evidence_id, ',' order by cand.evidence_id) as evidence_ids,
  string_agg(distinct cl.clause_id, ',' order by cl.clause_id) as clause_ids from cand join g using (chunk_id) join cl on g.document_id = cl.document_id and g.first = cl.first where outcome = 'ACCEPT' group by all"""
)
def accepted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule may cite: evidence and clauses of its accepted candidates."""
    good, judged, _ = rule_candidates(spark, sf_dir)
    taken, _ = evidence.accepted(good, judged, ["package_id"])
    bound, _ = evidence.bind_clauses(chunks(spark, sf_dir), clauses(spark, sf_dir), KEY)
    taken = taken.join(bound.select("package_id", "chunk_id", "clause_ids"), ["package_id", "chunk_id"])
    n = taken.groupBy("package_id", "rule_id").agg(F.count("*").alias("n_accepted"))
    sets = evidence.candidate_sets(taken, ["package_id"]).withColumns({c: F.array_join(c, ",") for c in ("evidence_ids", "clause_ids")})
    return n.join(sets, ["package_id", "rule_id"])


@query(
    f"""with {HITS} select package_id, candidate_id, case when outcome = 'INSUFFICIENT' and package_id % 3 <> 0 then 'ACCEPT' else outcome end as outcome,
  case when outcome = 'INSUFFICIENT' and package_id % 3 <> 0 then 'semantic' else 'deterministic' end as assessed_by
from (select * replace (case when outcome = 'ACCEPT' and lexical_rank > 1 then 'INSUFFICIENT' else outcome end as outcome) from cand)"""
)
def promoted_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model items cite every contract candidate; those not accepted become semantic evidence where the item is decided."""
    _, judged, _ = rule_candidates(spark, sf_dir)
    weaker = judged.withColumn("outcome", F.when((F.col("outcome") == "ACCEPT") & (F.col("rank") > 1), "INSUFFICIENT").otherwise(F.col("outcome")))
    status = F.when(F.col("package_id") % 3 == 0, "UNKNOWN").otherwise("WARN").alias("status")
    items = judged.select("package_id", "rule_id", status, "evidence_ids")
    return evidence.promote(weaker, items, ["package_id"]).select("package_id", "candidate_id", "outcome", "assessed_by")


#: Phrases whose counts make the vector of a text: what stands for embeddings here, known to both engines.
DIMENSIONS = ("合同", "付款", "验收", "金额", "违约", "甲方", "乙方", "元")
VECTOR = "[" + ", ".join(f"cast((length({{0}}) - length(replace({{0}}, '{d}', ''))) // {len(d)} as double)" for d in DIMENSIONS) + "]"
DOT = "list_sum(list_transform(range(1, 9), lambda i: {0}[i] * {1}[i]))"
HYBRID = HITS.replace("lexical_rank <= 5", "lexical_rank <= 15") + f""",
v0 as (select p.package_id, p.rule_id, p.chunk_id, p.source_kind, {VECTOR.format('p.content')} as v, {VECTOR.format('p.text')} as q from p
  where package_id % 7 <> 0 and (source_kind = 'rule' or length(trim(content)) >= 8)),
v1 as (select *, {DOT.format('v', 'q')} as vq, sqrt({DOT.format('v', 'v')}) * sqrt({DOT.format('q', 'q')}) as norm from v0),
v2 as (select package_id, rule_id, chunk_id, source_kind, round(case when norm > 0 then vq / norm else 0 end, 2) as cosine from v1),
v as (select * from (select *, row_number() over (partition by package_id, rule_id order by case when source_kind = 'rule' then 0 else 1 end, cosine desc, chunk_id) as vector_rank
  from v2 where source_kind = 'rule' or cosine >= 0.1) where vector_rank <= 15),
fu as (select package_id, rule_id, chunk_id, lexical_rank, vector_rank, round(coalesce(1.0::double / (60 + lexical_rank), 0) + coalesce(1.0::double / (60 + vector_rank), 0), 12) as fused
  from (select * from hits where package_id % 7 <> 0) h full outer join v using (package_id, rule_id, chunk_id)),
slots as (select fu.*, 'hybrid' as mode, row_number() over (partition by package_id, rule_id order by case when p.source_kind = 'rule' then 0 else 1 end, fused desc, chunk_id) as slot
  from fu join p using (package_id, rule_id, chunk_id) where p.source_kind = 'rule' or not gated or len(rq) > 0)"""


@query(
    f"""with {HYBRID} select package_id, rule_id, chunk_id, cast(lexical_rank as int) as lexical_rank, cast(vector_rank as int) as vector_rank, mode, fused as score, cast(slot as int) as slot from slots where slot <= 5
union all select package_id, rule_id, chunk_id, cast(lexical_rank as int), null, 'lexical', score, cast(lexical_rank as int) from hits where package_id % 7 = 0 and lexical_rank <= 5"""
)
def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector hits of each rule fused by rank, gated again, in slots; packages without vectors keep their lexical hits."""
    counts = lambda c: F.array(*[((F.length(c) - F.length(F.replace(F.col(c), F.lit(d), F.lit("")))) / len(d)).cast("double") for d in DIMENSIONS])
    every, asked, queries, filters = rule_inputs(spark, sf_dir)
    index = cut(search.index_chunks(every, asked, ["package_id"]))
    vectors = every.where("package_id % 7 <> 0").select("package_id", "chunk_id", counts("content").alias("embedding"))
    hits = search.hybrid_search(index, vectors, asked.withColumn("embedding", counts("text")), filters, ["package_id"], 5)
    named = hits.join(F.broadcast(asked.select("query_id", "rule_id")), "query_id")  # the bundle's rules, a fixed few
    return named.select("package_id", "rule_id", "chunk_id", "lexical_rank", "vector_rank", "mode", "score", "slot")


LABELS = ["合同编号", "甲方", "乙方"]


@query(
    f"""with {C} select package_id, count(*) as n_hits, bool_and(contains(content, '甲方') or contains(content, '乙方') or contains(content, '合同') or contains(content, '编号')) as labelled
from c where regexp_matches(content, '甲方|乙方|合同|同编|编号') group by package_id"""
)
def element_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks where the labels of elements stand; neither gate applies to this query, only its 40 places."""
    c = chunks(spark, sf_dir)
    asked = search.location_query(c, "package_id", LABELS)
    filters = asked.select("package_id", "query_id", F.array(F.lit("contract")).alias("source_kinds"))
    index = cut(search.index_chunks(c.withColumn("rule_id", F.lit(None).cast("string")), asked, ["package_id"]))
    found = search.search(index, asked, filters, ["package_id"], 40)
    says = found.join(c.select("package_id", "chunk_id", "content"), ["package_id", "chunk_id"])
    return says.groupBy("package_id").agg(F.count("*").alias("n_hits"), F.bool_and(F.col("content").rlike("甲方|乙方|合同|编号")).alias("labelled"))


# ---- applicability and findings -----------------------------------------------------------------


@query(
    f"""with {HITS}, a as (select {K} as package_id, {HAS_ANNEX} as annex, {K} % 17 = 0 and {HAS_ANNEX} as open, {K} % 11 = 0 and {HAS_ANNEX} as strange from orders),
r as (select a.*, rule_id, case rule_id when 'breach' then case when package_id % 10 = 0 then 'not_applicable' else 'required' end
    when 'acceptance' then case when strange then 'unknown' else 'required' end else 'required' end as applies from a, (values ('amount'), ('payment'), ('acceptance'), ('breach')) as v(rule_id)),
n as (select package_id, rule_id, count(*) as n from cand where outcome = 'ACCEPT' group by all),
f as (select r.*, coalesce(n, 0) as n, case when rule_id = 'amount' then case when annex and package_id % 5 = 0 then 'UNKNOWN' when {TOTAL} = (package_id % 9 + 1) * 1000000 then 'PASS' else 'WARN' end end as checker,
    case when rule_id = 'breach' then case when open then 'UNKNOWN' when coalesce(n, 0) > 0 then 'WARN' else 'UNKNOWN' end end as keyword,
    case when rule_id = 'payment' then case package_id % 4 when 0 then 'PASS' else 'UNKNOWN' end end as playbook
  from r left join n using (package_id, rule_id) join orders on package_id = {K})
select package_id, rule_id, case when applies = 'not_applicable' then 'NOT_APPLICABLE' when applies = 'unknown' then 'UNKNOWN' else coalesce(playbook, checker, keyword, 'UNKNOWN') end as status,
  case when applies = 'not_applicable' then 'not_applicable' when applies = 'unknown' then 'applicability' when playbook is not null then 'playbook' when checker is not null then 'checker' when keyword is not null then 'keyword' else 'default' end as branch,
  (case when applies = 'not_applicable' then 1 else 2 + n end)::int as n_cited from f"""
)
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From chunks to findings: applicability, playbook, checker and keyword branches in order, each with what it cites."""
    from docketry.operators import applicability

    b = blocks(spark, sf_dir)
    kinds = b.groupBy("package_id").agg(F.bool_and("parsed").alias("all_parsed"), F.array_sort(F.collect_set("document_kind")).alias("kinds"))
    context = F.struct(
        F.lit("buyer").alias("party"), F.lit("CN").alias("place"), F.array(F.lit("software")).alias("tags"), (F.col("package_id") % 10).cast("double").alias("amount"), "kinds"
    )
    contexts = kinds.select("package_id", F.lit("software").alias("contract_type"), F.array().cast("array<string>").alias("review_scope"), context.alias("context"))
    none, some = F.array().cast("array<string>"), lambda *v: F.array(*map(F.lit, v))
    cond = lambda low=None, high=None, kinds_any=None: F.struct(
        none.alias("parties"), none.alias("places"), none.alias("tags"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high"), none.alias("kinds"),
        (some(*kinds_any) if kinds_any else none).alias("kinds_any"),
    )
    no = F.array().cast("array<struct<condition:struct<parties:array<string>,places:array<string>,tags:array<string>,low:double,high:double,kinds:array<string>,kinds_any:array<string>>,result:string>>")
    full = "软件开发/转让服务"
    one = lambda rule, base, exceptions: F.struct(F.lit(rule).alias("rule_id"), F.lit(full).alias("contract_type"), F.lit("required").alias("applicability"), F.lit("x").alias("expected_value"), base.alias("condition"), exceptions.alias("exceptions"))
    strange = F.array(F.struct(F.struct(none.alias("parties"), none.alias("places"), none.alias("tags"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), some("main_contract", "annex").alias("kinds"), none.alias("kinds_any")).alias("condition"), F.lit("recommended").alias("result")))
    specs = spark.range(1).select(F.explode(F.array(one("acceptance", cond(kinds_any=["main_contract"]), strange), one("breach", cond(low=1.0), no))).alias("s")).select("s.*")
    asked = rules(spark).withColumn("applies_to", some(full))
    applies = applicability.rules_of_contexts(asked, specs, contexts, "package_id").select("package_id", "rule_id", "applies")

    good, judged, _ = rule_candidates(spark, sf_dir)
    taken = cut(evidence.accepted(good, judged, ["package_id"])[0])
    cited = taken.groupBy("package_id", "rule_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"))
    figures = block_facts(spark, sf_dir).join(taken.select("package_id", "candidate_id", "chunk_id").distinct(), "chunk_id")
    own = execution.facts_of_rules(figures.select("package_id", "candidate_id", "kind", F.col("value").cast("decimal(26,6)").alias("value"), F.lit(1.0).alias("confidence")), taken, "package_id")

    def amount_case(found: DataFrame, packages: DataFrame, key: str) -> DataFrame:
        money = checks.money_checks(found.select(key, "kind", "value").distinct(), key, 0.13).where("checker = 'amount_case'")
        return money.join(found.groupBy(key).agg(F.min("confidence").alias("confidence")), key).select(key, "status", "confidence")

    checked = execution.run_checkers(own, kinds, asked, {"amount_case": amount_case}, "package_id").withColumnRenamed("status", "checker")
    words = spark.range(1).select(F.lit("breach").alias("rule_id"), F.lit("违约").alias("keyword"))
    keyword = execution.keyword_status(taken, kinds, words, "package_id").withColumnRenamed("status", "keyword")
    bound = taken.where("rule_id = 'payment'").groupBy("package_id").agg(F.bool_or(F.contains("content", F.lit("验收合格后"))).alias("met"))
    playbook = kinds.select("package_id").join(bound, "package_id", "left").select("package_id", F.lit("payment").alias("rule_id"), F.when(F.col("met"), "PASS").otherwise("UNKNOWN").alias("playbook"))
    rows = applies.join(checked, ["package_id", "rule_id"], "left").join(keyword, ["package_id", "rule_id"], "left").join(playbook, ["package_id", "rule_id"], "left").join(cited, ["package_id", "rule_id"], "left")
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in ("classification", "visual")} | {"rule_evidence": F.concat(F.lit("rule-"), "rule_id"), "package_evidence": F.concat(F.lit("package-"), "package_id")})
    out = execution.findings(rows, "package_id")
    return out.select("package_id", "rule_id", "status", "branch", F.size("evidence_ids").alias("n_cited"))


@query(
    f"""with {G}, {FACTS} select f.package_id, g.chunk_id || '/' || f.kind as fact_id, cl.clause_id from f join g on g.package_id = f.package_id and g.d = f.d and g.block_order = f.block_order
  join cl on cl.document_id = g.document_id and cl.first = g.first"""
)
def fact_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clause of each figure: by its evidence, for taxes by their block, for shares by the excerpt."""
    c = chunks(spark, sf_dir).select(*KEY, "chunk_id", "block_order", "content", F.element_at("evidence_ids", 1).alias("evidence_id"))
    found = block_facts(spark, sf_dir).join(c, "chunk_id")
    n = F.col("block_order")
    rows = found.select(
        *KEY, F.concat_ws("/", "chunk_id", "kind").alias("fact_id"), F.when(n.isin(6, 8), "ev-none").otherwise(F.col("evidence_id")).alias("evidence_id"),
        F.when(n == 6, F.col("chunk_id")).alias("block_id"), F.when(n == 8, F.col("content")).alias("excerpt"),
    ).distinct()
    rows, own = cut(rows), cut(clauses(spark, sf_dir))
    cited = own.select("clause_id", F.explode("chunk_ids").alias("chunk_id")).join(c.select("chunk_id", "evidence_id"), "chunk_id").groupBy("clause_id").agg(F.collect_set("evidence_id").alias("evidence_ids"))
    out = evidence.fact_clauses(rows, own.join(cited, "clause_id"), ["package_id"])
    return out.select("package_id", "fact_id", F.explode("clause_ids").alias("clause_id"))


@query(
    f"""select package_id, rule_id, case when takes then model else base end as status, case when takes then 'model' when model is not null and not passed then 'degraded' when not any_item then 'rule' when passed then 'rule' else 'degraded' end as origin from (
  select *, any_item and passed and model is not null and not missing as takes from (
    select {K} as package_id, rule_id, case when o_totalprice > 150000 then 'WARN' else 'UNKNOWN' end as base, case when {K} % 3 = 0 and rule_id <> 'breach' then 'PASS' end as model, {K} % 3 = 0 as any_item, {K} % 2 = 0 as passed,
      rule_id = 'payment' and {K} % 4 = 0 as missing from orders, (values ('amount'), ('payment'), ('breach')) as v(rule_id)))"""
)
def model_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three rules of each package under those of a model, whose response failed its gate for odd packages."""
    names = F.explode(F.array(*map(F.lit, ("amount", "payment", "breach")))).alias("rule_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("package_id"), "o_totalprice", names)
    k = F.col("package_id")
    base = rows.select("package_id", "rule_id", F.when(F.col("o_totalprice") > 150_000, "WARN").otherwise("UNKNOWN").alias("status"), ((F.col("rule_id") == "payment") & (k % 4 == 0)).alias("missing_attachment"))
    model = rows.where((k % 3 == 0) & (F.col("rule_id") != "breach")).select("package_id", "rule_id", F.lit("PASS").alias("status"), (k % 2 == 0).alias("passed"))
    return execution.overridden(base, model, "package_id")
