"""Facts, checks, gates, audit, packages and task reports on small tables."""

import hashlib
from decimal import Decimal

from pyspark.sql import functions as F

from docketry.operators import audit, checks, facts, gates, retrieval, structure
from docketry.sources import packages

MONEY = "合同金额：小写1000000元，大写：壹佰万元整。\n不含税金额：1000000元；税率：13%；税额：130000元。\n付款金额：1000000元。"


def test_money_checks(spark):
    docs = spark.createDataFrame([(1, MONEY), (2, None), (3, "合同金额：100元。付款金额：90元；预付款30%，尾款80%")], "k int, text string")
    found = facts.financial_facts(docs, "k")
    status = {(r.k, r.checker): r.status for r in checks.money_checks(found, "k", 0.13).collect()}
    assert [status[1, c] for c in ("amount_case", "tax_rate", "tax_amount", "payment_total")] == ["PASS"] * 4
    assert status[1, "invoice_total"] == "UNKNOWN" and status[3, "payment_total"] == "WARN" and status[3, "payment_ratio"] == "WARN"
    assert not [k for k in status if k[0] == 2]


def test_stated_amounts(spark):
    """Labels, literals, marks and percentages as they stand in sentences; (kind, value, place) of each fact."""
    cases = [
        ("合同金额：1000000", [("amount", "1000000", 5)]),
        ("合同总额：5000元", [("amount", "5000", 5)]),
        ("价税合计：300元", [("invoice", "300", 5)]),
        ("含税金额 700元", [("amount", "700", 5)]),
        ("合同金额：壹佰万元整", [("upper", "1000000", 5)]),
        ("违约金为合同价的5%，甲方付款后生效", []),
        ("开具13%专用发票", [("rate", "0.13", 2)]),
        ("含税单价，13%", [("rate", "0.13", 5)]),
        ("合同总价：1，000元", [("amount", "1000", 5)]),
        ("合同价款（数字：12.5万元，大写 壹拾贰万伍仟圆整）", [("amount", "125000", 8), ("upper", "125000", 18)]),
        ("付款比例为30%；尾款 70 %。", [("ratio", "0.3", 5), ("ratio", "0.7", 12)]),
        ("合同金额的5%", []),
        ("税额A12元 13元", [("tax", "13", 7)]),
        ("小计：300。金额 5", []),
        (None, []),
        ("合同金额\n5元", []),
        ("合同金额" + "款" * 101 + "5元", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "k int, text string")
    got = {}
    for r in facts.financial_facts(docs, "k").collect():
        got.setdefault(r.k, []).append((r.kind, r.value, r.begins))
    for i, (said, want) in enumerate(cases):
        assert sorted(got.get(i, []), key=lambda f: f[2]) == [(k, Decimal(v), at) for k, v, at in want], said
    cells = facts.financial_facts(docs, "k", table=F.lit(True)).where("kind like 'detail%'").collect()
    assert sorted((r.kind, r.value) for r in cells) == [("detail", Decimal(5)), ("detail_total", Decimal(300))]


def test_excerpt_holds_its_keyword(spark):
    docs = spark.createDataFrame([(1, "x" * 5000 + " Token " + "y" * 300), (2, "token"), (3, "z" * 1500 + "token" + "z" * 5000)], "k int, text string")
    got = {r.k: r.excerpt_sha256 for r in facts.first_keywords(docs, "k", {"credential": ("token",)}).collect()}
    says = {r.k: r.text for r in docs.collect()}
    want = {1: says[1][-2000:], 2: "token", 3: says[3][500:2500]}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in want.items()}


def test_two_values_are_unknown(spark):
    rows = spark.createDataFrame([(1, "amount", 5.0), (1, "amount", 5.0), (1, "upper", 5.0), (2, "amount", 5.0), (2, "amount", 6.0), (2, "upper", 5.0)], "k int, kind string, v double")
    out = checks.money_checks(rows.select("k", "kind", F.col("v").cast("decimal(26,6)").alias("value")), "k", 0.13)
    assert {r.k: r.status for r in out.where("checker = 'amount_case'").collect()} == {1: "PASS", 2: "UNKNOWN"}


def test_terms(spark):
    cases = [
        ("payment", "付款条款：合同签订后100%预付，乙方按项目计划完成实施。", "BLOCK"),
        ("payment", "验收合格后支付。", "PASS"),
        ("payment", "验收合格后十日内支付。", "WARN"),
        ("payment", "按月结算。", "WARN"),
        ("payment", "验收的标准另定。按月支付。", "WARN"),
        ("renewal", "本合同到期不自动续期。", "PASS"),
        ("renewal", "到期终止。", "PASS"),
        ("renewal", "到期自动续期。", "WARN"),
        ("acceptance", "逾期未提出异议视为验收合格。", "BLOCK"),
        ("acceptance", "逾期视为验收。", "WARN"),
        ("acceptance", "按测试报告验收。", "PASS"),
        ("termination", "逾期的，提前通知后解除。", "PASS"),
        ("breach", "违约方应支付违约金。", "WARN"),
        ("breach", "违约方赔偿损失，上限为合同金额。", "PASS"),
        ("breach", "乙方免责。", "BLOCK"),
    ]
    rows = spark.createDataFrame([(i, k, t) for i, (k, t, _) in enumerate(cases)], "i int, k string, t string")
    got = {r.i: r.s for r in rows.select("i", checks.term_text_status(F.col("k"), F.col("t")).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]
    packages = spark.createDataFrame([(1, True, "BLOCK"), (2, False, "BLOCK")], "p int, all_parsed boolean, policy string")
    facts_of = spark.createDataFrame([(1, "payment", "按月结算"), (1, "payment", "验收合格后支付")], "p int, term string, value string")
    out = checks.contract_terms(packages, facts_of, ["payment", "breach"], "p")
    assert {(r.p, r.term): (r.status, r.reason) for r in out.collect()} == {
        (1, "payment"): ("PASS", "stated"), (1, "breach"): ("BLOCK", "missing"), (2, "payment"): ("UNKNOWN", "unparsed"), (2, "breach"): ("UNKNOWN", "unparsed"),
    }


def test_tax_amount(spark):
    """The contract amount is the base only where the text says that it is untaxed; several taxes add up."""
    rows = [(1, "amount", 100), (1, "tax", 6), (1, "tax", 7), (1, "untaxed", 1), (2, "amount", 100), (2, "tax", 13), (3, "base", 100), (3, "amount", 113), (3, "tax", 13)]
    rows += [(k, "rate", 0.13) for k in (1, 2, 3)]
    found = spark.createDataFrame([(k, kind, float(v)) for k, kind, v in rows], "k int, kind string, value double").withColumn("value", F.col("value").cast("decimal(26,6)"))
    out = checks.money_checks(found, "k", 0.13).where("checker = 'tax_amount'")
    assert {r.k: r.status for r in out.collect()} == {1: "PASS", 2: "UNKNOWN", 3: "PASS"}


def test_form(spark):
    rules = spark.createDataFrame([(1, "party", "A"), (1, "party", "A")], "k int, field string, value string")
    items = spark.createDataFrame([(1, "party", "B", 0.9), (1, "date", "x", 0.4), (1, "date", "y", 1.0)], "k int, field string, value string, confidence double")
    form = facts.element_form(facts.merge_completions(rules, items, "k"), {"party": True, "date": False, "place": True}, rules, "k")
    assert {r.field: (r.source, r["values"], r.missing) for r in form.collect()} == {"party": ("rule", ["A"], False), "date": ("ai", ["y"], False), "place": ("empty", [], True)}


def test_rerank_features(spark):
    a = spark.sql("select array('abcd', 'xy') as a, array() as none, 'zz abcd .. q' as t")
    row = a.select(retrieval.share_found(F.col("a"), F.col("t")), retrieval.share_found(F.col("none").cast("array<string>"), F.col("t"))).first()
    assert row[0] == 4 / 6 and row[1] is None
    near = spark.range(1).select(retrieval.nearness(F.array(F.lit("a"), F.lit("c")), F.lit("a  c")), retrieval.nearness(F.array(F.lit("a")), F.lit("a"))).first()
    assert near[0] == 1 - 3 / 80 and near[1] is None
    assert [retrieval.pool_size(k) for k in (1, 10, 20, 50, 51)] == [3, 30, 50, 50, 51]


def test_within(spark):
    chunks = spark.createDataFrame([(1, "contract", ["c1"], ["e1"]), (2, "rule", ["c2"], ["e1", "e2"])], "i int, kind string, clauses array<string>, ev array<string>")
    ids = lambda df: [r.i for r in df.orderBy("i").collect()]
    assert ids(retrieval.within(chunks, {"kind": []})) == [1, 2] and ids(retrieval.within(chunks, {"kind": ["rule"]})) == [2]
    assert ids(retrieval.within(chunks, {}, overlap={"clauses": ["c1", "c9"]})) == [1] and ids(retrieval.within(chunks, {}, subset={"ev": ["e1"]})) == [1]


def test_values_of_whole_documents(spark):
    docs = spark.createDataFrame([(1, "\n".join(f"a{i} {i}0000" for i in range(1, 8)) + " 10000")], "d int, text string")
    of = lambda most: [r.value for r in facts.field_values(docs, "d", {"n": "[0-9]{5,}"}, most).orderBy("nth").collect()]
    assert of(None) == [f"{i}0000" for i in range(1, 8)] and of(5) == of(None)[:5]


def test_merged_candidates(spark):
    rows = spark.createDataFrame([("c2", 1, 7, "s"), ("c1", 2, 8, "s"), ("c3", 1, 9, "t")], "candidate_id string, rank int, doc_id int, source string")
    got = {r.source: (r.candidate_ids, r.rank, r.doc_id) for r in retrieval.merged_candidates(rows, ["source"]).collect()}
    assert got == {"s": (["c2", "c1"], 1, 7), "t": (["c3"], 1, 9)}


def test_definitions_and_questions(spark):
    rows = spark.createDataFrame([("d", "c1", "“工作日”指法定工作日，“工作日”是指同上"), ("d", "c2", '某公司（以下简称“甲方 ”）及本合同所称「源代码」')], "document string, clause string, text string")
    assert sorted((r.src, r.term) for r in structure.definitions(rows).collect()) == [("c1", "工作日"), ("c2", "源代码"), ("c2", "甲方")]
    f = spark.createDataFrame([("r1", "PASS", "e1"), ("r2", "UNKNOWN", "m1"), ("r3", "UNKNOWN", "e1"), ("r4", "WARN", "e1")], "rule_id string, status string, evidence_id string")
    out = structure.question_outcomes(f, spark.createDataFrame([("m1",)], "evidence_id string"))
    assert {r.rule_id: r.outcome for r in out.collect()} == {"r1": "SUPPORTED", "r2": "NOT_MENTIONED", "r3": "UNKNOWN", "r4": "CONTRADICTED"}


def test_provenance(spark):
    docs = spark.createDataFrame([(1, "hello world")], "d int, text string")
    sha, ex = F.sha2(F.lit("hello world"), 256), F.sha2(F.lit("world"), 256)
    rows = [("ok", 1, 6, "world"), ("off", 1, 5, "world"), ("out", 1, 9, "world"), ("gone", 2, 6, "world")]
    ev = spark.createDataFrame(rows, "evidence_id string, d int, begins int, excerpt string").withColumn("source_sha256", sha).withColumn("excerpt_sha256", ex)
    assert {r.evidence_id: r.issue for r in audit.provenance(ev, docs, "d").collect()} == {"off": "not there", "out": "outside", "gone": "no document"}


def test_replay(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (2, "y"), (3, ""), (4, "n")], "k int, v string")
    assert {r.k: r.state for r in audit.replay_differences(a, b, ["k"], ["v"]).collect()} == {3: "changed", 4: "new"}
    assert {r.k: r.state for r in audit.replay_differences(b, a, ["k"], ["v"]).collect()} == {3: "changed", 4: "missing"}


def test_fresh_candidates(spark):
    items = spark.createDataFrame([(2, "a"), (1, " a "), (3, "b"), (4, " ")], "i int, title string")
    pool = spark.createDataFrame([("b",)], "title string")
    assert [(r.i, r.title) for r in gates.fresh_candidates(items, "title", ["i"], pool).collect()] == [(1, " a ")]


def test_kinds(spark):
    docs = spark.createDataFrame([("p", "main.docx"), ("p", "x-annex.docx"), ("p", "other.docx")], "p string, filename string")
    kinds = spark.createDataFrame([("p", "main.docx", "MAIN"), ("p", "annex.docx", "ANNEX"), ("p", "in.docx", "X")], "p string, name string, kind string")
    assert {r.filename: r.kind for r in packages.kinds_by_name(docs, kinds, "p").collect()} == {"main.docx": "MAIN", "x-annex.docx": "ANNEX", "other.docx": None}


def test_delivery(spark):
    rows = [
        (1, "term", "d", "交付地点为现场"), (1, "date", "d", "5月1日"), (2, "term", "d", "交付"), (2, "date", "d", "5月1日"), (3, "term", "d", "交付"),
        (4, "date", "d", "5月1日"), (5, "term", "d", "地点"), (5, "date", "e", None), (6, "price", "d", "地点"),
    ]
    asked = [(k, k != 8, p) for k, p in enumerate(["BLOCK"] * 10) if k]
    packages_of = spark.createDataFrame([*asked, (10, True, None), (11, True, "NOT_APPLICABLE")], "k int, all_parsed boolean, policy string")
    out = checks.delivery_status(packages_of, spark.createDataFrame(rows, "k int, kind string, document string, text string"), "k")
    got = {r.k: (r.status, r.reason) for r in out.collect()}
    assert got == {
        1: ("PASS", "complete"), 2: ("WARN", "no place"), 3: ("BLOCK", "no date"), 4: ("BLOCK", "no term"), 5: ("UNKNOWN", "other documents"), 6: ("BLOCK", "missing"), 7: ("BLOCK", "missing"),
        8: ("UNKNOWN", "unparsed"), 9: ("BLOCK", "missing"), 10: ("UNKNOWN", "missing"), 11: ("NOT_APPLICABLE", "missing"),
    }
    sure = {r.k: (r.automatic, r.sufficient) for r in out.collect()}
    assert sure[1] == (True, True) and sure[3] == (False, False) and sure[8] == (False, False) and sure[9] == (True, True) and sure[10] == (False, True)