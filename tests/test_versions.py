"""Phrases, attachments and what a new version changes, on small tables."""

import pytest
from pyspark.sql import functions as F

from docketry.operators import phrases, versions


def test_containing_equals_brute_force(spark):
    texts = [(1, "abcabc xyz"), (2, "ab"), (3, None), (4, ""), (5, "付款条件与验收"), (1, "abcabc xyz"), (6, "xyzxyz")]
    sought = ["abc", "a", "xyz", "bcab", "cabc x", "验收", "付款条件", "nope", "", None, "b"]
    t = spark.createDataFrame(texts, "k int, text string")
    p = spark.createDataFrame([(s,) for s in sought], "phrase string")
    want = sorted({(k, s) for k, x in texts for s in sought if x and s and s in x})
    for size in (1, 2, 4):
        assert sorted((r.k, r.phrase) for r in phrases.containing(t, ["k"], "text", p, "phrase", size=size).collect()) == want


def test_containing_within_groups(spark):
    t = spark.createDataFrame([("g", 1, "hello"), ("h", 2, "hello")], "g string, k int, text string")
    p = spark.createDataFrame([("g", "ell"), ("h", "lol")], "g string, phrase string")
    assert [(r.g, r.k, r.phrase) for r in phrases.containing(t, ["k"], "text", p, "phrase", ["g"]).collect()] == [("g", 1, "ell")]
    assert phrases.containing(t.limit(0), ["k"], "text", p, "phrase", ["g"]).count() == 0


def test_spellings(spark):
    one = lambda s: spark.createDataFrame([(s,)], "t string").select(phrases.spellings(F.col("t"))).first()[0]
    assert one("合同 金额")[0] == "合同金额" and set(one("合同 金额")) == {"合同金额", "合同价款"}
    assert one("源码")[0] == "源码" and set(one("源码")) == {"源码", "源代码", "源程序"}
    assert one("ＡＢ c") == ["abc"] and one(" ") == []


def test_alias_matches(spark):
    t = spark.createDataFrame([(1, "支付 条款如下"), (2, "续签"), (3, None)], "k int, text string")
    terms = spark.createDataFrame([("付款条件",), ("续期",), ("源码",)], "term string")
    assert sorted((r.k, r.term) for r in phrases.alias_matches(t, ["k"], "text", terms, "term").collect()) == [(1, "付款条件"), (2, "续期")]


def test_attachments(spark):
    t = spark.createDataFrame([("p", "d", "e1", "详见《技术协议》，随附报价单文件；参见本合同第3条"), ("p", "d", "e2", "附件：验收清单。"), ("p", "d", "e3", None)], "p string, d string, e string, text string")
    refs = phrases.attachment_references(t, ["p", "d"], "e")
    assert sorted((r.evidence_id, r.name) for r in refs.collect()) == [("e1", "技术协议"), ("e1", "报价单"), ("e2", "验收清单")]
    files = spark.createDataFrame([("p", "01_技术协议 (终稿).docx"), ("q", "报价单.xlsx"), ("p", "验收 清单.pdf")], "p string, filename string")
    assert [r.name for r in phrases.missing_attachments(refs, files, "p").collect()] == ["报价单"]
    assert [(r.n_references, r.n_missing, r.status) for r in phrases.attachment_status(refs, files, "p").collect()] == [(3, 1, "UNKNOWN")]
    assert phrases.attachment_status(refs.where("name <> '报价单'"), files, "p").first().status is None


@pytest.mark.parametrize(
    ("text", "cap"),
    [
        ("赔偿责任上限为合同金额的30%。", ("ratio", 0.3)),
        ("责任上限：百分之五十", ("ratio", 0.5)),
        ("累计赔偿责任不超过100万元", ("amount", 1000000.0)),
        ("违约责任最高一百万元；另行约定", ("amount", 1000000.0)),
        ("合同金额为200元，赔偿责任不超过50元", ("amount", 50.0)),
        ("赔偿责任为30%或者50%", None),
        ("赔偿责任不超过30%。责任上限不超过40%", None),
        ("价格不超过30%", None),
        (None, None),
        ("", None),
    ],
)
def test_cap(spark, text, cap):
    got = spark.createDataFrame([(text,)], "t string").select(versions.liability_cap(F.col("t")).alias("c")).first().c
    assert (got and (got.kind, float(got.value))) == cap


def changes(spark):
    rows = [
        ("x", "k1", "s1", "s2", "验收后付款", "100% 预付"),
        ("x", "k2", "s1", "s2", "赔偿责任不超过30%", "赔偿责任不超过50%"),
        ("x", "k3", "s1", "s2", "weather", None),
        ("y", "k4", "s1", "s1", "交付并验收合格后支付", "交付后支付"),
    ]
    return spark.createDataFrame(rows, "comparison_id string, change_id string, base_sha256 string, compare_sha256 string, before string, after string")


def test_impacts(spark):
    clauses = spark.createDataFrame([("c1", "s1", "第1条  验收后付款。"), ("c2", "s2", "付款：100% 预付"), ("c3", "s9", "验收后付款")], "clause_id string, source_sha256 string, text string")
    bound = versions.changed_clauses(changes(spark), clauses)
    assert sorted((r.change_id, r.clause_id) for r in bound.collect()) == [("k1", "c1"), ("k1", "c2")]
    rules = spark.createDataFrame([("r1", "payment_terms", "付款", "pay", "x1"), ("r2", "breach_liability_terms", "责任", "", "x2"), ("r3", "acceptance_terms", "验收条款", "q", "x3")], "rule_id string, checker string, title string, category string, condition string")
    findings = spark.createDataFrame([("r1", "c1"), ("r1", "c9")], "rule_id string, clause_id string")
    links = versions.affected_rules(changes(spark), bound, findings, versions.rule_markers(rules))
    got = sorted((r.change_id, r.rule_id or "", r.link) for r in links.collect())
    assert got == [("k1", "r1", "clause"), ("k2", "r2", "marker"), ("k3", "", "unmapped"), ("k4", "r1", "marker"), ("k4", "r3", "marker")]
    out = {(r.comparison_id, r.rule_id): (r.n_changes, r.payment, r.liability, r.cap, r.delivery) for r in versions.impacts(changes(spark), links, rules).collect()}
    assert out["x", "r1"] == (1, "increased", "unknown", "unknown", "unknown")
    assert out["x", "r2"] == (1, "unknown", "increased", "increased", "unknown")
    assert out["x", None] == (1, "requires_review", "requires_review", "requires_review", "requires_review")
    assert out["y", "r3"][4] == "increased" and out["y", "r1"][1] == "requires_review"
    touched = versions.impacts(changes(spark), links, rules)
    active = spark.createDataFrame([(c, r) for c in "xy" for r in ("r1", "r2", "r3")], "comparison_id string, rule_id string")
    assert sorted((r.comparison_id, r.rule_id) for r in versions.retriggered(touched, active).collect()) == [("x", "r1"), ("x", "r2"), ("x", "r3"), ("y", "r1"), ("y", "r3")]
    duties = spark.createDataFrame([("c1", "乙方", "required", "付款"), ("c2", None, "prohibited", "拖延")], "clause_id string, subject string, modality string, action string")
    assert sorted((r.rule_id, r.summary) for r in versions.affected_obligations(links, bound, duties).collect()) == [("r1", "乙方必须付款"), ("r1", "合同当事人不得拖延")]


def test_precedence_and_attach(spark):
    rows = [("a", "b", ["a", "b"], False), ("b", "a", ["a", "b"], False), ("a", "c", ["a", "b"], False), ("a", "a", ["a"], True), ("a", "b", None, False)]
    t = spark.createDataFrame(rows, "x string, y string, o array<string>, same boolean")
    got = [r[0] for r in t.select(versions.precedence(F.col("x"), F.col("y"), F.col("o"), F.col("same"))).collect()]
    assert got == ["base", "compare", "unresolved", "not_required", "unresolved"]
    comps = [("p", "c1", "s1", "a.docx", 1, 1), ("p", "c2", "s9", "a.docx", 1, 1), ("p", "c3", "s1", "z.docx", 1, 1), ("p", "c4", "s1", "a.docx", 2, 1), ("p", "c5", "s1", "a.docx", 0, 0), ("p", "c5", "s1", "a.docx", 0, 0)]
    c = spark.createDataFrame(comps, "p string, comparison_id string, base_sha256 string, base_name string, n_changes int, n_evidence int")
    docs = spark.createDataFrame([("p", "s1", "a.docx")], "p string, source_sha256 string, filename string")
    assert {r.comparison_id: r.issue for r in versions.comparison_issues(c, docs, "p").collect()} == {"c2": "base not in package", "c3": "other name", "c4": "change without evidence", "c5": "repeated id"}
    sets = spark.createDataFrame([("r", "s1", "f"), ("r", "s2", "g"), ("q", "s3", "f")], "run string, set_id string, base_fingerprint string")
    results = spark.createDataFrame([("r", "f")], "run string, fingerprint string")
    assert {r.set_id: r.issue for r in versions.revision_issues(sets, results, "run").collect()} == {"s2": "other base", "s3": "no such run"}
