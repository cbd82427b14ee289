"""Text functions and operators on small tables."""

from decimal import Decimal

from pyspark.sql import functions as F

from docketry.functions.text import compact, han_tokens, matches, money, tokens
from docketry.operators import corpus, review


def test_money(spark):
    cases = [
        ("人民币1000000元", "1000000.00"),
        ("1.2万元", "12000.00"),
        ("人民币壹佰万元整", "1000000.00"),
        ("壹佰贰拾叁万肆仟伍佰陆拾柒元捌角", "1234567.80"),
        ("一百二十元", "120.00"),
        ("十五元", "15.00"),
        ("三亿零五万元", "300050000.00"),
        ("合同编号2026", None),
        ("1，000元", "1000.00"),
        ("1,000", "1000.00"),
        ("3万", "30000.00"),
        ("貳佰元", "200.00"),
        ("壹佰万", "1000000.00"),
        ("壹兆元", "1000000000000.00"),
        ("壹佰元柒角陆分", "100.76"),
        ("1.005元", "1.01"),
        ("一千二百万亿", "112000000.00"),
        ("壹佰萬元", None),
        ("x元", None),
        ("元", None),
        ("整", None),
        ("", None),
        (None, None),
    ]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").orderBy("i").select(money(F.col("t"))).collect()
    assert [r[0] for r in got] == [None if v is None else Decimal(v) for _, v in cases]


def test_tokens_and_offsets(spark):
    row = spark.sql("select 'Pay 30 days, 付款条件' as t")
    t, h, m, c = row.select(tokens(F.col("t")), han_tokens(F.col("t")), matches(F.col("t"), "[0-9]+|条"), compact(F.lit("A　 b C"))).first()
    assert t == ["pay", "30", "days"] and h == ["pay", "30", "days", "付款", "款条", "条件", "付款条", "款条件"]
    assert [tuple(x) for x in m] == [(4, 6, "30"), (15, 16, "条")] and c == "abc"


def test_clause_absorb(spark):
    rows = [(1, 0, "第1条 付款"), (1, 1, "plain"), (1, 2, "第2条 交付"), (1, 3, "TABLE"), (1, 4, "after"), (1, 5, "more")]
    units = spark.createDataFrame(rows, "d int, unit int, says string")
    out = corpus.clause_groups(units, "d", F.col("says").rlike("^第.+条"), F.col("says") == "TABLE").orderBy("unit")
    assert [r.clause for r in out.collect()] == [1, 1, 2, 3, 4, 5]


def test_three_valued_order(spark):
    for tests, want in [((True, True), True), ((None, False), None), ((False, None), False), ((True, None), None)]:
        got = spark.range(1).select(review.first_undecided([F.lit(t).cast("boolean") for t in tests])).first()[0]
        assert got is want


def test_personal_data(spark):
    texts = [
        "call 13800138000 or a.b@c.de, id 11010519491231002X", "clean", None, "13800138000,13900139000", "账号：6222 0200 1234 5678 901",
        "统一社会信用代码：91110000ABCDEF1234", "1138001380001 110105194912310021234",
    ]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "i int, text string")
    got = {r.i: r for r in corpus.personal_data(docs, "i").collect()}
    assert (got[1].mainland_mobile, got[1].email, got[1].mainland_id, got[1].gate) == (1, 1, 1, "block")
    assert got[2].gate == "pass" and got[3].gate == "block"
    assert got[4].mainland_mobile == 2 and got[5].bank_account == 1 and got[6].unified_social_credit_code == 1
    assert got[7].gate == "pass" and {got[i].gate for i in (4, 5, 6)} == {"block"}
    packages = docs.selectExpr("case when i in (2, 7) then 'clean' else 'other' end as p", "text", "i <> 7 as parsed")
    gate = {r.p: (r.n_found > 0, r.n_unparsed, r.decision) for r in corpus.package_gate(packages, "p", "text", "parsed").collect()}
    assert gate == {"clean": (False, 1, "block"), "other": (True, 1, "block")}


def test_total_check(spark):
    d = spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0)], "k int, total double")
    parts = spark.createDataFrame([(1, 4.0), (1, 6.0), (2, 4.0)], "k int, part double")
    assert {r.k: r.status for r in review.total_check(d, parts, "k", "total", "part").collect()} == {1: "PASS", 2: "WARN", 3: "UNKNOWN"}


def test_line_units_keep_digits(spark):
    """Lines lose spaces at their ends only, whatever their number."""
    docs = spark.createDataFrame([(1, " 0 zero \n\n2 two 2\n 1 one"), (2, None)], "k int, text string")
    got = [(r.unit, r.says) for r in corpus.line_units(docs, "k").orderBy("unit").collect()]
    assert got == [(0, "0 zero"), (1, "2 two 2"), (2, "1 one")]
