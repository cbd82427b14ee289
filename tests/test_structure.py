"""Clause edges, obligations, version changes, gates and positions on small tables."""

from docketry.operators import compare, structure


def clauses(spark):
    rows = [
        ("d", "c1", "1", "第1条 “工作日”指法定工作日"),
        ("d", "c2", "1.1", "1.1 付款"),
        ("d", "c3", "2", "第2条 见第1.1条；违约责任见第9条，第1.1条同样适用"),
        ("d", "c4", "10", "第10条 付款义务。乙方应在验收后十个工作日内支付合同价款；甲方不得向无关第三方泄露源代码。"),
    ]
    return spark.createDataFrame(rows, "document string, clause string, number string, text string")


def test_edges(spark):
    assert [(r.src, r.dst) for r in structure.parents(clauses(spark)).collect()] == [("c1", "c2")]
    refs = structure.references(clauses(spark)).collect()
    assert sorted((r.src, r.number, r.dst, r.state) for r in refs if r.src == "c3") == [("c3", "1.1", "c2", "RESOLVED"), ("c3", "9", None, "UNRESOLVED")]


def test_obligations(spark):
    got = sorted(structure.obligations(clauses(spark)).where("clause = 'c4'").collect(), key=lambda r: r.begins)
    assert [(r.subject, r.modality) for r in got] == [("乙方", "required"), ("甲方", "prohibited")]
    assert got[0].deadline == "在验收后十个工作日内" and (got[0].confidence, got[1].confidence) == (0.8, 0.9)
    more = spark.createDataFrame([("d", "c", None, "乙方提供源代码。客户应付款项。采购人有义务验收货物。须遵守保密。应付款项")], "document string, clause string, number string, text string")
    got = [(r.subject, r.action, r.confidence) for r in structure.obligations(more).orderBy("begins").collect()]
    assert got == [("乙方", "源代码", 0.7), ("客户", "付款项", 0.8), ("采购人", "验收货物", 0.9), (None, "遵守保密", 0.8)]


def test_changes(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, "same", "same"), (3, None, "")], "pair_id long, before string, after string")
    got = [(r.pair_id, r.kind, r.before, r.after) for r in compare.unit_changes(pairs).orderBy("pair_id", "pos").collect()]
    assert got == [(1, "modified", "b", "x"), (1, "added", None, "d")]
    ratio = {r.pair_id: r.similarity for r in compare.similarity(pairs).collect()}
    assert ratio[1] < 1.0 and ratio[2] == ratio[3] == 1.0


def test_gate(spark):
    items = [("i1", "r1", "PASS", ["e1"], 0.9), ("i2", "r1", "PASS", ["e9"], 0.9), ("i3", "r1", "WARN", ["e1"], 0.4), ("i4", "r2", "PASS", [], 0.9)]
    table = spark.createDataFrame(items, "item_id string, rule_id string, status string, evidence_ids array<string>, confidence double")
    allowed = spark.createDataFrame([("r1", "e1"), ("r2", "e9")], "rule_id string, evidence_id string")
    assert {r.item_id: r.gated for r in compare.gate_items(table, allowed).collect()} == {"i1": "PASS", "i2": "REFUSED", "i3": "UNKNOWN", "i4": "UNKNOWN"}


def test_positions(spark):
    text = spark.createDataFrame([("付款 pay in 30 days",), ("liability is unlimited",)], "text string")
    kind = "rule_id string, clause_type string, missing string, positions array<struct<text:string,status:string,action:string>>"
    plays = [
        ("r1", "pay", "ESCALATE", [("prepaid", "BLOCK", "REJECT"), ("30 days", "PASS", "ACCEPT"), ("pay", "WARN", "REVISE")]),
        ("r2", "liability", "ESCALATE", [("unlimited", "BLOCK", "REJECT")]),
        ("r3", "liability", "ESCALATE", [("capped", "PASS", "ACCEPT")]),
        ("r4", "renewal", "ESCALATE", [("none", "PASS", "ACCEPT")]),
    ]
    got = {r.rule_id: (r.status, r.action) for r in compare.positions(text, spark.createDataFrame(plays, kind)).collect()}
    assert got == {"r1": ("PASS", "ACCEPT"), "r2": ("BLOCK", "REJECT"), "r3": ("UNKNOWN", "ESCALATE"), "r4": ("BLOCK", "ESCALATE")}
