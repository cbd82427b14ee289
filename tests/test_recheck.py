"""Audits that recompute, playbook validation, model requests, metrics and catalogs on small tables."""

import json

from pyspark.sql import functions as F

from docketry.operators import metrics, playbooks, recheck, requests
from docketry.sources import catalogs


def found(df, key):
    return sorted((r[key], r.issue) for r in df.collect())


def test_retrieval_issues(spark):
    s = 1 / 61 + 1 / 62
    hits = spark.createDataFrame(
        [("q", "c1", 1, 2, ["vector", "lexical"], s), ("q", "c2", 2, None, ["vector"], 1 / 62), ("q", "c3", 3, None, ["lexical"], 0.5), ("q", "c4", 4, None, ["lexical"], 1 / 64)],
        "query_id string, chunk_id string, lexical_rank int, vector_rank int, sources array<string>, score double",
    )
    chunks = spark.createDataFrame([(c,) for c in ("c1", "c2", "c3", "c5")], "chunk_id string")
    candidates = spark.createDataFrame([("q", c) for c in ("c1", "c2", "c3", "c5")], "query_id string, chunk_id string")
    assert found(recheck.retrieval_issues(hits, chunks, candidates), "chunk_id") == [("c2", "other sources"), ("c3", "other score"), ("c4", "no candidate"), ("c4", "no chunk"), ("c5", "no hit")]


def test_finding_issues(spark):
    kind = "finding_id string, rule_id string, version string, title string, risk string, status string, automatic boolean, quality string, evidence_ids array<string>, fact_ids array<string>"
    rows = [
        ("ok", "r", "1", "t", "high", "PASS", True, "SUFFICIENT", ["e1"], ["f1"]),
        ("rule", "z", "1", "t", "high", "WARN", False, "SUFFICIENT", ["e1"], []),
        ("version", "r", "2", "u", "low", "WARN", False, "SUFFICIENT", ["e1"], []),
        ("auto", "r", "1", "t", "high", "UNKNOWN", True, "SUFFICIENT", ["e1"], []),
        ("bare", "r", "1", "t", "high", "PASS", False, "SUFFICIENT", [], []),
        ("gone", "r", "1", "t", "high", "WARN", False, "NONE", ["e9"], ["f9"]),
        ("apart", "r", "1", "t", "high", "WARN", False, "NONE", ["e2"], ["f1"]),
        ("refused", "r", "1", "t", "high", "WARN", True, "SUFFICIENT", ["e2"], []),
        ("model", "m", "1", "t", "unclassified", "WARN", True, "SUFFICIENT", ["e3"], []),
    ]
    rules = spark.createDataFrame([("r", "1", "t", "high", False), ("m", "1", "t", None, True)], "rule_id string, version string, title string, risk string, by_model boolean")
    evidence = spark.createDataFrame([("e1",), ("e2",), ("e3",)], "evidence_id string")
    facts = spark.createDataFrame([("f1", ["e1"])], "fact_id string, evidence_ids array<string>")
    candidates = spark.createDataFrame([("e1", "ACCEPT", "deterministic"), ("e2", "REJECT", "deterministic"), ("e3", "ACCEPT", "semantic")], "evidence_id string, outcome string, assessed_by string")
    got = found(recheck.finding_issues(spark.createDataFrame(rows, kind), rules, evidence, facts, candidates), "finding_id")
    assert got == sorted(
        [
            ("rule", "no rule"),
            ("version", "other version"),
            ("version", "other title"),
            ("version", "other risk"),
            ("auto", "automatic unknown"),
            ("bare", "pass without evidence"),
            ("gone", "no such evidence"),
            ("gone", "no such fact"),
            ("apart", "fact without shared evidence"),
            ("refused", "evidence not accepted"),
        ]
    )


def test_fact_and_clause_issues(spark):
    kind = "fact_id string, document_ids array<string>, evidence_ids array<string>, candidate_ids array<string>"
    facts = spark.createDataFrame([("ok", ["d"], ["e1"], ["c1"]), ("far", ["x"], ["e2"], ["c1"]), ("rule", ["d"], ["e1"], ["c2"]), ("none", ["d"], ["e9"], [])], kind)
    candidates = spark.createDataFrame(
        [("c1", "contract", "d", "ACCEPT", "deterministic", ["e1"]), ("c2", "rule", "d", "REJECT", "deterministic", ["e1"])],
        "candidate_id string, source_kind string, document_id string, outcome string, assessed_by string, evidence_ids array<string>",
    )
    evidence = spark.createDataFrame([("e1",), ("e2",)], "evidence_id string")
    assert found(recheck.fact_issues(facts, candidates, evidence), "fact_id") == [
        ("far", "document of no candidate"),
        ("far", "evidence of no candidate"),
        ("none", "no such evidence"),
        ("rule", "candidate not accepted"),
        ("rule", "not a contract candidate"),
    ]
    clauses = spark.createDataFrame([("k1", "d", ["e1"], ["h1"]), ("k2", "d", ["e2"], ["h1", "h9"]), ("k3", "z", [], [])], "clause_id string, document_id string, evidence_ids array<string>, chunk_ids array<string>")
    chunks = spark.createDataFrame([("h1", "d", ["e1"])], "chunk_id string, document_id string, evidence_ids array<string>")
    got = found(recheck.clause_issues(clauses, chunks, spark.createDataFrame([("d",)], "document_id string")), "clause_id")
    assert got == [("k1", "chunk of two clauses"), ("k2", "evidence of the chunk is missing"), ("k2", "no such chunk"), ("k3", "no such document")]


def test_summary_and_results(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run string")
    bad = spark.createDataFrame([("a",), ("a",)], "run string")
    got = {r.run: (r.n_failed, r.failed, r.passed) for r in recheck.named_checks(runs, {"x": bad, "y": bad.limit(0)}, "run").collect()}
    assert got == {"a": (1, ["x"], False), "b": (0, [], True)}
    pairs = recheck.aligned(runs, spark.createDataFrame([("b",), ("c",)], "run string"), ["run"])
    assert sorted((r.run, r.state) for r in pairs.collect()) == [("a", "unfounded"), ("c", "unstated")]
    rows = spark.createDataFrame([("r", 1, "old"), ("r", 2, "new"), ("s", 1, "x")], "run string, revision_ts long, payload string")
    stored = rows.withColumn("payload_sha256", F.sha2(F.when(F.col("run") == "s", "y").otherwise(F.col("payload")), 256))
    assert {r.run: (r.payload, r.intact) for r in recheck.latest_result(stored, "run", F.col("payload")).collect()} == {"r": ("new", True), "s": ("x", False)}


PLAY = "struct<playbook_id:string,version:string,mode:string,clause_types:array<string>,preferred:string,fallback:array<string>,prohibited:array<string>,fallback_action:string,suggestion:string,threshold_ids:array<string>>"


def bundle_rules(spark):
    good = ("p1", "1", "position", ["pay"], "A", ["B"], ["C"], "COMMENT", None, ["t1", "t2"])
    rows = [
        ("b1", "r1", "c1", good),
        ("b1", "r2", None, None),
        ("b2", "r1", "c9", ("", "1", "checker", [], "x Y", ["q"], ["XY", "Q"], "REVISE", " ", ["t", "t"])),
        ("b2", "r2", None, ("p2", "1", "checker", ["z"], None, None, None, None, None, None)),
        ("b2", "r3", None, ("p2", "1", "position", None, None, None, None, None, None, None)),
        ("b2", "r3", None, None),
    ]
    return spark.createDataFrame(rows, f"bundle_id string, rule_id string, checker string, playbook {PLAY}")


def test_playbooks(spark):
    rules = bundle_rules(spark)
    got = sorted((r.bundle_id, r.rule_id, r.issue) for r in playbooks.playbook_issues(rules, ["c1"]).collect())
    assert got == sorted(
        [("b2", "r1", "UNSUPPORTED_CHECKER"), ("b2", "r1", "PLAYBOOK_ID_VERSION_REQUIRED"), ("b2", "r1", "PLAYBOOK_CHECKER_CLAUSE_TYPES_REQUIRED")]
        + [("b2", "r1", "PLAYBOOK_POSITION_CONFLICT"), ("b2", "r1", "PLAYBOOK_FALLBACK_PROHIBITED_CONFLICT"), ("b2", "r1", "PLAYBOOK_SUGGESTION_REQUIRED"), ("b2", "r1", "PLAYBOOK_THRESHOLD_ID_DUPLICATE")]
        + [("b2", "r2", "PLAYBOOK_CHECKER_BINDING_REQUIRED"), ("b2", "r3", "PLAYBOOK_POSITION_REQUIRED"), ("b2", "r3", "DUPLICATE_RULE_ID"), ("b2", "r2", "PLAYBOOK_VERSION_CONFLICT")]
    )
    bundles = spark.createDataFrame([("b1", "2.0", "DRAFT", None, None), ("b2", "1.0", "PUBLISHED", "no", "today")], "bundle_id string, schema string, status string, fingerprint string, published_at string")
    issues = playbooks.bundle_issues(bundles, rules, ["c1"], "2.0")
    own = sorted((r.bundle_id, r.issue) for r in issues.where("rule_id is null").collect())
    assert own == [("b2", "RELEASE_FINGERPRINT_MISMATCH"), ("b2", "REVIEW_SCHEMA_INCOMPATIBLE")]
    out = playbooks.published(bundles, rules, issues, F.lit("now"))
    assert [(r.bundle_id, r.status, r.published_at) for r in out.collect()] == [("b1", "PUBLISHED", "now")]
    assert playbooks.bundle_issues(out, rules.where("bundle_id = 'b1'"), ["c1"], "2.0", True).count() == 0
    weighed = rules.withColumn("weight", F.rand(1))
    assert sorted(playbooks.release_fingerprints(rules).collect()) == sorted(playbooks.release_fingerprints(weighed).collect())


def test_library_view(spark):
    rules = spark.createDataFrame([("r1", "a", "t2", True), ("r2", "b", "t1", False), ("r3", "c", "zz", True), ("r4", "d", "t1", True)], "rule_id string, title string, topic string, enabled boolean")
    topics = spark.createDataFrame([("t1", 1), ("t2", 2)], "topic string, topic_order long")
    got = [(r.topic, r.pos, r.rule_id, r.n_rules, r.n_enabled) for r in playbooks.library_view(rules, topics).orderBy("topic_order", "pos").collect()]
    assert got == [("t1", 1, "r2", 2, 1), ("t1", 2, "r4", 2, 1), ("t2", 1, "r1", 1, 1), ("zz", 1, "r3", 1, 1)]


def test_requests(spark):
    rules = spark.createDataFrame([("p", "r1", True, True, True), ("p", "r2", True, False, True), ("p", "r3", True, True, True)], "p string, rule_id string, judged_by_model boolean, in_scope boolean, applicable boolean")
    candidates = spark.createDataFrame([("p", "r1", "c1", "contract"), ("p", "r1", "c1", "contract"), ("p", "r2", "c2", "contract"), ("p", "r3", "c3", "rule")], "p string, rule_id string, candidate_id string, source_kind string")
    asked = requests.model_requests(rules, candidates, "p")
    assert [(r.rule_id, r.candidate_id) for r in asked.collect()] == [("r1", "c1")]
    assert requests.request_fingerprints(asked, "p", ["candidate_id"]).first().n_candidates == 1
    items = spark.createDataFrame([("p", "r1"), ("p", "r1"), ("p", "r9")], "p string, rule_id string")
    assert {r.rule_id: r.state for r in requests.recombined(asked, items, "p").collect()} == {"r1": "repeated", "r9": "unasked"}
    many = spark.createDataFrame([("p", i) for i in range(31)], "p string, rule_id int")
    chunks = requests.rule_chunks(many, "p", ["rule_id"])
    assert sorted(chunks.groupBy("chunk").count().collect()) == [(0, 15), (1, 15), (2, 1)]
    got = spark.createDataFrame([("p", 0, 1, i) for i in range(8)] + [("p", 0, 2, 0)] + [("p", 1, 1, i) for i in range(7)] + [("p", 1, 2, i) for i in range(7)], "p string, chunk int, attempt int, item int")
    best = requests.fuller_attempts(got, "p")
    assert sorted(best.groupBy("chunk", "attempt").count().collect()) == [(0, 1, 8), (1, 1, 7)]
    assert {r.chunk: r.covered for r in requests.chunk_coverage(chunks, best, "p").collect()} == {0: True, 1: False, 2: False}
    contexts = spark.createDataFrame([("a", " "), ("b", "sale"), ("c", None)], "p string, contract_type string")
    types = spark.createDataFrame([("a", 1, "lease"), ("a", 0, None), ("a", 2, "sale"), ("b", 0, "lease")], "p string, chunk int, contract_type string")
    assert {r.p: (r.contract_type, r.again) for r in requests.backfilled(contexts, types, "p").collect()} == {"a": ("lease", True), "b": ("sale", False), "c": (None, False)}


def test_parties(spark):
    rows = [("r", "f1", "1", "合同主体", "t", "x", "PASS", "high"), ("r", "f2", "1", "x", "涉诉", None, "UNKNOWN", None), ("r", "f3", "1", "x", "y", "失信", "BLOCK", None), ("r", "f4", "1", "x", "y", "z", "BLOCK", None)]
    kind = "run string, finding_id string, rule_id string, category string, title string, reason string, status string, risk_level string"
    got = [r.finding_id for r in requests.party_findings(spark.createDataFrame(rows, kind), "run").orderBy("place").collect()]
    assert got == ["f1", "f3", "f2"]
    runs = spark.createDataFrame([("r",)], "run string")
    assert {r.status for r in requests.outside_checks(runs, None, "run").collect()} == {"UNAVAILABLE"}
    told = spark.createDataFrame([("r", "litigation", "CLEAR")], "run string, code string, status string")
    assert sorted(r.status for r in requests.outside_checks(runs, told, "run").collect()) == ["CLEAR"] + ["UNAVAILABLE"] * 4


def test_metrics(spark):
    notes = [("a1", "d1", "pay", True), ("a2", "d1", "nope", True), ("a3", "d1", "pay", False), ("a4", "d9", "pay", True), ("a5", "d1", "nope", False)]
    a = spark.createDataFrame(notes, "annotation_id string, document_id string, phrase string, expected boolean")
    docs = spark.createDataFrame([("d1", "we pay"), ("d2", "nope")], "document_id string, text string")
    assert found(metrics.invalid_annotations(a, docs), "annotation_id") == [("a2", "absent"), ("a3", "present"), ("a4", "no such document")]
    scopes = spark.createDataFrame([("s1", "k", ["d1"], ["we", "pay"], True), ("s2", "k", ["d2"], ["we"], False)], "scope_id string, checker string, document_ids array<string>, phrases array<string>, expected boolean")
    cited = spark.createDataFrame([("k", "d1", "we pay")], "checker string, document_id string, excerpt string")
    assert {r.scope_id: r.found for r in metrics.citation_pairs(scopes, cited).collect()} == {"s1": True, "s2": False}
    expected = spark.createDataFrame([("c", "k1", "UNKNOWN", True), ("c", "k2", "UNKNOWN", True), ("c", "k3", "PASS", False), ("c", "k4", "PASS", False)], "case_id string, checker string, status string, reason_due boolean")
    said = spark.createDataFrame([("c", "k1", "UNKNOWN", False, "why"), ("c", "k2", "PASS", True, None), ("c", "k3", "PASS", True, None)], "case_id string, checker string, status string, automatic boolean, reason string")
    r = metrics.conclusions(expected, said, ["case_id"]).first()
    assert (r.n, r.correct, r.accuracy, r.false_pass) == (4, 2, 0.5, 1)
    want, have = (spark.createDataFrame(x, "case_id string, kind string, value double") for x in ([("c", "a", 1.0), ("c", "b", 2.0), ("c", "z", 3.0)], [("c", "a", 1.0), ("c", "b", 2.0), ("c", "b", 2.5)]))
    r = metrics.figures(want, have, ["case_id", "kind"], 1e-9, ["case_id"]).first()
    assert (r.n, r.found, r.correct) == (3, 1, 1)
    r = metrics.set_match(want, have, ["case_id", "kind"], ["case_id"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) == (2, 0, 1, 1.0, 0.666667, 0.8)
    cases = spark.createDataFrame([("c", 2, None), ("e", 1, 0)], "case_id string, min_findings int, min_clauses int")
    counts = spark.createDataFrame([("c", 2, 0)], "case_id string, findings int, clauses int")
    got = {(r.case_id, r.check): r.passed for r in metrics.fixture_gates(cases, counts, {"findings": "min_findings", "clauses": "min_clauses"}).collect()}
    assert got == {("c", "findings"): True, ("c", "clauses"): True, ("e", "findings"): False, ("e", "clauses"): True}


def test_catalogs(spark, tmp_path):
    def catalog(name, fields, version="1.0"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"catalog_id": name, "schema_version": version, "extractor_version": "1", "fields": fields}))

    catalog("good", [{"key": "party_a", "label": "A", "aliases": ["a"]}, {"key": "date", "label": "D", "patterns": ["x"], "required": True}])
    catalog("bad", [{"key": "X", "label": " ", "required": True, "enabled": False}, {"key": "X", "label": "x", "aliases": [" "], "enabled": False}], "9")
    fields = catalogs.element_fields(spark, str(tmp_path))
    issues = sorted((r.catalog_id, r.key, r.issue) for r in catalogs.catalog_issues(fields, "1.0").collect() if r.key)
    assert {i[0] for i in issues} == {"bad"} and {i[2] for i in issues} == {"schema version", "key", "label", "neither alias nor pattern", "required but disabled", "repeated key"}
    assert catalogs.catalog_issues(fields, "1.0").where("issue = 'nothing enabled'").count() == 1
    assert [r.sort_order for r in fields.where("catalog_id = 'good'").orderBy("pos").collect()] == [0, 10]


def test_contexts(spark):
    kind = "k int, contract_type string, party_position string, jurisdiction string, transaction_tags string, transaction_amount string, review_scope string"
    rows = [(1, "x", " 买方 ", None, "a, b；a", "1,000.5", '["s", "t "]'), (2, None, "nobody", None, None, "-1", '["s"'), (3, None, None, None, "", None, "")]
    got = {r.k: r for r in catalogs.review_contexts(spark.createDataFrame(rows, kind), "k").collect()}
    assert (got[1].party, got[1].tags, float(got[1].amount), got[1].scope, got[1].issues) == ("buyer", ["a", "b"], 1000.5, ["s", "t"], [])
    assert got[2].issues == ["party", "amount", "scope"] and (got[3].party, got[3].tags, got[3].scope, got[3].issues) == ("unknown", [], [], [])


def test_expert_tables(spark, tmp_path):
    case = {"case_id": "c", "package": {"package_id": "p", "documents": [{"document_id": "d", "text": "x"}]}, "annotations": [{"annotation_id": "a", "document_id": "d", "phrase": "x", "expected": True}]}
    (tmp_path / "set.json").write_text(json.dumps({"dataset_id": "s", "schema_version": "2.0", "cases": [case, {**case, "case_id": "c2"}]}))
    documents, notes = catalogs.expert_tables(spark, str(tmp_path))
    assert notes.count() == 2 and sorted((r.case_id, r.package_id) for r in catalogs.repeated_cases(documents).collect()) == [("c", "p"), ("c2", "p")]
