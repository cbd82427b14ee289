"""Rule bundles from nested JSON: loading, checks, and which layers are in force."""

import json

from docketry.sources import bundles


def rule(name, **more):
    return {"rule_id": name, "version": "1", "title": name, "applies_to": ["software"], "applicability": {"软件开发/转让服务": {"applicability": "required", "transaction_amount_min": 0}}, "check_method": "deterministic", "checker": "tax_rate"} | more


def bundle(name, rules, **more):
    return {"bundle_id": name, "source_sha256": name * 2, "release_status": "validated", "compatible_review_schema": "2.0", "rules": rules} | more


def loaded(spark, folder, **files):
    folder.mkdir()
    for name, said in files.items():
        (folder / f"{name}.json").write_text(said if isinstance(said, str) else json.dumps(said, ensure_ascii=False, indent=1))
    return bundles.load_bundles(spark, str(folder))


def test_base_and_extension(spark, tmp_path):
    base = loaded(spark, tmp_path / "b", base=bundle("base", [rule("b"), rule("a", expected_value="13%")]))
    more = loaded(spark, tmp_path / "e", more=bundle("more", [rule("c", playbook={"playbook_id": "p", "version": "1", "evaluation_mode": "checker", "clause_types": ["付款"]})]))
    rules, issues = bundles.active_rules(base, more, base.limit(0))
    got = rules.orderBy("place").collect()
    assert issues.count() == 0 and [(r.rule_id, r.place, r.active_bundle) for r in got] == [("b", 1, "base+more"), ("a", 2, "base+more"), ("c", 3, "base+more")]
    assert got[1].expected_value == "13%" and got[0].applicability["软件开发/转让服务"].transaction_amount_min == 0 and got[2].playbook.clause_types == ["付款"]
    alone, _ = bundles.active_rules(base, base.limit(0), base.limit(0))
    assert {(r.active_bundle, r.active_sha256) for r in alone.collect()} == {("base", "basebase")}


def test_published_replaces_both(spark, tmp_path):
    base = loaded(spark, tmp_path / "b", base=bundle("base", [rule("a")]), other=bundle("own", [rule("a")], library="x"))
    more = loaded(spark, tmp_path / "e", more=bundle("more", [rule("a")]))
    out = loaded(spark, tmp_path / "p", out=bundle("out", [rule("z")]))
    rules, issues = bundles.active_rules(base, more, out)
    assert {(r.library, r.rule_id, r.active_bundle) for r in rules.collect()} == {("", "z", "out"), ("x", "a", "own")} and issues.count() == 0


def test_refused(spark, tmp_path):
    """A rule id in both layers, broken JSON, and each of the checks."""
    base = loaded(spark, tmp_path / "b", base=bundle("base", [rule("a"), rule("b")]), x=bundle("x", [rule("a")], library="x"), y='{"bundle_id": "y", "rules": [')
    more = loaded(spark, tmp_path / "e", more=bundle("more", [rule("b")]))
    rules, issues = bundles.active_rules(base, more, base.limit(0))
    found = {(r.library, r.rule_id, r.issue) for r in issues.collect()}
    assert ("", "b", "in base and extension") in found and ("", None, "unreadable") in found and ("", None, "several bundles of a layer") in found
    assert {(r.library, r.rule_id) for r in rules.collect()} == {("x", "a")}
    bad = [
        rule("r1", applies_to=[], applicability={}), rule("r2", applicability={"other": {"applicability": "required"}}), rule("r3", human_review=True), rule("r4", checker="nobody"),
        rule("r5", title=" "), rule("r6", checker=None, playbook={"playbook_id": "p", "version": "1", "evaluation_mode": "checker", "clause_types": ["x"]}), rule("r7"), rule("r7"), rule("r8", applies_to=["mixed"], applicability={}),
    ]
    heads = loaded(spark, tmp_path / "c", bad=bundle("bad", bad), old=bundle("old", [], compatible_review_schema="1.0", release_status="draft", library="o"))
    found = {(r.library, r.rule_id, r.issue) for r in bundles.load_issues(heads).collect()}
    assert found == {
        ("", "r1", "no contract type"), ("", "r2", "contract type without applicability"), ("", "r3", "deterministic under human review"), ("", "r4", "UNSUPPORTED_CHECKER"),
        ("", "r5", "no id, version or title"), ("", "r6", "PLAYBOOK_CHECKER_BINDING_REQUIRED"), ("", "r7", "DUPLICATE_RULE_ID"), ("o", None, "schema"), ("o", None, "not released"),
    }
