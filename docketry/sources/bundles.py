"""Rule bundles: nested JSON snapshots as one table of rules, their checks, and the merge of a base, its extension and what was published."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.operators.applicability import type_names
from docketry.operators.playbooks import playbook_issues, row_issues

SPEC = "struct<applicability:string,party_positions:array<string>,jurisdictions:array<string>,transaction_amount_min:double,transaction_amount_max:double,note:string>"
PLAYBOOK = (
    "struct<playbook_id:string,version:string,evaluation_mode:string,clause_types:array<string>,preferred_position:string,fallback_positions:array<string>,"
    "prohibited_positions:array<string>,fallback_action:string,suggested_revision:string,escalation_thresholds:array<struct<threshold_id:string,metric:string,operator:string,value:string,action:string>>>"
)
RULE = (
    f"struct<rule_id:string,version:string,title:string,category:string,applies_to:array<string>,applicability:map<string,{SPEC}>,condition:string,check_method:string,checker:string,"
    f"expected_value:string,risk_level:string,weight:double,required_evidence:array<string>,human_review:boolean,playbook:{PLAYBOOK}>"
)
HEAD = "schema_version string, library string, bundle_id string, source_sha256 string, release_status string, compatible_review_schema string"
BUNDLE = f"{HEAD}, rules array<{RULE}>, _unreadable string"
#: Names of the checkers that a rule may name.
CHECKERS = (
    "amount_case_consistency", "amount_detail_total", "untaxed_amount", "tax_rate", "tax_amount", "payment_ratio", "guarantee_requirement", "payment_total", "invoice_type", "invoice_amount",
    "invoice_total", "attachment_completeness", "payment_terms", "delivery_terms", "acceptance_terms", "renewal_terms", "termination_terms", "breach_liability_terms", "cross_document_consistency",
)


def load_bundles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, the columns of HEAD, rules, unreadable: a row for each bundle of the JSON files at `path` (one for each file, or for each line).

    `library` says whose bundle it is; files that lack it belong to one library, "".
    """
    raw = spark.read.schema(BUNDLE).options(multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_unreadable").json(path)
    named = raw.select(F.col("_metadata.file_path").alias("file"), *raw.columns)
    return named.withColumns({"library": F.coalesce("library", F.lit("")), "unreadable": F.col("_unreadable").isNotNull()}).drop("_unreadable")


def bundle_rules(bundles: DataFrame) -> DataFrame:
    """library, bundle_id, source_sha256, pos and the columns of a rule: one row for each rule of each bundle."""
    rows = bundles.select("library", "bundle_id", "source_sha256", F.posexplode("rules").alias("pos", "r"))
    return rows.select("library", "bundle_id", "source_sha256", "pos", "r.*").withColumns({"applies_to": F.coalesce("applies_to", F.array().cast("array<string>")), "human_review": F.coalesce("human_review", F.lit(False))})


def _covered(applies: Column, applicability: Column) -> Column:
    """Whether each contract type has a spec, under its own name or one that it stands for."""
    names = F.coalesce(F.map_keys(applicability), F.array().cast("array<string>"))
    return F.forall(applies, lambda t: F.arrays_overlap(names, type_names(t)))


def load_issues(bundles: DataFrame, schema: str = "2.0", checkers: Sequence[str] = CHECKERS) -> DataFrame:
    """library, bundle_id, rule_id (null for the bundle itself), issue: a bundle with any must not be used."""
    rules = bundle_rules(bundles)
    held = F.coalesce(F.size("applicability"), F.lit(0))
    checks = {
        "no contract type": (F.size("applies_to") > 0) | (held > 0),
        "contract type without applicability": (held == 0) | _covered(F.col("applies_to"), F.col("applicability")),
        "deterministic under human review": ~F.col("human_review") | (F.coalesce("check_method", F.lit("")) != "deterministic"),
        "no id, version or title": F.forall(F.array("rule_id", "version", "title"), lambda c: F.coalesce(F.trim(c), F.lit("")) != ""),
    }
    own = row_issues(rules, ["library", "bundle_id", "rule_id"], checks)
    p = F.col("playbook")
    plain = F.struct(
        p["playbook_id"].alias("playbook_id"), p["version"].alias("version"), F.coalesce(p["evaluation_mode"], F.lit("position")).alias("mode"), p["clause_types"].alias("clause_types"),
        p["preferred_position"].alias("preferred"), p["fallback_positions"].alias("fallback"), p["prohibited_positions"].alias("prohibited"), p["fallback_action"].alias("fallback_action"),
        p["suggested_revision"].alias("suggestion"), F.coalesce(p["escalation_thresholds"]["threshold_id"], F.array().cast("array<string>")).alias("threshold_ids"),
    )
    whole = rules.select(F.struct("library", "bundle_id").alias("bundle_id"), "rule_id", "checker", F.when(p.isNotNull(), plain).alias("playbook"))
    books = playbook_issues(whole, list(checkers)).select("bundle_id.library", "bundle_id.bundle_id", "rule_id", "issue")
    good = {
        "unreadable": ~F.col("unreadable"),
        "schema": F.coalesce("compatible_review_schema", F.lit(schema)) == schema,
        "not released": F.col("release_status").isin("validated", "published"),
        "no id": F.coalesce(F.trim("bundle_id"), F.lit("")) != "",
    }
    heads = row_issues(bundles, ["library", "bundle_id"], good).select("library", "bundle_id", F.lit(None).cast("string").alias("rule_id"), "issue")
    return own.union(books).union(heads)


def active_rules(base: DataFrame, extension: DataFrame, published: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, issues) in force for each library, from the bundles of its layers (load_bundles).

    A published bundle is the whole set in force and replaces what base and extension make together. Base and
    extension must not share a rule id; a library where they do, or one of whose bundles has an issue, has no rules in force. Of
    several bundles of a layer only one may be given for a library.
    """
    layers = [df.withColumn("layer", F.lit(name)) for name, df in (("base", base), ("extension", extension), ("published", published))]
    every = layers[0].unionByName(layers[1]).unionByName(layers[2])
    out = every.where("layer = 'published'").select("library").distinct()
    used = every.where("layer = 'published'").unionByName(every.where("layer <> 'published'").join(out, "library", "left_anti"))
    issues = load_issues(used)
    twice = used.groupBy("library", "layer").count().where("count > 1").select("library", F.lit(None).cast("string").alias("bundle_id"), F.lit(None).cast("string").alias("rule_id"), F.lit("several bundles of a layer").alias("issue"))
    rows = bundle_rules(used.where("layer <> 'published'")).select("library", "rule_id", "bundle_id").distinct()
    both = rows.groupBy("library", "rule_id").agg(F.count_distinct("bundle_id").alias("n")).where("n > 1")
    shared = both.select("library", F.lit(None).cast("string").alias("bundle_id"), "rule_id", F.lit("in base and extension").alias("issue"))
    issues = issues.union(twice).union(shared)
    head = F.array_sort(F.collect_list(F.struct("layer", "bundle_id", "source_sha256")))  # one or two bundles
    names = used.groupBy("library").agg(head.alias("b"))
    merged = names.select(
        "library",
        F.array_join(F.transform("b", lambda x: x["bundle_id"]), "+").alias("active_bundle"),
        F.when(F.size("b") > 1, F.sha2(F.array_join(F.transform("b", lambda x: x["source_sha256"]), "\x1f"), 256)).otherwise(F.get("b", F.lit(0))["source_sha256"]).alias("active_sha256"),
    )
    good = merged.join(issues.select("library").distinct(), "library", "left_anti")
    layer = used.select("library", "bundle_id", "layer").distinct()
    rules = bundle_rules(used).join(layer, ["library", "bundle_id"]).join(good, "library")
    order = Window.partitionBy("library").orderBy("layer", "pos")  # base before extension; a library's rules are few
    return rules.withColumn("place", F.row_number().over(order)), issues
