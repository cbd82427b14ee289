"""Validation and publication of rule bundles with playbooks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import fold
from docketry.operators.audit import row_hash

#: Fields that only present a rule; they don't change what it finds and are not in a fingerprint.
PRESENTATION = ("weight", "high_standard", "mid_standard", "low_standard", "suggested_action")


def row_issues(rows: DataFrame, key: Sequence[str], checks: Mapping[str, Column]) -> DataFrame:
    """key, issue: one row for each named check that a row fails. A check that is NULL is not met, either."""
    failed = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.select(*key, F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("issue"))


def _overlap(a: Column, b: Column) -> Column:
    plain = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), fold), lambda v: v != "")
    return F.arrays_overlap(plain(a), plain(b))


def playbook_issues(rules: DataFrame, checkers: Sequence[str]) -> DataFrame:
    """bundle_id, rule_id, issue of rules with or without playbook.

    rules: bundle_id, rule_id, checker, playbook struct (playbook_id, version, mode, clause_types, preferred, fallback,
    prohibited, fallback_action, suggestion, threshold_ids). A null playbook has no playbook issues.
    """
    p = F.col("playbook")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    plain = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    known = F.col("checker").isNull() | F.col("checker").isin(*checkers)
    placed = (size(p["clause_types"]) > 0) | plain(p["preferred"]) | (size(p["fallback"]) > 0) | (size(p["prohibited"]) > 0)
    by_position = p["mode"] == "position"
    fine = {
        "PLAYBOOK_ID_VERSION_REQUIRED": plain(p["playbook_id"]) & plain(p["version"]),
        "PLAYBOOK_POSITION_REQUIRED": ~by_position | placed,
        "PLAYBOOK_CHECKER_CLAUSE_TYPES_REQUIRED": by_position | (size(p["clause_types"]) > 0),
        "PLAYBOOK_CHECKER_BINDING_REQUIRED": (p["mode"] != "checker") | F.col("checker").isNotNull(),
        "PLAYBOOK_POSITION_CONFLICT": ~_overlap(F.array(p["preferred"]), p["prohibited"]),
        "PLAYBOOK_FALLBACK_PROHIBITED_CONFLICT": ~_overlap(p["fallback"], p["prohibited"]),
        "PLAYBOOK_SUGGESTION_REQUIRED": (F.coalesce(p["fallback_action"], F.lit("")) != "REVISE") | plain(p["suggestion"]),
        "PLAYBOOK_THRESHOLD_ID_DUPLICATE": size(F.array_distinct(p["threshold_ids"])) == size(p["threshold_ids"]),
    }
    checks = {"UNSUPPORTED_CHECKER": known} | {name: p.isNull() | F.coalesce(ok, F.lit(False)) for name, ok in fine.items()}
    one_by_one = row_issues(rules, ["bundle_id", "rule_id"], checks)
    repeats = rules.groupBy("bundle_id", "rule_id").count().where("count > 1").select("bundle_id", "rule_id", F.lit("DUPLICATE_RULE_ID").alias("issue"))
    says = F.sha2(F.to_json("playbook"), 256)
    apart = rules.where(p.isNotNull()).groupBy("bundle_id", "playbook.playbook_id", "playbook.version").agg(F.min(says).alias("a"), F.max(says).alias("b"), F.min("rule_id").alias("rule_id"))
    conflicts = apart.where("a <> b").select("bundle_id", "rule_id", F.lit("PLAYBOOK_VERSION_CONFLICT").alias("issue"))
    return one_by_one.union(repeats).union(conflicts).distinct()


def release_fingerprints(rules: DataFrame, key: str = "rule_id") -> DataFrame:
    """bundle_id, expected: one fingerprint for each bundle, from all fields of its rules but those of presentation.

    A bundle is a rule library of bounded size: what is gathered is one hash for each rule.
    """
    plain = [F.to_json(F.struct(c)).alias(c) if "<" in t else F.col(c) for c, t in rules.dtypes]
    fields = sorted(c for c in rules.columns if c not in (*PRESENTATION, "bundle_id"))
    hashed = rules.select(*plain).select("bundle_id", F.struct(F.col(key), row_hash(fields).alias("h")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"])
    return hashed.groupBy("bundle_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("expected"))


def bundle_issues(bundles: DataFrame, rules: DataFrame, checkers: Sequence[str], schema: str, require_published: bool = False) -> DataFrame:
    """bundle_id, rule_id (null for the bundle itself), issue. bundles: bundle_id, schema, status, fingerprint, published_at."""
    out = F.col("status") == "PUBLISHED"
    both = bundles.join(release_fingerprints(rules), "bundle_id", "left")
    marked = F.col("fingerprint").isNotNull() & F.col("published_at").isNotNull()
    checks = {
        "REVIEW_SCHEMA_INCOMPATIBLE": F.col("schema") == schema,
        "RULE_BUNDLE_NOT_PUBLISHED": out | F.lit(not require_published),
        "PUBLISHED_METADATA_REQUIRED": ~out | marked,
        "RELEASE_FINGERPRINT_MISMATCH": ~out | ~marked | (F.col("fingerprint") == F.col("expected")),
        "UNPUBLISHED_METADATA_INVALID": out | (F.col("fingerprint").isNull() & F.col("published_at").isNull()),
    }
    own = row_issues(both, ["bundle_id"], checks).select("bundle_id", F.lit(None).cast(rules.schema["rule_id"].dataType).alias("rule_id"), "issue")
    return own.union(playbook_issues(rules, checkers))


def published(bundles: DataFrame, rules: DataFrame, issues: DataFrame, at: Column) -> DataFrame:
    """Bundles without an issue, with their fingerprint and time of publication; the others are left out."""
    good = bundles.join(issues.select("bundle_id").distinct(), "bundle_id", "left_anti").drop("fingerprint", "published_at", "status")
    stamped = good.join(release_fingerprints(rules), "bundle_id").withColumnRenamed("expected", "fingerprint")
    return stamped.withColumn("status", F.lit("PUBLISHED")).withColumn("published_at", at)


def library_view(rules: DataFrame, topics: DataFrame) -> DataFrame:
    """topic, pos, rule_id, title, n_rules, n_enabled in the topics' order; rules of unknown topics come last.

    rules: rule_id, title, topic, enabled. topics: topic, topic_order.
    """
    placed = rules.join(topics, "topic", "left").withColumn("topic_order", F.coalesce("topic_order", F.lit(2**31 - 1).cast("long")))
    group = Window.partitionBy("topic_order", "topic")
    pos = F.row_number().over(group.orderBy("rule_id"))
    return placed.select(
        "topic_order", "topic", pos.alias("pos"), "rule_id", "title", F.count("*").over(group).alias("n_rules"), F.count_if(F.col("enabled")).over(group).alias("n_enabled")
    )
