"""Tables that go to a model and what comes back: requests, splits, chunks, back-fill, and the view of counterparties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.operators.audit import fingerprint

#: Words of findings about the parties, checks of a party by outside sources, and ranks of gravity.
SUBJECT_WORDS = ("合同主体", "资信", "征信", "客商", "注册资本", "经营状况", "经营状态", "营业执照", "涉诉", "诉讼", "被执行", "失信", "合作历史")
OUTSIDE_CHECKS = ("registered_capital", "business_status", "litigation", "dishonesty", "credit_rating")
STATUS_RANK = {"BLOCK": 0, "WARN": 1, "UNKNOWN": 2}
RISK_RANK = {"critical": 0, "high": 0, "medium": 1, "low": 3}


def model_requests(rules: DataFrame, candidates: DataFrame, package: str) -> DataFrame:
    """package, rule_id, candidate_id: rules (package, rule_id, judged_by_model, in_scope, applicable) that go to a model.

    Only rules with a contract candidate (package, rule_id, candidate_id, source_kind) are asked about.
    """
    asked = rules.where("judged_by_model and in_scope and applicable").select(package, "rule_id").distinct()
    own = candidates.where("source_kind = 'contract'").select(package, "rule_id", "candidate_id").distinct()
    return asked.join(own, [package, "rule_id"])


def request_fingerprints(requests: DataFrame, package: str, columns: Sequence[str]) -> DataFrame:
    """package, rule_id, n_candidates, fingerprint: one request for each rule; sums of row hashes, so that order doesn't matter."""
    return fingerprint(requests, columns, [package, "rule_id"]).withColumnRenamed("n", "n_candidates")


def recombined(requests: DataFrame, items: DataFrame, package: str) -> DataFrame:
    """package, rule_id, state: `one` where a split request came back with exactly one item, else missing, repeated or unasked."""
    asked = requests.select(package, "rule_id").distinct().withColumn("_asked", F.lit(True))
    got = items.groupBy(package, "rule_id").agg(F.count("*").alias("_n"))
    both = asked.join(got, [package, "rule_id"], "full_outer")
    state = F.when(F.col("_asked").isNull(), "unasked").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "repeated").otherwise("one")
    return both.select(package, "rule_id", state.alias("state"))


def rule_chunks(rules: DataFrame, by: str, order: Sequence[str], size: int = 15) -> DataFrame:
    """Add `chunk`, from 0: rules of equal number in the order of the library."""
    return rules.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def chunk_coverage(chunked: DataFrame, items: DataFrame, by: str) -> DataFrame:
    """by, chunk, n_rules, n_items, covered: whether a chunk's items are half of its rules at least. items: by, chunk."""
    rules = chunked.groupBy(by, "chunk").agg(F.count("*").alias("n_rules"))
    got = items.groupBy(by, "chunk").agg(F.count("*").alias("n_items"))
    both = rules.join(got, [by, "chunk"], "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))
    return both.withColumn("covered", 2 * F.col("n_items") >= F.col("n_rules"))


def fuller_attempts(items: DataFrame, by: str) -> DataFrame:
    """Items of the attempt with the most items of each chunk; the earlier of equals. items: by, chunk, attempt, ..."""
    n = items.groupBy(by, "chunk", "attempt").agg(F.count("*").alias("_n"))
    best = n.groupBy(by, "chunk").agg(F.max_by("attempt", F.struct("_n", -F.col("attempt"))).alias("attempt"))
    return items.join(best, [by, "chunk", "attempt"], "left_semi")


def backfilled(contexts: DataFrame, detected: DataFrame, package: str) -> DataFrame:
    """contract_type from the context, else the first detected one by chunk; `again` where that asks for a second pass.

    contexts: package, contract_type. detected: package, chunk, contract_type.
    """
    first = detected.where("contract_type is not null").groupBy(package).agg(F.min_by("contract_type", F.struct("chunk", "contract_type")).alias("_found"))
    blank = F.nullif(F.trim("contract_type"), F.lit("")).isNull()
    both = contexts.join(first, package, "left")
    kind = F.when(blank, F.col("_found")).otherwise(F.col("contract_type"))
    return both.withColumn("again", blank & F.col("_found").isNotNull()).withColumn("contract_type", kind).drop("_found")


def gravity(status: Column, risk: Column) -> Column:
    """0 for the gravest; a finding that neither blocks, warns nor is unknown counts by its rule's risk."""
    first = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.upper(F.coalesce(status, F.lit("")))]
    second = F.create_map(*[F.lit(x) for kv in RISK_RANK.items() for x in kv])[F.lower(F.coalesce(risk, F.lit("")))]
    return F.coalesce(first, second, F.lit(4))


def party_findings(findings: DataFrame, run: str, words: Sequence[str] = SUBJECT_WORDS) -> DataFrame:
    """Findings (run, finding_id, rule_id, category, title, reason, status, risk_level) about parties, with `place` by gravity and ids."""
    said = F.concat_ws(" ", "category", "title", "reason")
    about = findings.where(said.rlike("|".join(words))).withColumn("gravity", gravity(F.col("status"), F.col("risk_level")))
    return about.withColumn("place", F.row_number().over(Window.partitionBy(run).orderBy("gravity", "rule_id", "finding_id")))


def outside_checks(runs: DataFrame, outcomes: DataFrame | None, run: str) -> DataFrame:
    """run, code, status: all outside checks of each run; UNAVAILABLE where no source (run, code, status) tells of one."""
    wanted = runs.select(run).distinct().select(run, F.explode(F.array(*map(F.lit, OUTSIDE_CHECKS))).alias("code"))
    if outcomes is None:
        return wanted.withColumn("status", F.lit("UNAVAILABLE"))
    told = outcomes.groupBy(run, "code").agg(F.max("status").alias("status"))
    return wanted.join(told, [run, "code"], "left").withColumn("status", F.coalesce("status", F.lit("UNAVAILABLE")))
