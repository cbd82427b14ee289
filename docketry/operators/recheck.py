"""Audits that recompute: retrieval, assessments, findings, facts, clauses, and the summary of named checks by run.

Every audit returns rows of issues; an empty result means that the audit holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.audit import replay_differences
from docketry.operators.playbooks import row_issues


def retrieval_issues(hits: DataFrame, chunks: DataFrame, candidates: DataFrame, k: int = 60) -> DataFrame:
    """query_id, chunk_id, issue: hits on no chunk, whose sources or fused score don't follow from their ranks, hits that
    became no candidate, and candidates without a hit.

    hits: query_id, chunk_id, lexical_rank, vector_rank, sources, score.
    """
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("lexical_rank").isNotNull(), F.lit("lexical")), F.when(F.col("vector_rank").isNotNull(), F.lit("vector"))))
    known = chunks.select("chunk_id", F.lit(True).alias("_chunk")).distinct()
    taken = candidates.select("query_id", "chunk_id", F.lit(True).alias("_candidate")).distinct()
    both = hits.withColumn("_hit", F.lit(True)).join(taken, ["query_id", "chunk_id"], "full_outer").join(known, "chunk_id", "left")
    no_hit = F.col("_hit").isNull()
    checks = {
        "no hit": ~no_hit,
        "no chunk": F.col("_chunk").isNotNull(),
        "no candidate": F.col("_candidate").isNotNull(),
        "other sources": no_hit | (F.array_sort("sources") == sources),
        "other score": no_hit | (F.abs(F.col("score") - part("lexical_rank") - part("vector_rank")) <= 1e-12),
    }
    return row_issues(both, ["query_id", "chunk_id"], checks)


def recomputed(stored: DataFrame, again: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, state of rows (assessments, snapshots of rules, items or elements) that a recomputation doesn't confirm."""
    return replay_differences(stored, again, keys, columns)


def _all_known(rows: DataFrame, key: str, ids: str, known: DataFrame, id_name: str) -> DataFrame:
    """key of rows with an id in the array `ids` that `known` lacks."""
    cited = rows.select(key, F.explode(ids).alias(id_name))
    return cited.join(known.select(id_name).distinct(), id_name, "left_anti").select(key).distinct()


def finding_issues(findings: DataFrame, rules: DataFrame, evidence: DataFrame, facts: DataFrame, candidates: DataFrame) -> DataFrame:
    """finding_id, issue of findings (finding_id, rule_id, version, title, risk, status, automatic, quality, evidence_ids, fact_ids).

    rules: rule_id, version, title, risk, by_model. facts: fact_id, evidence_ids. candidates: evidence_id, outcome,
    assessed_by of contract candidates. Automatic findings rest on accepted candidates only, by the deterministic
    assessor or, for rules that a model judges, by the semantic one.
    """
    of = rules.select("rule_id", *[F.col(c).alias(f"_{c}") for c in ("version", "title", "risk", "by_model")], F.lit(True).alias("_known"))
    both = findings.join(of, "rule_id", "left")
    sufficient = F.col("quality") == "SUFFICIENT"
    no_rule = F.col("_known").isNull()
    same = lambda c: no_rule | F.col(c).eqNullSafe(F.col(f"_{c}"))
    direct = row_issues(
        both,
        ["finding_id"],
        {
            "no rule": ~no_rule,
            "other version": same("version"),
            "other title": same("title"),
            "other risk": no_rule | (F.col("risk") == F.coalesce("_risk", F.lit("unclassified"))),
            "automatic unknown": (F.col("status") != "UNKNOWN") | ~F.col("automatic"),
            "pass without evidence": (F.col("status") != "PASS") | (sufficient & (F.size("evidence_ids") > 0)),
            "automatic without evidence": ~F.col("automatic") | sufficient,
        },
    )
    tell = lambda rows, issue: rows.select("finding_id", F.lit(issue).alias("issue"))
    cited = findings.select("finding_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    used = findings.select("finding_id", F.explode("fact_ids").alias("fact_id")).distinct()
    of_facts = used.join(facts.select("fact_id", F.explode("evidence_ids").alias("evidence_id")), "fact_id")
    shared = of_facts.join(cited, ["finding_id", "evidence_id"], "left_semi").select("finding_id", "fact_id").distinct()
    known_facts = used.join(facts.select("fact_id").distinct(), "fact_id", "left_semi")
    automatic = both.where("automatic").select("finding_id", F.explode("evidence_ids").alias("evidence_id"), F.coalesce("_by_model", F.lit(False)).alias("_by_model"))
    accepts = (F.col("outcome") == "ACCEPT") & ((F.col("assessed_by") == "deterministic") | (F.col("_by_model") & (F.col("assessed_by") == "semantic")))
    judged = automatic.join(candidates, "evidence_id").groupBy("finding_id", "evidence_id").agg(F.max(F.coalesce(accepts, F.lit(False))).alias("ok"))
    return (
        direct.union(tell(_all_known(findings, "finding_id", "evidence_ids", evidence, "evidence_id"), "no such evidence"))
        .union(tell(_all_known(findings, "finding_id", "fact_ids", facts, "fact_id"), "no such fact"))
        .union(tell(known_facts.join(shared, ["finding_id", "fact_id"], "left_anti"), "fact without shared evidence"))
        .union(tell(judged.where("not ok"), "evidence not accepted"))
        .distinct()
    )


def fact_issues(facts: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id, issue of facts (fact_id, document_ids, evidence_ids, candidate_ids): facts come from accepted contract candidates only.

    candidates: candidate_id, source_kind, document_id, outcome, assessed_by, evidence_ids.
    """
    tell = lambda rows, issue: rows.select("fact_id", F.lit(issue).alias("issue"))
    used = facts.select("fact_id", F.explode("candidate_ids").alias("candidate_id")).join(candidates, "candidate_id")
    fit = (F.col("source_kind") == "contract") & F.col("document_id").isNotNull()
    fair = (F.col("outcome") == "ACCEPT") & (F.col("assessed_by") == "deterministic")
    direct = row_issues(used, ["fact_id"], {"not a contract candidate": fit, "candidate not accepted": fair})
    with_candidates = facts.where(F.size("candidate_ids") > 0)
    own = with_candidates.select("fact_id", F.explode("evidence_ids").alias("evidence_id"))
    given = used.select("fact_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    places = with_candidates.select("fact_id", F.explode("document_ids").alias("document_id"))
    return (
        direct.union(tell(_all_known(facts, "fact_id", "candidate_ids", candidates, "candidate_id"), "no such candidate"))
        .union(tell(_all_known(facts, "fact_id", "evidence_ids", evidence, "evidence_id"), "no such evidence"))
        .union(tell(own.join(given, ["fact_id", "evidence_id"], "left_anti"), "evidence of no candidate"))
        .union(tell(places.join(used.select("fact_id", "document_id").distinct(), ["fact_id", "document_id"], "left_anti"), "document of no candidate"))
        .distinct()
    )


def clause_issues(clauses: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """clause_id, issue of clauses (clause_id, document_id, evidence_ids, chunk_ids) against chunks (chunk_id, document_id, evidence_ids)."""
    tell = lambda rows, issue: rows.select("clause_id", F.lit(issue).alias("issue"))
    held = clauses.select("clause_id", "document_id", "evidence_ids", F.explode("chunk_ids").alias("chunk_id"))
    of = chunks.select("chunk_id", F.col("document_id").alias("_document"), F.col("evidence_ids").alias("_evidence"))
    direct = row_issues(
        held.join(of, "chunk_id", "left"),
        ["clause_id"],
        {
            "no such chunk": F.col("_document").isNotNull(),
            "chunk of another document": F.col("_document").isNull() | (F.col("_document") == F.col("document_id")),
            "evidence of the chunk is missing": F.col("_evidence").isNull() | (F.size(F.array_except("_evidence", "evidence_ids")) == 0),
        },
    )
    shared = held.groupBy("chunk_id").agg(F.min("clause_id").alias("clause_id"), F.max("clause_id").alias("_other")).where("clause_id <> _other")
    repeats = clauses.groupBy("clause_id").count().where("count > 1")
    return (
        direct.union(tell(clauses.join(documents.select("document_id").distinct(), "document_id", "left_anti"), "no such document"))
        .union(tell(shared, "chunk of two clauses"))
        .union(tell(repeats, "repeated id"))
        .distinct()
    )


def named_checks(runs: DataFrame, issues: Mapping[str, DataFrame], run: str) -> DataFrame:
    """run, n_failed, failed, passed: which named checks have an issue in a run. Every issue table has the column `run`."""
    rows = None
    for name, found in issues.items():
        one = found.select(run, F.lit(name).alias("check")).distinct()
        rows = one if rows is None else rows.union(one)
    failed = rows.groupBy(run).agg(F.array_sort(F.collect_list("check")).alias("failed"))
    out = runs.select(run).distinct().join(failed, run, "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    return out.select(run, F.size("failed").alias("n_failed"), "failed", (F.size("failed") == 0).alias("passed"))


def aligned(stated: DataFrame, found: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, state of rows that only one side has: `unfounded` if only stated, `unstated` if only found. For manifests, kinds,
    precedence, attachments and decisions alike."""
    a, b = stated.select(*on).distinct().withColumn("_a", F.lit(True)), found.select(*on).distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_b").isNull(), "unfounded").when(F.col("_a").isNull(), "unstated")
    return a.join(b, list(on), "full_outer").select(*on, state.alias("state")).where("state is not null")


def latest_result(results: DataFrame, run: str, payload: Column, order: str = "revision_ts") -> DataFrame:
    """The last revision of each run with `intact`: whether its payload still has the stored payload_sha256."""
    last = results.groupBy(run).agg(F.max_by(F.struct(*[c for c in results.columns if c != run]), F.struct(order, "payload_sha256")).alias("r"))
    return last.select(run, "r.*").withColumn("intact", F.sha2(payload, 256).eqNullSafe(F.col("payload_sha256")))
