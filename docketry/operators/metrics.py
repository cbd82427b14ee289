"""Evaluation against expert annotations: clauses, citations, conclusions, unknowns, figures, versions, fixture gates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.operators.phrases import containing


def share(part: Column, whole: Column) -> Column:
    """part / whole to six places; 0/0 is NULL."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 6)


def phrases_found(annotations: DataFrame, texts: DataFrame, document: str = "document_id") -> DataFrame:
    """Annotations (annotation_id, document, phrase, expected) with `found`: whether a text of the document holds the phrase."""
    held = texts.select(document, F.col("text")).distinct()
    hits = containing(held, [document, "text"], "text", annotations.select(document, "phrase").distinct(), "phrase", [document])
    met = hits.select(document, "phrase").distinct().withColumn("found", F.lit(True))
    return annotations.join(met, [document, "phrase"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def invalid_annotations(annotations: DataFrame, documents: DataFrame, document: str = "document_id") -> DataFrame:
    """annotation_id, issue: phrases that are not where they should be, or are where they shouldn't, and unknown documents."""
    found = phrases_found(annotations, documents, document)
    known = found.join(documents.select(document, F.lit(True).alias("_known")).distinct(), document, "left")
    issue = F.when(F.col("_known").isNull(), "no such document").when(F.col("expected") & ~F.col("found"), "absent").when(~F.col("expected") & F.col("found"), "present")
    return known.select("annotation_id", issue.alias("issue")).where("issue is not null")


def citation_pairs(scopes: DataFrame, cited: DataFrame) -> DataFrame:
    """scope_id, expected, found: whether one cited excerpt of the checker's finding is in the documents and has all phrases.

    scopes: scope_id, checker, document_ids, phrases, expected. cited: checker, document_id, excerpt.
    """
    at = scopes.select("scope_id", "checker", "phrases", F.explode("document_ids").alias("document_id"))
    all_in = F.forall("phrases", lambda p: F.contains("excerpt", p))
    met = at.join(cited, ["checker", "document_id"]).where(all_in).select("scope_id").distinct().withColumn("found", F.lit(True))
    return scopes.join(met, "scope_id", "left").select("scope_id", "checker", "expected", F.coalesce("found", F.lit(False)).alias("found"))


def conclusions(expected: DataFrame, findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, n, correct, accuracy, false_pass: expected (case_id, checker, status, reason_due) against findings (case_id, checker, status, automatic, reason).

    Where a reason is due, a conclusion is right only with one. A false pass is an automatic PASS where UNKNOWN was expected.
    """
    said = findings.select("case_id", "checker", F.col("status").alias("_said"), "automatic", "reason")
    both = expected.join(said, ["case_id", "checker"], "left")
    reasoned = ~F.col("reason_due") | (F.coalesce("reason", F.lit("")) != "")
    right = F.coalesce((F.col("_said") == F.col("status")) & reasoned, F.lit(False))
    wrong_pass = (F.col("status") == "UNKNOWN") & (F.col("_said") == "PASS") & F.col("automatic")
    n, correct = F.count("*"), F.count_if(right)
    return both.groupBy(*by).agg(n.alias("n"), correct.alias("correct"), share(correct, n).alias("accuracy"), F.count_if(F.coalesce(wrong_pass, F.lit(False))).alias("false_pass"))


def figures(expected: DataFrame, facts: DataFrame, key: Sequence[str], within: float, by: Sequence[str]) -> DataFrame:
    """by, n, found, correct, accuracy: expected figures (key, value) against the one value that facts (key, value) state."""
    one = facts.groupBy(*key).agg(F.when(F.min("value") == F.max("value"), F.min("value")).alias("_value"))
    both = expected.join(one, list(key), "left")
    right = F.coalesce(F.abs(F.col("value") - F.col("_value")) <= within, F.lit(False))
    n, correct = F.count("*"), F.count_if(right)
    return both.groupBy(*by).agg(n.alias("n"), F.count("_value").alias("found"), correct.alias("correct"), share(correct, n).alias("accuracy"))


def set_match(expected: DataFrame, found: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 over distinct rows: version changes, affected rules or redlines against the expected ones."""
    a = expected.select(*on).distinct().withColumn("_a", F.lit(True))
    b = found.select(*on).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, list(on), "full_outer")
    in_a, in_b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    counts = both.groupBy(*by).agg(F.count_if(in_a & in_b).alias("tp"), F.count_if(~in_a).alias("fp"), F.count_if(~in_b).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def fixture_gates(cases: DataFrame, counts: DataFrame, least: Mapping[str, str], case: str = "case_id") -> DataFrame:
    """case, check, passed: cases with least numbers against the numbers counted; `least` maps a column of counts to one of cases.

    A case without counts fails what it asks for; a null least number asks for nothing.
    """
    both = cases.join(counts, case, "left")
    checks = [F.struct(F.lit(n).alias("check"), (F.coalesce(F.col(n), F.lit(0)) >= F.coalesce(F.col(m), F.lit(0))).alias("passed")) for n, m in least.items()]
    return both.select(case, F.explode(F.array(*checks)).alias("c")).select(case, "c.*")
