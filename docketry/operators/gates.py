"""Gates of risk items, rule identity, single choice, and the rule library with its edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("BLOCK", "WARN", "INFO", "PASS", "UNKNOWN", "NOT_APPLICABLE")


def risk_candidates(candidates: DataFrame, key: str, most: int = 32) -> DataFrame:
    """One candidate for each chunk (the lowest id), then the `most` best of each key by (score, candidate_id)."""
    chosen = candidates.groupBy(key, "chunk_id").agg(F.min_by(F.struct("candidate_id", "score"), "candidate_id").alias("c")).select(key, "chunk_id", "c.*")
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "candidate_id")
    return chosen.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def risk_items(items: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Items (key, item_id, level, evidence_ids, confidence) with `state`, evidence cut to the allowed (key, evidence_id), confidence in 0 to 1.

    An unknown level is refused; so is BLOCK, WARN or INFO without allowed evidence.
    """
    cited = items.select(key, "item_id", F.posexplode("evidence_ids").alias("pos", "evidence_id"))
    kept = cited.join(allowed.select(key, "evidence_id").distinct(), [key, "evidence_id"])
    pairs = F.array_sort(F.collect_list(F.struct("pos", "evidence_id")))
    kept = kept.groupBy(key, "item_id").agg(F.array_distinct(F.transform(pairs, lambda p: p["evidence_id"])).alias("kept"))
    out = items.drop("evidence_ids").join(kept, [key, "item_id"], "left").withColumn("confidence", F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)))
    bare = F.col("level").isin("BLOCK", "WARN", "INFO") & F.col("kept").isNull()
    state = F.when(F.col("level").isNull() | ~F.col("level").isin(*LEVELS), "bad level").when(bare, "no evidence").otherwise("kept")
    return out.withColumn("state", state).withColumn("evidence_ids", F.coalesce("kept", F.array().cast(items.schema["evidence_ids"].dataType))).drop("kept")


def resolved_rules(items: DataFrame, rules: DataFrame, title: Column) -> DataFrame:
    """Add resolved_id: the item's own rule_id if a rule has it, else that of the one rule with its title."""
    known = rules.select("rule_id", F.lit(True).alias("known"))
    titles = rules.groupBy(title.alias("_title")).agg(F.count_distinct("rule_id").alias("_n"), F.min("rule_id").alias("by_title")).where("_n = 1").drop("_n")
    out = items.join(known, "rule_id", "left").withColumn("_title", title).join(titles, "_title", "left")
    return out.withColumn("resolved_id", F.coalesce(F.when(F.col("known"), F.col("rule_id")), F.col("by_title"))).drop("_title", "known", "by_title")


def single_choice(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Where one finding of a group alone passes, the others don't apply."""
    passes = F.count_if(F.col("status") == "PASS").over(Window.partitionBy(*by))
    status = F.when((passes == 1) & (F.col("status") != "PASS"), "NOT_APPLICABLE").otherwise(F.col("status"))
    return findings.withColumn("status", status)


def overlay(base: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, edited: the base with the last edit of each key laid over it.

    edits: key, seq, action (upsert or remove), value. Upserts of unknown keys are new rows.
    """
    last = edits.groupBy(key).agg(F.max_by(F.struct("action", F.col(value).alias("v")), "seq").alias("e"))
    both = base.select(key, F.col(value).alias("_base")).join(last, key, "full_outer").where("e is null or e.action <> 'remove'")
    return both.select(key, F.when(F.col("e").isNull(), F.col("_base")).otherwise(F.col("e.v")).alias(value), F.col("e").isNotNull().alias("edited"))


def fresh_candidates(items: DataFrame, title: str, order: Sequence[str], *pools: DataFrame) -> DataFrame:
    """The first item of each trimmed title that no pool (column `title`) has."""
    out = items.withColumn("_t", F.trim(title)).where("_t <> ''")
    for pool in pools:
        out = out.join(pool.select(F.trim("title").alias("_t")).distinct(), "_t", "left_anti")
    return out.groupBy("_t").agg(F.min_by(F.struct(*items.columns), F.struct(*order)).alias("i")).select("i.*")
