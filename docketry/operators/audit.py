"""Integrity of tables: repeated ids, provenance of evidence, fingerprints and replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.canonical import canonical_row


def repeated_ids(rows: DataFrame, keys: Sequence[str], payload: Column) -> DataFrame:
    """keys, n, n_payloads of keys that occur twice or more; more than one payload is a conflict."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(payload).alias("_a"), F.max(payload).alias("_b"))
    return n.where("n > 1").withColumn("conflict", ~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")


def provenance(evidence: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """evidence_id, issue: evidence without its document, of another version of it, outside it or with another excerpt.

    evidence: evidence_id, key, source_sha256, begins, excerpt, excerpt_sha256. documents: key, text.
    """
    own = documents.select(key, F.col("text").alias("_t"), F.sha2("text", 256).alias("_sha"))
    both = evidence.join(own, key, "left")
    end = F.col("begins") + F.length("excerpt")
    issue = (
        F.when(F.col("_sha").isNull(), "no document")
        .when(F.col("_sha") != F.col("source_sha256"), "other version")
        .when(F.sha2("excerpt", 256) != F.col("excerpt_sha256"), "excerpt changed")
        .when((F.col("begins") < 0) | (end > F.length("_t")), "outside")
        .when(F.substring("_t", F.col("begins") + 1, F.length("excerpt")) != F.col("excerpt"), "not there")
    )
    return both.select("evidence_id", issue.alias("issue")).where("issue is not null")


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns in their order, each with its length in front; a null differs from an empty string."""
    part = lambda c: F.concat(F.length(c), F.lit("="), c)
    return F.sha2(F.concat(*[F.coalesce(part(F.col(c).cast("string")), F.lit("~")) for c in columns]), 256)


def _sums(h: Column) -> list[Column]:
    """Numbers from all of a digest, whose sums stand for a bag of rows."""
    return [F.conv(F.substring(h, i, 13), 16, 10).cast("decimal(30,0)") for i in (1, 14, 27, 40, 53)]


def fingerprint(rows: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, n, fingerprint: a sum over row hashes, so neither order nor partitioning matters and nothing is gathered."""
    sums = [F.sum(p).cast("string") for p in _sums(F.col("_h"))]
    return rows.withColumn("_h", row_hash(columns)).groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws("-", *sums).alias("fingerprint"))


def content_fingerprint(rows: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """by, n, fingerprint of rows that hold structs, arrays and maps, by their canonical JSON without run times."""
    names = [c for c in (columns or rows.columns) if c not in by]
    hashed = rows.select(*by, F.sha2(canonical_row(rows, names), 256).alias("_h"))
    return hashed.groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws("-", *[F.sum(p).cast("string") for p in _sums(F.col("_h"))]).alias("fingerprint"))


def replay_differences(first: DataFrame, second: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, state: keys whose rows differ between two runs: changed, missing from the second or new in it.

    Both runs meet in one aggregation; a key's rows are compared as a bag by their number and hash sums.
    """
    h = row_hash(columns).alias("_h")
    rows = first.select(*keys, F.lit(True).alias("_first"), h).union(second.select(*keys, F.lit(False), h))
    a, b = F.col("_first"), ~F.col("_first")
    total = lambda c: F.struct(*[F.sum(F.when(c, p)) for p in _sums(F.col("_h"))])
    both = rows.groupBy(*keys).agg(F.count_if(a).alias("_a"), F.count_if(b).alias("_b"), (total(a) == total(b)).alias("_same"))
    state = F.when(F.col("_b") == 0, "missing").when(F.col("_a") == 0, "new").when((F.col("_a") != F.col("_b")) | ~F.col("_same"), "changed")
    return both.select(*keys, state.alias("state")).where("state is not null")
