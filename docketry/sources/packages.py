"""Packages of documents: manifests, snapshots, what is new since the last run, report texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.canonical import canonical


def manifest(documents: DataFrame, package: str, document: str, sha: str) -> DataFrame:
    """package, documents (sorted by id), snapshot, duplicates: one row for each package.

    A package is one review's set of files; its ids and hashes are what a row holds.
    """
    once = documents.groupBy(package, document).agg(F.min(sha).alias("sha"), F.count("*").alias("n"))
    files = F.array_sort(F.collect_list(F.struct(F.col(document).alias("document"), F.col("sha"))))
    out = once.groupBy(package).agg(files.alias("documents"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))
    return out.withColumn("snapshot", F.sha2(canonical(F.col("documents"), out.schema["documents"].dataType), 256))


def kinds_by_name(documents: DataFrame, kinds: DataFrame, package: str) -> DataFrame:
    """Add `kind` from kinds (package, name, kind): by the whole file name, else by the one name that it ends with."""
    named = kinds.select(package, F.col("name").alias("_name"), F.col("kind").alias("_kind"))
    fits = documents.select(package, "filename").distinct().join(named, package).where(F.endswith("filename", F.col("_name")))
    exact = F.max(F.when(F.col("filename") == F.col("_name"), F.col("_kind")))
    one = F.when(F.count("*") == 1, F.min("_kind"))
    found = fits.groupBy(package, "filename").agg(F.coalesce(exact, one).alias("kind"))
    return documents.join(found, [package, "filename"], "left")


def unseen(rows: DataFrame, done: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows whose identity (text hash, model, endpoint and the like) no row of `done` has."""
    return rows.join(done.select(*identity).distinct(), list(identity), "left_anti")


def report_text(findings: DataFrame, run: str, order: Sequence[str], line: Column, title: str) -> DataFrame:
    """run, report: the findings of each run as lines of text in order, under a title with their number."""
    rows = findings.select(run, F.struct(*order, line.alias("_line")).alias("r"))
    lines = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["_line"])
    grouped = rows.groupBy(run).agg(F.count("*").alias("n"), lines.alias("lines"))
    head = F.concat(F.lit(f"# {title} "), F.col(run).cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return grouped.select(run, F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("report"))
