"""Units, evidence, clauses and personal data of document tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import DETECTORS, stable_id


def line_units(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, unit (dense from 0), says: the non-blank lines of each text."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("unit", "says"))


def evidence(units: DataFrame, key: str) -> DataFrame:
    """One evidence row for each unit: a stable id and the hash of the excerpt."""
    return units.select(key, "unit", stable_id("ev-", F.col(key), F.col("unit"), F.col("says")).alias("evidence_id"), F.sha2("says", 256).alias("excerpt_sha256"))


def clause_groups(units: DataFrame, key: str, numbered: Column, hard: Column) -> DataFrame:
    """Add `clause`: numbered units absorb the plain ones behind them, other hard units stand alone."""
    order = Window.partitionBy(key).orderBy("unit")
    marked = units.withColumn("_hard", hard | numbered).withColumn("_numbered", numbered)
    last = F.last(F.when(F.col("_hard"), F.col("_numbered")), ignorenulls=True).over(order)
    opens = F.col("_hard") | ~F.coalesce(last, F.lit(False))
    return marked.withColumn("_opens", opens.cast("int")).withColumn("clause", F.sum("_opens").over(order)).drop("_hard", "_numbered", "_opens")


def personal_data(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Counts by detector and the gate: block on any finding or a missing text. Values are not kept."""
    counts = [F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)).cast("long").alias(k) for k, p in DETECTORS.items()]
    found = sum((F.col(k) for k in DETECTORS), F.lit(0))
    return docs.select(key, *counts, F.col(text).isNull().alias("_missing")).select(
        key, *DETECTORS, F.when(F.col("_missing") | (found > 0), "block").otherwise("pass").alias("gate")
    )


def package_gate(blocks: DataFrame, package: str, text: str, parsed: str) -> DataFrame:
    """package, n_found, n_unparsed, decision: block on any finding, a missing text or a document that isn't parsed."""
    found = sum((F.coalesce(F.regexp_count(F.col(text), F.lit(p)), F.lit(0)) for p in DETECTORS.values()), F.lit(0))
    bad = F.col(text).isNull() | ~F.coalesce(F.col(parsed), F.lit(False))
    out = blocks.groupBy(package).agg(F.sum(found.cast("long")).alias("n_found"), F.count_if(bad).alias("n_unparsed"))
    return out.withColumn("decision", F.when((F.col("n_found") > 0) | (F.col("n_unparsed") > 0), "block").otherwise("allow"))


#: Options of a comparison and the block types that each leaves out; the other options leave out no blocks.
SKIPPED = {
    "ignore_tables": ("table", "table_cell"),
    "ignore_images": ("image",),
    "ignore_header_footer": ("header", "footer"),
    "ignore_seals": ("seal",),
    "ignore_watermark": ("image",),
}
OPTIONS = (*SKIPPED, "ignore_symbols", "ignore_handwriting")
#: Where a text breaks into lines.
BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def compare_options(given: Mapping[str, bool] | None) -> dict[str, bool]:
    """All options of a comparison; what isn't given is off, what isn't known is dropped."""
    return {name: bool((given or {}).get(name)) for name in OPTIONS}


def compared(text: Column, options: Mapping[str, bool]) -> Column:
    """The text that is compared: without anything but letters, digits and Han characters if symbols are ignored."""
    return F.regexp_replace(text, r"(?U)[^\w\x{4E00}-\x{9FFF}]+", "") if options.get("ignore_symbols") else text


def parsed_units(blocks: DataFrame, pages: DataFrame, key: str, options: Mapping[str, bool] | None = None) -> DataFrame:
    """key, unit (dense from 0), says, kind: the parts of parsed documents that are compared.

    blocks: key, page, n (order in it), node (of the document's own outline), block_type, text. pages: key, page, text. A document with
    an outline is its nodes alone. Any other is the blocks of its pages in order, and the lines of pages that have no block.
    Types that the options ignore and blank texts are left out.
    """
    flags = compare_options(options)
    ignored = sorted({t for name, types in SKIPPED.items() if flags[name] for t in types})
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    outlined = blocks.where("node").select(key).distinct()
    flat = blocks.where("not node").join(outlined, key, "left_anti")
    used = blocks.where("node").unionByName(flat)
    if ignored:
        used = used.where(~F.coalesce(F.col("block_type").isin(*ignored), F.lit(False)))
    told = used.select(key, "page", "n", strip(F.col("text")).alias("says"), F.col("block_type").alias("kind"))
    bare = pages.join(outlined, key, "left_anti").join(flat.select(key, "page").distinct(), [key, "page"], "left_anti")
    lines = bare.select(key, "page", F.posexplode(F.split(F.col("text"), BREAKS)).alias("n", "says")).select(key, "page", "n", strip(F.col("says")).alias("says"), F.lit("paragraph").alias("kind"))
    every = told.unionByName(lines.withColumn("n", F.col("n").cast(told.schema["n"].dataType))).where("says <> ''")
    order = Window.partitionBy(key).orderBy("page", "n")  # the parts of one document
    return every.select(key, (F.row_number().over(order) - 1).alias("unit"), "says", "kind")
