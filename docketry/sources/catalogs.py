"""Catalogs of fields, review contexts and expert datasets, read from JSON and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators.playbooks import row_issues

#: Names of the party that a review is for.
PARTY_NAMES = {"buyer": "buyer", "买方": "buyer", "甲方": "buyer", "seller": "seller", "卖方": "seller", "乙方": "seller",
               "both": "both", "双方": "both", "unknown": "unknown", "未知": "unknown"}
FIELD = "struct<key:string,label:string,aliases:array<string>,patterns:array<string>,required:boolean,enabled:boolean,sort_order:int,hint:string>"
CATALOG = f"catalog_id string, schema_version string, extractor_version string, fields array<{FIELD}>"
#: Fixed value: the form of a field's key.
KEY = "^[a-z][a-z0-9_]{1,39}$"
EXPERT = (
    "dataset_id string, schema_version string, cases array<struct<case_id:string,package:struct<package_id:string,documents:array<struct<document_id:string,text:string>>>,"
    "annotations:array<struct<annotation_id:string,document_id:string,phrase:string,expected:boolean>>>>"
)


def element_fields(spark: SparkSession, path: str) -> DataFrame:
    """catalog_id, schema_version, extractor_version, pos and the columns of a field: one row for each field of the catalogs at `path`."""
    raw = spark.read.schema(CATALOG).json(path, multiLine=True)
    rows = raw.select("catalog_id", "schema_version", "extractor_version", F.posexplode_outer("fields").alias("pos", "f")).select("*", "f.*").drop("f")
    filled = rows.withColumn("enabled", F.coalesce("enabled", F.lit(True))).withColumn("required", F.coalesce("required", F.lit(False)))
    return filled.withColumn("sort_order", F.coalesce("sort_order", 10 * F.col("pos"))).withColumn("label", F.trim("label"))


def catalog_issues(fields: DataFrame, schema_version: str, readable: Column | None = None) -> DataFrame:
    """catalog_id, key, issue of element_fields(); a catalog with any issue is not to be used.

    `readable` says whether a field's patterns compile; patterns are tried where they are used if it is not given.
    """
    held = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    size = lambda c: F.coalesce(F.size(F.filter(F.col(c), lambda x: F.trim(x) != "")), F.lit(0))
    checks = {
        "schema version": F.col("schema_version") == schema_version,
        "catalog id": held("catalog_id"),
        "extractor version": held("extractor_version"),
        "key": F.col("key").rlike(KEY),
        "label": held("label"),
        "neither alias nor pattern": size("aliases") + size("patterns") > 0,
        "required but disabled": F.col("enabled") | ~F.col("required"),
    }
    if readable is not None:
        checks["pattern"] = readable
    own = row_issues(fields, ["catalog_id", "key"], checks)
    per = fields.groupBy("catalog_id", "key").count().where("count > 1").select("catalog_id", "key", F.lit("repeated key").alias("issue"))
    none = fields.groupBy("catalog_id").agg(F.max("enabled").alias("any")).where("not any").select("catalog_id", F.lit(None).cast("string").alias("key"), F.lit("nothing enabled").alias("issue"))
    return own.union(per).union(none).distinct()


def listed(text: Column) -> Column:
    """Distinct trimmed items of a JSON array of strings or of text split at commas, semicolons and line ends; NULL for broken JSON."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    items = F.when(plain.startswith("["), F.from_json(plain, "array<string>", {"mode": "PERMISSIVE"})).otherwise(F.split(plain, "[,，;；\n]"))
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != ""))


def review_contexts(raw: DataFrame, key: str) -> DataFrame:
    """key, contract_type, party, jurisdiction, tags, amount, scope, issues from columns of text
    (contract_type, party_position, jurisdiction, transaction_tags, transaction_amount, review_scope)."""
    named = F.lower(F.trim(F.coalesce("party_position", F.lit(""))))
    names = F.create_map(*[F.lit(x) for kv in PARTY_NAMES.items() for x in kv])
    party = F.when(named == "", "unknown").otherwise(names[named])
    amount = F.trim(F.regexp_replace("transaction_amount", "[,，]", "")).try_cast("decimal(30,6)")
    out = raw.select(
        key,
        "contract_type",
        party.alias("party"),
        "jurisdiction",
        listed(F.col("transaction_tags")).alias("tags"),
        amount.alias("amount"),
        listed(F.col("review_scope")).alias("scope"),
        F.col("transaction_amount").isNotNull().alias("_stated"),
    )
    issue = F.array(
        F.when(F.col("party").isNull(), F.lit("party")),
        F.when(F.col("tags").isNull(), F.lit("tags")),
        F.when(F.col("_stated") & (F.col("amount").isNull() | (F.col("amount") < 0)), F.lit("amount")),
        F.when(F.col("scope").isNull(), F.lit("scope")),
    )
    return out.withColumn("issues", F.array_compact(issue)).drop("_stated")


def expert_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents (case_id, package_id, document_id, text) and annotations (case_id, annotation_id, document_id, phrase, expected)."""
    case = spark.read.schema(EXPERT).json(path, multiLine=True).select(F.explode("cases").alias("c"))
    documents = case.select("c.case_id", "c.package.package_id", F.explode("c.package.documents").alias("d")).select("case_id", "package_id", "d.*")
    return documents, case.select("c.case_id", F.explode("c.annotations").alias("a")).select("case_id", "a.*")


def repeated_cases(documents: DataFrame) -> DataFrame:
    """case_id, package_id that don't stand one to one."""
    pairs = documents.select("case_id", "package_id").distinct()
    by_case = pairs.groupBy("case_id").count().where("count > 1").select("case_id")
    by_package = pairs.groupBy("package_id").count().where("count > 1").select("package_id")
    return pairs.join(by_case, "case_id", "left_semi").union(pairs.join(by_package, "package_id", "left_semi").select("case_id", "package_id")).distinct()
