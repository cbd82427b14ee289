"""An append-only ledger of JSON lines: batches listed in a manifest with their revision, number of rows and digest.

A batch's rows are written first and listed last, so one that was cut off is not listed and is written anew. A batch
that is listed is never written again: the same rows change nothing, other rows are refused. What a reader gets is checked
against the digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docketry.operators.audit import content_fingerprint
from docketry.sources.shared import cut

MANIFEST = "batch string, revision int, n long, digest string"
#: Times keep their microseconds in JSON.
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Conflict(ValueError):
    """A listed batch was to be written with other rows."""


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """batch, revision, n, digest of the batches of a ledger; a new ledger has none."""
    spark.createDataFrame([], MANIFEST).write.mode("ignore").json(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def append(rows: DataFrame, folder: str, batch: str, revision: int = 0) -> bool:
    """Add rows as a revision of a batch; False if it is there already with the same rows, Conflict if with others."""
    spark = rows.sparkSession
    held = manifest(spark, folder).where((F.col("batch") == batch) & (F.col("revision") == revision)).collect()
    rows = cut(rows)
    n, digest = content_fingerprint(rows).select("n", "fingerprint").first()
    if held:
        if (held[0]["n"], held[0]["digest"]) != (n, digest):
            raise Conflict(f"batch {batch}, revision {revision} is listed with other rows")
        return False
    rows.write.mode("overwrite").options(**FORMATS).json(f"{folder}/rows/batch={batch}/revision={revision}")
    spark.createDataFrame([(batch, revision, n, digest)], MANIFEST).coalesce(1).write.mode("append").json(f"{folder}/manifest")
    return True


def read(spark: SparkSession, folder: str, schema: StructType, latest: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with batch and revision, issues): of listed batches whose digest holds; of each batch the latest revision if `latest`.

    issues: batch, revision, issue (changed: listed with another digest; missing: listed without rows; unlisted: cut off while it was written).
    """
    listed = manifest(spark, folder)
    if listed.isEmpty():
        empty = spark.createDataFrame([], StructType(schema.fields)).withColumns({"batch": F.lit("").cast("string"), "revision": F.lit(0)})
        return empty, spark.createDataFrame([], "batch string, revision int, issue string")
    data = spark.read.schema(schema).options(**FORMATS).json(f"{folder}/rows").withColumns({"batch": F.col("batch").cast("string"), "revision": F.col("revision").cast("int")})
    found = content_fingerprint(data, ["batch", "revision"]).withColumnRenamed("n", "found")
    both = cut(listed.join(found, ["batch", "revision"], "full_outer"))
    issue = F.when(F.col("n").isNull(), "unlisted").when(F.col("found").isNull() & (F.col("n") > 0), "missing").when(F.col("found").isNotNull() & (F.col("fingerprint") != F.col("digest")), "changed")
    judged = both.select("batch", "revision", issue.alias("issue"))
    good = judged.where("issue is null").drop("issue")
    if latest:
        newest = Window.partitionBy("batch").orderBy(F.col("revision").desc())
        good = good.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")
    return data.join(good, ["batch", "revision"], "left_semi"), judged.where("issue is not null")


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: int = 64) -> DataFrame:
    """The rows of a ledger as a stream, as their files arrive."""
    return spark.readStream.schema(schema).options(**FORMATS).option("maxFilesPerTrigger", files).json(f"{folder}/rows/*/*")


def append_stream(stream: DataFrame, folder: str, state: str, name: str = "s") -> StreamingQuery:
    """Append each micro-batch of a stream as a batch of its own; one that is repeated after a failure changes nothing."""

    def keep(batch: DataFrame, number: int) -> None:
        append(batch, folder, f"{name}{number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
