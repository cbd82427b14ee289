"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session (tests) may do without and gets one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder or tempfile.mkdtemp(prefix="spark-checkpoint-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the cluster's shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the faster built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def words(text: Column) -> Column:
    """Whitespace-separated words of a non-null text."""
    return F.array_remove(F.split(text, SPACE), "")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and hand it to `body`, which may use it within lambdas."""
    return F.transform(F.array(value), body)[0]


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Two longs that identify a row by id and content; rows alike in both share a key. Ids are whole numbers or texts of such."""
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("key_id"),
        F.xxhash64(F.col(doc_id).isNull(), F.col(text).isNull(), F.col(text)).alias("key_text"),
    ]


def wrapped(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows of docs as one column `whole`, so that its column names can't clash with `more`."""
    return docs.select(F.struct(*docs.columns).alias("whole"), *more)


def positions(
    df: DataFrame, keys: Sequence[str], ticket: str, ties: Sequence[str], name: str, per_bucket: int = 200_000
) -> DataFrame:
    """Add `name`: the 0-based gapless position of each row in its group, by (ticket, ties).

    `ticket` is a long drawn by a hash. A group larger than `per_bucket` rows is cut into
    ranges of its ticket; each range is ordered by a task of its own and starts where the
    ranges before it end, so no group has to fit in one task. `df` is read three times and
    should be narrow and materialised. Keys must not be null.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_parts", F.ceil(F.col("_n") / per_bucket)).drop("_n")
    unit = F.shiftrightunsigned(F.col(ticket), 1).cast("double") / float(2**63)
    split = df.join(sizes, keys).withColumn("_part", F.least(F.floor(unit * F.col("_parts")), F.col("_parts") - 1)).drop("_parts")
    # shiftrightunsigned orders tickets as unsigned numbers, and so must the order within a range
    split = split.withColumn("_u", F.shiftrightunsigned(F.col(ticket), 1))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = split.groupBy(*keys, "_part").agg(F.count("*").alias("_c"))
    offsets = offsets.withColumn("_from", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    within = Window.partitionBy(*keys, "_part").orderBy("_u", *ties)
    out = split.join(offsets, [*keys, "_part"])
    return out.withColumn(name, F.col("_from") + F.row_number().over(within) - 1).drop("_part", "_from", "_u")
