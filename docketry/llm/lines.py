"""Line dedup: a suffix array over line ids by distributed prefix doubling.

A suffix of a document begins at one of its lines. Ranking suffixes by their first line gives
the first order; a round joins the rank at a line with the rank further down and ranks the
pairs, so the length doubles. Ranks keep the order of the sorted suffixes: a rank is the number of
classes before it, added up over sampled range partitions. Suffixes alone in their class hold no
repeated run and drop out. After the last round a class is an interval of the suffix array whose
longest common prefix reaches `min_lines`. Every line of an interval's later members (by id, then
text hash, then line) is deleted; overlapping ones join to maximal repeated runs. With `min_words`,
shorter runs of more words than that are deleted alike, by the ranks of their own number of lines.

Classes are only counted and reduced to their first member, never gathered.

Defined results: lines are what \\n separates; a null text has none, an empty one has one, empty.
Rows alike in doc_id and text are one document and get the same result. A null id sorts as -1.
Ties between copies go by id, text hash and line. A very long text is one row, whose lines are ranked
each on its own; an empty table gives an empty result; other columns come back in `whole`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, row_key, words, wrapped

KEY = ["key_id", "key_text"]


def _ranked(classes: DataFrame, by: list[str]) -> DataFrame:
    """Add `rank`, 1 for the first class in the order of `by`, from counts of sampled ranges."""
    dealt = cut(classes.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    counts = dealt.groupBy("range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy("range").orderBy(*by)
    ranked = dealt.join(counts.select("range", "before"), "range").withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.select(*by, "rank")


def _rounds(docs: DataFrame, min_lines: int, every: bool) -> Iterator[tuple[int, DataFrame]]:
    """(length, ranks) of the rounds up to min_lines, of each length if `every`; ranks as in suffix_ranks, with the first line's `own` and all `words`."""
    lines = docs.select(*row_key(), F.posexplode(F.split("text", "\n")).alias("line", "says"))
    own = [F.size(words(F.col("says"))).cast("long").alias("own")] if every else []
    ids = lines.select(*KEY, "line", F.xxhash64("says").alias("a"), F.xxhash64(F.lit(1), "says").alias("b"), *own)
    kept = [*KEY, "line", "rank", *(["own", "words"] if every else [])]
    ids = ids.withColumn("words", F.col("own")) if every else ids
    classes = ids.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    now = ids.join(_ranked(classes.select("a", "b"), ["a", "b"]), ["a", "b"]).select(*kept).dropDuplicates([*KEY, "line"])
    length = 1
    while length < min_lines:
        now = cut(now)
        yield length, now
        step = 1 if every else min(length, min_lines - length)
        further = now.select(*KEY, (F.col("line") - step).alias("line"), F.col("rank").alias("b"), *([F.col("words").alias("more")] if every else []))
        pairs = now.withColumnRenamed("rank", "a").join(further, [*KEY, "line"])
        pairs = cut(pairs.withColumn("words", F.col("own") + F.col("more")).drop("more") if every else pairs)
        classes = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
        now = pairs.join(_ranked(classes.select("a", "b"), ["a", "b"]), ["a", "b"]).select(*kept)
        length += step
    yield length, cut(now)


def suffix_ranks(docs: DataFrame, min_lines: int) -> DataFrame:
    """key_id, key_text, line (from 0), rank: suffixes that share their first `min_lines` lines with another."""
    return list(_rounds(docs, min_lines, False))[-1][1]


def _runs(starts: Column) -> Column:
    """Runs (line, upto) sorted by line, joined where they overlap or touch: (start, end) pairs."""
    kind = "array<struct<start:int,end:int>>"
    first = F.struct(F.lit(None).cast("int").alias("start"), F.lit(-1).alias("end"), F.array().cast(kind).alias("out"))
    closed = lambda a: F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), a["end"].alias("end"))))

    def step(a: Column, s: Column) -> Column:
        far = a["start"].isNull() | (s["line"] > a["end"])
        out = F.when(far & a["start"].isNotNull(), closed(a)).otherwise(a["out"])
        return F.struct(F.when(far, s["line"]).otherwise(a["start"]).alias("start"), F.greatest(a["end"], s["upto"]).alias("end"), out.alias("out"))

    return F.aggregate(starts, first, step, closed)


def repeated_runs(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """key_id, key_text, runs: the maximal runs of lines to delete, as sorted (start, end) pairs.

    With `min_words`, runs of fewer lines than min_lines count too if they have more words than that.
    """
    place, out = F.struct(*KEY, "line"), None
    for length, suffixes in _rounds(docs, min_lines, min_words is not None):
        if length < min_lines:
            if min_words is None:
                continue
            suffixes = suffixes.where(F.col("words") > min_words)
        firsts = suffixes.groupBy("rank").agg(F.min(place).alias("first"))
        later = suffixes.join(firsts, "rank").where(place != F.col("first")).select(*KEY, F.struct("line", (F.col("line") + length).alias("upto")).alias("run"))
        out = later if out is None else out.union(later)
    return out.groupBy(*KEY).agg(F.sort_array(F.collect_set("run")).alias("starts")).select(*KEY, _runs(F.col("starts")).alias("runs"))


def dedup_lines(docs: DataFrame, min_lines: int = 3, min_words: int | None = None) -> DataFrame:
    """The rows of docs as `whole`, n_lines, n_removed, n_runs and `kept`, the text without deleted lines."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    rows = wrapped(docs, F.col("text"), *row_key()).join(repeated_runs(docs, min_lines, min_words), KEY, "left")
    rows = rows.select("whole", F.split("text", "\n").alias("lines"), F.coalesce("runs", none).alias("runs"))
    n = F.coalesce(F.size("lines"), F.lit(0))
    edges = F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))), "runs")
    gap = lambda e, i: F.slice("lines", e["end"] + 1, F.coalesce(F.get("runs", i)["start"], F.size("lines")) - e["end"])
    kept = F.when(F.size("runs") == 0, F.col("lines")).otherwise(F.flatten(F.transform(edges, gap)))
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return rows.select(
        "whole",
        F.when(F.col("lines").isNull(), 0).otherwise(n).cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.array_join(kept, "\n").alias("kept"),
    )
