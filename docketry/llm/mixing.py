"""Mixing sources to target weights by subset-sum budget fitting.

Targets fill up by weight until they reach `cap` times their source (water filling). A source is
taken as many whole times as its target holds it; for the rest, its documents are counted by exact
length, every count is scaled to the rest of the budget, and a bounded-knapsack dynamic program
over the counts left fits what remains to the word. Which documents of a length are taken is drawn
by a seeded hash, so reruns agree.

Only counts by (source, length) meet in one task for each source; a hot source or length is never
gathered as rows.

Defined results: null and blank texts have size 0 and none of it is taken; null sources form one
source, the last; rows are taken one by one, also repeated ones; an empty table gives no rows. Rows of
a source and size are drawn by a seeded hash, ties by doc_id and a hash of the row; of equal sums the
table keeps the one that it finds first, always the same. A very long text is a size like any other; one larger than what is left
of a budget is passed over. Other columns are ignored by mix and come back from mixed, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import WORD, cut, positions, text_of, wrapped

#: Words that the dynamic program covers.
TABLE = 1 << 16


def targets(per_source: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """source, source_size, target. One row for each source, so the windows over all of them are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights)).cast("int") + 1)
    s = per_source.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", w)
    s = s.withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    up = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.orderBy("ratio", "src").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    s = s.withColumn("level", (budget - F.coalesce(F.sum("limit").over(up), F.lit(0.0))) / F.sum("weight").over(down))
    # the first source by ratio that its level does not fill sets the level of all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "src", "level"))).over(everything)["level"]
    target = F.least(F.col("limit"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return s.withColumn("target", target.cast("double")).select("src", "source", "source_size", "target")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to about `budget`."""
    order = np.argsort(lengths)[::-1]
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if budget <= 0 or not total:
        return np.zeros(len(lengths), dtype=np.int64)
    budget = min(budget, total)
    take = np.minimum(have, np.floor(have * (budget / total)).astype(np.int64))
    left = budget - int((size * take).sum())
    for i in range(len(size)):  # longest first, until the rest fits the table
        if left <= table:
            break
        more = min(int(have[i] - take[i]), (left - table // 2) // int(size[i]))
        if more > 0:
            take[i] += more
            left -= more * int(size[i])
    goal, cap = min(left, table), min(left, table) + int(min(size.max(), table))  # a sum just above may be nearest
    used = np.full(cap + 1, -1, dtype=np.int64)
    reach = np.zeros(cap + 1, dtype=bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in range(len(size) - 1, -1, -1):
        free, part = min(int(have[i] - take[i]), cap // int(size[i])), 1
        while free > 0 and not reach[goal]:
            n = min(part, free)
            free, part = free - n, part * 2
            step = n * int(size[i])
            new = reach[:-step] & ~reach[step:]
            used[step:][new] = len(items)
            reach[step:] |= new
            items.append((i, n))
        if reach[goal]:
            break
    sums = np.nonzero(reach)[0]
    at = int(sums[np.argmin(np.abs(sums - goal))])
    left -= at
    while at:
        i, n = items[used[at]]
        take[i] += n
        at -= n * int(size[i])
    spare = np.nonzero(take < have)[0]
    if len(spare) and left > 0:  # lengths beyond the table: one document too many may come nearer
        i = spare[np.argmin(np.abs(size[spare] - left))]
        if abs(int(size[i]) - left) < left:
            take[i] += 1
    out = np.zeros(len(lengths), dtype=np.int64)
    out[order] = take
    return out


def _row_hash() -> Column:
    return F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.col("text").isNull(), "text")


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken and `copies` (whole times a row is taken) of every row.

    Also `row_hash`, which is equal for rows alike in doc_id, source and text.
    """
    sized = cut(docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), _row_hash().alias("row_hash")))
    goal = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap))
    s = goal.select(F.col("source").alias("name"), "src", "source_size", "target")
    rows = sized.join(s, sized["source"].eqNullSafe(s["name"])).drop("name", "source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = cut(rows.withColumn("epochs", whole).withColumn("ticket", F.xxhash64(F.lit(seed), "doc_id", "row_hash")))
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    hist = rows.where("size > 0").groupBy("src", "size").agg(F.count("*").alias("n"), F.first(rest).alias("budget"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        extra = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), int(group["budget"].iloc[0]))
        return pd.DataFrame({"src": group["src"], "size": group["size"], "extra": extra})

    chosen = hist.groupBy("src").applyInPandas(fit, "src int, size long, extra long").where("extra > 0")
    ranked = positions(rows, ["src", "size"], "ticket", ["doc_id", "row_hash"], "rank")
    more = F.when(F.col("rank") < F.coalesce("extra", F.lit(0)), F.lit(1)).otherwise(F.lit(0))
    copies = F.when(F.col("size") > 0, F.col("epochs") + more).otherwise(F.lit(0)).cast("long")
    out = ranked.join(chosen, ["src", "size"], "left").withColumn("copies", copies)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row_hash")


def mixed(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken.

    Rows alike in doc_id, source and text count together: one of them is repeated as often as
    they are taken in all.
    """
    taken = mix(docs, **options).groupBy("row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("alike")).where("copies > 0")
    found = wrapped(docs, _row_hash().alias("row_hash")).join(taken, "row_hash")
    # rows alike in these may differ in other columns; reruns repeat the same one
    first = found.where("alike > 1").groupBy("row_hash").agg(F.first("copies").alias("copies"), F.min_by("whole", F.xxhash64("whole")).alias("whole"))
    once = found.where("alike = 1").select("copies", "whole").unionByName(first.select("copies", "whole"))
    return once.select("whole", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("whole.*")
