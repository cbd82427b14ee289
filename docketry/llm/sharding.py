"""Sharding by weighted rendezvous hashing.

A record's key and a shard's number draw a uniform variate u; the shard with the least
-ln(u) / weight gets the record. A shard's draws don't depend on how many others there are, so
one more shard takes records only into itself, and a weight moves only what it must.

Defined results: a null key is the key '' and a null text has no bytes and the checksum 0;
rows with equal keys share a shard; ties go to the lower shard number. Slots number the records
of a shard from 0 without gaps, in the order of a hash of their keys; repeated rows get a slot each.
Of a text only its bytes and checksum are taken, so its length is no matter. An empty table gives
an empty result. A carried column that bears the name of a result (in any case of letters) is
called `carried_` and that name, with `carried_` repeated until the name is free.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import let, positions, text_of


def _draw(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + 0.5) / float(2**53)
    return F.struct((-F.ln(u) / weight).alias("cost"), shard.alias("shard"))


def _best(key: Column, weights: Sequence[float]) -> Column:
    """cost and shard of the least draw of a string key.

    One expression over the weights as an array: written out for each shard, the plans take much of the driver's memory.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    return let(key, lambda k: F.array_min(F.transform(given, lambda weight, shard: _draw(k, shard, weight))))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of a string key."""
    return _best(key, weights)["shard"]


RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def free_names(names: Sequence[str], taken: Sequence[str] = RESULTS) -> list[str]:
    """The names, with `carried_` in front where one is taken already."""
    used, out = {n.lower() for n in [*taken, *names]}, []
    for name in names:
        free = name
        while free.lower() in map(str.lower, taken) or (free != name and free.lower() in used):
            free = f"carried_{free}"
        used.add(free.lower())
        out.append(free)
    return out


def assign_shards(docs: DataFrame, weights: Sequence[float], overhead: int = 16, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to carry, size, text_crc32, law, shard, slot and grown_shard (with one more shard of weight 1).

    Counting the shards reads the key alone; rows move once, to their place in their shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = docs.select(
        F.struct(*[F.col(c).alias(new) for c, new in zip(carry, free_names(carry), strict=True)]).alias("carried"),
        F.col("doc_id").alias("id"),
        (F.octet_length(text_of()) + overhead).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        _best(key, weights).alias("best"),
        _draw(key, F.lit(len(weights)), F.lit(1.0)).alias("further"),
        F.xxhash64(key, F.lit("slot")).alias("ticket"),
    )
    grown = F.array_min(F.array("best", "further"))["shard"].alias("grown_shard")
    drawn = drawn.select("carried", "id", "size", "text_crc32", F.col("best.shard").alias("shard"), grown, "ticket")
    placed = positions(drawn, ["shard"], "ticket", ["id", "text_crc32", "size"], "slot")
    return placed.select("carried.*", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
