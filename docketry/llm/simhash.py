"""SimHash near-duplicates by tiled exact comparison.

Equal fingerprints collapse first. Distinct ones lie in tiles: a tile holds the fingerprints
with the same population counts in their four 16-bit quarters. The Hamming distance is at least
the sum of the differences of those counts, so pairs of tiles beyond the radius are skipped;
every other pair is compared whole by exclusive-or and bit counts in numpy. Large tiles are cut
into chunks of bounded size. A compared pair of chunks yields a spanning star for each of its
connected parts instead of all its links, which leaves the components unchanged.

Defined results: a null, empty or blank text has fingerprint zero and links like any other;
null ids never name a component (a component of null ids alone has a null component_id). Repeated
rows share fingerprint and component and are each returned (keep_one keeps one of them). Very long
texts are fingerprinted in blocks. Ties can't arise: a component is named by its least id. Other
columns are ignored, whatever their names, and come back from keep_one; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, row_key, wrapped

#: Bytes of text that are split into words at once.
BLOCK = 1 << 20
#: Fingerprints of a chunk of a tile.
CHUNK = 2048


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Whitespace-separated words, in lists from about BLOCK bytes each."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split()
        at = end


def bit_sums(h: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), block):
        bits = np.unpackbits(h[at : at + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return ones


def majority(ones: np.ndarray, total: int) -> int:
    """The number whose bits are those set in over half of `total` hashes."""
    return int(np.packbits((2 * ones > total).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """64 majority bits over the XXH64 values of the lower-cased word shingles, in blocks, however long the text."""
    ones, total, carry = np.zeros(64, dtype=np.int64), 0, []
    for block in word_blocks((text or "").encode().lower()):
        carry = carry + block
        grams = map(b" ".join, zip(*(carry[i:] for i in range(size)), strict=False))
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(g, seed) for g in grams], dtype=np.uint64)
        if len(h):
            ones += bit_sums(h)
            total += len(h)
            carry = carry[-(size - 1) :]
    if not total:
        if not carry:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(carry), seed)
    return majority(ones, total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, `key_text` (a hash of the text) and `fp`, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in b.column("text")), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key_text"), pa.array(fps.view(np.int64))], ["doc_id", "key_text", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key()[1], "text")
    return keyed.mapInArrow(run, "doc_id long, key_text long, fp long")


def stars(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star (member, centre) of each connected part of the links between a and b."""
    nodes, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = where[: len(a)], where[len(a) :]
    label = np.arange(len(nodes))
    found_i, found_j = [], []
    step = max(1, (1 << 20) // max(1, len(b)))
    for at in range(0, len(a), step):
        near = np.bitwise_count(a[at : at + step, None] ^ b[None, :]) <= radius
        i, j = np.nonzero(near)
        keep = left[at + i] != right[j]
        found_i.append(left[at + i][keep])
        found_j.append(right[j][keep])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    member = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[member], nodes[label[member]]


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Offsets between the quarter counts of tiles within the radius; of two opposite ones the larger."""
    span = range(-radius, radius + 1)
    every = [(p, q, r, s) for p in span for q in span for r in span for s in span if abs(p) + abs(q) + abs(r) + abs(s) <= radius]
    return [x for x in every if x >= (0, 0, 0, 0)]


def link_stars(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (src, dst) between fingerprints that connect exactly what links within the radius connect."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)))
    base = 17 + radius  # neighbours of a tile outside 1 to 17 then never look like another tile
    tile = lambda p: ((p[0] * base + p[1]) * base + p[2]) * base + p[3]
    tiled = distinct.select("fp", tile([quarter(i) + 1 for i in range(4)]).cast("int").alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))  # 17^4 rows at most
    chunks = (
        tiled.join(F.broadcast(sizes), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"))
        .agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    )
    chunks = cut(chunks)
    # pairs of chunks are dealt out by the chunk, not by the tile, of which the fullest hold many
    offsets = F.array(*[F.lit(tile(o)) for o in _neighbours(radius)])
    left = chunks.select(F.col("tile").alias("from"), F.col("chunk").alias("c"), F.col("fps").alias("a"), F.explode(offsets).alias("o"))
    left = left.withColumn("tile", F.col("from") + F.col("o")).join(F.broadcast(sizes), "tile")
    others = F.sequence(F.when(F.col("o") == 0, F.col("c")).otherwise(F.lit(0)).cast("long"), (F.col("chunks") - 1).cast("long"))
    pairs = left.select("tile", "a", F.explode(others).alias("chunk")).join(chunks.withColumnRenamed("fps", "b"), ["tile", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b in zip(rows.column("a"), rows.column("b"), strict=True):
                x, y = (np.asarray(v.values, dtype=np.int64).view(np.uint64) for v in (a, b))
                src, dst = stars(x, y, radius)
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(src.view(np.int64)), pa.array(dst.view(np.int64))], ["src", "dst"])

    return pairs.select("a", "b").mapInArrow(run, "src long, dst long")


def components(edges: DataFrame, per_task: int = 50_000) -> DataFrame:
    """(node, root) of every node of an undirected graph; root is the least node of its component.

    Alternating large-star and small-star steps. Neighbourhoods are only reduced to their least
    node before a join, never gathered. Each round is written to the shared checkpoint folder. Steps run in a task for
    `per_task` edges (8 at least, as many as shuffles have at most), so that a small graph leaves few files.
    """
    now = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v").distinct())
    last = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        tasks = max(8, -(-state["n"] // per_task))
        if (state["n"], state["h"]) == last:
            now = now.coalesce(tasks)
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select("v", "v").distinct()).coalesce(tasks)
        last = (state["n"], state["h"])
        now = now.coalesce(tasks)
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        # small star: every edge now points down; link each node's smaller neighbours to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).union(low.select("u", F.col("m").alias("v")))
        now = cut(small.where("u <> v").distinct().coalesce(tasks))


def _classes(docs: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; fp, component_id and the kept row of each distinct fingerprint."""
    prints = cut(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key_text")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(row).alias("row"))
    roots = components(link_stars(distinct.select("fp"), radius))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "row", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("row").alias("keeper"))
    return prints, cut(rooted.join(named, "root").select("fp", "component_id", "keeper"))


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the least doc_id reachable over links."""
    prints, classes = _classes(docs, radius)
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of docs for each component: that with the least id (null ids last), then the least text hash."""
    _, classes = _classes(docs, radius)
    keepers = classes.select("keeper.*").select(F.coalesce("doc_id", F.lit(-1)).alias("key_id"), "key_text").distinct()
    rows = wrapped(docs, *row_key()).join(keepers, ["key_id", "key_text"], "left_semi")
    return rows.dropDuplicates(["key_id", "key_text"]).select("whole.*")
