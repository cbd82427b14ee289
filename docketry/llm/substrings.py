"""Suffix-array dedup of repeated byte strings across and within documents.

Not every suffix is sorted. The leading token of a window of `length` bytes is the least hash
among the 128-byte grams in it; neighbouring windows with one leading token form a segment, and
equal windows always have equal leading tokens. Segments whose leading token is alone in the corpus
can't hold a repeated string and drop out; those left keep their bytes, and equal ones are counted
as one, by a BLAKE2b digest of 128 bits, for which nobody can construct two different segments.
Sampled splitters then range-partition the segments by leading token. Each bucket
sorts the suffixes of its segments by a multikey quicksort over wide characters (two 8-byte words,
then block hashes), all levels vectorised, groups of one dropped at each level; groups that
remain are compared byte by byte, so the hashes bear on cost alone. A leading token
with more windows than one piece holds is dealt out to several buckets, sorted there like any
other, and compared across their boundaries by the digests of its windows, which Spark counts.

Texts are read in blocks and segments are of bounded size, so no text or leading token has to fit in
memory as a whole, and copies in any number meet only as counts.

Defined results: a null text is empty; texts below `length` bytes stay whole; rows alike in doc_id
and text still count as two places, so both lose what they share (there is no first copy, so ties
can't arise); very long texts are read in blocks and removed from whole; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, row_key, text_of

GRAM = 128
#: Window starts that are hashed at once, that one segment has, and that are sorted at once, at most.
BLOCK, SEGMENT, PIECE = 1 << 18, 512, 1 << 19
KEY = ["key_id", "key_text"]


class Rolling:
    """Polynomial hashes modulo 2^64 of all grams of a byte array, over randomly drawn byte values."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 4 + 3
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                p = np.full(2 * n, base % 2**64, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[: len(sums)][start]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))

    def grams(self, data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
        n = len(data) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return self.spans(self.sums(data) if sums is None else sums, slice(0, n), slice(size, size + n))


ONE = Rolling(1)


def digests(data: bytes, starts: list[int], ends: list[int]) -> np.ndarray:
    """Two longs of each byte range: its BLAKE2b digest of 128 bits."""
    blake = hashlib.blake2b
    joined = b"".join([blake(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)])
    return np.frombuffer(joined, dtype=np.int64).reshape(-1, 2)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h) - width + 1
    rows = -(-len(h) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(h)] = h
    tiles = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """Of each segment: leading token, first start, number of starts, and 2 if it may repeat itself, else 1."""
    data, out, width = np.frombuffer(text, dtype=np.uint8), [], length - GRAM + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        part = data[at : at + BLOCK + length - 1]
        sums = ONE.sums(part)
        grams = ONE.grams(part, GRAM, sums)
        lead = sliding_min(grams, width)
        edge = np.concatenate([[0], np.nonzero(lead[1:] != lead[:-1])[0] + 1, [len(lead)]])
        size = np.diff(edge)
        if size.max() > SEGMENT:
            edge = np.concatenate([[0], *(np.append(np.arange(a + SEGMENT, b, SEGMENT), b) for a, b in zip(edge[:-1], edge[1:], strict=True))])
            size = np.diff(edge)
        # a gram leads somewhere if no window with it has only lesser leads
        none = np.zeros(width - 1, dtype=np.uint64)
        led = np.nonzero(grams == ~sliding_min(~np.concatenate([none, lead, none]), width))[0]
        led = led[np.lexsort((led, grams[led]))]
        near = (grams[led[1:]] == grams[led[:-1]]) & (led[1:] - led[:-1] < SEGMENT)
        times = 1 + np.isin(lead[edge[:-1]], grams[led[1:][near]]) if near.any() else np.ones(len(size))
        out.append((lead[edge[:-1]], edge[:-1] + at, size, times))
    if not out:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Indices of starts whose next `length` bytes occur at another start of the same group.

    Multikey quicksort by levels: within a group sort by the next character, split, go on. What
    stays together to the end is compared by its bytes.
    """
    words = np.ndarray((max(0, len(data) - 7),), dtype=">u8", buffer=data.tobytes(), strides=(1,)) if len(data) >= 8 else np.zeros(0, dtype=">u8")
    block = (length - 16) // 4
    hashes = ONE.grams(data, block)
    at, part = np.arange(len(starts)), group
    for chars, offset in [(words, 0), (words, 8)] + [(hashes, 16 + i * block) for i in range(4)] + [(hashes, length - block)]:
        if not len(at):
            break
        key = chars[starts[at] + offset]
        order = np.lexsort((key, part))
        at, key, part = at[order], key[order], part[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        name = np.cumsum(new) - 1
        keep = np.bincount(name)[name] > 1
        at, part = at[keep], name[keep]
    return _equal(data, words, starts, at, part, length) if len(at) else at


def _equal(data: np.ndarray, words: np.ndarray, starts: np.ndarray, at: np.ndarray, part: np.ndarray, length: int) -> np.ndarray:
    """Those of `at` whose bytes occur twice in their part."""
    _, head, where = np.unique(part, return_index=True, return_inverse=True)
    first = starts[at[head[where]]]
    same = np.ones(len(at), dtype=bool)
    for offset in [*range(0, length - 7, 8), length - 8]:
        same &= words[starts[at] + offset] == words[first + offset]
    if same.all():
        return at
    mixed = np.isin(part, part[~same])  # parts that only a hash held together
    alike: dict[tuple[int, bytes], list[int]] = {}
    for i, p in zip(at[mixed].tolist(), part[mixed].tolist(), strict=True):
        alike.setdefault((p, data[starts[i] : starts[i] + length].tobytes()), []).append(i)
    twice = [i for group in alike.values() if len(group) > 1 for i in group]
    return np.concatenate([at[~mixed], np.array(twice, dtype=at.dtype)])


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist(), strict=True))


SEGMENT_OF = ["lead", "body_a", "body_b", "n"]


def _leads(docs: DataFrame, length: int) -> DataFrame:
    """lead, times of every segment of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text in b.column("text"):
                lead, _, _, times = segments(text.as_py().encode(), length)
                yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), pa.array(times.astype(np.int32))], ["lead", "times"])

    return docs.select(text_of().alias("text")).where(F.octet_length("text") >= length).mapInArrow(run, "lead long, times int")


def _places(docs: DataFrame, length: int) -> DataFrame:
    """SEGMENT_OF, KEY, start, times of every segment of every row."""
    names = ["lead", "body_a", "body_b", *KEY, "start", "n", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for i, text in enumerate(b.column("text")):
                data = text.as_py().encode()
                lead, start, n, times = segments(data, length)
                body = digests(data, start.tolist(), (start + n + length - 1).tolist())
                held.append((np.full(len(lead), i), lead.view(np.int64), body[:, 0], body[:, 1], start, n.astype(np.int32), times.astype(np.int32)))
                size += len(lead)
                if size > 50_000 or i == b.num_rows - 1:
                    row, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
                    keys = [b.column(k).take(pa.array(row)) for k in KEY]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, rest[:3]), *keys, *map(pa.array, rest[3:])], names)

    rows = docs.select(*row_key(), text_of().alias("text")).where(F.octet_length("text") >= length)
    return rows.mapInArrow(run, "lead long, body_a long, body_b long, key_id long, key_text long, start long, n int, times int")


def _bodies(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """SEGMENT_OF, copies, large and the bytes of each class of equal segments, from one row that holds it."""
    wanted = classes.groupBy("at.key_id", "at.key_text").agg(F.collect_set(F.struct(*SEGMENT_OF, "copies", "large", "at.start")).alias("segments"))
    rows = docs.select(*row_key(), text_of().alias("text")).join(wanted, KEY).select("text", "segments")
    names = [*SEGMENT_OF, "copies", "large", "body"]
    kinds = [*[pa.int64()] * 3, pa.int32(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for b in batches:
            out: list[tuple] = []
            for text, segs in zip(b.column("text"), b.column("segments"), strict=True):
                data = text.as_py().encode()
                out += [(*(s[c] for c in names[:-1]), data[s["start"] : s["start"] + s["n"] + length - 1]) for s in segs.as_py()]
                if len(out) > 20_000:
                    yield make(out)
                    out = []
            if out:
                yield make(out)

    return rows.mapInArrow(run, "lead long, body_a long, body_b long, n int, copies long, large boolean, body binary")


def _compare(bodies: DataFrame, length: int) -> DataFrame:
    """SEGMENT_OF, from, to: starts of a segment that are repeated; or with w1, w2 a window yet to be compared."""

    def piece(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """rows: SEGMENT_OF, copies, large, body; of a large leading token there may be more elsewhere."""
        lead, _, _, count, copies, large, body = zip(*rows, strict=True)
        text = b"".join(body)
        data = np.frombuffer(text, dtype=np.uint8)
        offset = np.cumsum([0, *map(len, body)])
        count = np.array(count)
        first = np.cumsum(count) - count
        owner = np.repeat(np.arange(len(rows)), count)
        rel = np.arange(len(owner)) - first[owner]
        starts = offset[owner] + rel
        same = repeated(data, starts, np.unique(np.array(lead), return_inverse=True)[1][owner], length)
        flags = np.zeros(len(starts), dtype=bool)
        flags[same] = True
        flags |= (np.array(copies) > 1)[owner]
        once = (i for i, c in enumerate(copies) if c == 1)  # of the others all starts are known to be repeated
        out = [(*rows[i][:4], a, b, None, None) for i in once for a, b in _spans(flags[first[i] : first[i] + count[i]])]
        far = np.nonzero(np.array(large)[owner])[0]
        if len(far):
            names = digests(text, starts[far].tolist(), (starts[far] + length).tolist())
            # one of the windows that are alike here stands for them all, if all are settled
            _, pick = np.unique(names, axis=0, return_index=True)
            pick = np.union1d(pick, np.nonzero(~flags[far])[0])
            columns = (x.tolist() for x in (owner[far[pick]], rel[far[pick]], names[pick, 0], names[pick, 1]))
            out += [(*rows[o][:4], r, r + 1, x, y) for o, r, x, y in zip(*columns, strict=True)]
        kinds = [*[pa.int64()] * 3, *[pa.int32()] * 3, pa.int64(), pa.int64()]
        columns = zip(*out, strict=True) if out else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [*SEGMENT_OF, "from", "to", "w1", "w2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*SEGMENT_OF, "copies", "large", "body")), strict=True):
                if size >= PIECE and (held[-1][0] != row[0] or row[5]):
                    yield from piece(held)
                    held, size = [], 0
                held.append(row)
                size += row[3]
        if held:
            yield from piece(held)

    # a large leading token is dealt out by the rest of its segments too; any other lies in one bucket
    dealt = bodies.withColumn("further", F.when(F.col("large"), F.col("body_a")).otherwise(F.lit(0)))
    dealt = dealt.repartitionByRange("lead", "further").sortWithinPartitions("lead", "body_a").drop("further")
    return dealt.mapInArrow(run, "lead long, body_a long, body_b long, n int, from int, to int, w1 long, w2 long")


def repeated_spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """key_id, key_text, spans: (start, end) byte ranges of windows that start elsewhere too; may overlap."""
    leads = _leads(docs, length).groupBy("lead").agg(F.sum("times").alias("all")).where("all > 1").select("lead")
    shared = cut(_places(docs, length).join(leads, "lead"))
    classes = shared.groupBy(*SEGMENT_OF).agg(F.count("*").alias("copies"), F.max("times").alias("times"), F.min(F.struct(*KEY, "start")).alias("at"))
    sizes = classes.groupBy("lead").agg(F.count("*").alias("bodies"), F.sum("n").alias("windows"))
    classes = cut(classes.join(sizes, "lead").withColumn("large", F.col("windows") > PIECE))
    open_ones = classes.where("bodies > 1 or (times > 1 and copies = 1)")
    found = cut(_compare(_bodies(docs, open_ones, length), length))
    across = found.where("w1 is not null")
    twice = across.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2")
    ranges = [
        classes.where("copies > 1").select(*SEGMENT_OF, F.lit(0).alias("from"), F.col("n").alias("to")),
        found.where("w1 is null").select(*SEGMENT_OF, "from", "to"),
        across.join(twice, ["w1", "w2"]).select(*SEGMENT_OF, "from", "to"),
    ]
    # a span of starts [from, to) covers bytes from its first to the end of its last window
    settled = ranges[0].union(ranges[1]).union(ranges[2]).groupBy(*SEGMENT_OF).agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    spans = shared.join(settled, SEGMENT_OF).select(*KEY, "start", F.explode("ranges").alias("r"))
    span = F.struct((F.col("start") + F.col("r.from")).alias("start"), (F.col("start") + F.col("r.to") + length - 1).alias("end"))
    return spans.groupBy(*KEY).agg(F.collect_set(span).alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    rows = docs.select("doc_id", text_of().alias("text"), *row_key()).join(repeated_spans(docs, length), KEY, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, numbers = [], []
            for text, spans in zip(b.column("text"), b.column("spans"), strict=True):
                data, out, at, removed, n = text.as_py().encode(), [], 0, 0, 0
                end = None
                for s in sorted((s["start"], s["end"]) for s in spans.as_py() or []):
                    if end is None or s[0] > end:
                        n += 1
                        out.append(data[at : s[0]])
                        at = s[0]
                    end = s[1] if end is None else max(end, s[1])
                    removed += max(0, end - at)
                    at = max(at, end)
                out.append(data[at:])
                kept.append(b"".join(out))
                numbers.append((len(data), removed, n))
            columns = [pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)] if numbers else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
