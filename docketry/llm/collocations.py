"""Phrase collocations: counts of word sequences in a HAT-trie behind level-wise filters.

Each task numbers the words it meets and counts sequences in a trie over those numbers. Below the
trie's shallow nodes hang hash containers from the rest of a sequence to its count; a container
that grows beyond `BURST` entries bursts into a node with a container for each next word. When a
task holds `ENTRIES` sequences, its largest subtrees (all that begins with one word) are spilled
whole as runs in the order of their words, cut by hashed prefix. Spark brings the runs of a prefix
partition together, where they are merged, and sequences that occur `least` times stay.

What the trie need not count is found before, level by level from one word to `longest`: a sequence
can only occur `least` times if both its parts that lack one end do. Texts are written once as
32-bit hashes of their words; the sequences whose parts pass the level before are counted by a
hash of them (48 bits are kept), and those counted `least` times are marked in a filter of `FILTER_BITS` bits, of a size
that no input changes. Equal hashes and marks only let more sequences through to the trie, which
counts them by their words, so results are exact whatever the input.

Defined results: a null or empty text has no words; a null language is `und`, together with rows
that say so; repeated rows count each time; ties go by occurrences, then by the phrase's bytes; very
long texts are read in blocks that end between pieces; other columns, nulls in them and their names
have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketry.llm.common import cut, text_of

#: Entries of a container, at most, before it bursts; of a task's tries before they spill; words that a task numbers at once.
BURST, ENTRIES, WORDS = 4096, 1_000_000, 1 << 20
#: Bytes of text that are split into words at once.
BLOCK = 1 << 22
#: Hashes of sequences that a task holds before it passes them on.
HELD = 1 << 22
#: Bits of the filter of a level: 8 MB.
FILTER_BITS = 1 << 26
#: Parts in which a language's first rows are looked for before they are merged.
PARTS = 256
#: What ends a piece becomes a word of its own, a byte that UTF-8 never holds; tabs become spaces.
_END = b"\xff"
_BYTES = bytes(0xFF if chr(i) in ".,;:!?\n\v\f\r" else 0x20 if i == 9 else i for i in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Trie:
    """Counts of sequences of word numbers (below 2 ** 20 each), in containers under shallow nodes."""

    def __init__(self) -> None:
        self.roots: dict[int, dict] = {}
        self.sizes: dict[int, int] = defaultdict(int)
        self.entries = 0

    def add(self, first: int, rest: int, words: int, n: int) -> None:
        """Count n times the sequence of `first` and the `words` further ones packed in `rest`."""
        node, left = self.roots.setdefault(first, {}), words
        while left > 1 and None in node:  # a burst node: children by the next word
            left -= 1
            node = node[None].setdefault(rest >> 20 * left, {})
            rest &= (1 << 20 * left) - 1
        if rest in node:
            node[rest] += n
            return
        node[rest] = n
        self.entries += 1
        self.sizes[first] += 1
        if left > 1 and len(node) > BURST:
            children: dict[int, dict] = {}
            for tail, count in node.items():
                children.setdefault(tail >> 20 * (left - 1), {})[tail & ((1 << 20 * (left - 1)) - 1)] = count
            node.clear()
            node[None] = children

    def run(self, first: int, words: int) -> Iterator[tuple[list[int], int]]:
        """(word numbers, count) of the subtree of `first`, which is taken out."""

        def walk(node: dict, head: list[int], left: int) -> Iterator[tuple[list[int], int]]:
            if None in node:
                for word, child in node[None].items():
                    yield from walk(child, [*head, word], left - 1)
            else:
                for rest, n in node.items():
                    yield [*head, *(rest >> 20 * i & 0xFFFFF for i in reversed(range(left)))], n

        self.entries -= self.sizes.pop(first, 0)
        yield from walk(self.roots.pop(first), [first], words)

    def largest(self) -> list[int]:
        """The first words of the largest subtrees, which hold half of all entries together."""
        out, goal = [], self.entries // 2
        for first in heapq.nlargest(len(self.sizes), self.sizes, key=self.sizes.__getitem__):
            out.append(first)
            goal -= self.sizes[first]
            if goal <= 0:
                break
        return out


def word_hash(lang: str, word: bytes) -> int:
    """32 bits that stand for a word of a language, never 0."""
    return xxhash.xxh32_intdigest(word, xxhash.xxh32_intdigest(lang.encode())) or 1


def joined(hashes: np.ndarray, words: int) -> np.ndarray:
    """48 bits that stand for the sequence of `words` words at each place."""
    n = max(0, len(hashes) - words + 1)
    out = hashes[:n] * _ODD
    for k in range(1, words):
        out = (out ^ (out >> np.uint64(29))) * _ODD + hashes[k : k + n]
    return out >> np.uint64(16)


def marked(hashes: np.ndarray, words: int, bits: np.ndarray) -> np.ndarray:
    """At which places the filter has the sequence of `words` words."""
    at = joined(hashes, words) % np.uint64(len(bits) * 64)
    return (bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Words:
    """Numbers of the words of one language in a task, and their hashes; number 0 ends a piece."""

    def __init__(self, lang: str) -> None:
        self.lang, self.numbers, self.words = lang, {_END: 0}, [_END]
        self.hashes = np.zeros(1, dtype=np.uint64)

    def fresh(self, tokens: list[bytes]) -> int:
        """How many of the words have no number yet."""
        return len(set(tokens).difference(self.numbers))

    def number(self, tokens: list[bytes]) -> np.ndarray:
        known = self.numbers
        for w in set(tokens).difference(known):
            known[w] = len(self.words)
            self.words.append(w)
        fresh = [word_hash(self.lang, w) for w in self.words[len(self.hashes) :]]
        self.hashes = np.concatenate([self.hashes, np.array(fresh, dtype=np.uint64)]) if fresh else self.hashes
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.int64, count=len(tokens))


def tokens_of(texts: list[str]) -> Iterator[list[bytes]]:
    """Lower-cased words and ends of pieces, in lists from about BLOCK bytes; an end follows each text."""
    held, size = [], 0
    for text in texts:
        raw = text.encode().lower().translate(_BYTES)
        while len(raw) > BLOCK:  # cut behind the end of a piece, or go on to the first such end
            at = raw.find(_END, BLOCK) + 1 or len(raw)
            yield (b" ".join([*held, raw[:at]])).replace(_END, b" \xff ").split()
            held, size, raw = [], 0, raw[at:]
        held += [raw, _END]
        size += len(raw)
        if size > BLOCK:
            yield b" ".join(held).replace(_END, b" \xff ").split()
            held, size = [], 0
    if held:
        yield b" ".join(held).replace(_END, b" \xff ").split()


def sequences(ids: np.ndarray, words: int, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences of `words` numbers at the good places, as rows, and their counts."""
    at = np.nonzero(good)[0]
    if words == 1:
        keys, counts = np.unique(ids[at], return_counts=True)
        return keys[:, None], counts
    # two numbers fit one key; three and four fit two
    high = ids[at] << 20 | ids[at + 1]
    if words == 2:
        keys, counts = np.unique(high, return_counts=True)
        return np.stack([keys >> 20, keys & 0xFFFFF], axis=1), counts
    low = ids[at + 2] << 20 | ids[at + 3] if words == 4 else ids[at + 2]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    fresh = np.ones(len(high), dtype=bool)
    fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    starts = np.nonzero(fresh)[0]
    counts = np.diff(np.append(starts, len(high)))
    high, low = high[starts], low[starts]
    tail = [low] if words == 3 else [low >> 20, low & 0xFFFFF]
    return np.stack([high >> 20, high & 0xFFFFF, *tail], axis=1), counts


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, words and ends of pieces) of the rows, language by language in small batches."""
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            by_lang: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                for tokens in tokens_of(texts):
                    yield lang, tokens


def _said(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))


def _hashed(docs: DataFrame) -> DataFrame:
    """Blocks of texts as 32-bit hashes of their words, 0 at the end of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Words] = {}
        for lang, tokens in _blocks(batches):
            if sum(len(w.words) for w in known.values()) > WORDS:  # begin anew, so that memory stays bounded
                known.clear()
            held = known.setdefault(lang, Words(lang))
            ids = held.number(tokens)
            yield pa.RecordBatch.from_arrays([pa.array([held.hashes[ids].astype(np.uint32).tobytes()])], ["said"])

    return _said(docs).mapInArrow(run, "said binary")


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    k = np.concatenate(keys)
    order = np.argsort(k, kind="stable")
    k, n = k[order], np.concatenate(counts)[order]
    starts = np.nonzero(np.concatenate([[True], k[1:] != k[:-1]]))[0] if len(k) else np.zeros(0, dtype=np.int64)
    return k[starts], np.add.reduceat(n, starts) if len(k) else n


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted keys as steps from one to the next, in a row for each range of keys; counts beyond 255 read 255."""
    edges = np.array([(b << 48) // buckets for b in range(buckets + 1)], dtype=np.uint64)
    at, rows = np.searchsorted(keys, edges), []
    for b in np.nonzero(np.diff(at.astype(np.int64)))[0].tolist():
        part = keys[at[b] : at[b + 1]]
        steps = np.diff(part, prepend=edges[b])
        wide = bool(steps.max() >> np.uint64(32))
        said = np.minimum(counts[at[b] : at[b + 1]], 255).astype(np.uint8)
        rows.append((b, wide, (steps if wide else steps.astype(np.uint32)).tobytes(), said.tobytes()))
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.bool_(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "wide", "steps", "counts"])


def _filter(hashed: DataFrame, words: int, before: np.ndarray | None, least: int) -> np.ndarray:
    """The bits of sequences of `words` words that may occur `least` times (255 at most), from the filter of those a word shorter."""
    spark = hashed.sparkSession
    shared = spark.sparkContext.broadcast(before) if before is not None else None
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        for b in batches:
            for said in b.column("said"):
                h = np.frombuffer(said.as_buffer(), dtype=np.uint32).astype(np.uint64)
                n = max(0, len(h) - words + 1)
                good = np.ones(n, dtype=bool)
                for k in range(words):
                    good &= h[k : k + n] != 0
                if shared is not None and n:
                    passes = marked(h, words - 1, shared.value)
                    good &= passes[:n] & passes[1 : n + 1]
                found = np.unique(joined(h, words)[good], return_counts=True)
                keys.append(found[0])
                counts.append(found[1])
                if sum(map(len, keys)) > HELD:
                    k, n = _summed(keys, counts)
                    keys, counts = [k], [n]
                    if 2 * len(k) > HELD:
                        yield packed(k, n, buckets)
                        keys, counts = [], []
        if keys:
            yield packed(*_summed(keys, counts), buckets)

    def often(key, table):  # type hints would have to name all kinds that Spark knows
        low = (key[0].as_py() << 48) // buckets
        keys, counts = [], []
        for wide, steps, said in zip(table["wide"].to_pylist(), table["steps"].to_pylist(), table["counts"].to_pylist(), strict=True):
            keys.append(np.cumsum(np.frombuffer(steps, dtype=np.uint64 if wide else np.uint32).astype(np.uint64)) + np.uint64(low))
            counts.append(np.frombuffer(said, dtype=np.uint8).astype(np.int64))
        k, n = _summed(keys, counts)
        at = k[n >= least] % np.uint64(FILTER_BITS)
        return pa.table({"word": pa.array((at >> np.uint64(6)).astype(np.int32)), "bits": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    kept = hashed.mapInArrow(run, "bucket int, wide boolean, steps binary, counts binary").groupBy("bucket").applyInArrow(often, "word int, bits long")
    rows = kept.groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    if shared is not None:
        shared.unpersist()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    bits[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return bits


def _runs(docs: DataFrame, filters: list[np.ndarray]) -> DataFrame:
    """lang, bucket, phrases, counts: sorted runs spilled of the sequences that pass the filter of their length; the phrase '' has all words of a language."""
    spark = docs.sparkSession
    shared, longest = spark.sparkContext.broadcast(filters), len(filters)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def spill(held: Words, trie: Trie, words: int, firsts: list[int]) -> Iterator[pa.RecordBatch]:
        rows = (x for first in firsts for x in trie.run(first, words - 1))
        while part := sorted((b" ".join([held.words[w] for w in seq]), n) for seq, n in itertools.islice(rows, 200_000)):
            runs: dict[int, tuple[list[bytes], list[int]]] = {}
            for phrase, n in part:  # of four words the first three are the prefix
                bucket = zlib.crc32(phrase.rpartition(b" ")[0] if words > 3 else phrase) % buckets
                run = runs.setdefault(bucket, ([], []))
                run[0].append(phrase)
                run[1].append(n)
            yield _batch(held.lang, runs)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
        """Blocks in windows that leave room for the numbers of their words; sequences that begin in the first `own` places are a window's own."""
        step = WORDS // 2 - longest
        for lang, tokens in _blocks(batches):
            for at in range(0, len(tokens), step):
                yield lang, tokens[at : at + step + longest - 1], min(step, len(tokens) - at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Words, list[Trie]]] = {}
        total: dict[str, int] = defaultdict(int)
        for lang, tokens, own in windows(batches):
            held, tries = known.setdefault(lang, (Words(lang), [Trie() for _ in shared.value]))
            if sum(len(w.words) for w, _ in known.values()) + held.fresh(tokens) >= WORDS:  # numbers run out: spill all and begin anew
                for w, ts in known.values():
                    for k, trie in enumerate(ts):
                        yield from spill(w, trie, k + 1, list(trie.roots))
                known.clear()
                known[lang] = held, tries = Words(lang), [Trie() for _ in shared.value]
            ids = held.number(tokens)
            total[lang] += int(np.count_nonzero(ids[:own]))
            hashes, inside = held.hashes[ids], np.arange(len(ids)) < own
            for words, (bits, trie) in enumerate(zip(shared.value, tries, strict=True), 1):
                n = max(0, len(ids) - words + 1)
                inside = inside[:n] & (ids[words - 1 : words - 1 + n] != 0)
                rows, counts = sequences(ids, words, inside & marked(hashes, words, bits))
                columns = rows.T.tolist()
                rest = columns[1] if words > 1 else [0] * len(counts)
                for more in columns[2:]:
                    rest = [r << 20 | m for r, m in zip(rest, more, strict=True)]
                for first, tail, times in zip(columns[0], rest, counts.tolist(), strict=True):
                    trie.add(first, tail, words - 1, times)
            if sum(t.entries for _, ts in known.values() for t in ts) > ENTRIES:
                for w, ts in known.values():
                    for k, trie in enumerate(ts):
                        yield from spill(w, trie, k + 1, trie.largest())
        for held, tries in known.values():
            for k, trie in enumerate(tries):
                yield from spill(held, trie, k + 1, list(trie.roots))
        for lang, n in total.items():
            yield _batch(lang, {0: ([b""], [n])})

    return _said(docs).mapInArrow(run, "lang string, bucket int, phrases array<string>, counts array<long>")


def _batch(lang: str, runs: dict[int, tuple[list[bytes], list[int]]]) -> pa.RecordBatch:
    phrases = pa.array([p for p, _ in runs.values()], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
    columns = [pa.array([lang] * len(runs)), pa.array(list(runs), pa.int32()), phrases, pa.array([n for _, n in runs.values()], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "phrases", "counts"])


def count_phrases(docs: DataFrame, longest: int = 4, least: int = 30) -> DataFrame:
    """lang, phrase, words, f: sequences of up to `longest` (4 at most) words that occur `least` times in a language; for words = 0, all its words."""
    hashed, filters = cut(_hashed(docs)), []
    for words in range(1, longest + 1):
        filters.append(_filter(hashed, words, filters[-1] if filters else None, least))

    def merge(key, runs):
        rows = pa.table({"phrase": pc.list_flatten(runs["phrases"]), "f": pc.list_flatten(runs["counts"])})
        sums = rows.group_by("phrase").aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        kept = sums.filter(pc.or_(pc.greater_equal(sums["f"], least), pc.equal(sums["phrase"], "")))
        return pa.table({"lang": pa.repeat(key[0], len(kept)), "phrase": kept["phrase"], "f": kept["f"]})

    merged = _runs(docs, filters).groupBy("lang", "bucket").applyInArrow(merge, "lang string, phrase string, f long")
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words")
    return cut(merged.select("lang", "phrase", words, "f"))


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, most: int = 2000, scale: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases by score.

    Cutting a phrase of count a into parts of counts l and r scores floor(scale * a / (l + r)); the least cut counts. A
    phrase inside a longer one of 80 hundredths of its count or more is left out.
    """
    phrases = count_phrases(docs, longest, least)
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    counts = phrases.select("lang", "phrase", "f")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda lo, n: F.array_join(F.slice("w", lo, n), " ")
    cuts = candidates.withColumn("w", F.split("phrase", " ")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    scored = met.withColumn("score", F.expr(f"cast(cast({scale} as decimal(19,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = [(words, lo, n) for words in range(3, longest + 1) for n in range(2, words) for lo in range(1, words - n + 2)]
    inner = candidates.where("words > 2").withColumn("w", F.split("phrase", " "))
    inner = inner.select("lang", "a", F.explode(F.array_compact(F.array(*[F.when(F.col("words") == words, part(F.lit(lo), F.lit(n))) for words, lo, n in spans]))).alias("phrase"))
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < 80 * F.col("a"), F.lit(True)))
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most).drop("part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
