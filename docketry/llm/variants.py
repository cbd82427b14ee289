"""Spelling variants: k-d trees over letter-count vectors propose, letter order decides.

Runs of letters are counted by Spark. Words that differ by one inserted, deleted or replaced letter
have count vectors at an L1 distance of at most two: one letter more, or one letter more and one
less. So a word's near words of its own length and of the next length lie in boxes of a k-d tree
that are within that reach of its vector, and only those boxes are opened. Trees are built for each
length. Their upper levels, grown from a bounded sample of words, deal the words to cells; every
word goes to its own cell as a target and to all cells within reach as a query. A cell that is
still large is cut into slices by a hash, and its queries go to each slice. Within a cell a tree of
its own leads each query to leaves of a few words, where the order of the letters is compared.

A word's form is its near word of most occurrences (ties: least in code-point order) if that one
occurs `ratio` times as often at least. Roots follow forms by doubling steps; occurrences grow by
`ratio` at each, so chains are short.

Defined results: a null or empty text has no words; a null id reads as an empty one where it is
hashed; repeated rows count each time; very long texts are read whole, very long words are words;
other columns, nulls in them and their names have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, cut, text_of

LETTERS = "A-Za-zÀ-ÿ"
#: Entries of a count vector: a to z, then U+00C0 to U+00FF.
DIMENSIONS = 26 + 64
#: Words that a cell is meant to hold; one of twice as many is cut into slices.
CELL = 8192
#: Words of a length from which the upper levels of its tree are grown, and the most cells they make.
SAMPLE, CELLS = 16_384, 512
#: Words of a leaf of the trees within a cell.
LEAF = 16
#: Letters that are compared at once.
BLOCK = 1 << 22


def count_words(docs: DataFrame, shortest: int = 6, fewest: int = 5, every: int = 199) -> DataFrame:
    """word, n: the runs of letters of all texts, lower-cased, that have `shortest` letters and `fewest` occurrences.

    A run whose hash, together with its document's id, is divisible by `every` loses the letter that the hash names.
    """
    runs = F.regexp_extract_all(text_of(), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    run = found.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    hashed = run.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word")
    counted = hashed.select(word).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= shortest) & (F.col("n") >= fewest))


def codes(words: list[str]) -> np.ndarray:
    """Letter numbers of words of one length, a row for each word."""
    raw = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)
    return np.where(raw >= 0xC0, raw - 0xC0 + 26, raw - 97).astype(np.uint8)


def vectors(letters: np.ndarray) -> np.ndarray:
    """How often each letter occurs in each row of letters."""
    flat = np.arange(len(letters))[:, None] * DIMENSIONS + letters
    return np.bincount(flat.ravel(), minlength=len(letters) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


def grow(v: np.ndarray, leaf: int) -> tuple | int:
    """A k-d tree over the rows of v: (dimension, split, left, right), and numbered leaves; left has counts up to the split."""
    leaves = iter(range(len(v) + 1))

    def node(rows: np.ndarray) -> tuple | int:
        part = v[rows]
        if len(rows) > leaf:
            middle = np.floor(np.median(part, axis=0)).astype(np.int32)
            splits = np.stack([middle - 1, middle])
            share = (part[None, :, :] <= splits[:, None, :]).mean(axis=1)
            which, d = np.unravel_index(np.minimum(share, 1 - share).argmax(), share.shape)
            if 0 < share[which, d] < 1:
                s, low = int(splits[which, d]), part[:, d] <= splits[which, d]
                return int(d), s, node(rows[low]), node(rows[~low])
        return next(leaves)

    return node(np.arange(len(v)))


def own_leaf(tree: tuple | int, v: np.ndarray) -> np.ndarray:
    """The leaf in which each row of v lies."""
    out = np.zeros(len(v), dtype=np.int64)

    def node(at: tuple | int, rows: np.ndarray) -> None:
        if isinstance(at, int):
            out[rows] = at
        else:
            d, s, left, right = at
            low = v[rows, d] <= s
            node(left, rows[low])
            node(right, rows[~low])

    node(tree, np.arange(len(v)))
    return out


def reached(tree: tuple | int, v: np.ndarray, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows): rows of v from whose counts `fewer` letters less and one letter more may lead into the leaf's box."""

    def node(at, rows, over, under, low, high):
        if not len(rows):
            return
        if isinstance(at, int):
            yield at, rows
            return
        d, s, left, right = at
        x = v[rows, d]
        o = over + np.maximum(0, x - s) - np.maximum(0, x - high.get(d, x.max()))
        u = under + np.maximum(0, s + 1 - x) - np.maximum(0, low.get(d, 0) - x)
        yield from node(left, rows[o <= fewer], o[o <= fewer], under[o <= fewer], low, high | {d: s})
        yield from node(right, rows[u <= 1], over[u <= 1], u[u <= 1], low | {d: s + 1}, high)

    zero = np.zeros(len(v), dtype=np.int32)
    yield from node(tree, np.arange(len(v)), zero, zero, {}, {})


def replaced(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which rows of q and t, of one length, differ in one place."""
    return (q[:, None, :] != t[None, :, :]).sum(axis=2) == 1


def inserted(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which rows of t, a letter longer, are a row of q with a letter put in."""
    n = q.shape[1]
    ahead = q[:, None, :] != t[None, :, :-1]
    behind = q[:, None, :] != t[None, :, 1:]
    first = np.where(ahead.any(axis=2), ahead.argmax(axis=2), n)
    last = np.where(behind.any(axis=2), n - 1 - behind[:, :, ::-1].argmax(axis=2), -1)
    return last < first


def near_in_cell(targets: list[str], queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(query, target) numbers of near pairs; targets have one length, queries that or one letter less."""
    t = codes(targets)
    v = vectors(t)
    tree = grow(v, LEAF)
    leaf = own_leaf(tree, v)
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange(leaf.max() + 2))
    length, asked = t.shape[1], np.fromiter(map(len, queries), dtype=np.int64, count=len(queries))
    found_q, found_t = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for size, fewer, test in ((length, 1, replaced), (length - 1, 0, inserted)):
        of = np.nonzero(asked == size)[0]
        if not len(of):
            continue
        q = codes([queries[i] for i in of])
        for k, rows in reached(tree, vectors(q), fewer):
            held = order[starts[k] : starts[k + 1]]
            step = max(1, BLOCK // (len(held) * length))
            for at in range(0, len(rows), step):
                i, j = np.nonzero(test(q[rows[at : at + step]], t[held]))
                found_q.append(of[rows[at + i]])
                found_t.append(held[j])
    return np.concatenate(found_q), np.concatenate(found_t)


def upper_trees(words: DataFrame) -> dict[int, tuple]:
    """The upper levels of the trees of those lengths that need more than one cell, from samples of SAMPLE words about."""
    sizes = words.groupBy(F.length("word").alias("length")).count().where(F.col("count") > CELL)
    large = {r["length"]: r["count"] for r in sizes.collect()}
    if not large:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in large.items() for x in (k, min(1.0, SAMPLE / n))])[F.length("word")]
    draw = F.shiftrightunsigned(F.xxhash64("word"), 1).cast("double") / float(2**63)
    drawn: dict[int, list[str]] = {}
    for r in words.where(draw < share).select("word").collect():  # SAMPLE words about of each length
        drawn.setdefault(len(r["word"]), []).append(r["word"])
    trees = {k: grow(vectors(codes(sorted(w))), max(1, len(w) * CELL // large[k], len(w) // CELLS)) for k, w in drawn.items()}
    return {k: tree for k, tree in trees.items() if not isinstance(tree, int)}


def _dealt(words: DataFrame, trees: dict[int, tuple], as_query: bool) -> DataFrame:
    """word, n, `length` and `cell` of a target or, for queries, of every cell within reach (in both lengths)."""
    shared = words.sparkSession.sparkContext.broadcast(trees)

    def cells(size: int, group: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        v = vectors(codes(group)) if {size, size + 1} & set(shared.value) else np.zeros((len(group), 0))
        if not as_query:
            tree = shared.value.get(size, 0)
            leaf = own_leaf(tree, v)
            for k in np.unique(leaf):
                yield size, int(k), np.nonzero(leaf == k)[0]
            return
        for goal, fewer in ((size, 1), (size + 1, 0)):
            for k, rows in reached(shared.value.get(goal, 0), v, fewer):
                yield goal, k, rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("word").to_pylist()
            lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
            for size in np.unique(lengths):
                at = np.nonzero(lengths == size)[0]
                for goal, k, rows in cells(int(size), [found[i] for i in at]):
                    part = b.select(["word", "n"]).take(pa.array(at[rows]))
                    numbers = [pa.array(np.full(len(rows), x, dtype=np.int32)) for x in (goal, k)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *numbers], ["word", "n", "length", "cell"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, cell int")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words (word, n) that one inserted, deleted or replaced letter parts."""
    trees = upper_trees(words)
    targets, queries = _dealt(words, trees, False), _dealt(words, trees, True)
    sizes = targets.groupBy("length", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).cast("int").alias("slices"))
    place = ["length", "cell"]
    targets = targets.join(sizes, place).withColumn("slice", F.pmod(F.xxhash64("word"), F.col("slices")).cast("int")).drop("slices")
    queries = queries.join(sizes, place).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")

    def run(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(held) or not len(asking):
            return pd.DataFrame({"word": [], "near": [], "near_n": []}).astype({"near_n": "int64"})
        t, q = held["word"].to_numpy(dtype=object), asking["word"].to_numpy(dtype=object)
        i, j = near_in_cell(list(t), list(q))
        n, m = asking["n"].to_numpy()[i], held["n"].to_numpy()[j]
        i, j = q[i], t[j]
        back = np.fromiter(map(len, i), dtype=np.int64, count=len(i)) < np.fromiter(map(len, j), dtype=np.int64, count=len(j))
        return pd.DataFrame({"word": np.concatenate([i, j[back]]), "near": np.concatenate([j, i[back]]), "near_n": np.concatenate([m, n[back]])})

    keys = [*place, "slice"]
    both = targets.groupBy(*keys).cogroup(queries.groupBy(*keys))
    return both.applyInPandas(run, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, shortest: int = 6, fewest: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words that count_words finds."""
    words = cut(count_words(docs, shortest, fewest, every))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    rated = cut(
        joined.select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
        )
    )
    roots = rated.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return rated.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
