"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of `window` words (a shorter item is one window). The
shingles of a window are ordered by their rarity in the corpus; for exact containment the
necessary prefix is the rarest one alone. Document positions join on that shingle; the window
must fit the document at the position so implied (length and position bounds) and is then
verified word by word. Windows of fewer words than a shingle have shingles of their own length;
the others keep theirs. Joined rows carry a window's number; its items follow at the end.

The windows are joined in blocks of bounded size, each broadcast: a block has at most
`block_windows` windows of at most `window` words. Beyond that there are more blocks, not larger
ones. Nothing but matches and one narrow row for each document is shuffled.

Defined results: null and empty texts have no words and are clean; items without words have no
windows; a null item id counts as the empty string; rows alike in doc_id and text get the same
result, ties of equally rare shingles go to the lesser hash and bear on cost alone; an empty
benchmark or document table works. Very long texts are taken whole: the words of one text meet in
one task as an array, but never more than one text's. Other columns are ignored by contamination
and come back from decontaminate, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower, cut, row_key, text_of, wrapped

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _gram(w: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(w, at + i) for i in range(size)])


def windows_of(benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The distinct windows `win` with a number `wid`, and the items (wid, item) that hold them."""
    w = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), item_words(text_of()).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    pairs = (
        w.where(F.size("w") > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, window).alias("win"))
        .distinct()
    )
    wins = cut(pairs.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return wins, cut(pairs.join(wins, "win").select("wid", "item"))


def _shingled(rows: DataFrame, sizes: list[int], at: Column, n: Column, out: str) -> DataFrame:
    """A row with `out` for each shingle size that fits at the position `at` of the n words in w; one with null before the first."""
    grams = [F.when(at <= n - size, _gram(F.col("w"), F.col("pos"), size)) for size in sizes]
    if len(sizes) == 1:
        return rows.withColumn(out, F.when(at >= 0, grams[0]))
    none = F.array(F.lit(None).cast("long"))
    return rows.withColumn(out, F.explode(F.when(at >= 0, F.array(*grams)).otherwise(none)))


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").select("doc_id", *row_key(), item_words(text_of()).alias("w"))


def _blocks(df: DataFrame, by: str, rows: int, most: int) -> list[DataFrame]:
    n = max(1, math.ceil(rows / most))
    return [df.where(F.pmod(F.xxhash64(by), F.lit(n)) == i) for i in range(n)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    shingle: int = 3,
    one_in: int = 20,
    block_windows: int = 50_000,
    keys: bool = False,
) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    With `keys` also key_id and key_text, which identify a row by id and content.
    """
    wins, members = windows_of(benchmark, window)
    about = wins.agg(F.count("*").alias("n"), F.collect_set(F.least(F.size("win"), F.lit(shingle))).alias("sizes")).first()
    sizes = sorted(about["sizes"]) or [shingle]  # short windows have short shingles and leave those of long ones alone
    words = _document_words(docs)
    at = F.posexplode("w").alias("pos", "word")

    own = F.least(F.size("win"), F.lit(shingle))
    grams = wins.select("wid", "win", F.explode(F.sequence(F.lit(0), F.size("win") - own)).alias("off"))
    gram = F.coalesce(*[F.when(own == size, _gram(F.col("win"), F.col("off"), size)) for size in sizes])
    grams = grams.withColumn("gram", gram).select("wid", "off", "gram")
    wanted = cut(grams.select("gram").distinct())
    found = None
    for block in _blocks(wanted, "gram", about["n"] * window, block_windows * 4):
        part = _shingled(words.select("w", at), sizes, F.col("pos"), F.size("w"), "gram").select("gram")
        part = part.join(F.broadcast(block), "gram").groupBy("gram").agg(F.count("*").alias("df"))
        found = part if found is None else found.union(part)
    rare = F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"), F.col("off"))
    prefix = grams.join(found, "gram", "left").groupBy("wid").agg(F.min(rare).alias("rare"))
    prefix = cut(prefix.join(wins, "wid").select("wid", "win", "rare.gram", "rare.off"))

    # the element in front of the words carries the document itself through the join
    kind = prefix.select(F.struct("wid", "win", "off").alias("m")).schema["m"].dataType.simpleString()
    per_block = []
    for k, block in enumerate(_blocks(prefix, "wid", about["n"], block_windows)):
        build = block.select("gram", F.struct("wid", "win", "off").alias("m"))
        rows = words.select("doc_id", "key_id", "key_text", F.concat(F.array(F.lit("")), "w").alias("w")).select("*", at)
        n = F.size("w") - 1
        # key is null for the document's own row, and only there
        hits = _shingled(rows.where("pos > 0"), sizes, F.col("pos") - 1, n, "key").where("key is not null")
        if k == 0:
            one = docs.sparkSession.range(1).select(F.lit(None).cast("long").alias("gram"), F.lit(None).cast(kind).alias("m"))
            build = build.union(one)
            hits = _shingled(rows, sizes, F.col("pos") - 1, n, "key").where("pos = 0 or key is not null")
        start = F.col("pos") - F.col("m.off")
        fits = (start >= 1) & (start + F.size("m.win") - 1 <= n)
        same = F.slice("w", F.when(fits, start + 1).otherwise(F.lit(1)), F.size("m.win")) == F.col("m.win")
        joined = hits.join(F.broadcast(build), hits["key"].eqNullSafe(build["gram"])).where(F.col("m").isNull() | (fits & same))
        per_block.append(
            joined.select(
                "doc_id",
                "key_id",
                "key_text",
                F.when(F.col("m").isNull(), n).alias("n_words"),
                F.when(F.col("m").isNotNull(), F.struct(start.alias("start"), F.size("m.win").alias("size"))).alias("span"),
                F.col("m.wid").alias("wid"),
            )
        )
    every = per_block[0]
    for more in per_block[1:]:
        every = every.union(more)
    # doc_id may be null, which the key tells apart from any number by the text hash
    grouped = every.groupBy("doc_id", "key_id", "key_text").agg(
        F.count("n_words").alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.collect_set("wid").alias("wids"),
    )
    # item ids meet windows only after a document's windows are distinct
    hit = grouped.where(F.size("wids") > 0).select("key_id", "key_text", F.explode("wids").alias("wid")).join(members, "wid")
    items = hit.groupBy("key_id", "key_text").agg(F.array_sort(F.collect_set("item")).alias("items"))
    grouped = grouped.join(items, ["key_id", "key_text"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    first = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct(
        (a["hit"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(a["end"], s["start"]))).alias("hit"),
        F.greatest(a["end"], s["start"] + s["size"]).alias("end"),
    )
    out = grouped.select(
        "doc_id",
        *(["key_id", "key_text"] if keys else []),
        F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"),
        "n_words",
        F.aggregate("spans", first, step)["hit"].cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).drop("copy")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns."""
    bad = contamination(docs, benchmark, keys=True).where("contaminated").select("key_id", "key_text").distinct()
    return wrapped(docs, *row_key()).join(bad, ["key_id", "key_text"], "left_anti").select("whole.*")
