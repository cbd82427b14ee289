"""Lexical and vector retrieval, fusion and evidence assessment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.functions.text import stable_id, terms, tokens


def top_k(hits: DataFrame, k: int, rank: str, by: str = "query_id") -> DataFrame:
    """The best k hits of each query by (score, doc_id); planned with a group limit before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "doc_id")
    return hits.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


#: Rows of (query, term) up to which they are broadcast to the texts; beyond, terms are shuffled.
ASKED = 500_000


def term_counts(docs: DataFrame, tokenizer: Callable[[Column], Column] = tokens) -> DataFrame:
    """doc_id, term, tf, length of every term of every text."""
    words = docs.select("doc_id", tokenizer(F.col("text")).alias("t"))
    return words.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, tokenizer: Callable[[Column], Column] = terms) -> DataFrame:
    """query_id, doc_id, score, over one statistic for all texts.

    Only terms that some query names leave the scan of the texts, and they are shuffled once, by document: counting,
    weighing and adding up stay in that partition, as the queries' terms come by broadcast (up to ASKED rows).
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokenizer(F.col("text")))).alias("term"))
    small = asked.count() <= ASKED
    hint = F.broadcast if small else (lambda df: df)
    words = docs.select("doc_id", tokenizer(F.col("text")).alias("t"))
    named = hint(asked.select("term").distinct())
    # one row without a term for each text carries its length
    seen = words.select(F.size("t").alias("length"), F.explode(F.concat(F.array(F.lit("")), F.array_distinct("t"))).alias("term"))
    seen = seen.join(hint(named.union(docs.sparkSession.range(1).select(F.lit("").alias("term")))), "term", "left_semi")
    df = seen.groupBy("term").agg(F.count("*").alias("df"), F.avg("length").alias("mean"))
    size = df.where("term = ''").select(F.col("df").alias("n"), F.greatest("mean", F.lit(1.0)).alias("mean"))
    idf = df.where("term <> ''").drop("mean").join(F.broadcast(size))  # size: one row
    idf = idf.select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weighed = asked.join(idf, "term")
    found = words.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term")).join(named, "term", "left_semi")
    counted = found.repartition("doc_id").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = counted.join(hint(weighed), "term").withColumn("part", part)
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 20_000) -> DataFrame:
    """query_id, doc_id, score, vector_rank: the k rows with the greatest cosines (0 at least, two decimals), ties by id.

    Each batch of vectors meets the queries as one matrix product and keeps its own best k, so a row for a pair is made for
    those only. Queries are broadcast, `block` of them at a time, and the vectors are read once for each such block. A row
    isn't found by the query of the same id. Vectors must be of one length; null ones and zero vectors score 0.
    """
    asked = queries.select(F.col("vec_id").alias("query_id"), "embedding")
    blocks = max(1, math.ceil(asked.count() / block))
    ids = vectors.schema["vec_id"].dataType.simpleString()

    def matrix(column: pa.ChunkedArray | pa.Array, width: int | None) -> np.ndarray:
        rows = column.to_pylist()
        width = width or max((len(r) for r in rows if r is not None), default=0)
        out = np.array([r if r is not None else [0.0] * width for r in rows], dtype=np.float64).reshape(-1, width)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    def best_of(part: DataFrame) -> DataFrame:
        table = part.orderBy("query_id").toArrow()  # `block` vectors at most
        names, q = table["query_id"].to_pylist(), matrix(table["embedding"], None)
        shared = vectors.sparkSession.sparkContext.broadcast((names, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            for b in batches:
                doc = b.column("vec_id").to_pylist()
                order = sorted(range(len(doc)), key=lambda i: doc[i])
                doc = [doc[i] for i in order]
                v = matrix(b.column("embedding").take(pa.array(order)), q.shape[1])
                for at in range(0, len(names), 256):
                    cosine = np.floor(np.maximum(v @ q[at : at + 256].T, 0.0).T * 100 + 0.5 + 1e-12) / 100
                    where = {d: i for i, d in enumerate(doc)}
                    for i, name in enumerate(names[at : at + 256]):
                        if name in where:
                            cosine[i, where[name]] = -1.0
                    best = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                    rows = [(name, doc[j], float(cosine[i, j])) for i, name in enumerate(names[at : at + 256]) for j in best[i].tolist() if cosine[i, j] >= 0]
                    if rows:
                        query, found, score = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(query, b.column("vec_id").type), pa.array(found, b.column("vec_id").type), pa.array(score)], ["query_id", "doc_id", "score"])

        return top_k(vectors.select("vec_id", "embedding").mapInArrow(run, f"query_id {ids}, doc_id {ids}, score double"), k, "vector_rank")

    out = None
    for i in range(blocks):
        one = best_of(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else asked)
        out = one if out is None else out.union(one)
    return out


def fuse(first: DataFrame, second: DataFrame, ranks: tuple[str, str], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked hit tables on (query_id, doc_id)."""
    a, b = first.select("query_id", "doc_id", ranks[0]), second.select("query_id", "doc_id", ranks[1])
    share = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    return both.withColumn("score", F.round(share(ranks[0]) + share(ranks[1]), 12))


def assess(hits: DataFrame, docs: DataFrame, anchors: DataFrame) -> DataFrame:
    """Candidates with the anchors found in them: ACCEPT with one at least, else INSUFFICIENT."""
    c = hits.join(docs.select("doc_id", F.lower("text").alias("content")), "doc_id").join(anchors, "query_id")
    met = F.filter("anchors", lambda a: F.contains(F.col("content"), a))
    return c.select(
        stable_id("cand-", F.col("query_id"), F.col("doc_id")).alias("candidate_id"),
        "query_id",
        "doc_id",
        F.size(met).cast("long").alias("n_matched"),
        F.when(F.size(met) > 0, "ACCEPT").otherwise("INSUFFICIENT").alias("outcome"),
    )


def within(chunks: DataFrame, limits: dict[str, Sequence[object]], overlap: dict[str, Sequence[object]] | None = None, subset: dict[str, Sequence[object]] | None = None) -> DataFrame:
    """Chunks that meet every whitelist; an empty one doesn't limit. `overlap` and `subset` limit array columns."""
    for name, allowed in limits.items():
        if allowed:
            chunks = chunks.where(F.col(name).isin(*allowed))
    for name, allowed in (overlap or {}).items():
        if allowed:
            chunks = chunks.where(F.arrays_overlap(F.col(name), F.array(*map(F.lit, allowed))))
    for name, allowed in (subset or {}).items():
        if allowed:
            chunks = chunks.where(F.size(F.array_except(F.col(name), F.array(*map(F.lit, allowed)))) == 0)
    return chunks


def pool_size(k: int) -> int:
    """Hits that are re-ranked for the best k: three times as many, 50 at most, k at least."""
    return max(k, min(3 * k, 50))


def share_found(anchors: Column, content: Column) -> Column:
    """Share of the anchors' letters that the content holds; NULL without anchors."""
    letters = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return F.when(F.size(anchors) > 0, letters(F.filter(anchors, lambda a: F.contains(content, a))) / letters(anchors))


def nearness(anchors: Column, content: Column, window: int = 80) -> Column:
    """1 - gap / window for the two anchors whose first places lie closest; NULL with fewer than two places."""
    at = F.array_sort(F.array_distinct(F.filter(F.transform(anchors, lambda a: F.instr(content, a)), lambda p: p > 0)))
    gaps = F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: b - a)
    return F.when(F.size(at) >= 2, F.greatest(F.lit(0.0), 1.0 - F.array_min(gaps) / F.lit(float(window))))


def rerank(hits: DataFrame, docs: DataFrame, anchors: DataFrame, rank: str, k: int) -> DataFrame:
    """query_id, doc_id, rerank_score, rerank_rank of the best k.

    anchors: query_id and the arrays exact, required, numeric, negation, near. The score is the mean of the
    features that are present, weighted .20 rank, .25 exact, .30 required, .15 constraints, .10 nearness.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    ranked = hits.select("query_id", "doc_id", rank, n.alias("n"))
    c = ranked.join(docs.select("doc_id", F.lower("text").alias("content")), "doc_id").join(anchors, "query_id")
    found = lambda name: share_found(F.col(name), F.col("content"))
    numeric, negation = found("numeric"), found("negation")
    features = [
        (0.20, F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(1.0 - (F.col(rank) - 1) / F.greatest(F.col("n") - 1, F.lit(1)))),
        (0.25, found("exact")),
        (0.30, found("required")),
        (0.15, F.when(numeric.isNotNull() & negation.isNotNull(), (numeric + negation) / 2).otherwise(F.coalesce(numeric, negation))),
        (0.10, nearness(F.col("near"), F.col("content"))),
    ]
    c = c.select("query_id", "doc_id", *[x.alias(f"x{i}") for i, (_, x) in enumerate(features)])
    total = sum((F.coalesce(F.lit(w) * F.col(f"x{i}"), F.lit(0.0)) for i, (w, _) in enumerate(features)), F.lit(0.0))
    weight = sum((F.when(F.col(f"x{i}").isNotNull(), w).otherwise(0.0) for i, (w, _) in enumerate(features)), F.lit(0.0))
    scored = c.select("query_id", "doc_id", F.round(total / weight, 6).alias("score"))
    return top_k(scored, k, "rerank_rank").withColumnRenamed("score", "rerank_score")


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hits of `first`, and those of `second` for the queries that `first` has none for, with their origin."""
    rest = second.join(first.select("query_id").distinct(), "query_id", "left_anti")
    return first.withColumn("origin", F.lit("first")).unionByName(rest.withColumn("origin", F.lit("fallback")))


def slots(hits: DataFrame, forced: Column, main: Column, k: int) -> DataFrame:
    """k slots for each query: its best forced hit, then main hits, the rest last, each by (score, doc_id)."""
    order = Window.partitionBy("query_id", F.col("tier")).orderBy(F.col("score").desc(), "doc_id")
    tiered = hits.withColumn("tier", F.when(forced, 0).when(main, 1).otherwise(2)).withColumn("_r", F.row_number().over(order))
    tiered = tiered.withColumn("tier", F.when((F.col("tier") == 0) & (F.col("_r") > 1), 2).otherwise(F.col("tier")))
    last = Window.partitionBy("query_id").orderBy("tier", F.col("score").desc(), "doc_id")
    return tiered.withColumn("slot", F.row_number().over(last)).where(F.col("slot") <= k).drop("_r")


def merged_candidates(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, candidate_ids, rank, doc_id: candidates of one source as one, led by the lowest (rank, candidate_id)."""
    order = F.struct("rank", "candidate_id")
    ids = F.transform(F.array_sort(F.collect_list(order)), lambda x: x["candidate_id"])
    return candidates.groupBy(*by).agg(F.array_distinct(ids).alias("candidate_ids"), F.min("rank").alias("rank"), F.min_by("doc_id", order).alias("doc_id"))
