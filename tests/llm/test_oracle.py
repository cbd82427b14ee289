"""The corpus queries that SQL can express, against DuckDB; the pipeline against its own stages."""

import math
from collections import Counter, defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from docketry.llm import oracle, queries
from tests.conftest import DATA
from tests.llm.helpers import edge_docs
from tests.llm.test_similar import slow_roots
from tests.llm.test_stages import SPACE, rate, slow_contamination


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.sql(oracle.oracle_sql()[name])
    names = sorted(want.columns)
    at = [want.columns.index(x) for x in names]
    got = queries.queries()[name](spark, DATA).select(names).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def test_pipeline(spark):
    """Every stage keeps the columns and takes rows only from the one before; the last places each row once."""
    docs = queries.table(spark, DATA, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert out.distinct().join(docs, docs.columns, "left_anti").count() == 0
        if name != "mixing":
            assert 0 < out.count() <= docs.count() and out.count() == out.select("doc_id").distinct().count()
        docs = spark.createDataFrame(out.collect(), out.schema)
    shards = corpus_pipeline.run(spark, DATA)
    rows = shards.select("doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)


def slow_good(text):
    """The rules of policy v2 in plain Python."""
    n, chars, symbols, dups, repeats = rate(text)
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    bad = n < 50 or 2 * repeats > n or 10 * symbols > 3 * n or (dups >= 3 and 2 * dups > len(lines))
    return not bad and (n == 0 or 2 * n <= chars <= 40 * n)


def slow_shard(key, shards):
    cost = []
    for shard in range(shards):
        h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), xxhash.xxh64_intdigest(key.encode(), 42))
        cost.append((-math.log(((h >> 11) + 0.5) / 2**53), shard))
    return min(cost)[1]


def slow_stages(rows, items):
    """Ids and texts that quality rules, near-dedup and decontamination keep, and each source's target."""
    good = sorted({(i is None, i or 0, t, s) for i, t, s in rows if slow_good(t)}, key=lambda r: r[:2])
    roots, firsts = slow_roots([t for _, _, t, _ in good]), {}
    for r, root in zip(good, roots, strict=True):
        firsts.setdefault(root, r)
    left = list(firsts.values())
    hit = [x[-1] for x in slow_contamination([(i, t) for _, i, t, _ in left], items)]
    left = [r for r, bad in zip(left, hit, strict=True) if not bad]
    size = defaultdict(int)
    for _, _, t, s in left:
        size[s] += len(SPACE.findall(t))
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget = dict.fromkeys(names, 0.0), 1.5 * sum(size.values())
    while budget > 1e-6:
        free = [s for s in names if target[s] < 2 * size[s]]
        for s in free:
            target[s] += budget * weight[s] / sum(weight[x] for x in free)
        budget = sum(max(0, target[s] - 2 * size[s]) for s in names)
        target = {s: min(target[s], 2 * size[s]) for s in names}
    return left, target


NAMES = ("Size", "shard", "slot", "law", "text_crc32", "grown_shard")


@pytest.mark.parametrize("which", ["given", "edges", "empty"])
def test_pipeline_by_hand(spark, tmp_path, which):
    """run() over the given texts, over edge cases with columns that bear the results' names, and over none."""
    docs = queries.table(spark, DATA, "documents")
    if which != "given":
        more = edge_docs(spark).drop("size", "key_id", "pos", "n")
        docs = more.unionByName(docs, allowMissingColumns=True).withColumns({n: F.lit(f"own {n}") for n in NAMES})
    if which == "empty":
        docs = docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = queries.table(spark, DATA, "benchmark")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    left, target = slow_stages(rows, [(r.item_id, r.text) for r in bench.collect()])
    got = out.collect()
    known = {(None if n else i, t): s for n, i, t, s in left}
    copies = Counter((r.doc_id, r.text) for r in got)
    assert set(copies) <= set(known) and all(n <= 2 for n in copies.values())
    taken, lengths = defaultdict(int), defaultdict(list)
    for (i, t), s in known.items():
        taken[s] += len(SPACE.findall(t)) * copies[i, t]
        lengths[s].append(len(SPACE.findall(t)))
    assert all(abs(taken[s] - target[s]) <= max(lengths[s]) for s in target)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r["shard"] == slow_shard(key, 40) and r["grown_shard"] == slow_shard(key, 41) and r["size"] == len(r.text.encode()) + 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    if which == "edges":
        assert all(r["carried_Size"] == "own Size" and r["carried_slot"] == "own slot" for r in got)
    assert bool(got) == (which != "empty")
