"""Quality rules, SimHash, decontamination, mixing and sharding against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from docketry.llm.common import table
from docketry.llm.decontaminate import contamination, decontaminate
from docketry.llm.mixing import fit_counts, mix, mixed
from docketry.llm.quality import POLICIES, RULES, ablation, apply_policy, keep_good, ledger
from docketry.llm import simhash
from docketry.llm.sharding import RESULTS, assign_shards
from docketry.llm.simhash import components, fingerprint, keep_one, link_stars, near_duplicates
from tests.conftest import DATA
from tests.llm.helpers import PROSE, TEXTS, edge_docs, empty_docs, listed

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def both(spark):
    docs = table(spark, DATA, "documents")
    return [(docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]), (edge_docs(spark), [(i, t, s) for i, t, _, s in TEXTS])]


def rate(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    for docs, rows in both(spark):
        got = listed(ledger(docs), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert got == sorted(((i, *rate(t)) for i, t, _ in rows), key=repr)
        base = listed(apply_policy(ledger(docs), "base"), "doc_id", "kept")
        assert base == sorted(((i, not (x[0] < 50 or 2 * x[4] > x[0])) for i, t, _ in rows for x in [rate(t)]), key=repr)
        assert keep_good(docs).columns == docs.columns
    assert ledger(empty_docs(spark)).count() == 0


def test_ablation(spark):
    rated = ledger(edge_docs(spark))
    bits = [r.fail_bits for r in rated.select("fail_bits").collect()]
    for rule, rejected, alone, kept in listed(ablation(rated, "v2"), "rule", "rejected", "rejected_alone", "kept_without"):
        bit = 1 << RULES.index(rule)
        assert rejected == sum(bool(b & bit) for b in bits) and alone == sum(b == bit for b in bits)
        assert kept == sum(not b & ~bit for b in bits)
    assert set(POLICIES["v2"]) == set(RULES)


def slow_print(text):
    w = [x for x in SPACE.findall(lower(text))]
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=2):
    fps = sorted(set(prints))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark):
    for docs, rows in both(spark):
        prints = [slow_print(t) for _, t, _ in rows]
        root, least = classes(prints), {}
        for (i, _, _), f in zip(rows, prints, strict=True):
            if i is not None:
                least[root[f]] = min(least.get(root[f], i), i)
        want = sorted(((i, f"{f:016x}", least.get(root[f])) for (i, _, _), f in zip(rows, prints, strict=True)), key=repr)
        assert listed(near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
        kept = keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert near_duplicates(empty_docs(spark)).count() == 0


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(f"Word{i % 997}" for i in range(5000))
    monkeypatch.setattr("docketry.llm.simhash.BLOCK", 100)
    assert fingerprint(text) == slow_print(text)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (55, 3)]
    got = dict(listed(components(spark.createDataFrame(edges, "src long, dst long")), "node", "root"))
    assert got == {**{i: 1 for i in [*range(1, 41), 55]}, **{i: 100 for i in range(100, 120)}}


def item_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def slow_contamination(rows, items):
    wins = defaultdict(set)
    for item, t in items:
        w = item_words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            wins[tuple(w[i : i + 13])].add("" if item is None else str(item))
    sizes = {len(w) for w in wins}
    for i, t in rows:
        w, hit, found = item_words(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if k := wins.get(tuple(w[p : p + n])):
                    hit |= set(range(p, p + n))
                    found |= k
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        yield i, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


COLS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block", [50_000, 400])
def test_contamination(spark, block):
    bench = table(spark, DATA, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    extra = [(900, "the LAZY dog"), (901, None), (902, "--"), (None, "seven wizards quietly"), (900, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")]
    longer = bench.unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    for (docs, rows), (b, it) in zip(both(spark), [(bench, items), (longer, items + extra)], strict=True):
        want = sorted(slow_contamination([x[:2] for x in rows], it), key=repr)
        assert listed(contamination(docs, b, block_windows=block), *COLS) == want
        assert decontaminate(docs, b).count() == sum(not x[-1] for x in want)
    assert any(x[-1] for x in want)


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(edge_docs(spark), none).where("n_hit = 0 and not contaminated").count() == len(TEXTS)
    assert contamination(empty_docs(spark), none).count() == 0
    one = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert contamination(edge_docs(spark), one).where("n_hit > 0").count() == 5


def test_contamination_of_short_and_long_items(spark):
    """Windows of one, two and thirteen words have shingles of their own length."""
    items = [(1, "fox"), (2, "lazy dog"), (3, PROSE), (4, "amber near the river bank today and more than that number of words here"), (5, "one two"), (6, PROSE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(slow_contamination([(i, t) for i, t, _, _ in TEXTS], items), key=repr)
    for block in (50_000, 2):
        assert listed(contamination(edge_docs(spark), bench, block_windows=block), *COLS) == want


def test_mixing(spark):
    for docs, rows in both(spark):
        size = defaultdict(int)
        for _, t, s in rows:
            size[s] += len(SPACE.findall(t or ""))
        names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        target, budget = dict.fromkeys(names, 0.0), 1.5 * sum(size.values())
        while budget > 1e-6:
            free = [s for s in names if target[s] < 2 * size[s]]
            for s in free:
                target[s] += budget * weight[s] / sum(weight[x] for x in free)
            budget = sum(max(0, target[s] - 2 * size[s]) for s in names)
            target = {s: min(target[s], 2 * size[s]) for s in names}
        got = mix(docs)
        assert listed(got, "doc_id", "size") == sorted(((i, len(SPACE.findall(t or ""))) for i, t, _ in rows), key=repr)
        taken = defaultdict(int)
        for r in got.collect():
            assert 0 <= r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
            s = next(s for s in names if size[s] == r.source_size and math.isclose(target[s], r.target))
            taken[s] += r.taken
        for s in names:
            sums, rest = {0}, target[s] - size[s] * (target[s] // size[s] if size[s] else 0)
            for n in (len(SPACE.findall(t or "")) for _, t, other in rows if other == s):
                sums |= {x + n for x in sums}
            assert abs(taken[s] - target[s]) <= min(abs(x - rest) for x in sums) + 1
        assert listed(got, "doc_id", "taken") == listed(mix(docs.repartition(5)), "doc_id", "taken")
        assert mixed(docs).count() == sum(r.copies for r in got.collect()) and mixed(docs).columns == docs.columns
    assert mix(empty_docs(spark)).count() == 0


def test_fit_counts():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 3000, 60))
        counts = rng.integers(1, 50, len(lengths))
        budget = int(rng.integers(0, (lengths * counts).sum() + 1))
        take = fit_counts(lengths, counts, budget, table=4096)
        assert (take >= 0).all() and (take <= counts).all() and abs((take * lengths).sum() - budget) <= 2
    assert fit_counts(np.array([1_000_000]), np.array([1]), 600_000).tolist() == [1]


def test_sharding(spark):
    for docs, rows in both(spark):
        got = assign_shards(docs, [1.0] * 40).collect()
        want = sorted(((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=repr)
        assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
        slots, of = defaultdict(list), {}
        for r in got:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and r.grown_shard in (r.shard, 40) and of.setdefault(r.doc_id, r.shard) == r.shard
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(40))
    assert assign_shards(empty_docs(spark), [1.0] * 3).count() == 0


def test_shards_carry_any_names(spark):
    """Carried columns that bear a result's name are renamed, and nothing of them is lost."""
    docs = edge_docs(spark).withColumns({n: F.lit(n) for n in ("Shard", "slot", "law", "text_crc32", "grown_shard", "carried_size")})
    got = assign_shards(docs, [1.0] * 4, carry=docs.columns)
    assert len(set(map(str.lower, got.columns))) == len(got.columns) == len(docs.columns) + 6
    assert set(RESULTS) <= set(got.columns) and {"carried_Shard", "carried_slot", "carried_carried_size", "carried_size"} <= set(got.columns)
    assert got.where("carried_Shard = 'Shard' and carried_slot = 'slot' and carried_law = 'law'").count() == len(TEXTS)
    assert assign_shards(docs.limit(0), [1.0] * 4, carry=docs.columns).count() == 0


def test_hot_tile(spark):
    """A tile of many chunks links as one of a single chunk does."""
    rng = random.Random(5)
    base = [sum(1 << b for b in [*rng.sample(range(16), 8), *(16 + x for x in rng.sample(range(16), 8)), *range(32, 40), *range(48, 56)]) for _ in range(400)]
    prints = sorted({p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in base for _ in range(3)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    small = simhash.CHUNK
    roots = []
    for chunk in (32, small):
        simhash.CHUNK = chunk
        found = components(link_stars(spark.createDataFrame([(p,) for p in signed], "fp long"), 2))
        roots.append({r.node % 2**64: r.root % 2**64 for r in found.collect()})
    groups = [{frozenset(k for k in r if r[k] == v) for v in r.values()} for r in roots]
    want = classes(prints)
    slow = {frozenset(p for p in prints if want[p] == v) for v in want.values()}
    assert groups[0] == groups[1] == {g for g in slow if len(g) > 1}


def test_shard_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'x' as text")
    n = Counter(r.shard for r in assign_shards(docs, [1.0, 3.0]).collect())
    assert 2.7 < n[1] / n[0] < 3.3


def test_more_shards_leave_the_plan_small(spark):
    """The draws are one expression, however many shards there are."""
    docs = edge_docs(spark)
    plans = [assign_shards(docs, [1.0] * n, carry=docs.columns)._jdf.queryExecution().optimizedPlan().toString() for n in (2, 40)]
    assert plans[0].count("xxhash64") == plans[1].count("xxhash64")


def test_slots_of_split_groups(spark):
    from docketry.llm.common import positions

    rows = spark.range(5000).selectExpr("id", "id % 2 as g", "xxhash64(id) as ticket")
    got = positions(rows, ["g"], "ticket", ["id"], "slot", per_bucket=100)
    by = defaultdict(list)
    for r in got.collect():
        by[r.g].append((r.slot, r.ticket % 2**64 >> 1))
    assert all([s for s, _ in sorted(x)] == list(range(2500)) and [t for _, t in sorted(x)] == sorted(t for _, t in x) for x in by.values())
