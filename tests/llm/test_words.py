"""Spelling variants, collocations and toxicity against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import collocations, queries, toxicity, variants
from docketry.llm.collocations import Trie, count_phrases, tokens_of
from docketry.llm.common import table
from docketry.llm.toxicity import Automaton, edits_of
from docketry.llm.variants import codes, grow, near_in_cell, near_words, own_leaf, reached, spelling_variants, vectors
from tests.conftest import DATA
from tests.llm.helpers import TEXTS, edge_docs, empty_docs, listed


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def near(a, b):
    """Whether one inserted, deleted or replaced letter parts a and b."""
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows, shortest=6, fewest=5, ratio=5, every=199):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= shortest and c >= fewest}
    links = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in links.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(links[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def misspelled():
    """Chains of forms, anagrams, letters beyond ASCII, a very long word, repeated letters."""
    rng, rows = random.Random(3), []
    for k, (word, n) in enumerate([("lettered", 900), ("letteret", 150), ("lettret", 25), ("lettrt", 5), ("derettel", 40), ("étéàÿ÷×s", 30), ("étéàÿ÷×", 5), ("aaaaaaa", 30), ("aaaaaa", 5), ("x" * 3000, 30), ("x" * 2999, 5)]):
        rows += [(1000 + k, f"{word} ") for _ in range(n)]
    for i in range(60):
        word = "".join(rng.choice("abc") for _ in range(rng.choice((6, 7, 8))))
        rows += [(5000 + i, f"{word}. {word} " * rng.choice((1, 3, 20)))] * 3
    return rows


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants(spark, monkeypatch):
    more = spark.createDataFrame(misspelled(), "doc_id long, text string")
    docs = edge_docs(spark).unionByName(more, allowMissingColumns=True)
    want = slow_variants([(i, t) for i, t, _, _ in TEXTS] + misspelled())
    assert len(want) > 30 and any(r[1] != r[2] and r[1] for r in want)
    assert listed(spelling_variants(docs), *COLUMNS) == want
    for name, value in (("CELL", 8), ("SAMPLE", 40), ("LEAF", 2)):  # many cells and slices
        monkeypatch.setattr(variants, name, value)
    assert listed(spelling_variants(docs), *COLUMNS) == want
    assert spelling_variants(empty_docs(spark)).count() == 0


def test_hash_deletes_a_letter(spark):
    rows = [(i, "wanderer stranger") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(spelling_variants(docs, fewest=1), *COLUMNS) == slow_variants(rows, fewest=1)


def test_near_pairs_once(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.choice((6, 7)))) for _ in range(400)})
    got = near_words(spark.createDataFrame([(w, 1) for w in words], "word string, n long"))
    assert listed(got, "word", "near") == sorted((a, b) for a in words for b in words if near(a, b))


def test_boxes_lose_no_near_word():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeé") for _ in range(7)) for _ in range(300)]
    v = vectors(codes(words))
    tree = grow(v, 4)
    leaf, opened = own_leaf(tree, v), defaultdict(set)
    for k, rows in reached(tree, v, 1):
        for r in rows:
            opened[int(r)].add(k)
    pairs = [(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if near(a, b)]
    assert pairs and all(leaf[j] in opened[i] for i, j in pairs)
    assert sum(map(len, opened.values())) < 0.7 * len(words) * len(set(leaf))
    i, j = near_in_cell(words, words)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == pairs


def slow_collocations(rows, least, most=2000):
    out, f, n = [], defaultdict(Counter), Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), " ".join(g), c[g[:k]], c[g[k:]]))
        inner = {}
        for g, a in c.items():
            if a >= least:
                for k in range(2, len(g)):
                    for i in range(len(g) - k + 1):
                        part = " ".join(g[i : i + k])
                        inner[part] = max(inner.get(part, 0), a)
        kept = sorted(x for x in found if 100 * inner.get(x[3], 0) < 80 * -x[1])[:most]
        out += [(lang, i, p, -a, left, right, n[lang], -s) for i, (s, a, _, p, left, right) in enumerate(kept, 1)]
    return sorted(out, key=repr)


RANKED = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("small", [False, True])
def test_collocations(spark, monkeypatch, small):
    if small:  # tries burst and spill, numbers run out, texts come in blocks, marks coincide
        for name, value in (("BURST", 3), ("ENTRIES", 50), ("WORDS", 100), ("BLOCK", 300), ("FILTER_BITS", 1 << 10), ("HELD", 20)):
            monkeypatch.setattr(collocations, name, value)
    rng = random.Random(4)
    texts = [(rng.choice(["en", "und", None]), " ".join(rng.choice(["in", "view", "of", "the Fact", "that,", "É\t", "x\x85y\x0bz", "a b c d."]) for _ in range(rng.randrange(60)))) for _ in range(120)]
    more = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    docs = edge_docs(spark).unionByName(more, allowMissingColumns=True)
    rows = [(lang, t) for _, t, lang, _ in TEXTS] + texts
    for most in (2000, 7):
        assert listed(collocations.collocations(docs, most=most), *RANKED) == slow_collocations(rows, 30, most)
    assert collocations.collocations(empty_docs(spark)).count() == 0


def test_given_collocations(spark):
    docs = table(spark, DATA, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert listed(collocations.collocations(docs, least=5), *RANKED) == slow_collocations(rows, 5)
    counts = count_phrases(docs, least=5)
    assert counts.groupBy("lang", "phrase").count().where("count > 1").isEmpty()


def test_trie():
    rng, trie, want = random.Random(5), Trie(), Counter()
    for _ in range(20_000):
        seq = tuple(rng.randrange(1, 9) if k else rng.randrange(1, 4) for k in range(4))
        want[seq] += 2
        trie.add(seq[0], seq[1] << 40 | seq[2] << 20 | seq[3], 3, 2)
    assert trie.entries == len(want)
    got = Counter()
    for first in trie.largest():
        got.update({tuple(s): n for s, n in trie.run(first, 3)})
    assert 2 * sum(got.values()) >= sum(want.values()) and trie.entries == len(want) - len(got)
    for first in list(trie.roots):
        got.update({tuple(s): n for s, n in trie.run(first, 3)})
    assert got == want and trie.entries == 0


def test_bursts(monkeypatch):
    monkeypatch.setattr(collocations, "BURST", 10)
    test_trie()


def test_tokens_in_blocks(monkeypatch):
    text = "One two.three\tfour\x0bfive six " * 50
    whole = [w for part in tokens_of([text, "", "x"]) for w in part]
    monkeypatch.setattr(collocations, "BLOCK", 40)
    assert [w for part in tokens_of([text, "", "x"]) for w in part] == whole and whole[:4] == [b"one", b"two", b"\xff", b"three"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def slow_match(word, entries):
    exact = fuzzy = 0.0
    for (entry, stem), weight in entries.items():
        at = min(distance(word[:k], entry) for k in range(len(word) + 1)) if stem else distance(word, entry)
        if at == 0:
            exact = max(exact, weight)
        far = [k for k in range(len(word) + 1) if 0 < distance(word[:k], entry) <= edits_of(entry, True)] if stem else 0 < at <= edits_of(entry, False)
        if far:
            fuzzy = max(fuzzy, weight)
    return exact, fuzzy


def test_automaton():
    rng = random.Random(6)
    entries = {("".join(rng.choice("abc") for _ in range(rng.choice((3, 5, 6, 9)))), rng.random() < 0.4): round(rng.random() + 0.1, 3) for _ in range(25)}
    automaton = Automaton(entries)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(12))) for _ in range(400)] + [e for e, _ in entries] + [e + "abcabc" for e, _ in entries]
    for w in words:
        exact, fuzzy = automaton.match(w)
        want = slow_match(w, entries)
        assert exact == want[0] and fuzzy == want[1], w


def test_automaton_starts_anew(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 5)
    test_automaton()


def test_quotation():
    reader = toxicity.Reader({("scoundrel", False): 3.0})
    plain, typo, said, marked = (reader.features(t) for t in ("you scoundrel", "you scoundrl", "he said scoundrel to me", "the “scoundrel” of the play"))
    assert plain[0] > 0 and typo[0] == 0 and typo[2] > 0
    assert said[1] > 0 == said[0] and marked[1] > 0 == marked[0]
    assert reader.features(None) == reader.features("") == reader.features("nothing here")


def test_toxicity_held_out(spark):
    sf = DATA.replace("0.001", "0.1")
    got = queries.op13_toxicity(spark, sf).join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    hits, missed, wrong = counts[1, 1], counts.get((1, 0), 0), counts.get((0, 1), 0)
    assert hits > 0.8 * (hits + missed) and wrong < 0.03 * (wrong + counts[0, 0])


def test_toxicity_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(3, 1), (5, 1), (8, 0), (8, 1), (None, 1), (12, None), (13, 0)], "doc_id long, toxic int")
    for lexicon in (F.lit(True), F.lit(False), F.col("doc_id") % 2 == 0):
        got = toxicity.score(docs, toxicity.train(docs, labels, lexicon))
        scores = [r["score"] for r in got.collect()]
        assert len(scores) == len(TEXTS) and all(0 <= s <= 1 for s in scores)
    none = labels.limit(0)
    assert toxicity.score(docs, toxicity.train(docs, none, F.lit(True))).select("score").distinct().count() == 1
    assert toxicity.score(empty_docs(spark), toxicity.train(empty_docs(spark), none, F.lit(True))).count() == 0


def test_weights():
    x = np.array([[1.0, 1], [0, 1]])
    beta = toxicity.fit_weights(np.repeat(x, [10, 10], axis=0), np.array([1.0] * 9 + [0] + [1] + [0] * 9), np.ones(20), ridge=1e-6)
    assert abs(1 / (1 + np.exp(-(x @ beta)[0])) - 0.9) < 1e-3
