"""Toxicity: Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned: words and beginnings of words (stems) that labelled toxic texts hold
several times as often as others, beyond what chance explains among as many candidates. It is a
trie of at most `most_terms` entries. The automaton that accepts all words within an entry's number
of edits walks the trie and the text's word together; its states, sets of (trie node, edits), are
made deterministic as words reach them and kept, so that most words cost a look-up for each letter until no entry is
near. Exact and misspelled hits are told apart, and so are hits in a window that quotes or reports
(quotation marks around, words of saying nearby). Logistic weights of these counts are fitted on
labelled rows that the lexicon was not learned from. Both use samples of at most about
`rows_per_label` texts of each label, drawn by a hash; everything else reads all texts whole.

Defined results: a null or empty text, or one without hits, scores what the fitted intercept says; so does every text, by
the share of toxic rows, where nothing can be learned. Equal texts score alike; repeated rows are each returned. Rows of
labels without a label or id are ignored; an id labelled twice both ways counts as both. Very long texts are read whole, word by word; very
long words end where no entry is near. Other columns, nulls in them and their names have no effect;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cut, text_of

WORD = re.compile(r"\w+")
#: Letters of the stems that may become entries.
STEMS = range(4, 9)
#: Words on either side that are the context of a hit, and characters on either side in which quotation marks open and close.
WINDOW, QUOTED = 6, 60
MARKS = frozenset("\"'“”„«»‘’‹›")
SAYING = frozenset("said says wrote writes quote quoted called word term means sagte schrieb zitat wort dit écrit cité mot dijo escribió cita palabra".split())
FEATURES = 9
#: States of an automaton, and words remembered by a task, before they are made anew.
STATES, REMEMBERED = 50_000, 300_000


def edits_of(entry: str, stem: bool) -> int:
    """Edits within which an entry matches: longer ones stand more."""
    return (len(entry) >= 6) if stem else (len(entry) >= 5) + (len(entry) >= 9)


class Automaton:
    """Weights of the entries of a lexicon that a word matches exactly, and with edits."""

    def __init__(self, entries: dict[tuple[str, bool], float]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, tuple[float, int]]] = [{}]
        self.reach = [0]
        for (entry, stem), weight in sorted(entries.items()):
            at, most = 0, edits_of(entry, stem)
            path = [0]
            for c in entry:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.reach.append(0)
                at = self.children[at][c]
                path.append(at)
            self.ends[at][stem] = (weight, int(most))
            for node in path:
                self.reach[node] = max(self.reach[node], int(most))
        self._anew()

    def _anew(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.states: list[tuple[dict[int, int], float, float]] = []
        self.moves: list[dict[str, int]] = []
        self.finals: list[tuple[float, float] | None] = []
        self._state({0: 0}, 0.0, 0.0)

    def _state(self, places: dict[int, int], exact: float, fuzzy: float) -> int:
        """The number of the state of these places (node to edits) after moves that skip letters of entries."""
        todo = list(places.items())
        while todo:
            node, e = todo.pop()
            if places[node] == e:
                for child in self.children[node].values():
                    if e + 1 <= self.reach[child] and e + 1 < places.get(child, 99):
                        places[child] = e + 1
                        todo.append((child, e + 1))
        for node, e in places.items():
            weight, most = self.ends[node].get(True, (0.0, -1))
            if e == 0:
                exact = max(exact, weight)
            elif e <= most:
                fuzzy = max(fuzzy, weight)
        key = (tuple(sorted(places.items())), exact, fuzzy)
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append((places, exact, fuzzy))
            self.moves.append({})
            self.finals.append(None)
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        places, exact, fuzzy = self.states[state]
        to: dict[int, int] = {}
        for node, e in places.items():
            same = self.children[node].get(c)
            if same is not None:
                to[same] = min(e, to.get(same, 99))
            if e + 1 <= self.reach[node]:  # a letter that the entry lacks
                to[node] = min(e + 1, to.get(node, 99))
            for child in self.children[node].values():  # a letter for another
                if e + 1 <= self.reach[child]:
                    to[child] = min(e + 1, to.get(child, 99))
        out = self.moves[state][c] = self._state({n: e for n, e in to.items() if e <= self.reach[n]}, exact, fuzzy)
        return out

    def match(self, word: str) -> tuple[float, float]:
        """The greatest weight among exact matches, and among those with edits; 0 for none."""
        if len(self.states) > STATES:
            self._anew()
        state = 0
        for c in word:
            state = self.moves[state][c] if c in self.moves[state] else self._move(state, c)
            if not self.states[state][0]:
                break
        if self.finals[state] is None:
            places, exact, fuzzy = self.states[state]
            for node, e in places.items():
                weight, most = self.ends[node].get(False, (0.0, -1))
                if e == 0:
                    exact = max(exact, weight)
                elif e <= most:
                    fuzzy = max(fuzzy, weight)
            self.finals[state] = (exact, fuzzy)
        return self.finals[state]


@dataclass(frozen=True)
class Model:
    entries: dict[tuple[str, bool], float]
    weights: np.ndarray  # of FEATURES features, the last is the intercept


class Reader:
    """Features of texts; remembers what words match."""

    def __init__(self, entries: dict[tuple[str, bool], float]) -> None:
        self.automaton, self.known = Automaton(entries), {}

    def features(self, text: str | None) -> list[float]:
        low = (text or "").lower()
        tokens = WORD.findall(low)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(tokens).difference(known):
            hit = self.automaton.match(w)
            known[w] = hit if hit != (0.0, 0.0) else None
        if not any(map(known.__getitem__, set(tokens))):
            return [0.0] * (FEATURES - 1) + [1.0]
        counts, most, total, near = [0, 0, 0, 0], [0.0, 0.0], 0.0, 0
        last = -WINDOW - 1
        for i, m in enumerate(WORD.finditer(low)):
            hit = known[m[0]]
            if hit:
                fuzzy = hit[0] == 0.0
                around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                counts[2 * fuzzy + (not SAYING.isdisjoint(around) or self.quoted(low, m.start(), m.end()))] += 1
                most[fuzzy] = max(most[fuzzy], hit[fuzzy])
                total += hit[0] + hit[1] / 4 * fuzzy
                near += i - last <= WINDOW
                last = i
        dense = math.log1p(100 * sum(counts) / len(tokens))
        return [*map(math.log1p, counts), *most, math.log1p(total), dense, 1.0]

    @staticmethod
    def quoted(text: str, start: int, end: int) -> bool:
        """Whether quotation marks stand on both sides of a hit, close by and in its line."""
        before = text[max(0, start - QUOTED) : start].rpartition("\n")[2]
        after = text[end : end + QUOTED].partition("\n")[0]
        return not MARKS.isdisjoint(before) and not MARKS.isdisjoint(after)


def terms_of(text: str) -> set[tuple[str, bool]]:
    """The words and stems of a text."""
    words = set(WORD.findall(text.lower()))
    return {(w, False) for w in words if 2 < len(w) <= 40} | {(w[:k], True) for w in words for k in STEMS if len(w) >= k}


def learn_lexicon(texts: DataFrame, most_terms: int = 5_000, times: float = 5.0) -> dict[tuple[str, bool], float]:
    """Entries and their weights (log of the ratio of rates), from the distinct texts (text, toxic)."""
    once = cut(texts.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")))
    sizes = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                sums[toxic].update(terms_of(text.as_py() or ""))
        for toxic, found in sums.items():
            rows = list(found.items())
            for at in range(0, len(rows), 100_000):
                part = rows[at : at + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for (t, _), _ in part], pa.string()), pa.array([s for (_, s), _ in part], pa.bool_()), pa.array([c * toxic for _, c in part], pa.int64()), pa.array([c * (1 - toxic) for _, c in part], pa.int64())],
                    ["term", "stem", "a", "b"],
                )

    counted = cut(once.select("text", "toxic").mapInArrow(run, "term string, stem boolean, a long, b long").groupBy("term", "stem").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    share = (F.col("a") + F.col("b")) / (p + n)
    # likelihood ratio of a term's rates in toxic and other texts against its rate in all
    fit = lambda k, m, q: F.when(k > 0, k * F.log(k / (m * q))).otherwise(0.0) + F.when(k < m, (m - k) * F.log((m - k) / (m * (1 - q)))).otherwise(0.0)
    ratio = 2 * (fit(F.col("a"), F.lit(p), share) + fit(F.col("b"), F.lit(n), share))
    weight = F.log(((F.col("a") + 0.5) / (p + 1)) / ((F.col("b") + 0.5) / (n + 1)))
    chance = 2 * math.log(max(2, counted.count()))
    chosen = counted.where(F.col("a") > 2).select("term", "stem", ratio.alias("g"), weight.alias("weight")).where((F.col("g") > chance) & (F.col("weight") > math.log(times)))
    rows = chosen.orderBy(F.col("g").desc(), "term", "stem").limit(most_terms).collect()
    return {(r["term"], r["stem"]): round(r["weight"], 6) for r in rows}


def fit_weights(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic weights by Newton steps; rows weigh w, the last feature is the intercept and is not shrunk."""
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (w * (p - y)) + shrink * beta
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(shrink), slope)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, lexicon: Column, rows_per_label: int = 10_000, most_terms: int = 5_000) -> Model:
    """Learn from docs (doc_id, text) and labels (doc_id, toxic); rows where `lexicon`, of doc_id, holds give the lexicon, the others the weights."""
    said = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    said = said.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["count"] for r in said.groupBy("toxic").count().collect()}
    share = {k: min(1.0, rows_per_label / max(1, n)) for k, n in sizes.items()}
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(7)), 1).cast("double") / float(2**63)
    drawn = said.where(draw < F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(drawn), "doc_id")  # ids and labels, rows_per_label about of each
    sample = cut(rows.select("text", "toxic", lexicon.alias("lexical")))
    entries = learn_lexicon(sample.where("lexical"), most_terms)
    shared = docs.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for b in batches:
            x = [reader.features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("toxic")], ["x", "toxic"])

    found = sample.where("not lexical").select("text", "toxic").mapInArrow(run, "x array<double>, toxic int")
    grouped = found.groupBy("x", "toxic").agg(F.count("*").alias("n")).collect()  # rows_per_label rows about of each label at most
    data = sorted((list(r["x"]), r["toxic"], r["n"] / share[r["toxic"]]) for r in grouped)
    if len({y for _, y, _ in data}) < 2:
        a, b = sizes.get(1, 0) + 0.5, sizes.get(0, 0) + 0.5
        return Model(entries, np.array([*[0.0] * (FEATURES - 1), math.log(a / b)]))
    x, y, w = (np.array(v, dtype=float) for v in zip(*data, strict=True))
    return Model(entries, fit_weights(x, y, w))


def score(docs: DataFrame, model: Model, *also: Column) -> DataFrame:
    """doc_id, the `also` columns and `score`, the probability that a text is toxic, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct("doc_id", *also).alias("row"), text_of().alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value.entries)
        for b in batches:
            x = np.array([reader.features(t.as_py()) for t in b.column("text")]).reshape(-1, FEATURES)
            p = 1 / (1 + np.exp(-np.clip(x @ shared.value.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(p)], ["row", "score"])

    return rows.mapInArrow(run, f"row {kind}, score double").select("row.*", "score")
