"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to `longest` code points, hashed into `1 << bits` features, over a
bounded sample of labelled rows: at most about `rows_per_language` rows of each language, drawn by a
hash of the row's id and text (every row where a language has fewer). Counts are summed by Spark.
The model is one matrix of log probabilities, features by languages, of a size that the
parameters and the set of languages fix; it is broadcast. Scoring keeps a text sparse, as the
list of its feature numbers, and sums the matrix rows they name, in blocks of bounded size. Every
text is scored whole.

Defined results: a null text or one without a letter is `und` with score 0; so is every text where
nothing could be learned. Equal scores go to the language that sorts first. Rows are scored one by
one, so nulls in other columns, repeats and further columns have no effect. Very long texts are
read in blocks of code points; an empty table gives an empty result. A lang column of more than
`most_languages` values is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import text_of

#: Code points that are turned into features at once.
BLOCK = 1 << 18
_ODD = np.uint32(0x9E3779B1)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # (1 << bits, languages): log probability of a feature
    prior: np.ndarray
    bits: int
    longest: int


def blocks(text: str, longest: int) -> Iterator[np.ndarray]:
    """Lower-cased code points, a space at each end, in blocks that overlap by longest - 1."""
    for at in range(0, len(text), BLOCK):
        part = text[max(0, at - longest + 1) : at + BLOCK].lower()
        part = (" " if at == 0 else "") + part + (" " if at + BLOCK >= len(text) else "")
        yield np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def features(points: np.ndarray, bits: int, longest: int, done: int = 0) -> np.ndarray:
    """Feature numbers of the n-grams that end behind the first `done` code points."""
    out, h = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * _ODD
        h ^= h >> np.uint32(15)
        out.append((h[max(0, done - n + 1) :] * _ODD) >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def text_features(text: str, bits: int, longest: int) -> Iterator[np.ndarray]:
    for k, points in enumerate(blocks(text, longest)):
        yield features(points, bits, longest, longest - 1 if k else 0)


def train(labelled: DataFrame, bits: int = 16, longest: int = 4, rows_per_language: int = 5_000, smoothing: float = 0.1, most_languages: int = 200) -> Model:
    """Learn from the columns text and lang (neither null) of `labelled`.

    More than `most_languages` distinct values of lang are refused: the matrix has a column for each.
    """
    rows = labelled.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"lang has more than {most_languages} distinct values; clean it or raise most_languages")
    languages = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, rows_per_language / sizes[lang]))])
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).cast("double") / float(2**63)
    sample = rows.where(draw < share[F.col("lang")]) if languages else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
                total = sums.setdefault(lang.as_py(), np.zeros(1 << bits, dtype=np.int64))
                for f in text_features(text.as_py(), bits, longest):
                    total += np.bincount(f, minlength=1 << bits)
        for lang, total in sums.items():
            at = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], ["lang", "feature", "n"])

    counted = sample.select("text", "lang").mapInArrow(count, "lang string, feature long, n long")
    found = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most languages x features rows
    weights = np.full((1 << bits, len(languages)), smoothing)
    where = {lang: i for i, lang in enumerate(languages)}
    np.add.at(weights, (found["feature"].to_numpy(dtype=np.int64), found["lang"].map(where).to_numpy(dtype=np.int64)), found["n"].to_numpy(dtype=float))
    weights = np.log(weights / weights.sum(axis=0)) if languages else weights
    prior = np.log(np.array([sizes[x] for x in languages], dtype=float) / max(1, sum(sizes.values())))
    return Model(languages, weights.astype(np.float32), prior, bits, longest)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Log joint probabilities, texts by languages."""
    out = np.tile(model.prior, (len(texts), 1))
    held: list[np.ndarray] = []
    rows: list[int] = []

    def add() -> None:
        starts = np.cumsum([0, *map(len, held[:-1])])
        np.add.at(out, rows, np.add.reduceat(model.weights[np.concatenate(held)], starts, axis=0, dtype=np.float64))
        held.clear()
        rows.clear()

    for i, text in enumerate(texts):
        for f in text_features(text, model.bits, model.longest):
            if len(f):
                held.append(f)
                rows.append(i)
            if sum(map(len, held[-64:])) > BLOCK or len(held) >= 64:
                add()
    if held:
        add()
    return out


def predict(docs: DataFrame, model: Model, *also: Column) -> DataFrame:
    """doc_id, the `also` columns, lang_pred and score (its posterior probability) of every row."""
    if not model.languages:
        return docs.select("doc_id", *also, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.struct("doc_id", *also).alias("row"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"), text_of().alias("text"))
    kind = plain.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                letters = np.array(part.column("letters").to_pylist(), dtype=bool)
                joint = scores([t.as_py() if ok else "" for t, ok in zip(part.column("text"), letters, strict=True)], m)
                best = joint.argmax(axis=1)
                score = 1 / np.exp(joint - joint.max(axis=1, keepdims=True)).sum(axis=1)
                pred = names[np.where(letters, best, len(m.languages))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], ["row", "lang_pred", "score"]
                )

    return plain.mapInArrow(run, f"row {kind}, lang_pred string, score double").select("row.*", "lang_pred", "score")
