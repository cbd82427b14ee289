"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; its outcome is one bit of `fail_bits`, next to
the measurements. Policies are named bit masks, so that a new policy version or an ablation
reads the ledger and never the texts again.

Defined results: a null or empty text has no words and fails `few_words`; null ids and repeated
rows are rated row by row; columns other than doc_id and text are ignored, whatever their names, and
come back from keep_good. Very long texts are rated whole, within one row; no rule has ties; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import WORD, let, text_of, words, wrapped

#: Bit number of each rule.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")
#: Policy versions: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": RULES,
}


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text."""
    n = F.size(w)
    grams = F.when(
        n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))

    def spans(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def covered(p: Column) -> Column:
            same = lambda e, other: F.coalesce(e["h"] == F.get(p, other)["h"], F.lit(False))
            at = F.array_sort(F.transform(F.filter(p, lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"]))
            return let(
                at,
                lambda s: F.aggregate(
                    F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
                ),
            )

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, covered))

    return let(grams, spans).cast("long")


def ledger(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to carry along, the measurements and `fail_bits` of every row."""
    lines = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(WORD))
    measured = (
        docs.select(F.struct(*carry).alias("carried"), text_of().alias("text"))
        .select(
            "carried",
            let(
                words(F.col("text")),
                lambda w: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    _repeat_words(w).alias("n_repeat_words"),
                ),
            ).alias("by_word"),
            F.regexp_count(F.col("text"), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(
                lines,
                lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
            ).alias("by_line"),
        )
        .select("carried.*", "by_word.*", "n_symbols", "by_line.*")
    )
    n = F.col("n_words")
    failed = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines")),
        "word_length": (n > 0) & ((F.col("word_chars") < 2 * n) | (F.col("word_chars") > 40 * n)),
    }
    bits = sum((F.when(failed[rule], F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES)), F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def keep_good(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that a policy keeps, with their own columns."""
    rated = ledger(wrapped(docs, F.col("text")), ["whole"])
    return apply_policy(rated, policy).where("kept").select("whole.*")


def apply_policy(rated: DataFrame, policy: str) -> DataFrame:
    """Add `kept`: no rule of the policy failed."""
    return rated.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablation(rated: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents it rejects, those it alone rejects, those kept without it.

    The ledger is first counted by its bits (2 to the number of rules at most), so the rest
    works on that many rows.
    """
    whole = mask_of(policy)
    counted = rated.groupBy("fail_bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    hit = F.col("fail_bits").bitwiseAND(F.col("bit")) != 0
    rest = F.col("fail_bits").bitwiseAND(F.lit(whole) - F.col("bit"))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return (
        counted.select("fail_bits", "n", rules.alias("r"))
        .select("fail_bits", "n", "r.*")
        .groupBy("rule")
        .agg(total(hit).alias("rejected"), total(hit & (rest == 0)).alias("rejected_alone"), total(rest == 0).alias("kept_without"))
    )
