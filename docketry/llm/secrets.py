"""Secret scans by a trigram inverted index.

Each rule's regular expression yields a Boolean query over trigrams that every match must hold
(case folded), written as alternatives of trigram sets. The index has postings (trigram, document)
for the trigrams that some query names. Postings are intersected by counting, for each document and
alternative, the trigrams found; the documents left are the rule's candidates, and only they are
searched with the expression. A rule without mandatory trigrams searches every text.

All of it is DataFrame operations. Spans come from cutting a text at its matches and adding up
lengths, so they are exact code point offsets.

Defined results: a null text is empty; rows alike in doc_id and text get the same result; spans that begin
alike come in the order of the rules; very long texts are searched whole; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import row_key, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length must reach `least`
    least: int = 0


#: In the order of their names in results; the first three are the base rules.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # finds what [0-9a-f]+ of 16 or more characters finds
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = 3

#: Alternatives, each a set of trigrams that must all occur. An empty set always holds.
Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: Strings that a part of an expression may stand for, and alternatives of a query, at most.
MOST = 64


def both(a: Query, b: Query) -> Query:
    if len(a) * len(b) > MOST:  # either alone is still necessary
        return a if len(a) >= len(b) else b
    return least(frozenset(x | y for x, y in product(a, b)))


def least(q: Query) -> Query:
    """Without alternatives that another one implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def of_strings(strings: frozenset[str]) -> Query:
    return least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _parts(tree: Sequence) -> tuple[frozenset[str] | None, Query]:
    """The strings that a sequence stands for (None: too many) and what it needs beside them."""
    exact: frozenset[str] | None = frozenset([""])
    run, need = frozenset([""]), ANY
    for kind, arg in tree:
        here, inner = None, ANY
        if kind == op.LITERAL:
            here = frozenset([chr(arg).lower()])
        elif kind == op.IN:
            chars = set()
            for what, value in arg:
                low, high = (value, value) if what == op.LITERAL else value if what == op.RANGE else (0, MOST + 1)
                chars |= {chr(c).lower() for c in range(low, min(high, low + MOST) + 1)} if what in (op.LITERAL, op.RANGE) else set(map(chr, range(MOST + 1)))
            here = frozenset(chars) if len(chars) <= 8 else None
        elif kind == op.SUBPATTERN:
            here, inner = _parts(arg[-1])
        elif kind == op.BRANCH:
            ways = [_parts(w) for w in arg[1]]
            if all(e is not None for e, _ in ways):
                here = frozenset().union(*(e for e, _ in ways))
            else:
                inner = least(frozenset().union(*(q if e is None else both(of_strings(e), q) for e, q in ways)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            fewest, most, what = arg
            e, q = _parts(what)
            if e is not None and (fewest, most) == (0, 1):
                here = e | {""}
            elif e is not None and fewest == most <= 4:
                here = frozenset("".join(x) for x in product(e, repeat=fewest)) if len(e) ** fewest <= MOST else None
            elif fewest:
                inner = q if e is None else both(of_strings(e), q)
        elif kind == op.AT:
            here = frozenset([""])
        if here is not None and len(run) * len(here) <= MOST:
            run = frozenset(a + b for a, b in product(run, here))
            continue
        exact = None
        need = both(both(need, of_strings(run)), inner)
        run = frozenset([""]) if here is None else here
    return (run, need) if exact is not None else (None, both(need, of_strings(run)))


def trigram_query(pattern: str) -> Query:
    exact, need = _parts(_parser.parse(pattern))
    return need if exact is None else both(of_strings(exact), need)


def candidates(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """key_id, key_text, `gates`: a bit for each rule whose trigram query the document meets."""
    terms = [(1 << r, f"{r}.{a}", gram, len(grams)) for r, rule in enumerate(rules) for a, grams in enumerate(trigram_query(rule.pattern)) for gram in grams]
    named = sorted({t[2] for t in terms})
    wanted = keyed.sparkSession.createDataFrame(terms or [(0, "", "", 0)], "rule long, way string, gram string, need long")  # fixed by the rules
    folded = keyed.select("key_id", "key_text", F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(g)) for g in named])) if named else F.array().cast("array<string>")
    postings = folded.select("key_id", "key_text", F.explode(present).alias("gram"))
    met = postings.join(F.broadcast(wanted), "gram").groupBy("key_id", "key_text", "rule", "way", "need").agg(F.count("*").alias("n"))
    return met.where("n >= need").groupBy("key_id", "key_text").agg(F.bit_or("rule").alias("gates"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Matches of a rule as structs (start, number, kind, end); the text is cut at them for their offsets."""
    pattern = F.lit(rule.pattern)
    cut_at = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    kind = "array<struct<start:int,number:int,kind:string,end:int>>"
    first = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(number).alias("number"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        good = x["whole"].isNotNull() & (F.length(x["part"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(cut_at, first, step)["out"]).otherwise(F.array().cast(kind))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and `found`, the array of (start, number, kind, end) of all matches, for every row."""
    keyed = docs.select("doc_id", text_of().alias("text"), *row_key())
    gated = keyed.join(candidates(keyed, rules), ["key_id", "key_text"], "left")
    none = F.array().cast("array<struct<start:int,number:int,kind:string,end:int>>")
    found = []
    for number, rule in enumerate(rules):
        spans = _spans(F.col("text"), number, rule)
        needs_index = frozenset() not in trigram_query(rule.pattern)
        found.append(F.when(F.col("gates").bitwiseAND(1 << number) != 0, spans).otherwise(none) if needs_index else spans)
    return gated.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, base: int = BASE) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans."""
    count = lambda i: F.size(F.filter("found", lambda s: s["number"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rule.kind}") for i, rule in enumerate(RULES[:base])],
        F.sha2(named(F.filter("found", lambda s: s["number"] < base)), 256).alias("base_sha256"),
        named(F.col("found")).alias("spans"),
    )


