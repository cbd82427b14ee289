"""Version comparison of text pairs and the gates of model output."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.functions.text import similarity_label


def unit_changes(pairs: DataFrame) -> DataFrame:
    """pair_id, pos, kind, before, after of changed lines, from pair_id, before, after texts.

    A replaced stretch pairs its lines by offset; what is left over is added or deleted. A pair is the unit of
    work; pairs spread over tasks and only one is compared at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pair, before, after in zip(b["pair_id"], b["before"], b["after"], strict=True):
                old, new = ([x.strip() for x in (t or "").split("\n") if x.strip()] for t in (before, after))
                pos = 0
                for tag, i, j, k, n in SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                    if tag == "equal":
                        continue
                    for at in range(max(j - i, n - k)):
                        was, now = (old[i + at] if i + at < j else None), (new[k + at] if k + at < n else None)
                        kind = "added" if was is None else "deleted" if now is None else "modified"
                        rows.append((pair, pos, kind, was, now))
                        pos += 1
            yield pd.DataFrame(rows, columns=["pair_id", "pos", "kind", "before", "after"])

    return pairs.select("pair_id", "before", "after").mapInPandas(run, "pair_id long, pos int, kind string, before string, after string")


def similarity(pairs: DataFrame) -> DataFrame:
    """pair_id and the matching ratio of the texts, 1.0 for two empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ratio = [round(SequenceMatcher(None, x or "", y or "", autojunk=False).ratio(), 4) for x, y in zip(b["before"], b["after"], strict=True)]
            yield pd.DataFrame({"pair_id": b["pair_id"], "similarity": ratio})

    return pairs.select("pair_id", "before", "after").mapInPandas(run, "pair_id long, similarity double")


def gate_items(items: DataFrame, allowed: DataFrame, least: float = 0.5) -> DataFrame:
    """Model items (item_id, rule_id, status, evidence_ids, confidence) with the status that survives the gate.

    Evidence outside the rule's whitelist (rule_id, evidence_id) refuses an item; low confidence or no
    evidence leaves UNKNOWN.
    """
    cited = items.select("item_id", "rule_id", F.explode("evidence_ids").alias("evidence_id"))
    foreign = cited.join(allowed, ["rule_id", "evidence_id"], "left_anti").select("item_id").distinct().withColumn("foreign", F.lit(True))
    out = items.join(foreign, "item_id", "left")
    weak = (F.coalesce("confidence", F.lit(0.0)) < least) | (F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0)
    return out.withColumn("gated", F.when(F.col("foreign"), "REFUSED").when(weak, "UNKNOWN").otherwise(F.col("status"))).drop("foreign")


def positions(clauses: DataFrame, playbook: DataFrame) -> DataFrame:
    """rule_id, status, action: the first position of a rule's playbook that a relevant clause contains.

    playbook: rule_id, clause_type, missing (action), positions array of (text, status, action) in order of precedence.
    """
    met = clauses.join(playbook, F.contains(clauses["text"], playbook["clause_type"]), "inner")
    found = met.select("rule_id", F.posexplode("positions").alias("pos", "p"), "text").where(F.contains("text", F.col("p.text")))
    first = found.groupBy("rule_id").agg(F.min_by("p", "pos").alias("p"))
    seen = met.select("rule_id").distinct().withColumn("seen", F.lit(True))
    out = playbook.join(first, "rule_id", "left").join(seen, "rule_id", "left")
    status = F.when(F.col("seen").isNull(), "BLOCK").otherwise(F.coalesce("p.status", F.lit("UNKNOWN")))
    action = F.when(F.col("seen").isNull(), F.col("missing")).otherwise(F.coalesce("p.action", F.lit("ESCALATE")))
    return out.select("rule_id", status.alias("status"), action.alias("action"))


#: Names of the kinds of change in a report, and of the bands of similarity.
KIND_NAMES = {"added": "新增", "deleted": "删除", "modified": "修改"}
BAND_NAMES = {"identical": "高度相似", "similar": "较为相似", "partial": "存在明显差异", "different": "差异较大"}


def report_lines(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """pair_id, n, line: the report of each compared pair as lines in order of n, which has gaps.

    pairs: pair_id, base, other (file names), similarity (0 to 1). changes: pair_id, pos (dense from 0), kind, before, after. A
    line's place follows from its change's, so the lines of a pair are never gathered or sorted here; whoever writes them
    sorts by (pair_id, n) in ranges.
    """
    name = lambda names, c: F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], c)
    line = lambda n, text: F.struct(F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.cast("long").alias("n"), text.alias("line"))
    counts = changes.groupBy("pair_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KIND_NAMES], F.count("*").alias("all"))
    known = pairs.join(counts, "pair_id", "left").na.fill(0, [*KIND_NAMES, "all"])
    total = F.concat_ws(" / ", *[F.concat(F.lit(f"{said} "), F.col(k), F.lit(" 处")) for k, said in KIND_NAMES.items()])
    percent = F.bround(100 * F.col("similarity"), 0).cast("int")
    band = F.concat(name(BAND_NAMES, similarity_label(percent)), F.lit("（"), percent.cast("string"), F.lit("%）"))
    head = [F.concat(F.lit("基准文档："), "base"), F.concat(F.lit("比对文档："), "other"), F.concat(F.lit("相似度："), band), total, F.lit("")]
    none = F.when(F.col("all") == 0, line(len(head), F.lit("未发现差异。")))
    top = known.select("pair_id", F.explode(F.array_compact(F.array(*[line(i, x) for i, x in enumerate(head)], none))).alias("l"))
    at = len(head) + 3 * F.col("pos")
    said = [
        line(at, F.concat((F.col("pos") + 1).cast("string"), F.lit(". ["), name(KIND_NAMES, F.col("kind")), F.lit("]"))),
        F.when(F.coalesce("before", F.lit("")) != "", line(at + 1, F.concat(F.lit("   基准："), "before"))),
        F.when(F.coalesce("after", F.lit("")) != "", line(at + 2, F.concat(F.lit("   比对："), "after"))),
    ]
    rest = changes.join(pairs.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.explode(F.array_compact(F.array(*said))).alias("l"))
    return top.union(rest).select("pair_id", "l.n", "l.line")
