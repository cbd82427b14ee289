"""Work on contract packages at size: tables that Spark's planner takes for too small are broadcast whole, expressions used twice run twice."""

import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.functions.text import MATCH, matches, money
from docketry.operators import elements
from docketry.plans import contracts
from docketry.plans.registry import QUERIES
from docketry.sources.shared import cut
from tests.conftest import DATA


def taken_for(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_blocks_are_taken_for_as_large_as_they_are(spark):
    ids = contracts.block_evidence(contracts.blocks(spark, DATA))
    assert taken_for(ids) >= 8 * ids.count()  # a number in each row, besides three more columns
    assert taken_for(cut(ids)) >= 8 * ids.count()


@pytest.mark.parametrize("name", ["knowledge_chunks", "clause_bindings", "clause_edges", "element_completions"])
def test_blocks_are_not_broadcast(spark, name):
    held = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert "BroadcastHashJoin" not in plan


def test_matches_cut_few_texts(spark):
    rows = spark.createDataFrame([("a1b22",), (f"1{MATCH}2",), ("1",), ("none",), ("",), (None,)], "t string")
    found = [None if r.m is None else [(m.start, m.end, m.says) for m in r.m] for r in rows.select(matches(F.col("t"), "[0-9]+").alias("m")).collect()]
    assert found == [[(1, 2, "1"), (3, 5, "22")], [(0, 1, "1"), (2, 3, "2")], [(0, 1, "1")], [], [], None]
    assert str(matches(F.col("t"), "[0-9]+")).startswith("Column<'CASE WHEN")  # without a match nothing is cut


def test_money_reads_a_text_once():
    assert str(money(F.col("t"))).count("人民币") == 1


def test_hints_miss_no_match():
    draw = random.Random(7)
    words = sorted({w for f in elements.HINTS for group in (*elements.HINTS[f], elements.ALIASES[f]) for w in group})
    words += ["方", "日", "2024年5月1日", "于", "前", "13%", "100元", "A123456789012345X", "提交某地仲裁委员会仲裁", "向某地人民法院起诉", "人民币", " ", "甲 方", "增值税专用发票"]
    seen = set()
    for _ in range(30_000):
        text = "".join(draw.choices(words, k=draw.randint(1, 6)))
        for f in elements.ALIASES:
            if any(re.search(p, text) for p in elements.field_patterns(f)):
                seen.add(f)
                assert all(any(w in text for w in group) for group in elements.HINTS[f]), (f, text)
    assert seen == set(elements.ALIASES)
