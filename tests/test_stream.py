"""Streams over files that arrive in turn."""

import pytest

from docketry.plans.base import table
from docketry.streaming.ledger import hourly_counts, review_arrivals, transition_breaks
from tests.conftest import DATA

REFUSED = [("error", "purchase"), ("click", "signup"), ("a", "c")]


@pytest.mark.parametrize("parts", [1, 4])
def test_streams_of_folders(spark, tmp_path, parts):
    """A table of part files, taken up one file at a time, gives the rows of the single file."""
    path = f"{tmp_path}/events.parquet"
    table(spark, DATA, "events").repartition(parts).write.parquet(path)
    one = f"{DATA}/events.parquet"
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(hourly_counts(spark, path, files=1)) == rows(hourly_counts(spark, one)) != []
    breaks = [rows(transition_breaks(spark, p, "user_id", "event_type", REFUSED, files=1)) for p in (path, one)]
    assert breaks[0] == breaks[1] != []


def test_late_events_take_their_place(spark, tmp_path):
    """b comes in a later file between a and c, so the step from a to c is no longer one."""
    path = f"{tmp_path}/events.parquet"
    for k, (event, at, name) in enumerate([(1, "00:00:00", "a"), (3, "02:00:00", "c"), (2, "01:00:00", "b")]):
        one = spark.createDataFrame([(event, 7, name)], "event_id long, user_id long, event_type string").selectExpr("*", f"timestamp_ntz'2024-01-01 {at}' as ts")
        one.coalesce(1).write.mode("append").parquet(path)
        got = [tuple(r) for r in transition_breaks(spark, path, "user_id", "event_type", REFUSED, files=1).collect()]
        assert got == ([(7, 3, "a", "c")] if k == 1 else [])


def test_arrivals(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    review = lambda df: df.selectExpr("i", "i % 2 = 0 as even")
    for part in (range(3), range(3, 5)):
        spark.createDataFrame([(i,) for i in part], "i long").coalesce(1).write.mode("append").parquet(source)
        review_arrivals(spark, source, spark.read.parquet(source).schema, review, target, state)
    got = spark.read.parquet(target)
    assert sorted((r.i, r.even, r.batch) for r in got.collect()) == [(0, True, 0), (1, False, 0), (2, True, 0), (3, False, 1), (4, True, 1)]
