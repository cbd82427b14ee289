"""Canonical JSON, and the ledger that it guards."""

import json

import pytest
from pyspark.sql import functions as F

from docketry.functions.canonical import canonical_row
from docketry.operators.audit import content_fingerprint
from docketry.sources import appended

EVENTS = "event_id long, at timestamp, says string, tags map<string,string>, parts array<struct<a:decimal(10,2),b:double>>"


def test_canonical_json(spark):
    df = spark.sql(
        """select map('b', 1, 'a', null, 'created_at', 5) as m, named_struct('z', cast(1.50 as decimal(10,2)), 'c', array('q"x', null, '中'), 'decided_at', 3) as s,
        cast(null as array<int>) as n, date'2024-01-02' as d, 1.0d as f, cast(100 as decimal(10,0)) as i, true as t, current_timestamp() as generated_at"""
    )
    said = df.select(canonical_row(df)).first()[0]
    assert said == '{"d":"2024-01-02","f":1.0,"i":100,"m":{"a":null,"b":1},"n":null,"s":{"c":["q\\"x",null,"中"],"z":1.5},"t":true}'
    assert json.loads(said)["s"]["z"] == 1.5
    a, b = spark.sql("select map('x', 1, 'y', 2) as m"), spark.sql("select map('y', 2, 'x', 1) as m")
    c = spark.sql("select named_struct('y', 2, 'x', 1) as m")
    assert len({df.select(canonical_row(df)).first()[0] for df in (a, b, c)}) == 1
    prints = [content_fingerprint(spark.range(9).select("id", F.create_map(*k, *v).alias("m")).repartition(n)).first() for n, (k, v) in enumerate([((F.lit("a"), "id"), (F.lit("b"), "id"))] * 2 + [((F.lit("b"), "id"), (F.lit("a"), "id"))], 1)]
    assert len({p.fingerprint for p in prints}) == 1


def rows(spark, ids, says="x"):
    out = spark.range(*ids).selectExpr("id as event_id", "timestamp_micros(1700000000123456 + id) as at", f"concat('{says}', id) as says", "map('k', cast(id as string)) as tags", "array(named_struct('a', cast(id as decimal(10,2)), 'b', id / 3)) as parts")
    return out.to(spark.createDataFrame([], EVENTS).schema)


def test_written_twice_is_written_once(spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    schema = spark.createDataFrame([], EVENTS).schema
    assert appended.read(spark, folder, schema)[0].count() == 0
    assert appended.append(rows(spark, (0, 10)), folder, "one") and appended.append(rows(spark, (10, 30)), folder, "two")
    assert not appended.append(rows(spark, (0, 10)).repartition(3), folder, "one")
    with pytest.raises(appended.Conflict):
        appended.append(rows(spark, (0, 10), "y"), folder, "one")
    with pytest.raises(appended.Conflict):
        appended.append(rows(spark, (0, 11)), folder, "one")
    found, issues = appended.read(spark, folder, schema)
    assert found.count() == 30 and issues.count() == 0
    assert found.select("event_id", "at", "says", "tags", "parts").where("event_id = 3").first() == rows(spark, (3, 4)).first()


def test_revisions_and_broken_batches(spark, tmp_path):
    folder = f"{tmp_path}/ledger"
    schema = spark.createDataFrame([], EVENTS).schema
    for batch, revision, says in (("run", 0, "a"), ("run", 1, "b"), ("bad", 0, "c"), ("gone", 0, "d")):
        appended.append(rows(spark, (0, 5), says), folder, batch, revision)
    rows(spark, (0, 4), "c").write.mode("overwrite").options(**appended.FORMATS).json(f"{folder}/rows/batch=bad/revision=0")
    rows(spark, (0, 5), "d").limit(0).write.mode("overwrite").json(f"{folder}/rows/batch=gone/revision=0")
    rows(spark, (0, 5), "e").write.options(**appended.FORMATS).json(f"{folder}/rows/batch=cut/revision=0")  # never listed
    found, issues = appended.read(spark, folder, schema)
    assert {(r.batch, r.revision, r.says[0]) for r in found.collect()} == {("run", 1, "b")}
    assert {(r.batch, r.issue) for r in issues.collect()} == {("bad", "changed"), ("gone", "missing"), ("cut", "unlisted")}
    assert appended.read(spark, folder, schema, latest=False)[0].count() == 10


def test_ledger_of_a_stream(spark, tmp_path):
    """A stream is appended batch by batch; the same batches come again after the state is lost and change nothing."""
    source, folder = f"{tmp_path}/in", f"{tmp_path}/ledger"
    schema = spark.createDataFrame([], EVENTS).schema
    for i in range(3):
        rows(spark, (10 * i, 10 * i + 10)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    for state in ("first", "lost"):
        appended.append_stream(stream, folder, f"{tmp_path}/{state}").awaitTermination()
    found, issues = appended.read(spark, folder, schema)
    assert found.count() == 30 and issues.count() == 0 and found.select("batch").distinct().count() == 3
    out = appended.read_stream(spark, folder, schema, files=1).writeStream.format("memory").queryName("ledger_rows")
    out.option("checkpointLocation", f"{tmp_path}/read").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("ledger_rows").count() == 30
