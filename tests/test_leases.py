"""Leases: the state machine, the stream over several micro-batches, late events and hot subjects."""

import random

from pyspark.sql import functions as F

from docketry.streaming.leases import Lease, lease_decisions

DAY = 86_400_000


def test_old_tokens_are_refused():
    lease = Lease(100, 1)
    assert lease.apply(0, "acquire", None) == "granted" and lease.apply(10, "acquire", None) == "held"
    assert lease.apply(20, "beat", 1) == "accepted" and lease.apply(30, "beat", 2) == "stale"
    assert lease.expire(119) is None and lease.expire(120) == (120, "requeue", 2)
    assert lease.apply(121, "beat", 1) == "stale" and lease.apply(122, "beat", 2) == "stale"  # nobody holds it
    assert lease.apply(130, "acquire", None) == "granted" and lease.token == 3
    assert lease.apply(140, "release", 2) == "stale" and lease.apply(150, "release", 3) == "released"
    assert lease.apply(160, "acquire", None) == "granted" and lease.expire(300) == (260, "requeue", 5)
    assert lease.apply(310, "acquire", None) == "granted" and lease.expire(999) == (410, "dead_letter", 6)
    assert lease.apply(1000, "acquire", None) == "refused" and lease.apply(1001, "beat", 6) == "stale"


def slow(events, ttl, retries, mark):
    out = []
    for subject in {e[1] for e in events}:
        lease = Lease(ttl, retries)
        for at, _, event, action, token in sorted(e for e in events if e[1] == subject and e[0] <= mark):
            if ended := lease.expire(at):
                out.append((subject, None, *ended))
            verdict = lease.apply(at, action, token)
            out.append((subject, event, at, verdict, lease.token))
        if ended := lease.expire(mark):
            out.append((subject, None, *ended))
    return sorted(out, key=repr)


def test_stream_in_batches(spark, tmp_path):
    """Files arrive in order of time but for some days of delay; one task has most events."""
    rng, events = random.Random(3), []
    for i in range(600):
        at = rng.randrange(40 * DAY)
        events.append((at, 1 if rng.random() < 0.6 else rng.randrange(2, 9), i, rng.choice(["acquire", "beat", "beat", "release"]), rng.randrange(1, 9)))
    ordered = sorted(events, key=lambda e: e[0] + rng.randrange(DAY))
    for k in range(4):
        part = spark.createDataFrame(ordered[150 * k : 150 * k + 150], "ms long, subject long, event_id long, action string, token long")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    schema = part.schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    rows = stream.select(F.timestamp_millis("ms").alias("time"), "subject", "event_id", "action", F.when(F.col("action") != "acquire", F.col("token")).alias("token"))
    got = sorted(map(tuple, lease_decisions(spark, rows, 2 * DAY, 3, "3 days").collect()), key=repr)
    known = [(at, s, i, a, None if a == "acquire" else t) for at, s, i, a, t in events]
    want = slow(known, 2 * DAY, 3, max(e[0] for e in events) - 3 * DAY)
    assert got == want and {r[3] for r in got} >= {"granted", "held", "stale", "accepted", "requeue"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "default").find("RocksDB") < 0
