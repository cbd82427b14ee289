"""Queries of task events: stale subjects, recent events, pages, conflicts, sliding latency, streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.operators import audit, tasks
from docketry.plans.base import query, table

REFUSED = [("signup", "signup"), ("error", "purchase"), ("view", "signup")]


@query(
    """with l as (select user_id, max(ts) as last, count_if(event_type = 'error') as n from events group by 1)
select user_id, cast(n as bigint) as n_retries, case when n < 3 then 'requeue' else 'dead' end as verdict from l where last < (select max(ts) - interval 12 hours from events)"""
)
def stale_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.stale(table(spark, sf_dir, "events"), "user_id", "ts", "12 hours", F.col("event_type") == "error", 3)


@query("select user_id, event_id, cast(r as int) as place from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 256")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tasks.recent(table(spark, sf_dir, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()])
    return out.select("user_id", "event_id", "place")


@query("select event_id, user_id, (select count(*) from events where event_type = 'error') as total from events where event_type = 'error' order by ts desc, event_id limit 20 offset 20")
def error_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of errors, newest first."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return tasks.page(rows, [F.col("ts").desc(), F.col("event_id")], 2, 20).select("event_id", "user_id", "total")


@query("select event_id, cast(2 as bigint) as n, event_id % 2 = 0 as conflict from events where event_type = 'signup'")
def event_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which the sign-ups are delivered twice, every second of those with another type."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    again = e.where("event_type = 'signup'").withColumn("event_type", F.when(F.col("event_id") % 2 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))
    return audit.repeated_ids(e.union(again), ["event_id"], F.col("event_type"))


@query(
    """with w as (select to_timestamp((floor(epoch(ts) / 3600) - i) * 3600) as w, event_type, value from (select *, unnest(range(0, 6)) as i from events)),
r as (select w, event_type, value, row_number() over (partition by w order by value nulls last) as r, count(value) over (partition by w) as nv, count(*) over (partition by w) as n from w)
select strftime(w at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as begins, cast(max(n) as bigint) as n, max(value) filter (r = (95 * nv + 99) // 100) as p95, round(count_if(event_type = 'error')::double / count(*), 6) as failure_rate
from r group by w"""
)
def sliding_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tasks.sliding(table(spark, sf_dir, "events"), "ts", "value", F.col("event_type") == "error", "6 hours", "1 hour")
    return out.withColumn("begins", F.date_format("begins", "yyyy-MM-dd HH:mm:ss"))


@query(
    """select event_id, user_id from events e where ts + interval 10 days < timestamp '2024-01-30 00:00:00'
  and not exists (select 1 from customer where c_custkey = user_id and c_acctbal > 0)"""
)
def expired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events past their keeping time that no customer in credit refers to."""
    live = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return tasks.expired(table(spark, sf_dir, "events"), "ts", "10 days", now, live, "user_id").select("event_id", "user_id")


@query(
    "select user_id as subject, event_id, before, after from (select user_id, event_id, event_type as after, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) "
    f"where (before, after) in ({', '.join(map(str, REFUSED))})"
)
def stream_transition_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; the state of a user is the stage of the last event."""
    from docketry.streaming.ledger import transition_breaks

    return transition_breaks(spark, f"{sf_dir}/events.parquet", "user_id", "event_type", REFUSED)


TTL_MS, RETRIES, LATE_MS = 36 * 3_600_000, 3, 2 * 86_400_000


@query(
    f"""with recursive w as (select epoch_us(max(ts)) // 1000 - {LATE_MS} as w from events),
e as (select user_id as subject, event_id, epoch_us(ts) // 1000 as t, case when event_type in ('signup', 'error') then 'acquire' when event_type = 'purchase' then 'release' else 'beat' end as action,
    event_id % 8 as claimed, row_number() over (partition by user_id order by epoch_us(ts) // 1000, event_id) as i from events, w where epoch_us(ts) // 1000 <= w),
s as (
  select distinct subject, cast(0 as bigint) as i, cast(null as bigint) as event_id, cast(null as bigint) as t, cast(0 as bigint) as token, false as running, cast(0 as bigint) as until,
    cast(0 as bigint) as retries, false as dead, cast(null as varchar) as verdict, cast(null as varchar) as ended, cast(null as bigint) as ended_token, cast(null as bigint) as ended_at from e
  union all
  select subject, i, event_id, t, case when granted then token1 + 1 else token1 end, granted or running1 and not released, case when granted or ok and action = 'beat' then t + {TTL_MS} else until end,
    case when released then 0 else retries1 end, dead1,
    case when action = 'acquire' then case when dead1 then 'refused' when running1 then 'held' else 'granted' end when not ok then 'stale' when released then 'released' else 'accepted' end,
    case when requeued then 'requeue' when expired then 'dead_letter' end, token1, until
  from (select *, action = 'acquire' and not dead1 and not running1 as granted, running1 and claimed = token1 and action <> 'acquire' as ok, running1 and claimed = token1 and action = 'release' as released
    from (select *, token + requeued::int as token1, running and not expired as running1, retries + requeued::int as retries1, dead or (expired and not requeued) as dead1
      from (select *, expired and retries < {RETRIES} as requeued
        from (select s.subject, e.i, e.event_id, e.t, e.action, e.claimed, s.token, s.running, s.until, s.retries, s.dead, s.running and s.until <= e.t as expired from s join e on e.subject = s.subject and e.i = s.i + 1)))))
select subject, event_id, t as at, verdict, token from s where i > 0
union all select subject, null, ended_at, ended, ended_token from s where ended is not null
union all select subject, null, until, case when retries < {RETRIES} then 'requeue' else 'dead_letter' end, token + (retries < {RETRIES})::int
  from (select *, row_number() over (partition by subject order by i desc) as last from s), w where last = 1 and running and until <= w"""
)
def lease_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as tasks: who gets the lease, who bears an old token, what time requeues or gives up, from the events as a stream."""
    from docketry.streaming import ledger, leases

    events = ledger.event_stream(spark, f"{sf_dir}/events.parquet")
    action = F.when(F.col("event_type").isin("signup", "error"), "acquire").when(F.col("event_type") == "purchase", "release").otherwise("beat")
    token = F.when(action != "acquire", F.col("event_id") % 8)
    asked = events.select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").alias("subject"), "event_id", action.alias("action"), token.alias("token"))
    return leases.lease_decisions(spark, asked, TTL_MS, RETRIES, f"{LATE_MS} milliseconds")
