"""Queries that run as streams over the tables, and say what the batch SQL says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import runs as SR
from ..streaming import twins as ST
from .registry import Read, query
from .tables import stage_folder


def _events(t: Read):
    return SR.stream_of(t.spark, f"{t.folder}/events.parquet")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM e)
  SELECT user_id, min(us) AS began_us, max(us) AS last_us, count(*) AS events FROM s GROUP BY user_id, session""")
def stream_sessions(t: Read):
    """Sessions of users that end with a gap of over an hour, as a stream."""
    events = _events(t).withColumn("ts", F.col("ts").cast("timestamp"))
    found = SR.drained(ST.gap_sessions(events, "user_id", gap="1 hour 1 microsecond"), "complete", stage_folder(t.spark))
    return found.select("user_id", F.unix_micros("began").alias("began_us"), (F.unix_micros("ended") - 3_600_000_001).alias("last_us"), "events")


@query("""SELECT DISTINCT lower('Saw ' || event_type || ' by ' || user_id % 100) AS fact_key FROM events""")
def stream_seen(t: Read):
    """Facts of a stream of events, each key once."""
    bullet = F.concat(F.lit("\"Saw  "), "event_type", F.lit(" by "), (F.col("user_id") % 100).cast("string"), F.lit("."))
    return SR.drained(SR.seen_facts(_events(t).select(bullet.alias("bullet"))), "append", stage_folder(t.spark)).select("fact_key")


@query("""SELECT event_type AS stage, sum(1 + event_id % 50)::BIGINT AS prompt_tokens, sum(event_id % 7)::BIGINT AS output_tokens, count(*) AS calls,
  count(*) FILTER (event_id % 3 = 0) AS begun, count(*) FILTER (event_id % 3 = 1) AS done FROM events GROUP BY event_type""")
def stream_ledger(t: Read):
    """Running totals of tokens by stage, and the units begun and done, folded from the same events by two streams."""
    action = F.when(F.col("event_id") % 3 == 0, "start").when(F.col("event_id") % 3 == 1, "done").otherwise("call")
    ledger = _events(t).select(F.col("event_type").alias("stage"), action.alias("action"), (1 + F.col("event_id") % 50).alias("prompt_tokens"), (F.col("event_id") % 7).alias("output_tokens"))
    totals = SR.drained(ST.running_tokens(ledger), "complete", stage_folder(t.spark))
    steps = SR.drained(ST.progress(ledger.select("stage", "action")), "update", stage_folder(t.spark))
    last = steps.groupBy("stage").agg(F.max_by("begun", "batch").alias("begun"), F.max_by("done", "batch").alias("done"))
    return totals.join(last, "stage").select("stage", "prompt_tokens", "output_tokens", "calls", "begun", "done")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, 1 + event_id % 50 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b AS (SELECT user_id, event_id, n, cost, cost <= 120 AS granted, CASE WHEN cost <= 120 THEN cost ELSE 0 END AS spent FROM e WHERE n = 1 UNION ALL
        SELECT e.user_id, e.event_id, e.n, e.cost, b.spent + e.cost <= 120, CASE WHEN b.spent + e.cost <= 120 THEN b.spent + e.cost ELSE b.spent END FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
  SELECT user_id AS account, event_id AS request, cost, granted FROM b""")
def stream_budget(t: Read):
    """Requests of every account against its budget, in order, as a stream with a value of state an account."""
    requests = _events(t).select(F.col("user_id").alias("account"), F.col("event_id").alias("request"), "ts", (1 + F.col("event_id") % 50).alias("cost"))
    before = {k: t.spark.conf.get(k, None) for k in SR.ROCKS}
    for k, v in SR.ROCKS.items():
        t.spark.conf.set(k, v)
    try:
        found = SR.drained(SR.granted_requests(requests, 120), "append", stage_folder(t.spark))
    finally:
        for k, v in before.items():
            t.spark.conf.unset(k) if v is None else t.spark.conf.set(k, v)
    return found.select("account", "request", "cost", "granted")
