"""Structured Streaming twins: sessions, deduplication, ledgers and progress, each with a watermark that bounds its state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import fact_key

LEDGER = "ts timestamp, stage string, unit string, action string, route string, attempt int, sent boolean, duration_ms bigint, error_class string, prompt_tokens bigint, cached_tokens bigint, output_tokens bigint"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of text files as they come."""
    return spark.readStream.text(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Events of an append-only JSON ledger."""
    return spark.readStream.schema(LEDGER).json(folder)


def gap_sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "3 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that end with a gap; rows over ``late`` behind are dropped, which bounds the state."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("events")).select(key, F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "events")


def dedup_facts(facts: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first fact of a key within the watermark; what comes later than that may return."""
    return facts.withColumn("fact_key", fact_key(F.col("bullet"))).withWatermark(ts, late).dropDuplicatesWithinWatermark(["fact_key"])


def running_tokens(ledger: DataFrame) -> DataFrame:
    """Token totals by stage so far (complete or update mode)."""
    return ledger.groupBy("stage").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def progress(ledger: DataFrame) -> DataFrame:
    """Per stage the units begun and done so far, folded in arrival order; the state is a row a stage."""
    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begun, done = state.get if state.exists else (0, 0)
        for f in frames:
            begun += int((f["action"] == "start").sum())
            done += int((f["action"] == "done").sum())
        state.update((begun, done))
        yield pd.DataFrame({"stage": [key[0]], "begun": [begun], "done": [done], "running": [begun - done]})

    return ledger.groupBy("stage").applyInPandasWithState(fold, "stage string, begun long, done long, running long", "begun long, done long", "update", GroupStateTimeout.NoTimeout)


def split_budget(limit: int, mandatory: list[int]) -> list[int] | None:
    """Quotas of calls per partition, mandatory ones first, the rest in turn; None if the limit is too small.

    Spark has no mutex across tasks, so a budget is dealt out before they start.
    """
    if sum(mandatory) > limit:
        return None
    rest, n = limit - sum(mandatory), max(1, len(mandatory))
    return [m + rest // n + (k < rest % n) for k, m in enumerate(mandatory)]


def append_ledger(stream: DataFrame, folder: str, checkpoint: str):
    """An exactly-once append of events as JSON."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
