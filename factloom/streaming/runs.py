"""Streams that run over what is there and end: a table as a source, a folder as the result, a checkpoint to go on from."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import fact_key

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    single = spark._jvm.org.apache.hadoop.fs.Path(path)
    if single.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(single).isFile():
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """What ``stream`` gives for all that is there now, in a ``batch`` column the batch that gave it; a later call goes on from the checkpoint.

    A batch is written under its number, so that one that runs twice is there
    once. In complete mode a batch is the whole result, and the last one is it.
    """
    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/result/batch={batch:09d}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/result")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch") if mode == "complete" else rows


def seen_facts(facts: DataFrame, text_col: str = "bullet") -> DataFrame:
    """The keys of facts, each once for the whole run; the state is the set of keys that were seen."""
    return facts.select(fact_key(F.col(text_col)).alias("fact_key")).dropDuplicates(["fact_key"])


class Budget(StatefulProcessor):
    """Requests of one account in their order: one is granted if what was granted before and it are within the limit."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "spent long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        spent = int(self.spent.get()[0]) if self.spent.exists() else 0
        asked = pd.concat(list(rows)).sort_values(["ts", "request"], kind="stable")
        granted = []
        for cost in asked["cost"]:
            ok = spent + int(cost) <= self.limit
            spent += int(cost) if ok else 0
            granted.append(ok)
        self.spent.update((spent,))
        yield pd.DataFrame({"account": key[0], "request": asked["request"].to_numpy(), "cost": asked["cost"].to_numpy(), "granted": granted, "spent": spent})

    def close(self) -> None:
        """Nothing is held beside the state."""


def granted_requests(requests: DataFrame, limit: int) -> DataFrame:
    """``requests`` (account, request, ts, cost) with whether each was granted; an account's state is a number.

    Requests of a batch are taken in order of ts; those of a later batch come
    after. An account's requests of one batch are in one task.
    """
    schema = "account long, request long, cost long, granted boolean, spent long"
    return requests.groupBy("account").transformWithStateInPandas(statefulProcessor=Budget(limit), outputStructType=schema, outputMode="Append", timeMode="None")
