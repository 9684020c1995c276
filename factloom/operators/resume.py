"""Calls that are made once: stage tables of replies, keyed by what was asked, that a later run takes up."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hash_key
from ..sources.storage import Store
from .completion import Completer, attempt

VERSION = 1
REPLY = "key string, reply string, reply_sha string, attempts int, route string"


class Bound(ValueError):
    """A folder holds the replies of another kind of run."""


def digest_of(parameters: Mapping[str, str]) -> str:
    """One hash of parameters, whatever their order."""
    return hashlib.sha256("\n".join(f"{k}={parameters[k]}" for k in sorted(parameters)).encode()).hexdigest()


class Stages:
    """The replies of each stage of a run, kept from run to run.

    The folder is bound to ``parameters`` (chunk sizes, versions, whatever changes
    what a stage asks without showing in its prompts) by a marker that is created
    with the folder: one with another marker, or with files and none, is an error
    and stays as it is. A reply is kept under the hash of stage, prompt,
    what stands upstream, and the parameters of its calls; a changed document has
    other hashes, so just its calls are made again.

    A stage's new replies are written to a hidden folder and moved to their place
    in one step, so that a run that dies leaves whole generations only. A reply
    that doesn't agree with its own hash, and a call that failed, count as missing.
    """

    MARKER = "BINDING.json"

    def __init__(self, spark: SparkSession, folder: str, parameters: Mapping[str, str]):
        self.spark, self.folder, self.store = spark, folder.rstrip("/"), Store(spark)
        want = {"version": VERSION, "parameters": dict(parameters)}
        marker = f"{self.folder}/{self.MARKER}"
        if not self.store.exists(marker):
            if self.store.names(self.folder):
                raise Bound(f"{folder} has files and no marker; choose a new folder")
            self.store.make(self.folder)
            staged = f"{self.folder}/.{self.MARKER}-{uuid.uuid4().hex}"
            self.store.create(staged, json.dumps(want, sort_keys=True))
            try:
                self.store.move(staged, marker)
            except Exception:  # another run was faster: its marker decides
                if not self.store.exists(marker):
                    raise
            finally:
                self.store.delete(staged)
        if json.loads(self.store.read(marker)) != want:
            raise Bound(f"{folder} is bound to other parameters; choose a new folder")

    def replies(self, stage: str) -> DataFrame:
        """(key, reply, ...) of all whole generations of a stage; of equal keys one."""
        kept = [n for n in self.store.names(f"{self.folder}/{stage}") if n.startswith("generation-")]
        if not kept:
            return self.spark.createDataFrame([], REPLY)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(REPLY).parquet(f"{self.folder}/{stage}/{n}") for n in kept])
        return rows.where(F.sha2("reply", 256) == F.col("reply_sha")).dropDuplicates(["key"])

    def keyed(self, stage: str, prompts: DataFrame, upstream: Column | None, call: Mapping[str, str]) -> DataFrame:
        return prompts.withColumn("key", hash_key(F.lit(stage), F.sha2("prompt", 256), F.coalesce(upstream, F.lit("")) if upstream is not None else F.lit(""), F.lit(digest_of(call))))

    def missing(self, stage: str, prompts: DataFrame, upstream: Column | None = None, call: Mapping[str, str] | None = None) -> DataFrame:
        """Distinct (key, prompt) that no kept reply answers: what a run would call, without calling."""
        wanted = self.keyed(stage, prompts, upstream, call or {}).select("key", "prompt").dropDuplicates(["key"])
        return wanted.join(self.replies(stage).select("key").hint("merge"), "key", "left_anti")

    def run(
        self, stage: str, prompts: DataFrame, completer: Completer, upstream: Column | None = None, call: Mapping[str, str] | None = None, valid: Callable[[str], bool] = bool, attempts: int = 3,
    ) -> DataFrame:
        """``prompts`` (key columns..., prompt) with key, reply, attempts, route and reused; only missing ones are called, equal ones once.

        Failed calls have no reply and are asked again by the next run.
        """
        before = self.replies(stage)
        wanted = self.missing(stage, prompts, upstream, call)

        def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                got = [attempt(completer, p, valid, attempts, None, 0.0) for p in f["prompt"]]
                yield pd.DataFrame({"key": f["key"], "reply": [g[0] for g in got], "attempts": [g[1] for g in got], "route": [g[2] for g in got]})

        place = f"{self.folder}/{stage}/generation-{uuid.uuid4().hex}"
        staged = place.replace("/generation-", "/.staging-")
        asked = wanted.mapInPandas(ask, "key string, reply string, attempts int, route string")
        try:
            asked.withColumn("reply_sha", F.sha2("reply", 256)).select("key", "reply", "reply_sha", "attempts", "route").write.parquet(staged)
            if self.spark.read.schema(REPLY).parquet(staged).isEmpty():
                made = self.spark.createDataFrame([], REPLY)
            else:
                self.store.move(staged, place)
                made = self.spark.read.schema(REPLY).parquet(place)
        finally:
            self.store.delete(staged)
        made = made.select("key", "reply", "attempts", "route", F.lit(False).alias("reused"))
        known = before.select("key", "reply", "attempts", "route", F.lit(True).alias("reused"))
        return self.keyed(stage, prompts, upstream, call or {}).join(known.unionByName(made).hint("merge"), "key", "left").drop("prompt")
