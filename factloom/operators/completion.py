"""Language-model calls as an injected function: templates, retries, reuse, budgets."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import SLICE
from ..functions.text import hash_key


class Completer(Protocol):
    """Anything that turns a prompt into a reply."""

    def __call__(self, prompt: str) -> str: ...


def render(template: str, values: dict[str, str]) -> str:
    """P20: every {{placeholder}} in one pass, so that a value is never expanded again."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values.get(m[1], m[0]), template)


def valid_prompt(template: str, needed: tuple[str, ...] = ("source", "facts")) -> bool:
    """P19"""
    return all(f"{{{{{n}}}}}" in template for n in needed)


def call_plan(units: DataFrame, edit: bool, attempts: int, limit: int) -> DataFrame:
    """Calls that must, and may at most, be made per document (chunks), before any is.

    Research is a call a chunk, the outline one, each section one and one more if
    edited; sections are capped at the chunks, three at least. What the limit
    leaves is headroom for recovery, two at most; a plan over the limit is
    rejected.
    """
    cap = F.greatest(F.lit(3), F.col("chunks"))
    mandatory = F.col("chunks") + 1 + (2 if edit else 1) * cap
    rows = units.withColumn("section_cap", cap).withColumn("mandatory", mandatory)
    return rows.withColumn("worst_case", F.col("mandatory") * attempts).withColumn("headroom", F.least(F.lit(2), F.greatest(F.lit(0), F.lit(limit) - F.col("mandatory")))).withColumn("rejected", F.col("mandatory") > limit)


def attempt(complete: Completer, prompt: str, valid: Callable[[str], bool], attempts: int, fallback: Completer | None, base_s: float) -> tuple[str | None, int, str]:
    """Replies are validated inside the loop: ``attempts`` tries with growing waits, then the fallback once."""
    error = ""
    for n in range(1, attempts + 1):
        try:
            reply = complete(prompt)
            if valid(reply):
                return reply, n, "primary"
            error = "invalid"
        except Exception as e:  # noqa: BLE001  a call may fail in any way; the kind is kept
            error = type(e).__name__
        if n < attempts and base_s:
            time.sleep(min(base_s * 2 ** (n - 1), 8.0))
    if fallback is not None:
        try:
            reply = fallback(prompt)
            if valid(reply):
                return reply, attempts + 1, "fallback"
        except Exception as e:  # noqa: BLE001
            error = type(e).__name__
    return None, attempts + (fallback is not None), error


def complete(prompts: DataFrame, completer: Completer, known: DataFrame | None = None, valid: Callable[[str], bool] = bool, attempts: int = 3, fallback: Completer | None = None, base_s: float = 0.0) -> DataFrame:
    """Replies to ``prompts`` (key columns..., prompt): known ones are taken, only the others are called.

    Equal prompts are called once. ``known`` (prompt_sha, reply) is the cache.
    Returns prompt_sha, the keys, reply, attempts and route (cached, primary,
    fallback or the kind of error). Write the result before using it twice: a
    lost task would call again. Prompts are shuffled once, with their keys, and
    sorted by hash, so that a reply is made where its keys are: replies aren't
    shuffled to meet them. A copy of a prompt leaves its task without the text.
    """
    keys = [c for c in prompts.columns if c != "prompt"]
    schema = T.StructType([T.StructField("prompt_sha", T.StringType()), *(prompts.schema[c] for c in keys), T.StructField("reply", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("route", T.StringType())])
    dealt = prompts.select(hash_key(F.col("prompt")).alias("prompt_sha"), *keys, "prompt")
    marked = T.StructType([*dealt.schema.fields, T.StructField(PLACE, T.IntegerType())])
    rows = dealt.mapInArrow(_copies_bare, marked)
    if known is not None:
        rows = known.select("prompt_sha", F.col("reply").alias("prompt"), F.lit(KNOWN).alias(PLACE)).unionByName(rows, allowMissingColumns=True).select(*marked.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, got = None, None
        for batch in batches:
            shas, places, said, begin, size = batch.column("prompt_sha").to_pylist(), batch.column(PLACE).to_pylist(), [], 0, 0
            for k, (sha, place) in enumerate(zip(shas, places, strict=True)):
                if sha != last:
                    text = batch.column("prompt")[k].as_py()
                    last, got = sha, (text, 0, "cached") if place == KNOWN else attempt(completer, text, valid, attempts, fallback, base_s)
                said.append(got)
                size += len(got[0] or "")
                if size >= SLICE or k + 1 == len(shas):  # a reply may have many keys
                    part = batch.slice(begin, len(said))
                    made = [*(part.column(c) for c in ["prompt_sha", *keys]), *(pa.array(v, t) for v, t in zip(zip(*said, strict=True), (pa.string(), pa.int32(), pa.string()), strict=True))]
                    yield pa.RecordBatch.from_arrays(made, schema.names).filter(pc.not_equal(part.column(PLACE), KNOWN))
                    said, begin, size = [], k + 1, 0

    return rows.repartition("prompt_sha").sortWithinPartitions("prompt_sha", PLACE).mapInArrow(run, schema)


#: What a row is to the prompts of its hash, in the order in which they are read: a known reply, a prompt, a copy of one without its text.
PLACE, KNOWN, FIRST, COPY = "_place", 0, 1, 2
#: Hashes that a task remembers when it looks for copies.
SEEN = 1 << 17


def _copies_bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``PLACE``; of equal prompts in a task the first keeps its text, so that a prompt of many copies isn't heavy for the task that calls it."""
    seen: set[str] = set()
    for batch in batches:
        places = []
        for sha in batch.column("prompt_sha").to_pylist():
            places.append(COPY if sha in seen else FIRST)
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(sha)
        at = pa.array(places, pa.int32())
        text = batch.column("prompt")
        kept = pc.if_else(pc.equal(at, FIRST), text, pa.scalar(None, text.type)) if COPY in places else text
        yield pa.RecordBatch.from_arrays([*(kept if n == "prompt" else batch.column(n) for n in batch.schema.names), at], [*batch.schema.names, PLACE])


def embed(texts: DataFrame, embedder: Callable[[list[str]], list[list[float]]], text_col: str = "text", batch: int = 64) -> DataFrame:
    """Adds ``embedding`` (array<float>); an embedder that returns another number of vectors is an error."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            vectors: list[list[float]] = []
            for k in range(0, len(f), batch):
                part = f[text_col].iloc[k : k + batch].tolist()
                found = embedder(part)
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} vectors for {len(part)} texts")
                vectors += found
            yield f.assign(embedding=vectors)

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInPandas(run, names + ", embedding array<float>")


def reuse_counts(units: DataFrame, stored: DataFrame) -> DataFrame:
    """Units per stage whose content, prompt and upstream hashes all agree with a stored response."""
    keys = ["stage", "unit", "content_sha", "prompt_sha", "upstream_sha"]
    hit = units.join(stored.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return hit.groupBy("stage").agg(F.count("*").alias("units"), F.count("hit").alias("reused"))


def hill_climb(prompt: str, score: Callable[[str], float], mutations: list[Callable[[str], str]], rounds: int) -> tuple[str, float]:
    """Mutations in turn; a candidate is taken if it scores higher, or as high and is shorter."""
    best, best_score = prompt, score(prompt)
    for k in range(rounds):
        candidate = mutations[k % len(mutations)](best)
        found = score(candidate)
        if found > best_score or (found == best_score and len(candidate) < len(best)):
            best, best_score = candidate, found
    return best, best_score
