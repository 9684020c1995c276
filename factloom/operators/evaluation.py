"""Evaluations around injected models: planted pairs, recognition, generation, prompts, digest checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .completion import Completer, complete
from .matching import _prepared
from .tournament import DEGRADATIONS, degrade_udf

HEAD_CHARS = 400


def planted_pairs(digests: DataFrame, kinds: tuple[str, ...] = DEGRADATIONS) -> DataFrame:
    """(name, kind, good_first, prompt): each digest (name, text) against each planted worse version, in both slots."""
    rows = digests.select("name", "text", F.explode(F.array(*map(F.lit, kinds))).alias("kind")).withColumn("bad", degrade_udf("kind", "text"))
    rows = rows.where("bad <> text").select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("good_first"))
    slot = lambda a, b: F.when(F.col("good_first"), F.col(a)).otherwise(F.col(b))
    return rows.select("name", "kind", "good_first", F.concat(F.lit("A:\n"), slot("text", "bad"), F.lit("\n\nB:\n"), slot("bad", "text")).alias("prompt"))


def planted_trials(pairs: DataFrame, completer: Completer) -> DataFrame:
    """Verdicts of both slot orders as trials for ``calibration``: which version won first and second."""
    said = complete(pairs, completer)
    letter = F.upper(F.trim(F.regexp_extract("reply", r'"winner"\s*:\s*"([^"]*)"', 1)))
    won = F.when(~letter.isin("A", "B"), None).when((letter == "A") == F.col("good_first"), "good").otherwise("bad")
    rows = said.select("name", "kind", "good_first", won.alias("won"))
    return rows.groupBy("name", "kind").agg(F.max(F.when(F.col("good_first"), F.col("won"))).alias("first"), F.max(F.when(~F.col("good_first"), F.col("won"))).alias("second")).withColumn("error", F.col("first").isNull() | F.col("second").isNull()).withColumn("grounded", F.lit(0))


def generate(models: list[str], topics: DataFrame, completer_of: Callable[[str], Completer]) -> DataFrame:
    """(model, topic, reply); a model may miss one topic, but has two replies at least, or it is left out."""
    parts = None
    for model in models:
        part = complete(topics.select(F.col("id").alias("topic"), F.col("brief").alias("prompt")), completer_of(model), attempts=1).withColumn("model", F.lit(model))
        parts = part if parts is None else parts.unionByName(part)
    got = parts.where("reply is not null")
    n = topics.count()
    return got.withColumn("n", F.count("*").over(W.partitionBy("model"))).where(F.col("n") >= max(n - 1, 2)).select("model", "topic", "reply")


def context_headers(chunks: DataFrame, skeletons: DataFrame, completer: Completer, by: str = "doc_id") -> DataFrame:
    """One call a document, on its first chunk and heading skeleton; the reply stands before each chunk's text."""
    first = chunks.groupBy(by).agg(F.min_by("text", "chunk_no").alias("first"))
    heads = skeletons.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("heads"))
    asked = complete(first.join(heads, by, "left").select(by, F.concat_ws("\n\n", "heads", "first").alias("prompt")), completer)
    return chunks.join(asked.select(by, "reply"), by, "left").withColumn("prompt", F.concat_ws("\n\n", "reply", "text")).drop("reply")


def evaluate_prompt(template: str, chunks: DataFrame, completer: Completer, known: DataFrame | None, budget: int) -> DataFrame:
    """Replies for a template over chunks (chunk_id, text); only missing ones are called, within a budget of calls."""
    prompts = chunks.select("chunk_id", F.concat(F.lit(template), F.lit("\n"), "text").alias("prompt"))
    wanted = prompts.select(X.hash_key(F.col("prompt")).alias("prompt_sha")).distinct()
    calls = (wanted if known is None else wanted.join(known.select("prompt_sha"), "prompt_sha", "left_anti")).count()
    if calls > budget:
        raise ValueError(f"{calls} calls are over the budget of {budget}")
    return complete(prompts, completer, known)


def cluster_outline(clusters: DataFrame, labels: DataFrame, by: str = "doc_id") -> DataFrame:
    """Sections of clusters (by, cluster, fact_ids) in order, titled by labels (by, cluster, label), else "Cluster n"."""
    rows = clusters.join(labels, [by, "cluster"], "left")
    n = F.row_number().over(W.partitionBy(by).orderBy("cluster"))
    return rows.withColumn("section", n).select(by, "section", F.coalesce(F.nullif(F.trim("label"), F.lit("")), F.concat(F.lit("Cluster "), F.col("section").cast("string"))).alias("title"), "fact_ids")


def parse_cluster_labels(replies: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, cluster, label) of "C<n>: label" lines; the last one of a cluster holds."""
    lines = replies.select(by, F.posexplode(F.split("reply", "\n")).alias("i", "t")).select(by, "i", F.regexp_extract("t", r"^\s*C([0-9]+):", 1).try_cast("int").alias("cluster"), F.trim(F.regexp_extract("t", r"^\s*C[0-9]+:(.*)$", 1)).alias("label"))
    return lines.where("cluster is not null and label <> ''").groupBy(by, "cluster").agg(F.max_by("label", "i").alias("label"))


def check_digests(digests: DataFrame, tensions: list[tuple[str, list[list[str]]]], preamble: list[str], artifacts: list[str], fabrications: list[str], band: tuple[int, int]) -> DataFrame:
    """Adds tensions kept, preamble, artifact and fabrication lists, words and the word band to digests (name, text).

    A tension is kept if each of its groups has a member at token boundaries;
    hygiene and fabrications are plain parts of the normalized text, preambles of
    its first 400 bytes.
    """
    norm = X.normalize(F.col("text"))
    rows = digests.withColumn("norm", norm)
    token = lambda a: F.col("norm").rlike(_prepared(a)[1])
    any_of = lambda group: F.exists(F.array(*[token(a) for a in group]), lambda b: b) if group else F.lit(False)
    kept = [F.when(F.forall(F.array(*[any_of(g) for g in both]), lambda b: b), F.lit(name)) for name, both in tensions]
    some = lambda column, names: F.array_compact(F.array(*[F.when(F.contains(column, F.lit(_prepared(n)[0])), F.lit(n)) for n in names])) if names else F.array().cast("array<string>")
    head = F.substring("norm", 1, HEAD_CHARS)
    out = rows.withColumns({"tensions": F.array_compact(F.array(*kept)) if kept else F.array().cast("array<string>"), "preamble": some(head, preamble), "artifacts": some(F.col("norm"), artifacts), "fabricated": some(F.col("norm"), fabrications), "words": X.word_count(F.col("text"))})
    return out.withColumn("word_band_ok", F.col("words").between(*band)).withColumn("unclean", (F.size("preamble") > 0) | (F.size("artifacts") > 0)).drop("norm")


def route_digest(roles: dict[str, str]) -> str:
    """One hash of a route policy, whatever the order of its roles."""
    import hashlib

    return hashlib.sha256("\n".join(f"{k}={roles[k]}" for k in sorted(roles)).encode()).hexdigest()


def facts_reuse(explicit: bool, resume: bool, verified: bool, provenance: bool) -> str:
    """Reuse facts when asked to, or on resume in a verified folder of before provenance; else verify first."""
    if explicit:
        return "reuse"
    return "reuse_unverified" if resume and verified and not provenance else "verify"
