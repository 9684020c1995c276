"""Scores, gates and rates over verdict, prediction and outcome rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import harmonic, ratio

#: Verdicts of a judge; anything else counts as not_in_source.
VERDICTS = ("supported", "missed", "not_in_source")


def error_class(code: Column) -> Column:
    """Systemic errors abort a sweep, retryable ones are tried again."""
    return F.when(code.isin(401, 402, 403, 404), "systemic").when(code.isin(408, 429) | (code >= 500), "retryable").otherwise("other")


def criterion(kind: Column) -> Column:
    """X40"""
    return F.when(kind == 0, "merit").when(kind == 1, "comedy").otherwise("publish")


def prediction_status(skipped: Column, error: Column, pred: Column, gold: Column) -> Column:
    """X41"""
    return F.when(skipped, "skipped").when(error, "error").when(pred.isNull(), "unparseable").when(pred == gold, "ok").otherwise("wrong")


def verdict_counts(verdicts: DataFrame, *by: str) -> DataFrame:
    """Counts by verdict and precision, recall, F1; with fewer keys, counts add up before ratios are taken."""
    v = F.lower(F.trim("verdict"))
    counts = verdicts.groupBy(*by).agg(
        F.count_if(v == "supported").alias("supported"), F.count_if(v == "missed").alias("missed"),
        F.count_if(~v.isin("supported", "missed") | v.isNull()).alias("not_in_source"),
    )
    return with_prf(counts, "supported", "not_in_source", "missed")


def with_prf(counts: DataFrame, tp: str, fp: str, fn: str) -> DataFrame:
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return counts.withColumns({"precision": p, "recall": r}).withColumn("f1", harmonic(F.col("precision"), F.col("recall")))


def class_scores(predictions: DataFrame, allowed: list[str], model: str = "model") -> DataFrame:
    """Per model and allowed label support, TP, FP, FN, P, R, F1; labels without support are there too."""
    labels = predictions.sparkSession.createDataFrame([(a,) for a in allowed], "label string")
    sides = predictions.select(model, F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.when(F.col("pred") == F.col("gold"), 1).otherwise(0).alias("tp"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(0).alias("tp"), F.lit(1).alias("p")))).alias("s")).select(model, "s.*")
    counts = sides.where(F.col("label").isNotNull()).groupBy(model, "label").agg(F.sum("g").alias("support"), F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))
    every = predictions.select(model).distinct().crossJoin(F.broadcast(labels))  # a row per model and allowed label
    full = every.join(counts, [model, "label"], "left").na.fill(0, ["support", "tp", "fp", "fn"])
    return with_prf(full, "tp", "fp", "fn")


def model_scores(predictions: DataFrame, allowed: list[str], model: str = "model") -> DataFrame:
    """Accuracy and macro-F1 over all allowed labels."""
    macro = class_scores(predictions, allowed, model).groupBy(model).agg(F.avg("f1").alias("macro_f1"))
    rows = predictions.groupBy(model).agg(F.count("*").alias("items"), F.count_if(F.col("pred") == F.col("gold")).alias("correct"), F.count_if(F.col("pred").isNull()).alias("unparseable"))
    return rows.join(macro, model).withColumn("accuracy", ratio(F.col("correct"), F.col("items")))


def pass_rates(outcomes: DataFrame, model: str, problem: str) -> DataFrame:
    """Cases passed over all, problems solved; a problem without cases can't be solved."""
    per = outcomes.groupBy(model, problem).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"), F.max(F.col("blocked").cast("int")).alias("blocked"))
    return per.groupBy(model).agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.count_if((F.col("passed") == F.col("total")) & (F.col("total") > 0)).alias("solved"), F.sum("blocked").alias("blocked")).withColumn("pass_rate", ratio(F.col("passed"), F.col("total")))


def calibration(trials: DataFrame, *by: str) -> DataFrame:
    """Trials (first, second winner slot, better slot, grounded marks); errors are left out of the rates.

    A pair is judged in both slot orders. It is robust if the better one wins
    both, biased if one slot wins both.
    """
    ok = ~F.col("error")
    robust = (F.col("first") == "good") & (F.col("second") == "good")
    biased = F.col("first") != F.col("second")
    found = trials.groupBy(*by).agg(F.count_if(ok).alias("pairs"), F.count_if(F.col("error")).alias("errors"), F.count_if(ok & robust).alias("robust"), F.count_if(ok & (F.col("first") == "good")).alias("naive"), F.count_if(ok & biased).alias("biased"), F.sum(F.when(ok, F.col("grounded"))).alias("grounded"))
    pairs = F.col("pairs")
    rates = found.select(*by, "pairs", "errors", ratio(F.col("robust"), pairs).alias("robust_rate"), ratio(F.col("naive"), pairs).alias("naive_rate"), ratio(F.col("biased"), pairs).alias("bias_rate"), ratio(F.coalesce("grounded", F.lit(0)), 2 * pairs).alias("grounded_rate"))
    return rates.withColumn("trustworthy", (F.col("pairs") > 0) & (F.col("robust_rate") >= 0.9) & (F.col("bias_rate") <= 0.2))


def gate_reasons(min_recall: float = 0, max_overlap: float = 0, min_tensions: int = 0, clean: bool = False, word_band: tuple[int, int] | None = None, max_fabrications: int = 0, exclude: tuple[str, ...] = ()) -> Column:
    """Every reason why a digest (recall, overlap, tensions_kept, unclean, words, fabrications, name) is out."""
    out = []
    if min_recall:
        out.append(F.when(F.col("recall") < min_recall, "low recall"))
    if max_overlap:
        out.append(F.when(F.col("overlap") > max_overlap, "copier"))
    if min_tensions:
        out.append(F.when(F.col("tensions_kept") < min_tensions, "flattened tensions"))
    if clean:
        out.append(F.when(F.col("unclean"), "hygiene"))
    if word_band:
        out.append(F.when(~F.col("words").between(*word_band), "word band"))
    if max_fabrications:
        out.append(F.when(F.col("fabrications") > max_fabrications, "fabricates"))
    if exclude:
        out.append(F.when(F.exists(F.array(*[F.lit(e.lower()) for e in exclude if e]), lambda e: F.contains(F.lower("name"), e)), "excluded"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def run_gate(coverage: Column, cited: Column, precision: Column, words: Column, min_coverage: float = 0, min_cited: float = 0, min_precision: float = 0, band: tuple[int, int] = (0, 0)) -> Column:
    """Null if a run passes, else the first reason; a limit of 0 is off, a metric that is asked for and missing fails."""
    reason = F.lit(None).cast("string")
    checks = [(band[1] and words > band[1], "too long"), (band[0] and words < band[0], "too short"), (min_precision and (precision.isNull() | (precision < min_precision)), "precision"), (min_cited and (cited.isNull() | (cited < min_cited)), "cited"), (min_coverage and coverage < min_coverage, "coverage")]
    for failed, name in checks:
        if not isinstance(failed, (int, float)):
            reason = F.when(failed, name).otherwise(reason)
    return reason
