"""Whole tournaments in rounds: the next comparison of every merge of every tournament is one table, judged at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .completion import Completer, attempt, render
from .tournament import fnv1a_32, pair_key

#: What a judge is asked, by criterion; the reply is a JSON object.
_REPLY = 'Reply with {"winner": "A" or "B", "reason": "..."} and quote what decided.\n\nABOUT:\n{{source}}\n\nA:\n{{a}}\n\nB:\n{{b}}'
RUBRICS = {
    "merit": "Which of two digests is truer to its source and leaves less out? " + _REPLY,
    "comedy": "Which of two bits on the same topic is funnier? " + _REPLY,
    "publish": "You are an editor. Which of two articles would you print as it is? " + _REPLY,
}
VERDICT = "winner string, reason string"


class Tournaments(NamedTuple):
    """What came out: (contest, rank, name); a row per comparison; a row per audited triple."""

    ranking: DataFrame
    edges: DataFrame
    audit: DataFrame


def merges(n: int) -> list[tuple[int, int, int]]:
    """(depth, first, middle) of each merge of a merge sort of ``n`` places, halves rounded down to the left."""
    out, open_ = [], [(0, 0, n)]
    while open_:
        depth, a, b = open_.pop()
        if b - a > 1:
            mid = a + (b - a) // 2
            out.append((depth, a, mid))
            open_ += [(depth + 1, a, mid), (depth + 1, mid, b)]
    return out


def routed(pairs: DataFrame, judges: list[str]) -> DataFrame:
    """``pairs`` (a, b) with the judge that the pair's hash picks of those that aren't in it, and its label; the first judge, if none is left."""
    eligible = F.filter(F.array(*map(F.lit, judges)), lambda j: (j != F.col("a")) & (j != F.col("b")))
    key = fnv1a_32(pair_key(F.col("a"), F.col("b"))).bitwiseAND(F.lit(0x7FFFFFFF))
    rows = pairs.withColumn("pool", eligible).withColumn("key", key)
    picked = F.when(F.size("pool") > 0, F.get("pool", (F.col("key") % F.greatest(F.size("pool"), F.lit(1))).cast("int")))
    return rows.withColumn("judge", F.coalesce(picked, F.lit(judges[0]))).withColumn("label", F.coalesce(picked, F.lit(f"{judges[0]} (fallback)"))).drop("pool", "key")


def judged(pairs: DataFrame, entries: DataFrame, judges: Mapping[str, Completer], attempts: int = 1) -> DataFrame:
    """``pairs`` (contest, a, b, ...) with label, winner, flip, error, grounded, reason.

    Both slot orders are asked, of one judge; a pair has a winner only if both
    name it. A call that fails, or a reply without a winner, is an error, which
    stops nothing else. With one judge, its label is empty.
    """
    names = list(judges)
    rows = routed(pairs, names) if len(names) > 1 else pairs.withColumns({"judge": F.lit(names[0]), "label": F.lit("")})
    for slot in ("a", "b"):
        side = entries.select("contest", F.col("name").alias(slot), F.col("text").alias(f"text_{slot}"), *(["criterion", "source"] if slot == "a" else []))
        rows = rows.join(side, ["contest", slot])
    asked = {"forward": "string", "backward": "string"}
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {n} {t}" for n, t in asked.items())
    valid = lambda reply: bool(reply and "{" in reply)

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            replies: dict[str, list[str | None]] = {"forward": [], "backward": []}
            for r in f.itertuples():
                for way, (a, b) in (("forward", (r.text_a, r.text_b)), ("backward", (r.text_b, r.text_a))):
                    prompt = render(RUBRICS[r.criterion], {"source": r.source or "", "a": a or "", "b": b or ""})
                    replies[way].append(attempt(judges[r.judge], prompt, valid, attempts, None, 0.0)[0])
            yield f.assign(**replies)

    said = rows.mapInPandas(call, schema)
    for way in asked:
        said = said.withColumn(way, F.from_json(F.regexp_extract(way, r"(?s)(\{.*\})", 1), VERDICT))
    letter = lambda way: F.upper(F.trim(F.col(way)["winner"]))
    one, two = F.when(letter("forward") == "A", F.col("a")).when(letter("forward") == "B", F.col("b")), F.when(letter("backward") == "A", F.col("b")).when(letter("backward") == "B", F.col("a"))
    text_of = lambda name: F.when(name == F.col("a"), F.col("text_a")).otherwise(F.col("text_b"))
    error = one.isNull() | two.isNull()
    held = F.coalesce(X.grounded(F.col("forward")["reason"], text_of(one)), F.lit(False)) | F.coalesce(X.grounded(F.col("backward")["reason"], text_of(two)), F.lit(False))
    return said.select(*pairs.columns, "label", F.when(~error & (one == two), one).alias("winner"), (~error & (one != two)).alias("flip"), error.alias("error"), (~error & held).alias("grounded"), F.when(~error, F.col("forward")["reason"]).alias("reason"))


EDGE = ["contest", "a", "b", "label", "winner", "flip", "error", "grounded", "reason"]


def drawn_triples(ranking: DataFrame, count: int, seed: int = 1) -> DataFrame:
    """(contest, draw, x, y, z): ``count`` draws of three different names of each contest, by the digest of contest, draw and seed."""
    names = ranking.groupBy("contest").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]).alias("names"))
    rows = names.where(F.size("names") >= 3).select("contest", "names", F.size("names").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(count))).alias("draw")) if count else names.select("contest", "names", F.lit(0).alias("n"), F.lit(0).alias("draw")).where("false")
    digest = F.md5(F.concat_ws(":", F.col("contest"), F.col("draw").cast("string"), F.lit(str(seed))))
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(3)]
    rows = rows.select("*", (h[0] % F.col("n")).alias("i"), (h[1] % (F.col("n") - 1)).alias("j"), (h[2] % (F.col("n") - 2)).alias("l"))
    rows = rows.withColumn("j", F.col("j") + (F.col("j") >= F.col("i")).cast("int"))  # the place among those that are left
    for other in (F.least("i", "j"), F.greatest("i", "j")):
        rows = rows.withColumn("l", F.col("l") + (F.col("l") >= other).cast("int"))
    return rows.select("contest", "draw", *(F.get("names", F.col(c).cast("int")).alias(x) for c, x in zip("ijl", "xyz", strict=True)))


def tournaments(
    entries: DataFrame, judges: Mapping[str, Completer], write: Callable[[DataFrame], DataFrame], audit_triples: int = 5, most: int = 64, attempts: int = 1, seed: int = 1
) -> Tournaments:
    """Every contest of ``entries`` (contest, criterion, source, name, seed, text) ranked by its judges.

    Each contest is merge-sorted around a judge that may contradict itself; a tie
    keeps the left one, so the order of ``seed`` breaks ties. A merge waits for one
    verdict at a time, but all merges of a level, of all contests, are rows of one
    table: a round judges the heads of all of them in one stage, moves each winner
    out, and writes the table, so that a call is never made again. Contests have
    up to ``most`` entries, and rounds are as many as the longest has; the number
    of contests is open. Two names meet once in a sort; the audit asks only for
    those pairs of its triples that haven't met. Several judges are a panel: none
    rules on itself (``routed``).

    Names are unique in a contest. A contest of one is ranked without a comparison.
    """
    entries = write(entries)
    place = F.row_number().over(W.partitionBy("contest").orderBy("seed", "name")) - 1
    runs = write(entries.select("contest", place.alias("lo"), F.array("name").alias("names")))
    sizes = runs.groupBy("contest").agg(F.count("*").cast("int").alias("n"))
    found = sorted(r.n for r in sizes.select("n").distinct().collect())
    if found and found[-1] > most:
        raise ValueError(f"a contest has {found[-1]} entries, over {most}")
    shape = [(n, *m) for n in found for m in merges(n)]
    judged_rounds = []
    for depth in range(max((d for _, d, *_ in shape), default=-1), -1, -1):
        here = entries.sparkSession.createDataFrame([(n, a, mid) for n, d, a, mid in shape if d == depth], "n int, lo int, mid int")
        nodes = sizes.join(F.broadcast(here), "n").select("contest", "lo", "mid")
        left, right = runs.withColumnRenamed("names", "left"), runs.select("contest", F.col("lo").alias("mid"), F.col("names").alias("right"))
        active = nodes.join(left, ["contest", "lo"]).join(right, ["contest", "mid"]).select("contest", "lo", "mid", "left", "right", F.array().cast("array<string>").alias("out"))
        done = []
        while True:
            heads = active.select("*", F.get("left", F.lit(0)).alias("a"), F.get("right", F.lit(0)).alias("b"))
            said = judged(heads, entries, judges, attempts)
            second = F.coalesce(F.col("winner") == F.col("b"), F.lit(False))
            rest = lambda side: F.slice(side, F.lit(2), F.size(side))
            moved = said.withColumns({
                "out": F.concat("out", F.array(F.when(second, F.col("b")).otherwise(F.col("a")))),
                "left": F.when(second, F.col("left")).otherwise(rest("left")), "right": F.when(second, rest("right")).otherwise(F.col("right")),
            })
            moved = write(moved.withColumn("over", (F.size("left") == 0) | (F.size("right") == 0)))
            judged_rounds.append(moved.select(EDGE))
            done.append(moved.where("over").select("contest", "lo", F.concat("out", "left", "right").alias("names")))
            active = moved.where("not over").select("contest", "lo", "mid", "left", "right", "out")
            if active.isEmpty():
                break
        merged = nodes.select("contest", F.explode(F.array("lo", "mid")).alias("lo"))
        runs = write(reduce(DataFrame.unionByName, done).unionByName(runs.join(merged, ["contest", "lo"], "left_anti")))
    ranking = runs.select("contest", F.posexplode("names").alias("rank", "name")).withColumn("rank", F.col("rank") + 1)
    schema = "contest string, a string, b string, label string, winner string, flip boolean, error boolean, grounded boolean, reason string"
    edges = reduce(DataFrame.unionByName, judged_rounds) if judged_rounds else entries.sparkSession.createDataFrame([], schema)
    triples = drawn_triples(ranking, audit_triples, seed)
    sides = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("z").alias("y")), F.struct("x", F.col("z").alias("y"))))
    met = write(triples.select("contest", "draw", sides.alias("s")).select("contest", "draw", F.col("s.x").alias("a"), F.col("s.y").alias("b")).withColumn("key", pair_key(F.col("a"), F.col("b"))))
    first = met.groupBy("contest", "key").agg(F.min_by("a", F.struct("draw", "a", "b")).alias("a"), F.min_by("b", F.struct("draw", "a", "b")).alias("b"))
    new = first.join(edges.select("contest", pair_key(F.col("a"), F.col("b")).alias("key")), ["contest", "key"], "left_anti")
    edges = edges.unionByName(write(judged(new.select("contest", "a", "b"), entries, judges, attempts)).select(EDGE))
    winners = met.join(edges.select("contest", pair_key(F.col("a"), F.col("b")).alias("key"), "winner"), ["contest", "key"]).groupBy("contest", "draw").agg(F.collect_list("winner").alias("w"))
    audit = winners.where(F.size("w") == 3).select("contest", "draw", (F.size(F.array_distinct("w")) == 3).alias("cyclic"))  # three strict edges; no name wins two
    return Tournaments(ranking, edges, audit)


def standings(edges: DataFrame) -> DataFrame:
    """(contest, name, wins, losses, ties) over the comparisons made; errors count in none."""
    sides = edges.where("not error").select("contest", "winner", F.explode(F.array("a", "b")).alias("name"))
    won = F.col("winner") == F.col("name")
    return sides.groupBy("contest", "name").agg(F.count_if(won).alias("wins"), F.count_if(~won).alias("losses"), F.count_if(F.col("winner").isNull()).alias("ties"))


def judge_counts(edges: DataFrame) -> DataFrame:
    """Comparisons that each judge ruled on, failed ones included."""
    return edges.groupBy("contest", F.col("label").alias("judge")).agg(F.count("*").alias("comparisons"), F.count_if("error").alias("errors"))


def trust(edges: DataFrame, audit: DataFrame) -> DataFrame:
    """Per contest the rates of flips, errors, grounded verdicts and cycles, and whether the ranking can be trusted."""
    e = edges.groupBy("contest").agg(F.count("*").alias("comparisons"), *(F.count_if(c).alias(f"{c}s") for c in ("flip", "error", "grounded")))
    rows = e.join(audit.groupBy("contest").agg(F.count("*").alias("triples"), F.count_if("cyclic").alias("cycles")), "contest", "left").na.fill(0, ["triples", "cycles"])
    n = F.col("comparisons")
    rate: Callable[[str, Column], Column] = lambda c, of: X.ratio(F.col(c), of)
    rows = rows.select("contest", "comparisons", "triples", rate("flips", n).alias("flip_rate"), rate("errors", n).alias("error_rate"), rate("groundeds", n).alias("grounded_rate"), rate("cycles", F.col("triples")).alias("cycle_rate"))
    return rows.withColumn("trustworthy", (n > 0) & (F.col("error_rate") <= 0.15) & (F.col("flip_rate") <= 0.25) & (F.col("cycle_rate") <= 0.15))
