"""Pairwise comparison: verdict pairs, records, cycles, trust, and the adaptive sort around a judge."""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.slices import freed, slices
from ..functions.text import ratio


def pair_key(a: Column, b: Column) -> Column:
    """One key for (a, b) and (b, a)."""
    return F.concat_ws("\x00", F.least(a, b), F.greatest(a, b))


def compare(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Edges (a, b, winner, flip, error) from verdicts (a, b, winner) in both slot orders.

    A comparison is decisive only if both orders name the same winner. A missing
    or failed verdict is an error: a tie that enters no record.
    """
    f, b = forward.select("a", "b", F.col("winner").alias("w1")), backward.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("winner").alias("w2"))
    error = F.col("w1").isNull() | F.col("w2").isNull()
    same = F.col("w1") == F.col("w2")
    return f.join(b, ["a", "b"], "full_outer").select("a", "b", F.when(~error & same, F.col("w1")).alias("winner"), (~error & ~same).alias("flip"), error.alias("error"))


def records(edges: DataFrame) -> DataFrame:
    """Wins, losses and ties of each participant; errors count in none."""
    sides = edges.where("not error").select(F.explode(F.array(F.struct(F.col("a").alias("name"), "winner"), F.struct(F.col("b").alias("name"), "winner"))).alias("s")).select("s.*")
    return sides.groupBy("name").agg(F.count_if(F.col("winner") == F.col("name")).alias("wins"), F.count_if(F.col("winner") != F.col("name")).alias("losses"), F.count_if(F.col("winner").isNull()).alias("ties"))


def triples(edges: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """Triples of which all three edges are strict, and whether no member beats both others.

    Edges are directed from winner to loser and joined three ways; ``among``
    (a, b, c in order) limits them to drawn triples, as all triples grow with the
    cube of the participants.
    """
    won = edges.where("winner is not null").select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), "winner")
    ab, ac, bc = (won.select(F.col("p").alias(x), F.col("q").alias(y), F.col("winner").alias(x + y)) for x, y in (("a", "b"), ("a", "c"), ("b", "c")))
    start = ab if among is None else among.join(ab, ["a", "b"])
    found = start.join(ac, [*(["a", "c"] if among is not None else ["a"])]).join(bc, ["b", "c"])
    wins = lambda n, *over: sum((F.when(F.col(o) == F.col(n), 1).otherwise(0) for o in over), F.lit(0))
    most = F.greatest(wins("a", "ab", "ac"), wins("b", "ab", "bc"), wins("c", "ac", "bc"))
    return found.select("a", "b", "c", (most < 2).alias("cyclic"))


def rates(edges: DataFrame, audit: DataFrame) -> DataFrame:
    """One row of flip, error and cycle rates with the trust predicate; errors stay in the comparisons."""
    e = edges.agg(F.count("*").alias("comparisons"), F.count_if("flip").alias("flips"), F.count_if("error").alias("errors"))
    a = audit.agg(F.count("*").alias("triples"), F.count_if("cyclic").alias("cycles"))
    r = e.crossJoin(a).select("comparisons", "triples", ratio(F.col("flips"), F.col("comparisons")).alias("flip_rate"), ratio(F.col("errors"), F.col("comparisons")).alias("error_rate"), ratio(F.col("cycles"), F.col("triples")).alias("cycle_rate"))  # one row each
    return r.withColumn("trustworthy", (F.col("error_rate") <= 0.15) & (F.col("flip_rate") <= 0.25) & (F.col("cycle_rate") <= 0.15))


@F.pandas_udf(T.LongType())
def fnv1a_32(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 32 bits, all rows in step."""
    raw = [t.encode() for t in text]
    lengths = np.array([len(b) for b in raw])
    h = np.full(len(raw), 0x811C9DC5, np.uint32)
    for k in range(lengths.max(initial=0)):
        live = np.flatnonzero(lengths > k)
        with np.errstate(over="ignore"):
            h[live] = (h[live] ^ np.array([raw[i][k] for i in live], np.uint32)) * np.uint32(0x01000193)
    return pd.Series(h.astype(np.int64))


def assign_judges(pairs: DataFrame, judges: list[str]) -> DataFrame:
    """Of the judges that aren't in the pair (or the first, if none is left), the one that the pair's hash picks."""
    eligible = F.filter(F.array(*map(F.lit, judges)), lambda j: (j != F.col("a")) & (j != F.col("b")))
    pool = F.when(F.size(eligible) > 0, eligible).otherwise(F.array(F.lit(judges[0])))
    key = fnv1a_32(pair_key(F.col("a"), F.col("b"))).bitwiseAND(F.lit(0x7FFFFFFF))
    return pairs.withColumn("pool", pool).withColumn("judge", F.element_at("pool", (key % F.size("pool")).cast("int") + 1)).drop("pool")


def merge_sort(names: list[str], better: Callable[[str, str], str | None]) -> list[str]:
    """A stable merge sort around a judge that may contradict itself; a tie keeps the left one.

    It asks n log n times where a table of all verdicts has n squared, so it is
    the driver's loop and only the verdicts are data. Each unordered pair is
    asked once.
    """
    memo: dict[tuple[str, str], str | None] = {}

    def ask(a: str, b: str) -> str | None:
        key = (a, b) if a <= b else (b, a)
        if key not in memo:
            memo[key] = better(a, b)
        return memo[key]


    def sort(items: list[str]) -> list[str]:
        if len(items) < 2:
            return items
        mid = len(items) // 2
        left, right, out = sort(items[:mid]), sort(items[mid:]), []
        while left and right:
            out.append(right.pop(0) if ask(left[0], right[0]) == right[0] else left.pop(0))
        return out + left + right

    return sort(list(names))


def draw_triples(names: list[str], count: int, seed: int = 1) -> list[tuple[str, str, str]]:
    """``count`` triples of distinct names, each in order, from a seeded generator."""
    rng = random.Random(seed)
    return [tuple(sorted(rng.sample(names, 3))) for _ in range(count)] if len(names) >= 3 else []


def recognition_trials(judge: str, names: list[str], trials: int = 8, size: int = 4, seed: int = 1) -> list[tuple[int, list[str], int]]:
    """(trial, names in slot order, the judge's own slot): own digest among shuffled decoys."""
    rng = random.Random(seed)
    decoys = sorted(n for n in names if n != judge)
    out = []
    for trial in range(trials):
        picked = rng.sample(decoys, min(size - 1, len(decoys)))
        slot = rng.randrange(len(picked) + 1)
        out.append((trial, picked[:slot] + [judge] + picked[slot:], slot))
    return out


def recognition_accuracy(trials: DataFrame) -> DataFrame:
    """Hits over trials by judge against chance 1 / size; a judge's error is a miss."""
    hit = F.coalesce((F.col("picked") == F.col("slot")).cast("int"), F.lit(0))
    return trials.groupBy("judge").agg(F.count("*").alias("trials"), F.sum(hit).alias("hits"), F.avg(hit.cast("double")).alias("accuracy"), F.avg(1 / F.col("size")).alias("chance"))


# The openings that fill, in turn, and the order of the degradations.
FILLERS = ("It is important to note that, at the end of the day, ", "In today's fast-paced world, one simply cannot deny that ", "Needless to say, when all is said and done, ")
DEGRADATIONS = ("shuffle", "truncate", "filler", "listify", "drop_ends", "reverse_sentences")

_GAP = re.compile(r"\n[\t\n\f\r ]*\n")
_STOP = re.compile(r"[.?!](?:[\"')]*)(?=[ \n\t]|$)")


def plain_sentences(text: str) -> list[str]:
    """Sentences of a degradation: they end at . ? ! with quotes and brackets behind, before a blank or the end."""
    ends = [m.end() for m in _STOP.finditer(text)]
    return [s for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if (s := text[a:b].strip())]


def degrade(kind: str, text: str) -> str:
    """A planted worse version of a text."""
    paragraphs = _GAP.split(text.strip())
    if kind == "shuffle":
        return "\n\n".join(reversed(paragraphs))
    if kind == "truncate":
        words = text.split()
        return " ".join(words[: len(words) * 45 // 100 or len(words)])
    if kind == "filler":
        return "\n\n".join(FILLERS[k % len(FILLERS)] + p[:1].lower() + p[1:] for k, p in enumerate(map(str.strip, paragraphs)))
    if kind == "listify":
        return "".join(f"- {s}\n" for s in plain_sentences(text))
    if kind == "drop_ends":
        sentences = plain_sentences(text)
        return " ".join(sentences[1:-1]) if len(sentences) > 2 else text
    if kind == "reverse_sentences":
        return "\n\n".join(" ".join(reversed(plain_sentences(p))) for p in paragraphs)
    raise ValueError(f"no degradation {kind!r}")


@F.pandas_udf(T.StringType())
def degrade_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """``degrade`` of (kind, text), a slice of a batch at a time."""
    for kind, text in batches:
        for part in slices(pd.DataFrame({"kind": kind, "text": text}), text.str.len()):
            yield pd.Series([degrade(k, t or "") for k, t in zip(part["kind"], part["text"], strict=True)], dtype=object)
    freed()


def degraded_udf(*kinds: str):
    """A struct of a text's worse versions by kind: the text goes to one worker once, whatever the number of kinds."""
    @F.pandas_udf(T.StructType([T.StructField(k, T.StringType()) for k in kinds]))
    def degraded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for text in batches:
            for part in slices(text, text.str.len()):
                yield pd.DataFrame({k: [degrade(k, t or "") for t in part] for k in kinds}, dtype=object)
        freed()

    return degraded
