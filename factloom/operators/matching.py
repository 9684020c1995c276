"""Golden facts against texts, citations against facts."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .chunks import spread

#: Facts that one broadcast holds; a longer list is taken in blocks, each a pass over the texts.
FACT_BLOCK = 100_000


class Anchors:
    """Facts of a block behind one automaton of all their anchors: a text is read once, whatever the number of facts."""

    def __init__(self, facts: list[tuple[list[str], list[list[str]]]]):
        import ahocorasick

        self.facts = facts
        self.automaton = ahocorasick.Automaton()
        for anchor in {a for need, groups in facts for a in [*need, *(x for g in groups for x in g)] if a}:
            self.automaton.add_word(anchor, anchor)
        self.automaton.make_automaton()
        self.by_anchor: dict[str, list[int]] = {}
        self.free = []  # facts that need no anchor
        for k, (need, _) in enumerate(facts):
            self.by_anchor.setdefault(need[0], []).append(k) if need else self.free.append(k)

    @staticmethod
    def bounded(text: str, a: int, b: int) -> bool:
        """Whether text[a:b] stands at token boundaries, see ``functions.text.token_pattern``."""
        digit, first, last = "0123456789".__contains__, text[a], text[b - 1]
        if digit(first):
            if a and (digit(text[a - 1]) or text[a - 1] == "." and a > 1 and digit(text[a - 2])):
                return False
        elif "a" <= first <= "z" and a and "a" <= text[a - 1] <= "z":
            return False
        after = text[b : b + 2]
        if digit(last):
            return not after or not (digit(after[0]) or after[0] == "." and len(after) > 1 and digit(after[1]))
        return not ("a" <= last <= "z" and after and "a" <= after[0] <= "z")

    def covered(self, text: str) -> int:
        found: set[str] = set()
        if len(self.automaton):
            for end, anchor in self.automaton.iter(text):
                if anchor not in found and self.bounded(text, end + 1 - len(anchor), end + 1):
                    found.add(anchor)
        count = 0
        for k in [*self.free, *(k for a in found for k in self.by_anchor.get(a, ()))]:
            need, groups = self.facts[k]
            count += found.issuperset(need) and (not groups or any(found.issuperset(g) for g in groups))
        return count


@F.pandas_udf(T.StructType([T.StructField("total", T.LongType()), T.StructField("covered", T.LongType())]))
def tokens_held(text: pd.Series, anchors: pd.Series) -> pd.DataFrame:
    """A text's distinct anchors that aren't empty, and how many of them it has at token boundaries; both are normalized."""
    def held(t: str, anchor: str) -> bool:
        at = t.find(anchor)
        while at >= 0 and not Anchors.bounded(t, at, at + len(anchor)):
            at = t.find(anchor, at + 1)
        return at >= 0

    names = [{a for a in each if a} for each in anchors]
    return pd.DataFrame({"total": [len(n) for n in names], "covered": [sum(held(t, a) for a in n) for t, n in zip(text, names, strict=True)]})


def score_facts(texts: DataFrame, golden: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, covered): how many golden facts (fact_id, anchors, any) each text has.

    A fact is covered if the text has all its anchors and, where it has
    alternatives, all of one of them; anchors match at token boundaries of the
    normalized text. Facts without either are always covered. Facts come to the
    driver a block at a time; no row per text and fact is ever made, and a text is
    normalized once a block.
    """
    spark, facts = texts.sparkSession, golden.select("anchors", "any").toLocalIterator()
    rows = spread(texts.select(*by, X.normalize(F.coalesce("text", F.lit(""))).alias("norm")))
    parts = []
    while block := [([_prepared(a)[0] for a in r.anchors or []], [[_prepared(a)[0] for a in g] for g in r.any or []]) for r in islice(facts, FACT_BLOCK)]:
        parts.append(rows.select(*by, F.lit(len(block)).cast("long").alias("total"), _covered(spark.sparkContext.broadcast(block))("norm").alias("covered")))
    if not parts:
        return rows.select(*by, F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("covered"))
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum("total").alias("total"), F.sum("covered").alias("covered"))


def _covered(sent: Broadcast):
    @F.pandas_udf("long")
    def covered(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = Anchors(sent.value)
        for norm in batches:
            yield norm.map(anchors.covered)

    return covered


def _prepared(anchor: str) -> tuple[str, str]:
    import re

    norm = re.sub("[\t\n\f\r ]+", " ", re.sub("([0-9]),([0-9])", r"\1\2", anchor.lower())).strip(" ")
    return norm, X.token_pattern(norm) or "(?!)"


def citation_coverage(articles: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """Distinct valid fact ids cited over all, and the ids that aren't cited, ascending.

    ``articles`` (by, text); ``facts`` (by, fact_id).
    """
    cited = articles.select(by, F.explode(X.citation_ids(F.col("text"))).alias("fact_id")).distinct().withColumn("cited", F.lit(1))
    rows = facts.select(by, "fact_id").distinct().join(cited.hint("merge"), [by, "fact_id"], "left")
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count("cited").alias("cited"), F.array_sort(F.collect_list(F.when(F.col("cited").isNull(), F.col("fact_id")))).alias("missing"))
