"""Leaderboards: scores matched to slugs by alias, candidates by role."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import family
from .numbering import sums_before

#: Aliases are broadcast up to so many; a longer list takes a sort of the cells' distinct values first.
MOST_ALIASES = 10_000

# The order in which roles are decided.
ROLE_ORDER = ("research", "outline", "section", "edit", "merge", "judge", "comedy")


def match_scores(cells: DataFrame, aliases: DataFrame, roster: DataFrame) -> DataFrame:
    """Best score per board and slug.

    A cell (board, cell, score) is the slug whose alias (alias, slug) it holds,
    in any case; of several, the first in the aliases' order. Only distinct cells
    are tested, against a broadcast list of aliases with a checked length; slugs
    that aren't in the roster (slug) drop out. ``lower`` boards take the smallest.
    """
    if aliases.limit(MOST_ALIASES + 1).count() > MOST_ALIASES:
        raise ValueError(f"over {MOST_ALIASES} aliases")
    names = cells.select("cell").distinct()
    found = names.join(F.broadcast(aliases), F.contains(F.lower("cell"), F.lower("alias"))).groupBy("cell").agg(F.min_by("slug", "alias").alias("slug"))
    best = F.when(F.first("lower_is_better"), F.min("score")).otherwise(F.max("score"))
    return cells.join(found, "cell").join(roster.select("slug"), "slug", "left_semi").groupBy("board", "slug").agg(best.alias("score"))


def candidates(scores: DataFrame, boards: DataFrame, roster: DataFrame, roles: DataFrame) -> DataFrame:
    """Per role the board's slugs by score in the board's direction, ties by place in the roster."""
    rows = roles.join(scores, "board").join(boards.select("board", "lower_is_better"), "board").join(roster, "slug")
    order = F.when(F.col("lower_is_better"), F.col("score")).otherwise(-F.col("score"))
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("role").orderBy(order, "pos")))


def picks(ranked: DataFrame) -> DataFrame:
    """The first candidate of each role; a role with ``cross_family_with`` takes the first of another family.

    The referenced role's own pick is its first candidate; where all are of its
    family, the first stays.
    """
    first = ranked.where("rank = 1").select(F.col("role").alias("cross_family_with"), family(F.col("slug")).alias("taken"))
    rows = ranked.join(first, "cross_family_with", "left")
    other = F.col("taken").isNull() | (family(F.col("slug")) != F.col("taken"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role")), F.lit(0)), F.lit(len(ROLE_ORDER) + 1))
    return rows.groupBy("role").agg(F.coalesce(F.min_by(F.when(other, F.col("slug")), F.when(other, F.col("rank"))), F.min_by("slug", "rank")).alias("slug")).withColumn("place", place)


#: Columns by which results are ranked, best first; - is from the largest down. Names break ties.
COMPARATORS = {
    "candidates": ("-f1", "name"),  # O01
    "recall": ("-recall", "name"),  # O02
    "digests": ("-composite", "-tensions", "name"),  # O03
    "structured": ("-passed", "-item_score", "-field_score", "name"),  # O05
    "labels": ("-macro_f1", "-accuracy", "name"),  # O06
    "code": ("-pass_rate", "-solved", "name"),  # O07
    "trace": ("-accuracy", "-correct", "name"),  # O08
}


def ranked(results: DataFrame, comparator: str, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``results`` with their rank under a comparator, from 1, numbered over ranges of the order, so that no task sorts all of them."""
    keys = COMPARATORS[comparator]
    signed = results.select("*", *((-F.col(k[1:])).alias(f"down_{k[1:]}") for k in keys if k.startswith("-")))
    order = [f"down_{k[1:]}" if k.startswith("-") else k for k in keys]
    placed = sums_before(signed, order, {"rank": F.lit(1).cast("long")}, write)
    return placed.select(*results.columns, (F.col("rank") + 1).alias("rank"))
