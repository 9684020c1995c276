"""Facts: bullets with their continuation lines, exact and near duplicates, routing to sections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import fact_key, fact_tokens, title_normalize

# Near-duplicate thresholds.
LEAST_TOKENS, LEAST_OVERLAP, MOST_BITS = 5, 0.72, 10

BULLET = r"^[-*+][\t ]+"
CONTINUED = r"^[\t ]+[^\t\n\f\r ]"


def bullet_entries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fact_no, bullet, first_line, last_line) of every bullet with the indented lines behind it."""
    order = W.partitionBy(id_col).orderBy("line_no")
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    marked = lines.withColumn("kind", F.when(F.col("line").rlike(BULLET), "b").when(F.col("line").rlike(CONTINUED), "c").otherwise("x"))
    grouped = marked.withColumn("fact_no", F.sum((F.col("kind") == "b").cast("int")).over(order)).withColumn("broken", F.max(F.when(F.col("kind") == "x", F.col("line_no"))).over(order)).withColumn("began", F.max(F.when(F.col("kind") == "b", F.col("line_no"))).over(order))
    kept = grouped.where((F.col("kind") != "x") & F.col("began").isNotNull() & (F.col("broken").isNull() | (F.col("broken") < F.col("began"))))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return kept.groupBy(id_col, "fact_no").agg(text.alias("bullet"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def dedup_facts(facts: DataFrame, by: str, order: list[str], text_col: str = "bullet") -> DataFrame:
    """Of facts with one key in a group, the first stays; facts of a blank key all stay."""
    keyed = facts.withColumn("fact_key", fact_key(F.col(text_col)))
    first = F.row_number().over(W.partitionBy(by, "fact_key").orderBy(*order)) == 1
    return keyed.withColumn("keep", first | (F.col("fact_key") == "")).where("keep").drop("keep")


def token_overlap(a: Column, b: Column) -> Column:
    """Tokens of b that a has, with multiplicity, over the shorter length."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 0.0).otherwise(F.size(F.filter(b, lambda t: F.array_contains(a, t))) / least)


@lru_cache(maxsize=1 << 18)
def _fnv1a_64(token: str) -> int:
    h = 0xCBF29CE484222325
    for byte in token.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _simhash(tokens: Iterable[str]) -> int:
    """Of a fact's tokens: per bit, whether over half of their FNV-1a hashes have it; a tie is 0."""
    hashes = np.array([_fnv1a_64(t) for t in tokens], "<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash(tokens: pd.Series) -> pd.Series:
    """The 64-bit pattern as a long."""
    return tokens.map(_simhash)


def near_earlier(tokens: list[list[str]], bits: np.ndarray, block: int = 512) -> np.ndarray:
    """D02 in one group, in order: whether a fact is near to an earlier one.

    Fingerprints are compared first, a block of rows against all earlier ones in
    one operation; tokens only where at most 10 bits differ.
    """
    able = np.flatnonzero([len(t) >= LEAST_TOKENS for t in tokens])
    out, own = np.zeros(len(tokens), bool), bits[able]
    sets = [set(tokens[k]) for k in able]
    for begin in range(0, len(able), block):
        rows = own[begin : begin + block]
        later, earlier = np.nonzero(np.bitwise_count(rows[:, None] ^ own[None, : begin + len(rows)]) <= MOST_BITS)
        for i, j in zip((later + begin).tolist(), earlier.tolist(), strict=True):
            if j < i and not out[able[i]]:
                b = tokens[able[i]]
                least = min(len(tokens[able[j]]), len(b))
                out[able[i]] = sum(t in sets[j] for t in b) >= LEAST_OVERLAP * least
    return out


def flag_near_duplicates(facts: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, near_dup) of facts (fact_key): near to an earlier one of their group; they stay.

    Near: five tokens each, overlap of 0.72 and 10 bits at most between
    fingerprints. Tokens and fingerprints are made once per fact, on the JVM and
    in batches. A group is a document: its facts come together as one row, and
    batches of such rows are compared, so that small groups cost no call each.
    """
    @F.pandas_udf("array<boolean>")
    def near(tokens: pd.Series, bits: pd.Series) -> pd.Series:
        return pd.Series([near_earlier([t.split() for t in ts], np.asarray(bs, np.int64).view(np.uint64)).tolist() for ts, bs in zip(tokens, bits, strict=True)])

    rows = facts.select(by, order, fact_tokens(F.col("fact_key")).alias("tokens")).withColumn("bits", simhash("tokens"))
    grouped = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.array_join("tokens", " ").alias("tokens"), "bits"))).alias("facts"))
    flagged = grouped.withColumn("near", near("facts.tokens", "facts.bits"))
    zipped = flagged.select(by, F.explode(F.arrays_zip(F.col(f"facts.{order}").alias("n"), F.col("near"))).alias("z"))
    return zipped.select(by, F.col("z.n").alias(order), F.col("z.near").alias("near_dup"))


def route_facts(sections: DataFrame, by: str) -> DataFrame:
    """A fact id that several sections (section, fact_ids) list stays with the first: section order, then place."""
    rows = sections.select(by, "section", F.posexplode("fact_ids").alias("pos", "fact_id"))
    return rows.withColumn("n", F.row_number().over(W.partitionBy(by, "fact_id").orderBy("section", "pos"))).where("n = 1").drop("n")


def orphans(units: DataFrame, routed: DataFrame, by: str) -> DataFrame:
    """Facts that no section has."""
    return units.join(routed.select(by, "fact_id").hint("merge"), [by, "fact_id"], "left_anti")


def merge_titles(sections: DataFrame, by: str) -> DataFrame:
    """Sections of one normalized title are one, at the first one's place and title, with all ids in order."""
    keyed = sections.withColumn("norm", title_normalize(F.col("title")))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("section", "fact_ids"))), lambda s: s["fact_ids"]))
    return keyed.groupBy(by, "norm").agg(F.min("section").alias("section"), F.min_by("title", "section").alias("title"), ids.alias("fact_ids"))
