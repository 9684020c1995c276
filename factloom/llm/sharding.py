"""Sharding: a minimax contiguous partition of ordered groups of equal texts, in DataFrame functions only."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate, groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Tables, settled

#: Rows of a cell, in which slots are numbered by one task, and cells of all shards at most: their offsets are broadcast.
CELL_ROWS, MOST_CELLS = 100_000, 1 << 20


class Segment(NamedTuple):
    """A run of neighbouring groups: those with keys of one prefix, between two of the largest groups, or one of these."""

    after: int  # number of largest groups in front of it, itself included
    rest: bool  # behind such a group, not the group itself
    prefix: str
    size: int
    groups: int


class Segments:
    """Segments in the order of their keys, and greedy fillings of shards with them.

    A shard holds up to the capacity, or one group that is larger. Of a segment of
    several groups only the sum is known, so there are two greedy checks: one
    takes it as atomic, which can only need more capacity than its groups do; one
    as liquid, which can only need less, as no group in it is over ``floor``.
    """

    def __init__(self, rows: list[Segment], floor: int):
        self.rows = sorted(rows)
        self.sums = [0, *accumulate(r.size for r in self.rows)]
        self.total, self.floor = self.sums[-1], floor

    def cuts(self, capacity: int, shards: int, liquid: bool) -> list[int]:
        """Positions in bytes at which a greedy filling ends each shard."""
        at, out = 0, []
        for _ in range(shards):
            k = bisect_right(self.sums, at + capacity) - 1
            end = max(at, self.sums[k])
            if k < len(self.rows):
                if liquid and self.rows[k].groups > 1:
                    end = at + capacity
                elif self.rows[k].groups == 1 and end == at:  # larger than the capacity: alone
                    end = self.sums[k + 1]
            at = min(end, self.total)
            out.append(at)
        return out

    def least(self, shards: int, liquid: bool) -> int:
        """The smallest capacity whose greedy filling takes everything in, by binary search."""
        low, high = self.floor, max(self.floor, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, liquid)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unsettled(self, shards: int) -> list[Segment]:
        """Segments of several groups whose inner cuts may matter."""
        first = self.cuts(self.least(shards, True), shards, False)
        last = self.cuts(self.least(shards, False), shards, True)
        found = set()
        for a, b in zip(first, last, strict=True):
            for k in range(max(0, bisect_right(self.sums, a) - 1), len(self.rows)):
                if self.sums[k] > b:
                    break
                if self.rows[k].groups > 1:
                    found.add(self.rows[k])
        return sorted(found)


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", digits: int = 4) -> DataFrame:
    """Puts every row of ``docs`` into a shard so that the largest shard is as small as it can be.

    Law: ``bytes``. A row's size is its text's bytes plus 8. Groups of equal
    texts are atomic and stand in the order of their digests; a shard is a run of
    neighbours in that order. The smallest feasible capacity is found by binary
    search with a greedy check, and the cuts fall where it fills a shard. A group
    that is larger than the capacity is a shard by itself, in its place: so the
    largest shard is the least that any contiguous partition has, however large
    one group is; between such groups the same search makes the shards even.

    The driver sees the ``shards`` largest groups and sums over ranges of digests
    between them (16**``digits`` at first), and has Spark split just those ranges
    in which a cut may fall, again and again until these hold one group each: the
    capacity is exact, and no list of all groups is ever gathered.

    Slots are gapless from 0 in each shard: rows spread over cells of a shard,
    CELL_ROWS in each or more where there would be over MOST_CELLS, by a hash of
    their number in the written table, cells are counted, and a row's slot is its
    cell's offset plus its place in the cell. So neither one text nor one id that
    is a third of all rows meets in a task.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null). Null
    text: as empty, size 8. Null and repeated ids: each row has its own slot. A
    shard's order is open. Empty table: no rows. Shards may stay empty when groups
    are few. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = tables.write(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.sha2(text, 256), 1, 32).alias("key"), F.monotonically_increasing_id().alias("number"))
    )
    groups = tables.write(slim.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    cut_keys = _cut_keys(groups, shards, digits)
    total = groups.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    tables.drop(groups)
    cells = min(max(16, total // (shards * CELL_ROWS)), MOST_CELLS // shards)
    shard = _below(cut_keys, F.col("key"))
    placed = slim.withColumn("shard", shard.cast("int")).withColumn("cell", F.pmod(F.xxhash64("number"), F.lit(cells)).cast("int"))
    counted = placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select("shard", "cell", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("shard", "cell").orderBy("key", "doc_id", "number")) - 1
    slots = placed.withColumn("place", place).join(F.broadcast(offsets), ["shard", "cell"])  # MOST_CELLS rows at most
    return settled(slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))


def _below(keys: list[str], key: Column) -> Column:
    """How many of ``keys``, a few, are not above ``key``."""
    return F.size(F.filter(F.array(*map(F.lit, keys)), lambda k: k <= key)) if keys else F.lit(0)


def _cut_keys(groups: DataFrame, shards: int, digits: int) -> list[str]:
    """Keys, or what stands between keys, at which the shards but the first begin."""
    top = groups.orderBy(F.desc("size"), "key").limit(shards + 1).collect()
    largest = sorted(r.key for r in top[:shards])
    floor = top[shards].size if len(top) > shards else 1  # more than ``shards`` groups can't each be a shard
    kinds = groups.select("key", "size", _below(largest, F.col("key")).alias("after"), (~F.col("key").isin(largest)).alias("rest")) if largest else groups.select("key", "size", F.lit(0).alias("after"), F.lit(True).alias("rest"))

    def sums(rows: DataFrame, length: int) -> list[Segment]:
        found = rows.groupBy("after", "rest", F.substring("key", 1, length).alias("prefix")).agg(F.sum("size"), F.count("*"))
        return [Segment(*r) for r in found.collect()]

    def settled_segments(rows: list[Segment], shards: int) -> Segments:
        """``rows``, split until no cut of the best filling falls inside a segment of several groups."""
        now = Segments(rows, floor)
        while split := now.unsettled(shards):
            rows = [r for r in now.rows if r not in set(split)]
            for length in sorted({len(r.prefix) for r in split}):
                few = groups.sparkSession.createDataFrame([r[:3] for r in split if len(r.prefix) == length], "after int, rest boolean, prefix string")
                inner = kinds.withColumn("prefix", F.substring("key", 1, length)).join(F.broadcast(few), ["prefix", "after", "rest"], "left_semi")
                rows += sums(inner, length + 2)
            now = Segments(rows, floor)
        return now

    def begin(r: Segment) -> str:
        if not r.after:
            return r.prefix
        return max(r.prefix, largest[r.after - 1] + "~") if r.rest else largest[r.after - 1]

    whole = settled_segments(sums(kinds, digits), shards)
    capacity, starts = whole.least(shards, False), []
    for alone, run in groupby(whole.rows, lambda r: r.groups == 1 and r.size > capacity):
        run = list(run)
        if alone:
            starts += map(begin, run)
            continue
        ends = Segments(run, floor).cuts(capacity, shards, False)
        used = ends.index(ends[-1]) + 1
        part = settled_segments(run, used)  # its shards are made as even as they can be
        starts += [begin(part.rows[bisect_right(part.sums, at) - 1]) for at in [0, *part.cuts(part.least(used, False), used, False)[:-1]] if at < part.total]
    return starts[1:]
