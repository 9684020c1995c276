"""Merkle dataset manifest: rows sorted by range, aligned subtrees built where the rows are, ragged nodes finished by coordinate."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import Tables

HEX = 64
#: Rows of one Arrow batch of proofs.
BATCH_ROWS = 2048
STEPS = "array<struct<position: int, siblings: string>>"


def leaf_of(fields: Sequence[Column]) -> Column:
    """The hex sha256 of fields: ``-`` for a null, else the UTF-8 bytes of the value's text, ``:`` and the text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(F.substring(s["siblings"], F.lit(1), HEX * s["position"]), h, F.substring(s["siblings"], HEX * s["position"] + 1, F.length(s["siblings"]))), 256))


class Level(NamedTuple):
    """Neighbouring nodes of one level that a part has by itself: the first's index, how many the level has in all, digests."""

    start: int
    total: int
    nodes: list[str]


def built(leaves: list[str], start: int, total: int, arity: int) -> list[Level]:
    """The levels over neighbouring leaves, as far up as runs of ``arity`` are complete; the last run of a level may be short."""
    out = [Level(start, total, leaves)]
    while total > 1:
        end = start + len(leaves)
        first, last = -(-start // arity), -(-end // arity) if end == total else end // arity
        if last <= first:
            break
        leaves = [hashlib.sha256("".join(leaves[k * arity - start : (k + 1) * arity - start]).encode()).hexdigest() for k in range(first, last)]
        start, total = first, -(-total // arity)
        out.append(Level(start, total, leaves))
    return out


def ragged(levels: list[Level], arity: int) -> Iterator[tuple[int, int, int, str]]:
    """(level, index, nodes of the level, digest) of the nodes whose parent isn't among ``levels``: under two runs a level and side, or the top."""
    for k, (start, total, nodes) in enumerate(levels):
        end = start + len(nodes)
        a, b = end, end
        if k + 1 < len(levels):
            a, b = levels[k + 1].start * arity, (levels[k + 1].start + len(levels[k + 1].nodes)) * arity
        for i in [*range(start, min(a, end)), *range(max(b, start), end)]:
            yield k, i, total, nodes[i - start]


def _runs(table: pa.Table) -> tuple[dict[str, list[dict]], pa.Table, list[tuple[str, int, int]]]:
    """The rows of a part that aren't leaves by group, its leaves in order, and (group, first, end) of their groups."""
    leaves = table.filter(pc.field("kind") == 1).sort_by("place")
    others: dict[str, list[dict]] = {}
    for r in table.filter(pc.field("kind") == 0).to_pylist():
        others.setdefault(r["group"], []).append(r)
    ranges, at = [], 0
    for group, run in groupby(leaves["group"].to_pylist()):
        n = sum(1 for _ in run)
        ranges.append((group, at, at + n))
        at += n
    return others, leaves, ranges


def _nodes(arity: int, schema: pa.Schema):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, leaves, ranges = _runs(pa.Table.from_batches(batches))
        part, rows = leaves["part"][0].as_py(), []
        for group, a, b in ranges:
            span = spans[group][0]
            levels = built(leaves["leaf"].slice(a, b - a).to_pylist(), span["before"], span["leaves"], arity)
            rows += [{"part": part, "group": group, "level": k, "index": i, "total": t, "digest": d, "before": span["before"], "leaves": span["leaves"]} for k, i, t, d in ragged(levels, arity)]
        yield pa.RecordBatch.from_pylist(rows, schema)

    return nodes


def _proofs(arity: int, kept: list[str]):
    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, leaves, ranges = _runs(pa.Table.from_batches(batches))
        for group, a, b in ranges:
            own = ends[group]
            levels = built(leaves["leaf"].slice(a, b - a).to_pylist(), own[0]["before"], own[0]["leaves"], arity)
            known = {(r["level"], r["index"]): [(s["position"], s["siblings"]) for s in r["path"]] for r in own}

            def path(level: int, index: int) -> list[tuple[int, str]]:
                if (level, index) not in known:
                    start, _, nodes = levels[level]
                    first = index // arity * arity
                    run = nodes[first - start : first - start + arity]
                    known[level, index] = [(index - first, "".join(run[: index - first] + run[index - first + 1 :])), *path(level + 1, index // arity)]
                return known[level, index]

            for i in range(a, b, BATCH_ROWS):
                rows = leaves.slice(i, min(BATCH_ROWS, b - i)).select(kept).combine_chunks()
                found = []
                for k in range(i - a, i - a + rows.num_rows):
                    index = own[0]["before"] + k
                    found.append(path(0, index))
                    known.pop((0, index))
                steps = [s for p in found for s in p]
                flat = pa.StructArray.from_arrays([pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())], ["position", "siblings"])
                ends_at = [0]
                for p in found:
                    ends_at.append(ends_at[-1] + len(p))
                columns = {c: rows[c] for c in kept} | {c: pa.array([own[0][c]] * rows.num_rows, pa.string()) for c in ("top", "root")}
                out = pa.table(columns | {"proof": pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), flat)})
                yield from out.combine_chunks().to_batches()

    return proofs


def _proved(leaves: DataFrame, order: list[str], kept: list[str], arity: int, part_rows: int, tables: Tables, last: bool = False) -> DataFrame:
    """``kept`` columns of the leaves, with the top of their group's tree, the root over all groups, and the path to it.

    ``leaves`` is a written table of group (a string), leaf (hex) and others;
    leaves of a group stand in ``order``. With ``last``, a group's top is the root.
    """
    rows = leaves.count()
    shuffle = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(shuffle, rows // 2000), -(-rows // part_rows))
    by = ["group", *order, "leaf", "number"]
    ranged = leaves.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = ranged.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33).cast("int")).drop("number")
    placed = tables.write(placed, settle=False).withColumn("kind", F.lit(1))

    # where each group's leaves begin in each part
    counts = placed.groupBy("part", "group").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    spans = tables.write(counts.select("part", "group", F.coalesce(before, F.lit(0)).alias("before"), F.sum("rows").over(W.partitionBy("group")).alias("leaves")))

    # complete subtrees of each part; their nodes without a parent there
    schema = "part int, group string, level int, index long, total long, digest string, before long, leaves long"
    arrow = pa.schema([("part", pa.int32()), ("group", pa.string()), ("level", pa.int32()), ("index", pa.int64()), ("total", pa.int64()), ("digest", pa.string()), ("before", pa.int64()), ("leaves", pa.int64())])
    both = placed.select("part", "kind", "place", "group", "leaf").unionByName(spans.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    loose = tables.write(both.groupBy("part").applyInArrow(_nodes(arity, arrow), schema))

    # upper levels: nodes meet by the coordinate of their parent
    depth, most = 0, spans.agg(F.max("leaves")).first()[0] or 0
    while most > 1:
        depth, most = depth + 1, -(-most // arity)
    parent = F.expr(f"index div {arity}")
    run = F.sort_array(F.collect_list(F.struct("index", "digest")))  # at most ``arity`` nodes
    levels: list[DataFrame] = []
    for k in range(depth + 1 if loose.where("total > 1").take(1) else 0):  # none are needed where every group is in one part
        here = loose.where(F.col("level") == k).select("group", "index", "total", "digest")
        if k:
            above = levels[-1].where("total > 1").groupBy("group", parent.alias("index"), F.expr(f"(total + {arity - 1}) div {arity}").alias("total"))
            here = here.unionByName(above.agg(F.sha2(F.array_join(run["digest"], ""), 256).alias("digest")))
        levels.append(tables.write(here))

    # paths, from the tops down
    tops = reduce(DataFrame.unionByName, levels or [loose.drop("part", "level", "before", "leaves")]).where("total = 1").select("group", F.col("digest").alias("top"))
    if last:
        ended = tops.select("group", "top", F.col("top").alias("root"), F.array().cast(STEPS).alias("path"))
    else:
        roots = tables.write(tops.select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("top").alias("leaf")))
        ended = _proved(roots, ["name"], ["name", "leaf"], arity, part_rows, tables, True).select(F.col("name").alias("group"), F.col("leaf").alias("top"), "root", F.col("proof").alias("path"))
    ended = tables.write(ended)
    paths: list[DataFrame] = []
    for k in reversed(range(len(levels))):
        here = levels[k].where("total = 1").select("group", "index").join(ended, "group")
        if k < depth:
            met = levels[k].where("total > 1").groupBy("group", parent.alias("parent")).agg(run.alias("run"))
            each = met.select("group", "parent", "run", F.posexplode("run").alias("position", "node"))
            siblings = F.array_join(F.filter("run", lambda x: x["index"] != F.col("node.index"))["digest"], "")
            step = each.select("group", "parent", F.col("node.index").alias("index"), F.array(F.struct("position", siblings.alias("siblings"))).alias("step"))
            up = paths[-1].withColumnRenamed("index", "parent")
            here = here.unionByName(step.join(up, ["group", "parent"]).select("group", "index", "top", "root", F.concat("step", "path").alias("path")))
        paths.append(tables.write(here))
    edges = loose.select("part", "group", "level", "index", "before", "leaves")
    if levels:
        upper = reduce(DataFrame.unionByName, [p.withColumn("level", F.lit(depth - k)) for k, p in enumerate(paths)])
        ends = tables.write(edges.join(upper, ["group", "level", "index"]))
    else:
        ends = edges.join(ended, "group")

    # the subtrees again, with the paths above them
    fields = [f for f in leaves.schema if f.name in kept]
    wanted = StructType([*fields, *StructType.fromDDL(f"top string, root string, proof {STEPS}")])
    both = placed.unionByName(ends.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(_proofs(arity, [f.name for f in fields]), wanted)


def manifest(
    docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", arity: int = 8, part_rows: int = 200_000,
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Every row of ``docs`` as a leaf of a hash tree per ``group``, with its path to the root over all groups.

    A leaf is the digest of the row's ``fields`` (``leaf_of``). A group's leaves
    ascend by ``order``; while there are several nodes, every ``arity`` neighbours
    become the digest of their digests, the last of them maybe fewer. The tops of
    the groups, in the order of their names in UTF-8, are the leaves of one more
    such tree; its top is the root.

    Digests are sorted by range into parts of ``part_rows`` or fewer rows; sums of
    the counts of each part and group tell where a part's leaves stand in their
    group. A part builds the subtrees that it has all leaves of; the nodes on
    its two edges meet, by the coordinate of their parent, in as many shuffles
    as a group's tree has levels. Their paths come back to the parts, which
    build their subtrees again and append these paths to their own. The sorted
    table is written with its parts as a column, so that a lost executor changes
    nothing; texts are read once and never shuffled.

    Returns ``order``, leaf, top (of the group), root, proof (position among the
    run's nodes and the other nodes' digests, level by level), and ``carried``
    columns, expressions over ``docs``. A null group is one by itself, before the
    others; a null of ``order`` stands before other values, and of equal values the
    smaller digest first. Repeated rows are leaves of their own, with equal digests
    and each its path. Empty table: no rows. Other columns are ignored.
    """
    tables, carried = Tables(docs.sparkSession), dict(carried or {})
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    extra = {f"carried_{k}": c for k, c in enumerate(carried.values())}
    leaves = tables.write(docs.select(key.alias("group"), F.col(order).alias("key"), leaf_of([F.col(f) for f in fields]).alias("leaf"), *(c.alias(n) for n, c in extra.items())))
    out = _proved(leaves, ["key"], ["key", "leaf", *extra], arity, part_rows, tables)
    return out.select(F.col("key").alias(order), "leaf", "top", "root", "proof", *(F.col(n).alias(name) for n, name in zip(extra, carried, strict=True)))
