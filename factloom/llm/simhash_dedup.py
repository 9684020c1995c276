"""SimHash near-dedup: fingerprints linked by a range join over per-segment bit counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, attach, components, lean, settled
from .similar_dedup import similar_groups
from .spans import Words, chunks, xxh64


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, n: int = 3) -> np.ndarray:
    """64-bit fingerprints of rows of bytes, see ``fingerprints``."""
    words = Words(data, offsets, lower=True)
    per_row = np.diff(words.first)
    first, row = words.runs(n)
    last = first + n - 1
    short = np.flatnonzero((per_row > 0) & (per_row < n))
    if len(short):
        first = np.concatenate([first, words.first[short]])
        last = np.concatenate([last, words.first[short + 1] - 1])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        first, last, row = first[order], last[order], row[order]
    out = np.zeros(words.rows, np.uint64)
    if len(first):
        bits = np.unpackbits(xxh64(words.text, words.start[first], words.end[last]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        shingles = np.bincount(row, minlength=words.rows)
        has = np.flatnonzero(shingles)
        ones = np.add.reduceat(bits, np.searchsorted(row, has), axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > shingles[has, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp long): SimHash over XXH64 (seed 42) of ``words``-word shingles of the A-Z-lower-cased text, repeats included.

    Under so many words, the whole sequence is the one shingle; without words, and
    for null, the fingerprint is zero. A bit is 1 if set in over half the hashes.
    """
    def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints_of(data, offsets, words) for _, _, data, offsets in chunks(batch.column(1))]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_fingerprints), "doc_id long, fp long")


def _counts(fp: Column, bits: int) -> Column:
    """Bit counts of each segment of ``bits`` bits, each in its own ``bits`` bits: the embedding, packed."""
    if bits == 1:
        return fp
    low, next_bit = F.lit(0x5555555555555555), F.shiftrightunsigned(fp, 1)
    both, one = fp.bitwiseAND(next_bit).bitwiseAND(low), fp.bitwiseXOR(next_bit).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(one)


def links(classes: DataFrame, tables: Tables, segment_bits: int = 2, dense: int = 512) -> DataFrame:
    """(a, b) representatives of distinct fingerprints at 3 or fewer differing bits: at least enough to connect them.

    A fingerprint is embedded as its bit counts per segment. The Manhattan
    distance of two embeddings is a lower bound of the Hamming distance, so a
    pair within 3 has one half of the embedding within 1. The grid's cells are
    the values of either half: each class stands in its two cells and probes them
    and the cells that are one higher in one segment (of two neighbours, the lower
    one probes). Pairs are then held to the bound over both halves and verified on
    the fingerprints.

    A cell that over ``dense`` classes stand in or probe isn't joined. Its
    classes meet in the points of Hamming space instead: two are within 3 just if
    one has a point at distance 1 or less that is at distance 2 or less of the
    other, and all that come so near a point hang on the smallest one at distance
    1 or less of it. That is linear in the classes and as exact.
    """
    if segment_bits not in (1, 2):
        raise ValueError("segment_bits is 1 or 2")
    half_mask = (1 << 32) - 1
    counts = _counts(F.col("fp"), segment_bits)
    halves = classes.select("fp", "rep", counts.alias("counts"), F.explode(F.array(
        F.struct(F.lit(0).alias("side"), counts.bitwiseAND(F.lit(half_mask)).alias("cell")),
        F.struct(F.lit(1).alias("side"), F.shiftrightunsigned(counts, 32).alias("cell")),
    )).alias("at")).select("fp", "rep", "counts", "at.side", "at.cell")
    up = F.expr(f"transform(filter(sequence(0, {32 // segment_bits - 1}), k -> (shiftright(cell, cast({segment_bits} * k as int)) & {(1 << segment_bits) - 1}) < {segment_bits}), k -> cell + shiftleft(1L, cast({segment_bits} * k as int)))")
    probes = halves.select("fp", "rep", "counts", "side", F.col("cell").alias("own"), F.explode(F.concat(F.array("cell"), up)).alias("cell"))
    crowded = (
        probes.groupBy("side", "cell").agg(F.count("*").alias("n"))
        .join(halves.groupBy("side", "cell").agg(F.count("*").alias("m")), ["side", "cell"])
        .where((F.col("n") > dense) & (F.col("m") > 1)).select("side", "cell")
    )
    crowded = tables.write(crowded)
    any_crowded = bool(crowded.take(1))
    if any_crowded:
        loose_probes, loose_halves = probes.join(crowded, ["side", "cell"], "left_anti"), halves.join(crowded, ["side", "cell"], "left_anti")
    else:
        loose_probes, loose_halves = probes, halves
    p, q = loose_probes.alias("p"), loose_halves.alias("q")
    differs = F.col("p.fp").bitwiseXOR(F.col("q.fp"))
    apart = F.expr(" + ".join(f"abs((shiftright(p.counts, {k}) & {3 if segment_bits == 2 else 1}) - (shiftright(q.counts, {k}) & {3 if segment_bits == 2 else 1}))" for k in range(0, 64, segment_bits)))
    pairs = (
        p.join(q, (F.col("p.side") == F.col("q.side")) & (F.col("p.cell") == F.col("q.cell")) & ((F.col("p.own") != F.col("p.cell")) | (F.col("p.fp") < F.col("q.fp"))) & (apart <= 3) & (F.bit_count(differs) <= 3))
        .select(F.col("p.rep").alias("a"), F.col("q.rep").alias("b"))
    )
    if not any_crowded:
        return pairs
    near = tables.write(
        probes.join(crowded, ["side", "cell"]).select("fp", "rep").unionByName(halves.join(crowded, ["side", "cell"]).select("fp", "rep")).distinct()
    )
    bit = lambda k: f"shiftleft(1L, {k})"
    inner = near.select("rep", F.expr(f"explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ {bit('i')})))").alias("point"))
    outer = near.select("rep", F.expr(f"explode(flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> fp ^ {bit('i')} ^ {bit('j')}))))").alias("point"))
    hubs = inner.groupBy("point").agg(F.min("rep").alias("hub"))
    met = inner.unionByName(outer).join(hubs, "point").where("hub <> rep").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    return pairs.unionByName(met)


#: Up to so many distinct fingerprints, segments of two bits have cells with few of them; beyond, segments of one bit do.
MOST_FOR_PAIRS_OF_BITS = 1 << 22


def near_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, segment_bits: int | None = None, dense: int = 512) -> DataFrame:
    """(a, b), a table: each text with the smallest id of its fingerprint, and these ids along ``links``; texts without words, and null ids, have none."""
    tables = Tables(docs.sparkSession)
    marked = tables.write(fingerprints(docs, id_col, text_col, words).where("fp <> 0 AND doc_id IS NOT NULL"))
    classes = tables.write(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    between = links(classes.select("fp", "rep"), tables, segment_bits or (2 if count <= MOST_FOR_PAIRS_OF_BITS else 1), dense)
    within = attach(marked, classes.where("size > 1"), "fp", "size", total).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = tables.write(between.unionByName(within))
    tables.drop(marked)
    tables.drop(classes)
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None, segment_bits: int | None = None, dense: int = 512) -> DataFrame:
    """Every row of ``docs`` with the smallest doc_id reachable over links between near texts.

    Without ``similarity``, links are 3 or fewer differing bits between SimHash
    fingerprints of ``words``-word shingles. Equal fingerprints are one class with
    one representative, so copies are never paired; the classes' links are
    components of a graph. Documents without words have fingerprint zero and link
    like any other. ``segment_bits``, by default by the number of classes, changes
    the plan, not the result.

    With ``similarity``, links are pairs of texts whose sets of shingles have at
    least that Jaccard similarity. The same fingerprints and range join give the
    first candidates, each verified by its sets; pairs whose fingerprints differ
    in more bits than the grid can search for (some ten, at 0.8) are found by
    ``similar_groups``.

    Returns doc_id, component_id and, without ``similarity``, fingerprint (16
    lowercase hex digits). Null text: no words. Null ids form no representative
    unless a class has no other; its component_id is then null. Repeated rows each
    return. Empty table: no rows. Other columns are ignored. A text is held whole
    in one task's memory, at some 80 bytes a byte.
    """
    if similarity is not None:
        return similar_groups(docs, id_col, text_col, words, similarity, candidates=near_prints(docs, id_col, text_col, words, segment_bits, dense))
    tables = Tables(docs.sparkSession)
    marked = tables.write(fingerprints(docs, id_col, text_col, words))
    classes = tables.write(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    count, total = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    bits = segment_bits or (2 if count <= MOST_FOR_PAIRS_OF_BITS else 1)
    found = components(links(classes.where("rep is not null").select("fp", "rep"), tables, bits, dense), tables)
    placed = tables.write(
        classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "size", F.coalesce("component", "rep").alias("component_id"))
    )
    tables.drop(classes)
    return settled(attach(marked, placed, "fp", "size", total).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
