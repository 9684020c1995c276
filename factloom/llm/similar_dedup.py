"""Near-dedup by the texts themselves: word shingles, MinHash bands for candidates, exact Jaccard similarity for links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, attach, components, lean
from .spans import RangeHash, Words, chunks, mix

#: Minima in a band: texts that share a twentieth of their shingles meet in one of 3e6 bands.
BAND_ROWS = 5
#: Bits of a set's fingerprint, by which pairs are ruled out before their sets are read.
SKETCH_BITS = 512


def bands_for(similarity: float, miss: float) -> int:
    """The number of bands at which a pair of just ``similarity`` meets in none with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(similarity**BAND_ROWS))) if similarity < 1 else 1


def shingles_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows in order) of the runs of ``n`` words, A-Z lower-cased; under ``n`` words, the whole sequence is the one run."""
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
    return RangeHash(words.text)(words.start[first], words.end[last]), row


def bands_of(hashes: np.ndarray, row: np.ndarray, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows with shingles, their keys: rows x bands); equal keys stand for equal minima of a band."""
    has, starts = np.unique(row, return_index=True)
    rng = np.random.default_rng(0)
    flip, times = rng.integers(0, 1 << 63, (2, bands, BAND_ROWS), np.int64).astype(np.uint64)
    keys = np.zeros((len(has), bands), np.uint64)
    if len(has):
        for b in range(bands):
            key = np.full(len(has), b, np.uint64)
            for k in range(BAND_ROWS):
                key = mix(key + np.minimum.reduceat((hashes ^ flip[b, k]) * (times[b, k] | np.uint64(1)), starts))
            keys[:, b] = key
    return has, keys


def sketches_of(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprints of sets (distinct hashes of each row), rows x SKETCH_BITS / 64: a bit is 1 if an odd number of the set falls on it.

    The bits in which two fingerprints differ are no more than the elements that
    only one of the sets has.
    """
    odd = np.bincount(row * SKETCH_BITS + (hashes % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(rows, SKETCH_BITS), axis=1, bitorder="little").view(np.int64)


def _near(p: str, q: str, similarity: float) -> Column:
    """Whether sizes and fingerprints allow the similarity: a bound that no similar pair fails."""
    apart = sum((F.bit_count(F.col(f"{p}.sketch")[k].bitwiseXOR(F.col(f"{q}.sketch")[k])) for k in range(SKETCH_BITS // 64)), F.lit(0))
    return apart <= F.lit((1 - similarity) / (1 + similarity) + 1e-12) * (F.col(f"{p}.size") + F.col(f"{q}.size"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles share ``similarity`` of their union; many pairs may have one b."""
    degrees = pairs.groupBy("b").agg(F.count("*").alias("degree"))
    total = degrees.agg(F.sum("degree")).first()[0] or 0
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
    both = attach(left, sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")).join(degrees, "b"), "b", "degree", total)
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, miss: float = 1e-6, candidates: DataFrame | None = None) -> DataFrame:
    """Every row of ``docs`` and the smallest doc_id reachable over pairs of texts with a Jaccard similarity of ``similarity``.

    Similarity is of the sets of ``words``-word shingles, as 64-bit hashes. Texts
    are compared if they meet in a band of MinHash; a pair of just ``similarity``
    meets in none with a chance of ``miss``, a closer one with less. Of a band's
    texts, each is first compared with that which meets the most others in all its
    bands, as a text that the others were copied from does. What that leaves in
    other components is compared in full: nothing is capped, and a large group of
    near copies, which hang on the text they come from, is linear. Pairs are held
    to a lower bound of their difference, the Hamming distance of parity
    fingerprints, before their sets are read. ``candidates``, a table (a, b) of
    ids of texts with words, are pairs found in another way: they are held to the
    bound and verified along with the first ones.

    Returns doc_id, component_id. Texts without words, and null, link to none.
    Null ids: component_id is null. Repeated rows each return. Empty table: no rows.
    """
    tables = Tables(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bands = bands_for(similarity, miss)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, data, offsets in chunks(batch.column(1)):
                has, keys = bands_of(*shingles_of(data, offsets, words), bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[first + has], bands), pa.int64()), pa.array(keys.view(np.int64).ravel())], ["doc_id", "key"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1), rows=4096):
                hashes, row = shingles_of(data, offsets, words)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.ones(len(row), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
                hashes, row = hashes[new], row[new]
                places = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                sketch = sketches_of(hashes, row, end - first)
                lists = pa.ListArray.from_arrays(np.arange(end - first + 1, dtype=np.int32) * sketch.shape[1], sketch.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(places, hashes.view(np.int64)), pa.array(np.diff(places)), lists], ["doc_id", "shingles", "size", "sketch"])

    with_id = named.where("doc_id is not null")
    keys = tables.write(with_id.mapInArrow(lean(keys_of), "doc_id long, key long"))
    shared = tables.write(keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    met = tables.write(attach(keys, shared, "key", "n", total).select("key", "doc_id", "n"))
    tables.drop(keys)
    tables.drop(shared)
    meets = met.groupBy("doc_id").agg(F.sum("n").alias("meets"))
    members = meets.select("doc_id")
    if candidates is not None:
        members = members.unionByName(candidates.select(F.explode(F.array("a", "b")).alias("doc_id"))).distinct()
    sets = tables.write(with_id.join(members, "doc_id").select("doc_id", "text").mapInArrow(lean(sets_of), "doc_id long, shingles array<long>, size int, sketch array<long>"))
    slim = sets.drop("shingles")
    hubs = met.join(meets, "doc_id").groupBy("key").agg(F.max(F.struct("meets", "doc_id")).alias("hub"), F.max("n").alias("n")).select("key", F.col("hub.doc_id").alias("hub"), "n")
    pairs = attach(met.select("key", "doc_id"), hubs, "key", "n", total).where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    stars = tables.write((pairs if candidates is None else pairs.unionByName(candidates)).distinct())
    degrees = stars.groupBy("b").agg(F.count("*").alias("degree"))
    hung = attach(stars, slim.withColumnRenamed("doc_id", "b").join(degrees, "b").select("b", "degree", F.struct("size", "sketch").alias("q")), "b", "degree", stars.count())
    likely = hung.join(slim.select(F.col("doc_id").alias("a"), F.struct("size", "sketch").alias("p")), "a").where(_near("p", "q", similarity)).select("a", "b")
    near = tables.write(_verified(tables.write(likely), sets, similarity))
    placed = components(near, tables)
    at = tables.write(met.join(placed.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    tables.drop(met)
    split = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    apart = at.join(split, "key", "left_semi").join(slim, "doc_id")
    p, q = apart.alias("p"), apart.alias("q")
    rest = p.join(q, (F.col("p.key") == F.col("q.key")) & (F.col("p.component") < F.col("q.component")) & _near("p", "q", similarity))
    rest = tables.write(rest.select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b")).distinct())
    more = tables.write(_verified(rest, sets, similarity))
    found = placed.withColumnRenamed("node", "doc_id")
    if more.take(1):  # these join components: a graph of components alone is settled anew
        home = lambda side: placed.select(F.col("node").alias(side), F.col("component").alias(f"{side}_home"))
        links = more.join(home("a"), "a", "left").join(home("b"), "b", "left").select(F.coalesce("a_home", "a").alias("a"), F.coalesce("b_home", "b").alias("b"))
        joined = components(tables.write(links), tables)
        every = found.unionByName(joined.select(F.col("node").alias("doc_id"), F.col("node").alias("component")).join(found.select("doc_id"), "doc_id", "left_anti"))
        found = every.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("doc_id", F.coalesce("whole", "component").alias("component"))
    for spent in (sets, stars, at, rest):
        tables.drop(spent)
    return named.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
