"""Vectors: similarity, single-linkage clusters, coalescing, representative choice.

Groups (a document's facts) are folded whole in numpy, one task per group, but
for pairs, which are found in tiles of a group; what is across groups stays in joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _padded(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows x greatest length as doubles, lengths): null and empty vectors, and those with a null in them, are zeros of length 0."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    col = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(sizes), sizes.max(initial=0)))
    out[row, col] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    if flat.null_count:
        broken = np.unique(row[flat.is_null().to_numpy(zero_copy_only=False)])
        out[broken], sizes[broken] = 0, 0
    return out, sizes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed one dimension after another, as the sum of a list is."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def near_rows(v: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, similarity) of rows ``left`` x ``right`` of ``v`` at ``threshold`` or more, a block at a time.

    Products of matrices rule pairs out, with room for their rounding; what is
    left is summed in order, so that a similarity is the same in every tile.
    """
    norms = np.sqrt(_dots(v, v))
    u = np.divide(v, norms[:, None], out=np.zeros_like(v), where=norms[:, None] != 0)
    other = u[right].T
    step = max(1, min(block, (1 << 22) // max(1, len(right))))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        i, j = np.nonzero(~(u[rows] @ other < threshold - 1e-9) | (sizes[rows, None] != sizes[right]) & (threshold <= 0))
        i, j = rows[i], right[j]
        both = norms[i] * norms[j]
        ok = (sizes[i] == sizes[j]) & ~(both <= 0)
        sims = np.divide(_dots(v[i], v[j]), both, out=np.zeros(len(i)), where=ok)
        keep = ~(sims < threshold)
        yield i[keep], j[keep], sims[keep]


#: Rows of a group in a tile, at the mean: two tiles meet in one task, with a few tens of MB.
TILE = 2048


def tiled(vectors: DataFrame, by: str, id_col: str, vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """(by, id, v, own, p, q): every row once for each pair p <= q of its group's tiles in which its own tile is; rows without a group or an id go."""
    rows = vectors.select(by, F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where(F.col(by).isNotNull() & F.col("id").isNotNull())
    tiles = rows.groupBy(by).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = rows.join(tiles, by).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = dealt.select(by, "id", "v", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    return pairs.select(by, "id", "v", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))


def cosine_pairs(vectors: DataFrame, by: str, id_col: str, threshold: float, vec_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """Pairs i < j of a group with similarity of ``threshold`` or more, 0 for unequal lengths and zero norms.

    All pairs of a group are compared, in quadratic time. A group is dealt into
    tiles of some ``tile`` rows by a hash of the id; each two of them are a unit
    of work of their own, so that a large group is many tasks, and a task's memory
    is bounded by two tiles whatever the group's size.
    """
    kind = dict(vectors.dtypes)
    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, own = table["id"].combine_chunks(), table["own"].to_numpy()
        v, sizes = _padded(table["v"].combine_chunks())
        order = pc.rank(ids, tiebreaker="min").to_numpy()
        group, first, last = key[0], key[1].as_py(), key[2].as_py()
        for i, j, sims in near_rows(v, sizes, np.flatnonzero(own == first), np.flatnonzero(own == last), threshold):
            keep = order[i] < order[j] if first == last else order[i] != order[j]
            i, j, sims = i[keep], j[keep], sims[keep]
            i, j = np.where(order[i] < order[j], i, j), np.where(order[i] < order[j], j, i)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.repeat(group, len(i)), ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(sims)], [by, "i", "j", "similarity"])

    return tiled(vectors, by, id_col, vec_col, tile).groupBy(by, "p", "q").applyInArrow(fold, f"{by} {kind[by]}, i {kind[id_col]}, j {kind[id_col]}, similarity double")


def linked(v: np.ndarray, threshold: float, block: int = 1024) -> np.ndarray:
    """The lowest index reachable over pairs at ``threshold``, found in blocks of rows so that no square matrix is held."""
    n, u, label = len(v), unit(v), np.arange(len(v))
    changed = True
    while changed:
        changed = False
        for k in range(0, n, block):
            near = u[k : k + block] @ u.T >= threshold
            least = np.where(near, label, n).min(1, initial=n)
            new = np.minimum(label[k : k + block], least)
            if (new < label[k : k + block]).any():
                label[k : k + block] = new
                changed = True
        label = label[label]
    return label


def clusters(vectors: DataFrame, by: str, id_col: str, threshold: float = 0.9, vec_col: str = "embedding") -> DataFrame:
    """(by, id, cluster): each vector's lowest id reachable in its group."""
    kind = dict(vectors.dtypes)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(id_col, kind="stable")
        ids = f[id_col].to_numpy()
        return pd.DataFrame({by: f[by].to_numpy(), id_col: ids, "cluster": ids[linked(np.stack(f[vec_col].to_numpy()).astype(np.float64), threshold)]})

    return vectors.groupBy(by).applyInPandas(fold, f"{by} {kind[by]}, {id_col} {kind[id_col]}, cluster {kind[id_col]}")


def centroids(rows: DataFrame, *by: str, vec_col: str = "embedding") -> DataFrame:
    """(by, pos, mean): means per dimension, partially aggregated before the shuffle."""
    return rows.select(*by, F.posexplode(vec_col).alias("pos", "v")).groupBy(*by, "pos").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def coalesce(centres: list[np.ndarray], sizes: list[int], least: int) -> list[list[int]]:
    """The first cluster under ``least`` joins its nearest, of equals the first, until none is small.

    Returns the original indexes in each cluster; centres merge by size.
    """
    c, s, members = [np.asarray(x, np.float64) for x in centres], list(sizes), [[k] for k in range(len(sizes))]
    while len(s) > 1 and (small := next((k for k, n in enumerate(s) if n < least), None)) is not None:
        sims = unit(np.stack(c)) @ unit(c[small][None])[0]
        others = [k for k in range(len(s)) if k != small]
        near = max(others, key=lambda k: (sims[k], -k))
        _merge(c, s, members, min(small, near), max(small, near))
    return members


def agglomerate(centres: list[np.ndarray], sizes: list[int], most: int) -> list[list[int]]:
    """The closest pair joins, the first of equals, until ``most`` clusters are left."""
    c, s, members = [np.asarray(x, np.float64) for x in centres], list(sizes), [[k] for k in range(len(sizes))]
    while len(s) > most > 0:
        u = unit(np.stack(c))
        sims = np.where(np.triu(np.ones((len(s), len(s)), bool), 1), u @ u.T, -np.inf)
        i, j = divmod(int(sims.argmax()), len(s))
        _merge(c, s, members, i, j)
    return members


def _merge(c: list[np.ndarray], s: list[int], members: list[list[int]], keep: int, drop: int) -> None:
    c[keep] = (c[keep] * s[keep] + c[drop] * s[drop]) / (s[keep] + s[drop])
    s[keep] += s[drop]
    members[keep] += members[drop]
    del c[drop], s[drop], members[drop]


def split_size(total: Column, most_sections: int, factor: float = 1.5) -> Column:
    """The largest size of a cluster: an even share times the factor, rounded up."""
    return F.greatest(F.ceil(total / most_sections * factor), F.lit(1)).cast("int")


def representatives(v: np.ndarray, k: int, block: int = 1024) -> list[int]:
    """Greedy facility location: the choice that adds most to the sum of best similarities (0 at first), ties to the lowest index.

    Similarities are made in blocks of rows, anew in each round, so that no square matrix is held.
    """
    n = len(v)
    if k >= n:
        return list(range(n))
    u = unit(v.astype(np.float64))
    best, chosen = np.zeros(n), []
    for _ in range(k):
        gain = np.zeros(n)
        for at in range(0, n, block):
            gain += np.maximum(u[at : at + block] @ u.T - best[at : at + block, None], 0).sum(0)
        gain[chosen] = -1
        pick = int(np.flatnonzero(gain >= gain.max() - 1e-12)[0])
        chosen.append(pick)
        best = np.maximum(best, u @ u[pick])
    return sorted(chosen)


def choose(vectors: DataFrame, by: str, id_col: str, k: int, vec_col: str = "embedding") -> DataFrame:
    """(by, id) of the ``k`` representatives of each group."""
    kind = dict(vectors.dtypes)

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(id_col, kind="stable")
        return f.iloc[representatives(np.stack(f[vec_col].to_numpy()), k)][[by, id_col]]

    return vectors.groupBy(by).applyInPandas(fold, f"{by} {kind[by]}, {id_col} {kind[id_col]}")


def section_size(total: int, most: int, factor: float = 1.5) -> int:
    return max(1, math.ceil(total / most * factor))
