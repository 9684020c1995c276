"""Benchmark decontamination: pigeonhole pieces find candidates, Myers' bit-parallel distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, lean
from .spans import RangeHash, Words, chunks

_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]


def plain(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Lower-cased texts in which all but letters and digits is one space: case, punctuation and line breaks aren't edits."""
    for begin, stop, _, _ in chunks(texts):  # a part at a time, as lower-casing copies
        lower = pc.utf8_lower(texts.slice(begin, stop - begin).cast(pa.large_string()).fill_null(""))
        for first, end, data, offsets in chunks(lower):
            yield begin + first, begin + end, Words(_PLAIN[data], offsets)


def distance_within(pattern_masks: dict[int, int], length: int, text: bytes, most: int) -> int | None:
    """The least edit distance of the pattern to any part of ``text``, if ``most`` or less (Myers, 1999)."""
    ones, top = (1 << length) - 1, 1 << (length - 1)
    vp, vn, score, best = ones, 0, length, length
    get = pattern_masks.get
    for byte in text:
        eq = get(byte, 0)
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp = vn | ~(d0 | vp)
        hn = vp & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    break
        hp = hp << 1
        vp = ((hn << 1) | ~(d0 | hp)) & ones
        vn = hp & d0 & ones
    return best if best <= most else None


class Items:
    """Distinct benchmark texts with the ids of each, cut into pieces; ``LOOKED`` bytes of a piece are looked up first."""

    LOOKED = 16

    def __init__(self, rate: float):
        self.rate, self.bytes = rate, 0
        self.ids: dict[bytes, list[int | None]] = {}
        self._masks: dict[int, dict[int, int]] = {}

    def add(self, item: int | None, text: bytes) -> None:
        known = self.ids.setdefault(text, [])
        if not known:
            self.bytes += len(text)
        known.append(item)

    def compile(self) -> Items:
        self.texts = list(self.ids)
        self.budgets = np.array([int(len(t) * self.rate) for t in self.texts], np.int64)
        pieces = []  # item, offset, length
        for k, (text, budget) in enumerate(zip(self.texts, self.budgets.tolist(), strict=True)):
            n = budget + 1
            cut = [len(text) * i // n for i in range(n + 1)]
            pieces += [(k, a, b - a) for a, b in zip(cut, cut[1:]) if b > a]  # noqa: B905
        self.pieces = np.array(pieces, np.int64).reshape(-1, 3)
        self.looked = np.minimum(self.pieces[:, 2], self.LOOKED)
        joined = np.frombuffer(b"".join(self.texts) + b" " * 8, np.uint8)
        at = np.cumsum([0, *map(len, self.texts)])[self.pieces[:, 0]] + self.pieces[:, 1]
        hashed = RangeHash(joined)
        self.short, self.full = hashed(at, at + self.looked), hashed(at, at + self.pieces[:, 2])
        return self

    def masks(self, item: int) -> dict[int, int]:
        """Where the item has each byte, made when the item is first hit."""
        if (found := self._masks.get(item)) is None:
            found = self._masks[item] = {}
            for i, byte in enumerate(self.texts[item]):
                found[byte] = found.get(byte, 0) | 1 << i
        return found

    def places(self, words: Words, hashed: RangeHash, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, piece) of every piece that stands in the texts unchanged."""
        positions, pieces = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length in np.unique(self.looked).tolist():
            which = np.flatnonzero(self.looked == length)
            if size < length:
                continue
            at = np.arange(size - length + 1)
            text_hash = hashed(at, at + length)
            order = which[np.argsort(self.short[which], kind="stable")]
            keys = self.short[order]
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(seen[(text_hash & np.uint64(0xFFFFF)).astype(np.int64)])
            low = np.searchsorted(keys, text_hash[maybe], "left")
            count = np.searchsorted(keys, text_hash[maybe], "right") - low
            position = np.repeat(maybe, count)
            piece = order[np.arange(len(position)) + np.repeat(low - np.cumsum(count) + count, count)]
            end = position + self.pieces[piece, 2]
            inside = end <= size
            position, piece, end = position[inside], piece[inside], end[inside]
            same = hashed(position, end) == self.full[piece]
            positions.append(position[same])
            pieces.append(piece[same])
        return np.concatenate(positions), np.concatenate(pieces)

    def hits(self, words: Words) -> list[tuple[int, int, int]]:
        """(row, item, distance) of the rows' best matches within the items' budgets."""
        if not words.count or not len(self.pieces):
            return []
        size = int(words.end[-1])
        position, piece = self.places(words, RangeHash(words.text), size)
        bounds = np.append(words.start, size)[np.minimum(words.first, words.count)]  # where each row begins
        row, item = np.searchsorted(bounds, position, "right") - 1, self.pieces[piece, 0]
        whole = self.budgets[item] == 0
        out = []
        begins, ends = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        begins[words.start], ends[words.end] = True, True
        stop = position + self.pieces[piece, 2]
        exact = np.flatnonzero(whole & begins[position] & ends[stop] & (stop <= bounds[row + 1]))
        for r, k, p in dict.fromkeys(zip(row[exact].tolist(), item[exact].tolist(), position[exact].tolist(), strict=True)):
            if words.text[p : p + len(self.texts[k])].tobytes() == self.texts[k]:
                out.append((r, k, 0))
        out = list(dict.fromkeys(out))
        rest = np.flatnonzero(~whole)
        diagonal = position[rest] - self.pieces[piece[rest], 1]
        row, item = row[rest], item[rest]
        order = np.lexsort((diagonal, item, row))
        row, item, diagonal = row[order], item[order], diagonal[order]
        length, budget = np.fromiter(map(len, self.texts), np.int64, len(self.texts))[item], self.budgets[item]
        low, high = np.maximum(bounds[row], diagonal - budget), np.minimum(bounds[row + 1], diagonal + length + budget)
        # Windows of a row and item that overlap are one; along the diagonals, both ends ascend.
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(row))[: len(first)] - 1
        best: dict[tuple[int, int], int] = {}
        for r, k, a, b in zip(row[first].tolist(), item[first].tolist(), low[first].tolist(), high[last].tolist(), strict=True):
            if best.get((r, k)) == 0:
                continue
            found = distance_within(self.masks(k), len(self.texts[k]), words.text[a:b].tobytes(), int(self.budgets[k]))
            if found is not None:
                best[r, k] = min(found, best.get((r, k), found))
        return out + [(r, k, d) for (r, k), d in best.items()]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, rate: float, block_bytes: int) -> Iterator[Items]:
    """The benchmark in blocks of some ``block_bytes`` of distinct texts, each ready to be looked up."""
    block = Items(rate)
    for r in benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        for _, _, words in plain(pa.array([r.t], pa.string())):
            if words.count:
                block.add(r.i, words.text[: words.end[-1]].tobytes())
        if block.bytes >= block_bytes:
            yield block.compile()
            block = Items(rate)
    if block.ids:
        yield block.compile()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, distance) of every document that holds a benchmark item within the item's error budget.

    Texts are compared lower-cased, with all but letters and digits one space.
    An item of n bytes may differ by n * ``error_rate`` edits, rounded down. It is
    split into one piece more than that, so that one piece at least stands
    unchanged in any such match; exact piece hits are looked up by hash, compared
    in full by a second hash of the whole piece, and the text around each is
    verified by Myers' distance, once for hits whose surroundings overlap. An item
    too short for an edit is one piece and must stand between word boundaries.

    The benchmark is taken in blocks of ``block_bytes`` of distinct texts, the
    only part that the driver or a broadcast holds; each block is one pass over
    the documents.

    Null and empty items and texts match nothing. Null ids of documents return as
    null, of items too. Repeated rows of documents each return; of repeated items
    and ids each match returns. Empty tables: no rows. Other columns are ignored.
    A text is held whole in one task's memory, at some 60 bytes a byte.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark, tables, out = docs.sparkSession, Tables(docs.sparkSession), []

    def one_pass(items: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                found = [(first + row, i, d) for first, _, words in plain(batch.column(1)) for row, k, d in items.hits(words) for i in items.ids[items.texts[k]]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())], ["doc_id", "item_id", "distance"])

        return rows.mapInArrow(lean(run), "doc_id long, item_id long, distance int")

    waiting = None
    for block in _blocks(benchmark, item_col, item_text_col, error_rate, block_bytes):
        if waiting is not None:
            out.append(tables.write(waiting))
        waiting = one_pass(block)
    last = one_pass(Items(error_rate).compile()) if waiting is None else waiting
    return reduce(DataFrame.unionByName, out, last)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.05, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, see ``contaminated``; each is decided by itself.

    One pass without a shuffle: a row goes through the blocks of the benchmark one
    after another and stays if none is hit. Null and empty texts stay, null and
    repeated ids don't matter. Returns the columns of ``docs``.
    """
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, error_rate, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                stays = np.ones(batch.num_rows, bool)
                for first, _, words in plain(batch.column(at)):
                    stays[[first + row for row, _, _ in items.hits(words)]] = False
                yield batch.filter(pa.array(stays))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
