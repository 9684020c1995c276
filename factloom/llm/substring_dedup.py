"""Substring dedup: a De Bruijn graph of word windows, compacted by joins; its paths, at their source's places, are what is removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import HOT_SHARE, Tables, attach
from .spans import RangeHash, Words, chunks, mix

#: Words of the short run whose least hash anchors a window.
ANCHOR = 5
SALTS = 64
#: Places of a source that one task chains; joins chain what is beyond.
BLOCK = 4096
#: Spans of one source that one row of the check holds, about.
CHECKED_TOGETHER = 4096


class Windows:
    """Windows of ``k`` words of a chunk of rows, anchored; hashes keep ``bits`` bits (tests take few, so that they clash)."""

    def __init__(self, words: Words, k: int, bits: int = 64):
        self.words, self.k, self.mask = words, k, np.uint64((1 << bits) - 1)
        self.hashed = RangeHash(words.text)
        self.first, self.row = words.runs(k)
        least = self._least()[self.first] if len(self.first) else np.zeros(0, np.uint64)
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (self.row[1:] != self.row[:-1]) | (self.first[1:] != self.first[:-1] + 1)
        self.runs = np.flatnonzero(new)  # where runs of windows with one anchor begin
        self.anchors = least[self.runs]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from ``a`` to ``b``."""
        return self.hashed(self.words.start[a], self.words.end[b]) & self.mask

    def _least(self) -> np.ndarray:
        """The least hash of the runs of ANCHOR words in the ``k`` words from each word on."""
        g = min(ANCHOR, self.k)
        at = np.arange(self.words.count - g + 1)
        out = self.hash(at, at + g - 1)
        span, width = self.k - g + 1, 1
        while width < span:  # least of ``width`` neighbours, doubled up to ``span``
            step = min(width, span - width)
            out = np.minimum(out[:-step], out[step:])
            width += step
        return out

    def nodes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of windows, the nodes that they join as edges: their first k-1 words and their last."""
        first = self.first[which]
        return self.hash(first, first + self.k - 2), self.hash(first + 1, first + self.k - 1)

    def edges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The names of edges, by their nodes."""
        return mix(left * np.uint64(3) + right) & self.mask


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _lists(column: pa.Array, begin: int, end: int) -> tuple[pa.Array, np.ndarray]:
    """(values, their rows) of a slice of a list column."""
    own = column.slice(begin, end - begin)
    return own.flatten(), np.repeat(np.arange(end - begin), np.asarray(own.value_lengths().fill_null(0)))


def _compacted(edges: DataFrame, tables: Tables, low: int | None = None) -> DataFrame:
    """``edges`` (edge, left, right, source, source_place, n) with ``path``: a number of the nonbranching path that each lies on.

    A node with one edge in and one edge out joins these two. Edges whose source
    places follow one another chain in the order of their source, BLOCK places in
    a task; the pieces then chain over their end nodes by joins in which every
    piece's pointer to the piece before it doubles its reach each round, until all
    point to the head of their path. Where ``low``, the smallest source, is given
    and places are single, a piece's number is its first place, as small numbers
    compress in a shuffle; else it is a hash of that place and edge. A ring has no head: its pieces get numbers of some of them.
    """
    ways = edges.select(F.col("left").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("right").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    branching = ways.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in")).where("out > 1 or in > 1").select(F.col("node").alias("right"), F.lit(True).alias("branches"))
    w = W.partitionBy("source", "block").orderBy("source_place", "edge")
    before = lambda c: F.lag(c).over(w)
    follows = (before("source_place") == F.col("source_place") - 1) & (before("right") == F.col("left")) & ~before("branches")
    marked = edges.join(branching, "right", "left").withColumn("branches", F.coalesce("branches", F.lit(False))).withColumn("block", F.floor(F.col("source_place") / BLOCK))
    number = F.xxhash64("source", "source_place", "edge") if low is None else F.shiftleft(F.col("source") - low, 31).bitwiseOR(F.col("source_place").cast("long"))
    marked = marked.withColumn("head", F.when(~F.coalesce(follows, F.lit(False)), number))
    named = tables.write(marked.select(*edges.columns, "branches", F.last("head", ignorenulls=True).over(w).alias("piece")))
    ends = named.groupBy("piece").agg(F.min_by("left", "source_place").alias("begin"), F.max_by("right", "source_place").alias("end"), F.max_by("branches", "source_place").alias("branches"))
    ends = tables.write(ends)
    before_it = ends.where("not branches").select(F.col("end").alias("begin"), F.col("piece").alias("up"))
    up = tables.write(ends.join(before_it, "begin").where("piece <> up").select("piece", "up"))
    most = max(1, up.count()).bit_length() + 1
    for _ in range(most):
        further = up.select(F.col("piece").alias("up"), F.col("up").alias("over"))
        after = tables.write(up.join(further, "up", "left").select("piece", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
        moved = after.where("moved").limit(1).count()
        tables.drop(up)
        up = after.drop("moved")
        up.folder = after.folder
        if not moved:
            break
    return named.drop("branches").join(up, "piece", "left").select(*edges.columns, F.coalesce("up", "piece").alias("path"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep_text: bool = False, hash_bits: int = 64) -> DataFrame:
    """Removes words of windows that also start in a document with a smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``; a window of ``window`` words (2 at least) is
    an edge of a De Bruijn graph, from the node of its first words to that of its
    last. All windows of the input are judged:

    1. Anchors. Equal windows have the same least 5-word hash, their anchor. Of
       all anchors (one per run of some five windows) only those in two documents
       or more can belong to repeated edges.
    2. Edges. The windows of such runs become edges, named by the hashes of their
       two nodes; an edge in two documents or more is repeated. Its source is its
       first place in the document with the smallest id, where its nodes are read.
    3. Compaction. Nonbranching paths of repeated edges compact, see ``_compacted``.
    4. Spans. In a document, neighbouring windows whose source places follow one
       another too are a span, of one path or of several that meet end to end.
    5. Verification. Each distinct span is held against its source, word for word
       by SHA-256, at its place there. Where two different windows have one name, a
       span fails; all edges in its range of the source are then told apart by the
       SHA-256 of their words, and get sources of their own.

    Groups of a hot anchor are salted by document, those of hot edges and sources
    are split by their counts; no step gathers the occurrences of a key.

    Returns doc_id, n_words, n_removed, kept_sha256 (kept words joined by one
    space), n_paths (distinct paths that words were removed along), and with
    ``keep_text`` kept. Null text: no words. Null id: neither removed from nor a
    source. Rows that repeat an id aren't each other's source; each returns. Empty
    table: no rows. Other columns are ignored. A text is held whole in one task's
    memory, at some 100 bytes a byte.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark = docs.sparkSession
    tables = Tables(spark)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = named.where("doc_id is not null").groupBy("doc_id").count()
    low, high, most = ids.agg(F.min("doc_id"), F.max("doc_id"), F.max("count")).first()
    repeated_ids = (most or 0) > 1
    rows = named.select("doc_id", (F.coalesce(F.xxhash64("text"), F.lit(0)) if repeated_ids else F.lit(0).cast("long")).alias("copy"), "text")
    real = rows.where("doc_id is not null")
    # A place in a document as one number, whose least is the first place in the smallest document.
    kind = "long" if (high or 0) - (low or 0) < 1 << 32 else "decimal(38,0)"
    wide = F.lit(1 << 31).cast(kind)
    at = (F.col("doc_id").cast(kind) - F.lit(low or 0).cast(kind)) * wide + F.col("place").cast(kind)
    source, source_place = (F.floor(F.col("at") / wide).cast("long") if kind != "long" else F.shiftright("at", 31)) + F.lit(low or 0), (F.col("at") % wide).cast("int").alias("source_place")

    def anchors(batches: Iterator[pa.RecordBatch], hot: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, end, data, offsets in chunks(batch.column(2)):
                w = Windows(words := Words(data, offsets), window, hash_bits)
                mark, row, place = w.anchors, w.row[w.runs], w.first[w.runs] - words.first[w.row[w.runs]]
                if hot is None:
                    pair = np.lexsort((mark, row))
                    once = pair[np.append(True, (np.diff(row[pair]) != 0) | (mark[pair][1:] != mark[pair][:-1]))] if len(pair) else pair
                    yield pa.RecordBatch.from_arrays([_signed(mark[once]), batch.column(0).take(pa.array(row[once] + base))], ["anchor", "doc_id"])
                else:
                    own = mix(batch.column(0).slice(base, end - base).to_numpy().view(np.uint64) + batch.column(1).slice(base, end - base).to_numpy().view(np.uint64))
                    salt = np.where(np.isin(mark, hot), (own % np.uint64(SALTS))[row].astype(np.int64) + 1, 0).astype(np.int32)
                    to = pa.array(row + base)
                    yield pa.RecordBatch.from_arrays([_signed(mark), pa.array(salt), batch.column(0).take(to), batch.column(1).take(to), pa.array(place.astype(np.int32))], ["anchor", "salt", "doc_id", "copy", "place"])

    shared = tables.write(
        real.mapInArrow(lambda batches: anchors(batches, None), "anchor long, doc_id long")
        .groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n")
    )
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = spark.sparkContext.broadcast(np.array([r.anchor for r in shared.where(F.col("n") > F.lit(total * HOT_SHARE)).collect()], np.int64).view(np.uint64))  # 1 / HOT_SHARE at most
    salts = F.when(F.col("n") > F.lit(total * HOT_SHARE), F.sequence(F.lit(1), F.lit(SALTS))).otherwise(F.array(F.lit(0)))
    marked = real.mapInArrow(lambda batches: anchors(batches, hot.value), "anchor long, salt int, doc_id long, copy long, place int")
    candidates = tables.write(
        marked.join(shared.select("anchor", F.explode(salts).alias("salt")).hint("shuffle_hash"), ["anchor", "salt"])
        .groupBy("doc_id", "copy").agg(F.collect_list("place").alias("places"))
    )
    tables.drop(shared)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of the runs whose first places are listed, or of all where there is no list."""
        for batch in batches:
            for base, end, data, offsets in chunks(batch.column(2)):
                w = Windows(words := Words(data, offsets), window, hash_bits)
                flat, owner = _lists(batch.column(3), base, end)
                chosen = np.isin(w.first[w.runs], flat.to_numpy(zero_copy_only=False).astype(np.int64) + words.first[owner]) | batch.column(3).is_null().to_numpy(zero_copy_only=False)[base + w.row[w.runs]]
                keep = np.flatnonzero(np.repeat(chosen, np.diff(np.append(w.runs, len(w.first)))))
                to = pa.array(w.row[keep] + base)
                yield pa.RecordBatch.from_arrays([_signed(w.edges(*w.nodes(keep))), batch.column(0).take(to), batch.column(1).take(to), pa.array((w.first[keep] - words.first[w.row[keep]]).astype(np.int32))], ["edge", "doc_id", "copy", "place"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges with the nodes that stand at their source's places; of texts with one id, each gives those that it has."""
        for batch in batches:
            for base, end, data, offsets in chunks(batch.column(1)):
                w = Windows(words := Words(data, offsets), window, hash_bits)
                flat, owner = _lists(batch.column(2), base, end)
                edge, place, n = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                at = np.searchsorted(w.first, words.first[owner] + place)
                there = np.flatnonzero((at < len(w.first)) & (place < words.first[owner + 1] - words.first[owner]))
                there = there[w.row[at[there]] == owner[there]]
                left, right = w.nodes(at[there])
                same = w.edges(left, right).view(np.int64) == edge[there]
                there, to = there[same], pa.array(owner[there[same]] + base)
                yield pa.RecordBatch.from_arrays([pa.array(edge[there]), _signed(left[same]), _signed(right[same]), batch.column(0).take(to), pa.array(place[there]), pa.array(n[there])], ["edge", "left", "right", "source", "source_place", "n"])

    edges_of = lambda listed: listed.select("doc_id", "copy", "text", "places").mapInArrow(windows, "edge long, doc_id long, copy long, place int")

    def sourced(occurrences: DataFrame, *more: str) -> DataFrame:
        """Repeated edges, told apart by ``more`` as well, with their sources."""
        grouped = occurrences.groupBy("edge", *more).agg(F.min(at).alias("at"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
        return grouped.select("edge", *more, source.alias("source"), source_place, "high", "n").where("source < high").drop("high")

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            if single:
                (doc, place), (source, there), path = *((base + (c >> 31), (c & (1 << 31) - 1).astype(np.int32)) for c in columns[:2]), columns[2]
                copy = np.zeros(len(doc), np.int64)
            else:
                doc, copy, place, source, there, path = columns
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1) | (there[1:] != there[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(doc))[: len(first)] - 1
            new[1:] |= path[1:] != path[:-1]
            passed = path[new]
            lists = pa.ListArray.from_arrays(np.append(np.cumsum(new) - 1, len(passed))[np.append(first, len(doc))].astype(np.int32), pa.array(passed))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (doc[first], copy[first], source[first], there[first], place[first], place[last])), lists], ["doc_id", "copy", "source", "source_place", "begin", "last", "paths"])

    # Where one number is a place, it is all that is shuffled of it, and sorts by radix.
    single, base = kind == "long" and not repeated_ids, low or 0
    numbered = lambda df: df.select("edge", at.alias("at")) if single else df

    def spans_of(located: DataFrame) -> DataFrame:
        if single:
            own = located if "at" in located.columns else located.withColumn("at", at)
            from_source = F.shiftleft(F.col("source") - F.lit(base), 31).bitwiseOR(F.col("source_place").cast("long")).alias("from")
            dealt = own.where(F.shiftright("at", 31) + F.lit(base) > F.col("source")).select("at", from_source, "path").repartition(F.shiftright("at", 31)).sortWithinPartitions("at")
        else:
            own = located.where("doc_id > source").select("doc_id", "copy", "place", "source", "source_place", "path")
            dealt = own.repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "place")
        return tables.write(dealt.mapInArrow(paths, "doc_id long, copy long, source long, source_place int, begin int, last int, paths array<long>"))

    occurrences = tables.write(edges_of(real.join(candidates, ["doc_id", "copy"])))
    tables.drop(candidates)
    repeated = tables.write(sourced(occurrences))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = 64 if repeated_ids else 1  # the texts of one id may have any number of edges, one text only as many as words
    places = repeated.groupBy(F.col("source").alias("doc_id"), F.pmod(F.xxhash64("edge"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("edge", "source_place", "n")).alias("places"))
    joined = tables.write(real.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(nodes, "edge long, left long, right long, source long, source_place int, n long"))
    tables.drop(repeated)
    edges = tables.write(_compacted(joined.dropDuplicates(["edge"]) if repeated_ids else joined, tables, None if repeated_ids or kind != "long" else low or 0).drop("left", "right"))
    tables.drop(joined)
    spans = spans_of(attach(numbered(occurrences), edges, "edge", "n", total))
    tables.drop(occurrences)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row its result; for each of its spans the words that its source must have."""
        for batch in batches:
            for base, end, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets)
                flat, owner = _lists(batch.column(3), base, end)
                source, there, begin, last = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                path, passes = flat.field(4).flatten().to_numpy(), np.repeat(owner, np.asarray(flat.field(4).value_lengths()))
                a, b = words.first[owner] + begin, words.first[owner] + last + window
                change = np.bincount(a, minlength=words.count + 1) - np.bincount(b, minlength=words.count + 1)
                gone = np.cumsum(change)[: words.count] > 0
                sizes = words.end - words.start + 1
                text = words.text[: int(sizes.sum())][np.repeat(~gone, sizes)]
                bounds = np.concatenate([[0], np.cumsum(np.where(gone, 0, sizes))])[words.first]
                kept = [text[p : max(p, q - 1)].tobytes() for p, q in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                sums = np.concatenate([[0], np.cumsum(gone)])[words.first]
                order = np.lexsort((path, passes))
                fresh = np.append(True, (np.diff(passes[order]) != 0) | (np.diff(path[order]) != 0))[: len(order)]
                n, none = end - base, pa.nulls
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(base, n), pa.array(np.diff(words.first)), pa.array(np.diff(sums)), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(np.bincount(passes[order][fresh], minlength=n)[:n]), pa.array([k.decode() for k in kept] if keep_text else [None] * n, pa.string()), none(n, pa.int64()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.binary())], names)
                wanted = {}
                for s, t, length, p, q in zip(source.tolist(), there.tolist(), (b - a).tolist(), words.start[a].tolist() if len(a) else [], words.end[b - 1].tolist() if len(b) else [], strict=True):
                    wanted[s, t, length, hashlib.sha256(words.text[p:q]).digest()] = None
                n = len(wanted)
                yield pa.RecordBatch.from_arrays([none(n, pa.int64()), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.string()), none(n, pa.int64()), none(n, pa.string()), pa.array([w[0] for w in wanted], pa.int64()), pa.array([w[1] for w in wanted], pa.int32()), pa.array([w[2] for w in wanted], pa.int32()), pa.array([w[3] for w in wanted], pa.binary())], names)

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whether the source's text has the words of each span at its place."""
        for batch in batches:
            out = []
            for k, wanted in enumerate(batch.column(2).to_pylist()):
                words = next((Words(data, offsets) for _, _, data, offsets in chunks(batch.column(1).slice(k, 1))), None)
                s = batch.column(0)[k].as_py()
                for w in wanted:
                    t, end = w["source_place"], w["source_place"] + w["n"]
                    out.append((s, t, w["n"], w["digest"], words is not None and end <= words.count and hashlib.sha256(words.text[words.start[t] : words.end[end - 1]]).digest() == w["digest"]))
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()))], ["source", "source_place", "n", "digest", "same"])

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "n_paths", "kept", "source", "source_place", "n", "digest"]

    def made_of(spans: DataFrame) -> DataFrame:
        by_row = spans.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("source", "source_place", "begin", "last", "paths")).alias("spans"))
        none = F.expr("cast(array() as array<struct<source: long, source_place: int, begin: int, last: int, paths: array<long>>>)")
        return tables.write(
            rows.join(by_row, ["doc_id", "copy"], "left").select("doc_id", "copy", "text", F.coalesce("spans", none).alias("spans"))
            .mapInArrow(removed, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_paths long, kept string, source long, source_place int, n int, digest binary")
            .withColumn("request", F.col("source").isNotNull())
        )

    made = made_of(spans)
    request = ["source", "source_place", "n", "digest"]
    requests = tables.write(made.where("request").select(*request).distinct())
    by_source = requests.groupBy("source").agg(F.count("*").alias("size"))
    part = F.pmod(F.xxhash64("source_place", "n", "digest"), F.ceil(F.col("size") / CHECKED_TOGETHER)).alias("part")
    together = attach(requests, by_source, "source", "size", requests.count()).select(*request, part).groupBy("source", "part").agg(F.collect_list(F.struct("source_place", "n", "digest")).alias("wanted"))
    held = real.select(F.col("doc_id").alias("source"), "text")
    answers = together.join(held.distinct() if repeated_ids else held, "source").select("source", "text", "wanted").mapInArrow(checked, "source long, source_place int, n int, digest binary, same boolean")
    failed = tables.write(answers.groupBy(*request).agg(F.max("same").alias("same")).where("not same").select("source", "source_place", "n").distinct() if repeated_ids else answers.where("not same").select("source", "source_place", "n").distinct())
    tables.drop(requests)
    if failed.take(1):
        tables.drop(made)
        every = tables.write(edges_of(real.withColumn("places", F.lit(None).cast("array<int>"))))
        spans = spans_of(_told_apart(edges, failed, every, real, sourced, window, tables))
        made = made_of(spans)
    return made.where("not request").select("doc_id", "n_words", "n_removed", "kept_sha256", "n_paths", *(["kept"] if keep_text else []))


def _told_apart(edges: DataFrame, failed: DataFrame, occurrences: DataFrame, real: DataFrame, sourced, window: int, tables: Tables) -> DataFrame:
    """Occurrences with sources; those of edges in the failed ranges (source, source_place, n words) are grouped by the SHA-256 of their words too."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, end, data, offsets in chunks(batch.column(2)):
                words = Words(data, offsets)
                flat, owner = _lists(batch.column(3), base, end)
                place = flat.field(1).to_numpy(zero_copy_only=False)
                first = words.first[owner] + place
                found = [hashlib.sha256(words.text[p:q]).digest() for p, q in zip(words.start[first].tolist() if len(first) else [], words.end[first + window - 1].tolist() if len(first) else [], strict=True)]
                to = pa.array(owner + base)
                yield pa.RecordBatch.from_arrays([flat.field(0), batch.column(0).take(to), batch.column(1).take(to), pa.array(place), pa.array(found, pa.binary())], ["edge", "doc_id", "copy", "place", "digest"])

    near = F.floor(F.col("source_place") / BLOCK)
    last = F.col("source_place") + F.col("n") - window
    ranges = failed.select("source", F.col("source_place").alias("from"), last.alias("to"), F.explode(F.sequence(near, F.floor(last / BLOCK))).alias("block"))
    doubtful = edges.withColumn("block", near).join(ranges, ["source", "block"]).where(F.col("source_place").between(F.col("from"), F.col("to"))).select("edge").distinct()
    doubtful = tables.write(doubtful)
    mine = occurrences.join(doubtful, "edge", "left_semi").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("edge", "place")).alias("places"))
    texts = real.join(mine, ["doc_id", "copy"]).select("doc_id", "copy", "text", "places")
    apart = tables.write(texts.mapInArrow(digests, "edge long, doc_id long, copy long, place int, digest binary"))
    key = ["edge", "digest"]
    exact = tables.write(sourced(apart, "digest"))
    sure = edges.join(doubtful, "edge", "left_anti")
    columns = ["doc_id", "copy", "place", "source", "source_place", "path"]
    total = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    again = attach(apart, exact.withColumn("path", F.xxhash64(*key)), key, "n", total(exact)).select(*columns)
    return attach(occurrences, sure, "edge", "n", total(sure)).select(*columns).unionByName(again)
