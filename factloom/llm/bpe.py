"""BPE encoding and decoding: a minimal acyclic transducer for frequent words, exact merges for the others."""

from __future__ import annotations

import hashlib
import json
import mmap
import os
import re
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, held, lean
from .spans import chunks

#: What byte-level BPE splits texts by before merging; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of characters below U+0250 alone, with its letters, numbers and white space spelt out: the standard library's engine is faster.
_LETTERS, _NUMBERS, _SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_NARROW = re.compile(PATTERN.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS).replace(" ?[^\\s", f" ?[^{_SPACES}").replace(r"(?!\S)", f"(?![^{_SPACES}])").replace(r"\s", f"[{_SPACES}]").replace(f" ?{_LETTERS}+", f" ?[{_LETTERS}]+").replace(f" ?{_NUMBERS}+", f" ?[{_NUMBERS}]+"))
_WIDE = re.compile("[^\x00-\u024f]")

#: A worker keeps so many words' encodings at most.
CACHE_WORDS = 100_000


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges, ids and special tokens of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], _byte_of_char()
        raw = lambda token: bytes(byte_of[c] for c in token)
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.tables()

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of lowest rank merges first, of equal ones the leftmost."""
        if (known := self.id_of.get(word)) is not None and len(word) == 1:
            return [known]
        parts = [word[k : k + 1] for k in range(len(word))]
        if len(parts) > 256:
            return self._merge_long(parts)
        rank, none = self.rank, 1 << 60
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:])]  # noqa: B905
        while ranks:
            least = min(ranks)
            if least == none:
                break
            k = ranks.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank.get((parts[k], parts[k + 1]), none)
            if k:
                ranks[k - 1] = rank.get((parts[k - 1], parts[k]), none)
        return [self.id_of[p] for p in parts]

    def tables(self) -> None:
        """Arrays for ``merge_all``: ids of single bytes, ranks and results by pair of ids."""
        order = sorted(self.rank, key=lambda p: self.id_of[p[0]] << 32 | self.id_of[p[1]])
        self.byte_id = np.array([self.id_of[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array([self.id_of[a] << 32 | self.id_of[b] for a, b in order], np.int64)
        self.pair_rank = np.array([self.rank[p] for p in order], np.int64)
        self.result = np.zeros(len(order), np.int64)
        self.result[self.pair_rank] = [self.id_of[a + b] for a, b in order]
        bits = 20
        self.slot_shift = np.uint64(64 - bits)
        self.slot = np.full(1 << bits, -1, np.int64)
        self.slot[self._slots(self.pairs)] = np.arange(len(order))
        self.displaced = self.slot[self._slots(self.pairs)] != np.arange(len(order))
        self.crowded = np.zeros(1 << bits, bool)
        self.crowded[self._slots(self.pairs[self.displaced])] = True

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slot_shift).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids, 1 << 60 for pairs that don't merge: a hash table's slot, a search where slots are shared."""
        pairs = left << 32 | right
        slots = self._slots(pairs)
        at = self.slot[slots]
        out = np.where(self.pairs[at] == pairs, self.pair_rank[at], 1 << 60)
        doubtful = np.flatnonzero(self.crowded[slots])
        if len(doubtful):
            at = np.minimum(np.searchsorted(self.pairs, pairs[doubtful]), len(self.pairs) - 1)
            out[doubtful] = np.where(self.pairs[at] == pairs[doubtful], self.pair_rank[at], 1 << 60)
        return out

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """``merge`` of many words, which take their steps together: in each, every word merges its leftmost pair of lowest rank."""
        none = 1 << 60
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        rank = self._neighbours(ids, word)
        settled_ids, settled_words = [], []
        while len(ids):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(ids)))
            least = np.repeat(np.minimum.reduceat(rank, begins), sizes)
            going = least < none
            settled_ids.append(ids[~going])
            settled_words.append(word[~going])
            ids, word, rank, least = ids[going], word[going], rank[going], least[going]
            at = np.flatnonzero(rank == least)
            at = at[np.append(True, word[at][1:] != word[at][:-1])] if len(at) else at
            ids[at] = self.result[rank[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word, rank = ids[keep], word[keep], rank[keep]
            at -= np.arange(len(at))
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            if len(touched):
                right = np.minimum(touched + 1, len(ids) - 1)
                same = (word[right] == word[touched]) & (right > touched)
                rank[touched] = np.where(same, self.ranks_of(ids[touched], ids[right]), none)
        ids, word = np.concatenate(settled_ids or [ids]), np.concatenate(settled_words or [word])
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(len(words) + 1)).tolist()
        flat = ids[order].tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: B905

    def _neighbours(self, ids: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(ids), 1 << 60, np.int64)
        if len(ids) > 1:
            out[:-1] = np.where(word[1:] == word[:-1], self.ranks_of(ids[:-1], ids[1:]), 1 << 60)
        return out

    def _merge_long(self, parts: list[bytes]) -> list[int]:
        """The same with a heap over a linked list, for words of thousands of bytes."""
        import heapq

        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(len(parts) - 1) if (r := self.rank.get((parts[k], parts[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if n < 0 or parts[k] is not a or parts[n] is not b:
                continue
            parts[k], parts[n] = a + b, b""
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else -1
                if right >= 0 and (r := self.rank.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [self.id_of[p] for p in parts if p]


def build_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton of the words whose transitions count the words they skip, and the ids by a word's place.

    Words enter in order; suffixes that are complete are looked up in a register
    of equal states, so that endings are shared. Layout: five lengths, then
    transition keys (state * 256 + byte, ascending), targets, skipped words,
    final flags, and the ids' offsets and ids by the words' places in order.
    """
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple] = []
    counts: list[int] = []

    def settle(node: list) -> int:
        final, edges = node
        key = (final, tuple(edges))
        if (found := register.get(key)) is None:
            found = register[key] = len(states)
            states.append(key)
            counts.append(final + sum(counts[t] for _, t in edges))
        return found

    path: list[list] = [[0, []]]
    labels: list[int] = []
    last = b""
    for word in [*ordered, None]:
        common = 0
        if word is not None:
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
        while len(path) - 1 > common:
            done = settle(path.pop())
            path[-1][1].append((labels.pop(), done))
        if word is None:
            break
        for byte in word[common:]:
            labels.append(byte)
            path.append([0, []])
        path[-1][0] = 1
        last = word
    root = settle(path[0])
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(states):
        skipped = final
        for byte, target in edges:
            keys.append(state * 256 + byte)
            targets.append(target)
            skips.append(skipped)
            skipped += counts[target]
    ids = [words[w] for w in ordered]
    offsets = np.cumsum([0, *map(len, ids)], dtype=np.uint32)
    flat = np.array([i for row in ids for i in row], np.uint32)
    parts = [np.array(keys, np.int64), np.array(targets, np.int32), np.array(skips, np.int32), np.array([s[0] for s in states], np.int32), offsets, flat]
    return struct.pack("<5q", len(keys), len(states), len(ordered), len(flat), root) + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A lexicon, memory-mapped: its file is unlinked once mapped, so nothing is left when the worker ends."""

    def __init__(self, image: bytes):
        handle, path = tempfile.mkstemp(prefix="lexicon-")
        try:
            os.write(handle, image) if len(image) < 1 << 20 else self._write(handle, image)
            self.map = mmap.mmap(handle, len(image), access=mmap.ACCESS_READ)
        finally:
            os.close(handle)
            os.unlink(path)
        edges, states, self.words, flat, self.root = struct.unpack_from("<5q", self.map)
        at = 40
        arrays = []
        for kind, n in ((np.int64, edges), (np.int32, edges), (np.int32, edges), (np.int32, states), (np.uint32, self.words + 1), (np.uint32, flat)):
            arrays.append(np.frombuffer(self.map, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.skips, self.final, self.offsets, self.ids = arrays

    @staticmethod
    def _write(handle: int, image: bytes) -> None:
        view = memoryview(image)
        while view:
            view = view[os.write(handle, view) :]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon's order, -1 for words that aren't in it; all words step together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        data = np.frombuffer(b"".join(words), np.uint8)
        place, state = np.zeros(n, np.int64), np.full(n, self.root, np.int64)
        live = np.flatnonzero(lengths >= 0) if len(self.keys) else np.zeros(0, np.int64)
        level, out = 0, np.full(n, -1, np.int64)
        while len(live):
            ended = lengths[live] == level
            done = live[ended]
            out[done] = np.where(self.final[state[done]] == 1, place[done], -1)
            live = live[~ended]
            key = state[live] * 256 + data[starts[live] + level]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            live, at = live[hit], at[hit]
            place[live] += self.skips[at]
            state[live] = self.targets[at]
            level += 1
        return out

    def ids_at(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of letters (as bytes: A-Z, a-z and all from 0x80) with one space before, counted over the partition."""
    letter = np.zeros(256, bool)
    letter[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    held: list[pa.Table] = []

    def summed() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            inside = letter[data]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            cuts = offsets[:-1][offsets[:-1] < len(data)]
            begins[cuts] = inside[cuts]
            at = np.flatnonzero(begins)
            if not len(at):
                continue
            edge = np.zeros(len(data), bool)
            edge[cuts] = True
            spaced = at[(at > 0) & ~edge[at] & (data[at - 1] == 0x20)] - 1
            starts = begins.copy()
            starts[spaced + 1] = False
            starts[spaced] = True
            inside[spaced] = True
            ends = np.append(np.cumsum(inside)[np.flatnonzero(starts)] - 1, inside.sum()).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
            found = pc.value_counts(words)
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}))
            if sum(t.num_rows for t in held) > 1_000_000:
                held = [summed()]
                if held[0].num_rows > 500_000:
                    yield from held.pop().to_batches()
    if held:
        yield from summed().to_batches()


def frequent_words(docs: DataFrame, text_col: str = "text", most: int = 65_536) -> list[bytes]:
    """The most frequent words of all documents, ``most`` at most, which bounds the lexicon, not what is encoded.

    Words are counted over everything; then a histogram of the counts' logarithms
    (a few thousand rows) tells from which count on ``most`` words suffice, and
    only these come to the driver. No task sorts or sends candidates of its own.
    """
    tables = Tables(docs.sparkSession)
    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lean(_word_counts), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    level = F.floor(F.log2("n") * 64).cast("int")
    words = tables.write(counted.where("n > 1 and length(word) <= 64").select("word", level.alias("level")))
    least, taken = None, 0
    for r in sorted(words.groupBy("level").count().collect(), reverse=True):
        taken += r["count"]
        if taken > most:
            break
        least = r.level
    found = [] if least is None else [bytes(r.word) for r in words.where(F.col("level") >= least).select("word").collect()]
    tables.drop(words)
    return found


class Encoder:
    """Encodes texts; words are found in the lexicon or merged."""

    def __init__(self, vocabulary: Vocabulary, image: bytes):
        self.vocabulary, self.lexicon = vocabulary, Lexicon(image)
        self.find = regex.compile(PATTERN).findall
        self.cache: dict[str, tuple[str, bytes]] = {}
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None

    def words(self, text: str) -> list[str]:
        if self.special and any(s in text for s in self.vocabulary.special):
            return [w for part in self.special.split(text) for w in ([part] if part in self.vocabulary.special else self.find(part))]
        return self.find(text) if _WIDE.search(text) else _NARROW.findall(text)

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of new words into the cache: from the lexicon, or else merged."""
        v = self.vocabulary
        raw = [w.encode() for w in words]
        places = self.lexicon.places(raw).tolist()
        known = [self.lexicon.ids_at(p) if p >= 0 else None for p in places]
        short = [k for k, p in enumerate(places) if p < 0 and 0 < len(raw[k]) <= 64]
        for k, ids in zip(short, v.merge_all([raw[k] for k in short]), strict=True):
            known[k] = ids
        for word, b, ids in zip(words, raw, known, strict=True):
            if word in v.special:
                ids = [v.special[word]]
            elif ids is None:
                ids = v.merge(b)
            self.cache[word] = ",".join(map(str, ids)), np.array(ids, np.int32).tobytes()

    def rows(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """(ids joined by commas, ids as 32-bit integers) of each text."""
        split = [self.words(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = set().union(*split) - self.cache.keys()
        if new:
            self.learn(list(new))
        get = self.cache.__getitem__
        for words in split:
            found = [get(w) for w in words]
            yield ",".join([x[0] for x in found]), b"".join([x[1] for x in found])


class Decoder:
    """Texts of lists of ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.token = vocabulary.bytes_of.__getitem__

    def __call__(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token, ids.tolist())).decode("utf-8", "replace")


def _lists(ids: list[bytes]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *(len(i) // 4 for i in ids)], dtype=np.int32), np.frombuffer(b"".join(ids), np.int32))


def _encoded(docs: DataFrame, vocabulary_path: str, id_col: str, text_col: str, lexicon_words: int, columns: dict[str, str]) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = Vocabulary(vocabulary_path)
    words = frequent_words(docs, text_col, lexicon_words)
    image = build_lexicon({w: vocabulary.merge(w) for w in words})
    name = hashlib.sha256(image).hexdigest()
    sent = spark.sparkContext.broadcast((vocabulary, image))
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = held(name, lambda: (Encoder(*sent.value), Decoder(sent.value[0])))
        made_by = {
            "n_tokens": lambda made: pa.array([len(i) // 4 for _, i in made], pa.int64()),
            "ids": lambda made: _lists([i for _, i in made]),
            "ids_sha256": lambda made: pa.array([sha(text.encode()) for text, _ in made]),
            "decoded_sha256": lambda made: pa.array([sha(decoder(np.frombuffer(i, np.int32)).encode()) for _, i in made]),
        }
        for batch in batches:
            texts = batch.column(1)
            for first, end, _, _ in chunks(texts):
                made = list(encoder.rows(texts.slice(first, end - first).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(made_by[c](made) for c in columns)], ["doc_id", *columns])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(run), ", ".join(f"{k} {v}" for k, v in {"doc_id": "long", **columns}.items()))


def encode_documents(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536) -> DataFrame:
    """Byte-level BPE ids of every whole text.

    The words of all documents are counted; the most frequent, ``lexicon_words``
    at most, are merged once and compiled with their ids into a minimal acyclic
    automaton with shared suffixes. Its image, bounded by that number, is
    broadcast and memory-mapped by each worker from a file that is unlinked at
    once, so a lost worker loses nothing; any other word is merged exactly.
    Special tokens' strings are special tokens, as the tokenizers library has it.
    The vocabulary's file is read on the driver only.

    Returns doc_id, n_tokens, ids. Null text: as empty. Null and repeated ids and
    rows: each row returns. Empty table: no rows. Other columns are ignored.
    """
    return _encoded(docs, vocabulary_path, id_col, text_col, lexicon_words, {"n_tokens": "long", "ids": "array<int>"})


def decode_documents(encoded: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The texts of lists of ids, special tokens too; bytes that aren't UTF-8 are replaced as the tokenizers library does.

    Returns doc_id, text. Null list: null; empty list: empty. An id that the
    vocabulary lacks, or a null in a list, is an error. Null and repeated ids and
    rows: each row returns. Empty table: no rows. Other columns are ignored.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(sent.value)
        for batch in batches:
            texts = [None if ids is None else decoder(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon_words: int = 65_536) -> DataFrame:
    """Digests of what ``encode_documents`` gives and of what its ids decode to, in one pass.

    Returns doc_id, n_tokens, ids_sha256 (decimal ids joined by commas),
    decoded_sha256. Odd rows as in ``encode_documents``.
    """
    return _encoded(docs, vocabulary_path, id_col, text_col, lexicon_words, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
