"""Token counts: whole documents are encoded once, and tokens are attributed to sections by their offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN
from .shared import held
from .spans import chunks

RULES = ("start", "end", "majority")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def attribute(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a bound) of each section; ``bounds``: the sections' starts and the last one's end.

    An interval join of the tokens' byte spans with the sections': a token inside
    one section is that section's. One that crosses a bound goes, by ``rule``, to
    the section of its first byte, of its last, or to the one that holds most of
    it (of equals, the first). Empty sections get none.
    """
    sections = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends - 1, "right") - 1
    owner = last if rule == "end" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for k in crossing.tolist():
            held = [min(ends[k], bounds[s + 1]) - max(starts[k], bounds[s]) for s in range(first[k], last[k] + 1)]
            owner[k] = first[k] + int(np.argmax(held))
    return np.bincount(owner, minlength=sections)[:sections], np.bincount(owner[crossing], minlength=sections)[:sections]


def token_counts(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", separator: str = "\n") -> DataFrame:
    """Tokens of every section of every document, from one encoding of the whole text.

    Sections are the pieces between separators (one byte); a separator belongs to
    the section that it ends. Tokens have byte offsets, as byte-level tokens join
    to the text, and go to sections by ``attribute``; so a document's sections
    add up to the document's tokens, which counting each section alone doesn't
    give. The ranks are read on the driver and broadcast; their size is the
    vocabulary's.

    Returns one row per document and section: doc_id, section (from 0),
    byte_start, n_bytes, n_tokens, n_crossing (of these, tokens that cross a
    bound), doc_tokens. Null and empty text: one section of no bytes and tokens.
    Null and repeated ids and rows: each row returns its own sections. Empty
    table: no rows. Other columns are ignored. Special tokens' strings are text.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if len(separator.encode()) != 1:
        raise ValueError("separator is one byte")
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    mark = separator.encode()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        def made() -> tuple[tiktoken.Encoding, np.ndarray]:
            ranks = sent.value
            lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                lengths[rank] = len(token)
            return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths

        encoding, lengths = held(ranks_path, made)
        for batch in batches:
            for row, end, data, offsets in chunks(batch.column(1)):
                out: list[list[np.ndarray]] = []
                for k, text in enumerate(batch.column(1).slice(row, end - row).to_pylist()):
                    body = data[offsets[k] : offsets[k + 1]]
                    ends = np.cumsum(lengths[np.array(encoding.encode_ordinary(text or ""), np.int64)])
                    cuts = np.flatnonzero(body == mark) + 1
                    bounds = np.concatenate([[0], cuts[cuts < len(body)], [len(body)]]).astype(np.int64)
                    tokens, crossing = attribute(ends, bounds, rule)
                    n = len(tokens)
                    out.append([np.full(n, row + k), np.arange(n), bounds[:-1], np.diff(bounds), tokens, crossing, np.full(n, len(ends))])
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0]))] + [pa.array(c.astype(np.int64)) for c in columns[1:]], ["doc_id", "section", "byte_start", "n_bytes", "n_tokens", "n_crossing", "doc_tokens"])

    schema = "doc_id long, section long, byte_start long, n_bytes long, n_tokens long, n_crossing long, doc_tokens long"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
