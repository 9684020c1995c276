"""Word shingles in batches: expressions would make each of them in interpreted code."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .slices import freed, slices
from .text import SHINGLE

_WORD = re.compile("[a-z0-9]+")


def shingles(lowered: str | None, n: int = SHINGLE) -> set[str]:
    """Distinct runs of ``n`` words [a-z0-9]+ of a lower-cased text."""
    words = _WORD.findall(lowered or "")
    return {" ".join(words[k : k + n]) for k in range(len(words) - n + 1)}


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def shingle_digests_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """128-bit digests of the shingles: of 1e13 texts' shingles, two share one with a chance under 1e-12. Made a slice of a batch at a time."""
    for lowered in batches:
        for part in slices(lowered, lowered.str.len()):
            yield part.map(lambda t: [xxhash.xxh3_128_digest(s) for s in shingles(t)])
    freed()


@F.pandas_udf(T.StructType([T.StructField("shingles", T.LongType()), T.StructField("first_shingle", T.StringType()), T.StructField("last_shingle", T.StringType())]))
def shingle_range_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Number, least and greatest of the shingles."""
    for lowered in batches:
        rows = [(len(s), min(s, default=None), max(s, default=None)) for s in map(shingles, lowered)]
        yield pd.DataFrame(rows, columns=["shingles", "first_shingle", "last_shingle"]).astype({"shingles": "int64"})
    freed()
