"""Language ID: blended-spectrum presence kernels, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import HOT_SHARE, held, lean
from .spans import chunks

LONGEST = 3
UNKNOWN = "und"
#: Languages that are learned at most: those with the most labelled documents. Bounds the sample, as does the longest text in it.
MOST_LANGUAGES, MOST_SAMPLE_BYTES = 256, 1 << 20
#: Rows of one matrix product.
BLOCK_ROWS = 256

_CLEAN = np.full(256, 0x20, np.uint8)
_CLEAN[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x61, 0x7B), *range(0x80, 0x100)]
#: Bytes that are left, numbered; the first code of each n-gram length, and the number of all codes.
_NUMBER = np.zeros(256, np.int32)
_NUMBER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = np.arange(1, 155)
BYTES = 155
_FIRST = np.cumsum([0, *(BYTES**n for n in range(1, LONGEST + 1))]).astype(np.int32)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of texts, lower-cased; all but letters is a space."""
    for begin, stop, _, _ in chunks(texts):  # a part at a time, as lower-casing copies
        lower = pc.utf8_lower(texts.slice(begin, stop - begin).cast(pa.large_string()).fill_null(""))
        for first, end, data, offsets in chunks(lower, rows=BLOCK_ROWS):
            yield begin + first, begin + end, _CLEAN[data], offsets


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the byte n-grams of 1 to LONGEST bytes of one text, repeats included; a code holds its length in bytes above the n-gram's own."""
    out, code = [], np.zeros(len(data), np.int32)
    for n in range(1, LONGEST + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] * BYTES) + _NUMBER[data[n - 1 :]]
        out.append(code + _FIRST[n - 1])
    return out


class Distinct:
    """Distinct codes of a text, without sorting: of the places that a code writes into its slot, one is left."""

    def __init__(self) -> None:
        self.slot = np.zeros(_FIRST[-1], np.int32)

    def __call__(self, data: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
        if len(data) <= piece:
            return self._once(np.concatenate([*grams(data), np.zeros(0, np.int32)]))
        return self._once(np.concatenate([self(data[k : k + piece - LONGEST], piece) for k in range(0, len(data), piece - 2 * LONGEST)]))

    def _once(self, codes: np.ndarray) -> np.ndarray:
        places = np.arange(len(codes), dtype=np.int32)
        self.slot[codes] = places
        return codes[self.slot[codes] == places]


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # the landmarks' n-grams, ascending; others add to a text's norm alone
    landmarks: np.ndarray  # features x landmarks: whether a landmark has the n-gram, over the root of its number of n-grams
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    @cached_property
    def feature(self) -> np.ndarray:
        """code -> feature, -1 for n-grams that no landmark has."""
        out = np.full(_FIRST[-1], -1, np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "feature"}

    def kernel(self, data: np.ndarray, offsets: np.ndarray, distinct: Distinct) -> np.ndarray:
        """Rows x landmarks: the n-grams that two texts share, over the root of the product of their numbers."""
        rows = len(offsets) - 1
        presence, norm = np.zeros((rows, len(self.landmarks)), np.float32), np.ones((rows, 1), np.float32)
        for k in range(rows):
            codes = distinct(data[offsets[k] : offsets[k + 1]])
            found = self.feature[codes]
            presence[k, found[found >= 0]] = 1
            norm[k] = max(1, len(codes)) ** 0.5
        return presence @ self.landmarks / norm

    def scores(self, kernel: np.ndarray) -> np.ndarray:
        return kernel @ self.weights + self.bias


def fit(texts: list[str], languages: list[str], landmarks: int = 192, ridge: float = 1e-3) -> Model:
    """Kernel ridge regression, one language against the rest, over Nystroem features.

    The kernel is that of presence of all n-grams of 1 to LONGEST bytes; as only
    those of a landmark can be shared with it, the model holds no others, and
    none is left out.
    """
    known = sorted(set(languages))
    blocks = [(data, offsets) for _, _, data, offsets in _blocks(pa.array(texts, pa.large_string()))]
    rng, distinct = np.random.default_rng(0), Distinct()
    chosen = np.sort(np.concatenate([rng.permutation(np.flatnonzero(np.array(languages) == lang))[: max(1, landmarks // len(known))] for lang in known]))
    texts_of = [data[o : e] for data, offsets in blocks for o, e in zip(offsets[:-1], offsets[1:], strict=True)]
    marks = [distinct(texts_of[k]) for k in chosen]
    every = np.unique(np.concatenate(marks))
    columns = np.zeros((len(every), len(marks)), np.float32)
    for k, codes in enumerate(marks):
        columns[np.searchsorted(every, codes), k] = 1 / max(1, len(codes)) ** 0.5
    model = Model(known, every, columns, np.zeros((len(marks), len(known)), np.float32), np.zeros(len(known), np.float32))
    x = np.concatenate([model.kernel(d, o, distinct) for d, o in blocks]).astype(np.float64)
    values, vectors = np.linalg.eigh(columns.T.astype(np.float64) @ columns)
    good = values > 1e-6 * max(values[-1], 1e-12)
    root = vectors[:, good] / np.sqrt(values[good])
    phi = x @ root
    y = np.where(np.array(languages)[:, None] == np.array(known), 1.0, -1.0)
    share = np.array([1 / (len(known) * languages.count(lang)) for lang in languages])[:, None]  # languages count alike
    mean_phi, mean_y = (share * phi).sum(0), (share * y).sum(0)
    centred = phi - mean_phi
    beta = np.linalg.solve(centred.T @ (share * centred) + ridge * np.eye(phi.shape[1]), centred.T @ (share * (y - mean_y)))
    model.weights = (root @ beta).astype(np.float32)
    model.bias = (mean_y - mean_phi @ beta).astype(np.float32)
    return model


def sample(rows: DataFrame, by: str, per_class: int) -> DataFrame:
    """Up to ``per_class`` ids of each value of ``by``, those of the smallest id hash: (doc_id, by), each once.

    Classes with over 1/512 of the rows, 512 at most by that definition, are
    thinned by their counts before any of their rows meet in a task; of others,
    each task sends ``per_class`` rows at most, as Spark limits ranks before it
    shuffles.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = {r[by]: r["n"] for r in counts.where(F.col("n") > F.lit(total * HOT_SHARE)).collect()}
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.lit(1 << 30)
    for value, n in sorted(hot.items(), key=str):
        share = F.when(F.col(by) == value, F.lit(int((1 << 30) * min(1.0, (2 * per_class + 20) / n)))).otherwise(share)
    thin = rows.select("doc_id", by).withColumn("mark", mark).where(F.col("mark") < share).distinct()
    place = F.row_number().over(W.partitionBy(by).orderBy("mark", "doc_id"))
    return thin.withColumn("place", place).where(F.col("place") <= per_class).select("doc_id", by)


def labelled(rows: DataFrame, train: DataFrame, text_col: str, per_language: int) -> DataFrame:
    """``rows`` in one pass, with lang_pred and score behind their own columns, see ``identify``; ``text_col`` itself goes."""
    usable = train.where("doc_id is not null and lang is not null and text is not null").where(F.octet_length("text") <= MOST_SAMPLE_BYTES).select("doc_id", "text", "lang")
    names = [r.lang for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    usable = usable.where(F.col("lang").isin(names))
    chosen = usable.join(F.broadcast(sample(usable, "lang", per_language)), ["doc_id", "lang"])  # per_language ids of each language
    learned = chosen.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    learned.sort(key=lambda r: (r.lang, r.doc_id))
    model = fit([r.text for r in learned], [r.lang for r in learned]) if learned else None
    sent = rows.sparkSession.sparkContext.broadcast(model)
    own = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, distinct = sent.value, held("distinct n-grams", Distinct)
        for batch in batches:
            for first, end, data, offsets in _blocks(batch.column(len(own))):
                kept = [batch.column(k).slice(first, end - first) for k in range(len(own))]
                letters = batch.column(len(own) + 1).slice(first, end - first).to_numpy(zero_copy_only=False)
                if model is None:
                    names, score = [UNKNOWN] * (end - first), np.zeros(end - first)
                else:
                    raw = 4 * model.scores(model.kernel(data, offsets, distinct)).astype(np.float64)
                    p = np.exp(raw - raw.max(1, keepdims=True))
                    best = p.argmax(1)
                    score = np.where(letters, p.max(1) / p.sum(1), 0.0)
                    names = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score)], [*own, "lang_pred", "score"])

    text = F.col(text_col).cast("string")
    schema = StructType([*rows.select(own).schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.select(*own, text.alias("text_of_row"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters_of_row")).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_language: int = 400) -> DataFrame:
    """The language of every whole text of ``docs``, learned from ``train`` (doc_id, text, lang).

    At most ``per_language`` documents of a language, chosen by a hash of their
    ids, are gathered for fitting, of texts of up to MOST_SAMPLE_BYTES and of the
    MOST_LANGUAGES languages with the most labelled documents; an id that is
    repeated with one language counts once, with its smallest text. The model's
    size is bounded by these and is broadcast. Scoring reads every whole text.

    Returns doc_id, lang_pred, score (0 to 1). Null text and text without a
    letter: ``und``, 0. Without any training rows: ``und``, 0 for all. Null and
    repeated ids and rows: each row returns. Empty table: no rows. Rows of
    ``train`` with a null id, text or lang aren't learned. Other columns are ignored.
    """
    return labelled(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), train, "text", per_language)


def accepted(docs: DataFrame, train: DataFrame, languages: Collection[str] | None = None, least: float = 0.3, per_language: int = 400) -> DataFrame:
    """The rows of ``docs`` (text) in one of ``languages``, at a score of ``least`` or more; by default in any language learned.

    Null texts and texts without a letter go. If nothing could be learned there is
    no decision to take, and all texts with a letter stay. Each row is decided by
    itself, in one pass: null and repeated ids don't matter. Returns the columns of
    ``docs``.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    good = (F.col("score") >= least) & (F.lit(True) if languages is None else F.col("lang_pred").isin(*languages))
    letters = F.col("row.text").cast("string").rlike(r"\p{L}")
    return labelled(named, train, "text", per_language).where(letters & ((F.col("lang_pred") == UNKNOWN) | good)).select("row.*")


def held_out(id_col: str, folds: int, fold: int):
    """Whether the CRC-32 of the id as text leaves ``fold`` by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
