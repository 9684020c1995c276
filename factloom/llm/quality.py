"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import sample
from .spans import RangeHash, Words, chunks

#: Words of a passage.
PASSAGE = 48

_CLASSES = np.zeros((6, 256), np.int32)
for _k, _bytes in enumerate(([*range(0x41, 0x5B)], [*range(0x61, 0x7B)], [*range(0x30, 0x3A)], [*b".,;:'\"()-?"], [b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in b".,;:'\"()-?"], [*range(0x80, 0x100)])):
    _CLASSES[_k, _bytes] = 1
FEATURES = 6 + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features) of the passages of ``PASSAGE`` words of each row; a row without words has one empty passage."""
    words = Words(data, offsets)
    per_row = np.diff(words.first)
    number = np.maximum(1, -(-per_row // PASSAGE))
    row = np.repeat(np.arange(words.rows), number)
    begin = words.first[:-1][row] + PASSAGE * (np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number))
    end = np.minimum(begin + PASSAGE, words.first[1:][row])
    size = (end - begin).astype(np.float64)
    out = np.zeros((len(row), FEATURES), np.float32)
    if not words.count:
        return row, out
    has = size > 0
    a, b = words.start[np.minimum(begin, words.count - 1)], words.end[np.maximum(end - 1, 0)]
    length = np.where(has, b - a - (size - 1), 1).astype(np.float64)
    for k in range(6):
        sums = np.concatenate([[0], np.cumsum(_CLASSES[k][words.text], dtype=np.int64)])
        out[:, k] = np.where(has, (sums[b] - sums[a]) / length, 0)

    def share(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return np.where(has, (sums[end] - sums[begin]) / np.maximum(size, 1), 0)

    hashes = RangeHash(words.text)(words.start, words.end)
    owner = np.repeat(np.arange(len(row)), end - begin)
    order = np.lexsort((hashes, owner))
    fresh = np.zeros(words.count, bool)
    fresh[order] = np.append(True, (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1]))
    repeat = np.append(False, hashes[1:] == hashes[:-1])
    short = words.end - words.start
    last = words.text[words.end - 1]
    out[:, 6] = share(fresh)
    out[:, 7] = share(repeat)
    out[:, 8] = np.where(has, length / np.maximum(size, 1), 0) / 10
    out[:, 9] = share(short == 1)
    out[:, 10] = share((_CLASSES[4][last] == 1) & (short > 1))
    out[:, 11] = share(short > 20)
    out[:, 12] = np.log1p(size) / 4
    return row, out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, row: np.ndarray, rows: int) -> dict[str, np.ndarray]:
        """Every passage is encoded, gated attention weighs the passages of a row, and their mean by weight is scored."""
        w = self.w
        h = np.tanh((x - self.mean) / self.scale @ w["encode"] + w["encode_b"])
        t, s = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * s) @ w["weigh"]
        top = np.full(rows, -np.inf)
        np.maximum.at(top, row, e)
        a = np.exp(e - top[row])
        a /= np.bincount(row, a, rows)[row]
        z = np.zeros((rows, h.shape[1]))
        np.add.at(z, row, a[:, None] * h)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-(z @ w["score"] + w["score_b"])))}


def fit(x: np.ndarray, row: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Adam over the whole sample; classes count alike. x: passages, row: their documents, y: the documents' labels."""
    rng = np.random.default_rng(0)
    x = x.astype(np.float64)
    w = {"encode": rng.normal(0, 0.3, (x.shape[1], hidden)), "encode_b": np.zeros(hidden), "attend": rng.normal(0, 0.3, (hidden, attention)), "gate": rng.normal(0, 0.3, (hidden, attention)), "weigh": rng.normal(0, 0.3, attention), "score": rng.normal(0, 0.3, hidden), "score_b": np.zeros(())}
    model = Model(x.mean(0), x.std(0) + 1e-3, w)
    n, scaled = len(y), (x - model.mean) / model.scale
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, steps + 1):
        f = model.forward(x, row, n)
        h, t, s, a, z = f["h"], f["t"], f["s"], f["a"], f["z"]
        d_logit = weight * (f["p"] - y)
        d_z = d_logit[:, None] * w["score"]
        d_a = (d_z[row] * h).sum(1)
        d_e = a * (d_a - np.bincount(row, a * d_a, n)[row])
        d_ts = d_e[:, None] * w["weigh"]
        d_t, d_s = d_ts * s * (1 - t * t), d_ts * t * s * (1 - s)
        d_h = (a[:, None] * d_z[row] + d_t @ w["attend"].T + d_s @ w["gate"].T) * (1 - h * h)
        grads = {"encode": scaled.T @ d_h, "encode_b": d_h.sum(0), "attend": h.T @ d_t, "gate": h.T @ d_s, "weigh": (t * s).T @ d_e, "score": z.T @ d_logit, "score_b": d_logit.sum()}
        for k, g in grads.items():
            g = g + decay * w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        model.w = w
    return model


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1), rows=20_000):
            row, x = passages(data, offsets)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first).take(pa.array(row)), pa.array(row + first), batch.column(2).slice(first, end - first).take(pa.array(row)), lists], ["doc_id", "row", "label", "x"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 1500) -> DataFrame:
    """The quality of every whole text of ``docs``, learned from ``labels`` (doc_id, label 0 or 1).

    A document is a bag of passages of 48 words. Passages are encoded from their
    own text alone (shares of byte classes, repeats, word lengths); a gated
    attention net, trained from document labels, weighs them. At most
    ``per_class`` labelled documents of either label, chosen by a hash of their
    ids, are gathered for fitting.

    Returns doc_id, score (0 to 1, higher: label 1 likelier), predicted (1 from
    0.5 on). Null and empty text: one empty passage. Without labels of both kinds:
    0.5. Labels that are null or not 0 or 1 aren't learned; a document with
    several labels is learned with each. Null and repeated ids and rows: each row
    returns. Empty table: no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    chosen = sample(labels.where("label in (0, 1) and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label")), "label", per_class)
    learned = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").mapInArrow(_passages, "doc_id long, row long, label int, x array<float>").toPandas()  # 2 * per_class documents
    model = None
    if learned["label"].nunique() == 2:
        learned = learned.sort_values(["doc_id", "label", "row"], kind="stable")
        x, bag = np.stack(learned["x"].to_numpy()), learned.groupby(["doc_id", "label"], sort=True).ngroup().to_numpy()
        y = np.zeros(bag.max() + 1)
        y[bag] = learned["label"].to_numpy()
        model = fit(x, bag, y)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1), rows=20_000):
                row, x = passages(data, offsets)
                p = model.forward(x.astype(np.float64), row, end - first)["p"] if model else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
