"""Functions of texts work on slices of an Arrow batch, so that what they make is bounded whatever a batch holds."""

import pandas as pd

from factloom.functions import shingles as SH
from factloom.functions.slices import slices


def made(udf, *columns):
    """What a function yields for one batch."""
    return list(udf.func(iter([columns if len(columns) > 1 else columns[0]])))


def test_slices_keep_rows_and_bound_lengths():
    texts = pd.Series(["a" * k for k in (3, 0, 9, 1, 1, 30, 2, 0, 5)] + [None])
    parts = list(slices(texts, texts.str.len(), most=8))
    assert pd.concat(parts).equals(texts) and len(parts) > 3 and all(p.str.len().sum() - p.str.len().max() <= 8 for p in parts)
    assert [len(p) for p in slices(texts[:0], texts[:0].str.len())] == [0]


def test_shingles_of_a_batch_come_in_slices():
    texts = pd.Series([" ".join(f"w{j}" for j in range(k, k + 60_000)) for k in range(12)] + ["too short", None])
    parts = made(SH.shingle_digests_udf, texts)
    assert len(parts) > 3 and [len(x) for p in parts for x in p] == [59_993] * 12 + [0, 0]


def test_degradations_of_a_batch_come_in_slices_from_one_function():
    from factloom.operators.tournament import degrade, degrade_udf, degraded_udf

    texts = pd.Series([f"First {k}. Second.\n\n" + "More of it. " * 30_000 for k in range(10)] + ["", None])
    parts = made(degraded_udf("shuffle", "drop_ends"), texts)
    got = pd.concat(parts)
    assert len(parts) > 3 and got["drop_ends"].tolist() == [degrade("drop_ends", t or "") for t in texts] and got["shuffle"].tolist() == [degrade("shuffle", t or "") for t in texts]
    alone = made(degrade_udf, pd.Series(["shuffle"] * len(texts)), texts)
    assert len(alone) > 3 and pd.concat(alone).tolist() == got["shuffle"].tolist()


def test_sentences_of_a_batch_come_in_slices_and_counts_alone():
    from factloom.functions import sentences as SE

    texts = pd.Series(["It is so. It was, too. " * 20_000 for _ in range(9)] + ["", None])
    assert len(made(SE.sentences_udf, texts)) > 3
    counts = pd.concat(made(SE.sentence_counts_udf, texts))
    assert counts.values.tolist() == [[len(SE.split_sentences(t)), len(SE.simple_sentences(t))] for t in texts]
