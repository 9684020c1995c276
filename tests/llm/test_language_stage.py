import corpus_pipeline

EN = "the cat sat on the mat and the dog was in the house with all of them"
DE = "der hund und die katze sind in dem haus und das ist nicht schlecht für uns"


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_an_unlabelled_corpus_keeps_its_texts(spark, documents):
    docs = documents([(1, EN, None), (2, "12 34", None), (3, None, None), (4, DE, None)])
    assert left(corpus_pipeline.language_id(spark, docs, "")) == [(1, EN), (4, DE)]


def test_rows_without_an_id_stay(spark, documents):
    """They stay as any other row does, and go as copies of another row do."""
    docs = documents([(1, EN, "en"), (None, f"{EN} too", "en"), (None, "of all that was in the house the dog is not one", "en"), (2, DE, "de"), (None, "12", "en"), (None, EN, "en")])
    for stage in (corpus_pipeline.language_id, corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup):
        docs = stage(spark, docs, "")
    assert left(docs) == sorted([(1, EN), (None, "of all that was in the house the dog is not one"), (2, DE)], key=repr)


def test_the_model_decides(spark, documents):
    rows = [(i, f"{EN} {i}", "en") for i in range(10)] + [(20 + i, f"{DE} {i}", "de") for i in range(10)]
    docs = documents([*rows, (40, f"{DE} again", None)])
    german = corpus_pipeline.language_id(spark, docs, "", languages=["de"])
    assert german.columns == docs.columns
    assert [i for i, _ in left(german)] == [*range(20, 30), 40]
    assert left(corpus_pipeline.language_id(spark, docs, "", least=1.01)) == []
