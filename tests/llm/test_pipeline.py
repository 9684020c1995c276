import os
import re

import corpus_pipeline
from factloom.llm.queries import SQL, queries, tokenizer
from tests.llm.test_dedup import fold, reachable
from tests.llm.test_similar_dedup import similar

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FOLDER = "/root/testdata/sf0.001"


def plain(text):
    return " ".join(re.sub("[^0-9a-z\x80-\U0010ffff]", " ", text.lower()).split())


def plain_pipeline(rows, items):
    """Rows (doc_id, text) that are left. Languages of the tables aren't in doubt, so the first stage keeps each text that has a letter."""
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    order = lambda k: (rows[k][0] is not None, rows[k][0] or 0, -k)
    last = {}
    for k, (_, t) in enumerate(rows):
        last[fold(t)] = max(k, last.get(fold(t), k), key=order)
    rows = [rows[k] for k in last.values()]
    texts = {k: t for k, (_, t) in enumerate(rows)}
    roots, first = reachable(similar(texts), texts), {}
    for k, (i, _) in enumerate(rows):
        own = (i is None, i or 0, k)
        first[roots[k]] = min(own, first.get(roots[k], own))
    rows = [rows[k] for *_, k in first.values()]
    held = lambda x, text: f" {x} " in f" {text} " if len(x.encode()) < 20 else x in text  # noqa: E731  too short for an edit: whole words
    return [r for r in rows if not any(held(x, plain(r[1])) for x in items)]


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return sorted(((i, t.encode(x, add_special_tokens=False).ids) for i, x in rows), key=repr)


def test_run_matches_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted(((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, FOLDER).collect()), key=repr)
    assert got == encoded(plain_pipeline(docs, items))


def test_rows_are_judged_apart_from_their_ids(spark, documents, tmp_path):
    """Nulls, repeated ids with one and with several texts, repeated rows, empty and odd texts, extra columns; and an empty table."""
    said = lambda k, n=40: " ".join(f"{'lorem ipsum dolor'.split()[j % 3]}{k * j % 97}" for j in range(n))
    long = said(5, 300).split()
    rows = [
        (1, "same text here"), (2, "Same text here"), (1, "another text there"), (3, "dup dup"), (3, "dup dup"), (None, "null id"), (None, "null id"), (None, "dup dup"),
        (4, None), (5, ""), (6, " 12 "), (7, " ".join(long)), (11, " ".join([*long[:150], "edited", *long[151:]])), (None, " ".join([*long[:9], "edited", *long[10:]])),
        (8, f"in front {said(7)} behind"), (8, "a clean text of that id"), (9, said(3, 60_000)), (None, said(7)),
    ]
    items = [said(7), "12"]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)
    want = plain_pipeline(rows, [plain(x) for x in items])
    assert got == encoded(want) and {i for i, _ in want} == {1, 2, 3, 7, 8, 9, None} and len(want) == 7
    docs = documents([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name


def test_sql_says_the_same(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    for name, sql in SQL.items():
        got = queries()[name](spark, FOLDER).toPandas()
        want = c.sql(sql).df()[list(got.columns)]
        whole = lambda v: int(v) if isinstance(v, float) and v == int(v) else v  # noqa: E731  integers beside nulls come as floats from one engine only
        key = lambda p: sorted(repr([whole(v) for v in r]) for r in p.astype(object).where(p.notna(), None).values.tolist())
        assert key(got) == key(want), name


def test_driver_gives_memory_back_while_an_operator_writes_its_tables(spark, monkeypatch):
    from factloom.llm import shared

    seen = []
    whole = shared.relieved
    monkeypatch.setattr(shared, "relieved", lambda s: seen.append(1) or whole(s))
    tables = shared.Tables(spark)
    for k in range(8):
        tables.write(spark.range(k))
    assert len(seen) == 2


def test_driver_gives_memory_back_around_each_stage(spark, monkeypatch):
    seen = []
    whole = corpus_pipeline.relieved
    monkeypatch.setattr(corpus_pipeline, "relieved", lambda s: seen.append(1) or whole(s))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER)
        assert len(seen) == 2 * (k + 1)


def test_the_jvm_gives_back_what_it_has_freed(spark):
    from factloom.llm.shared import trimmed

    assert "rim" in trimmed(spark)
