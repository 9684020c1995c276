import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from factloom.llm import queries
from factloom.llm.fill_in_middle import fill_in_middle, restored


def draws(doc_id, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain(doc_id, text, units=lambda t: list(t)):
    text, parts = text or "", units(text or "")
    n, (h1, h2, h3, h4) = len(parts), draws(doc_id)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, n, form, len(prefix), len(middle), out


ROWS = [
    *((i, f"Row {i}: naïve 😀 text, {'word ' * (i % 40)}") for i in range(120)), (None, None), (None, "null id"), (500, ""), (501, "😀"), (502, "é" * 1024), (503, "x" * 2048),
    (504, "ab" * 60_000 + "😀"), (505, "a <P> in it"), (506, "<S><M>"), (507, "<P"), (508, "<"), (509, "ends with <"), (510, "S> <P ><M"), (9, "Row 9 again"), (9, "Row 9 again"), (511, " \n\t ")
]


def test_texts_match_a_plain_version(documents, rows_of):
    for run in (1024, 1, 7):
        out = fill_in_middle(documents(ROWS), run=run)
        assert rows_of(out) == sorted((plain(*r) for r in ROWS), key=repr)
    forms = [r.form for r in out.collect()]
    assert forms.count("plain") < forms.count("spm") + 20 < forms.count("psm")
    assert fill_in_middle(documents([])).count() == 0


def test_units_of_a_pattern(documents, rows_of):
    words = lambda t: re.findall(r"\w+\s*|.", t, re.S)
    out = fill_in_middle(documents(ROWS), unit=r"(?U)\w+\s*")
    assert rows_of(out) == sorted((plain(*r, words) for r in ROWS), key=repr)


def test_restored_is_the_text(documents):
    out = fill_in_middle(documents(ROWS), moved_percent=100, spm_percent=50)
    pairs = out.select("doc_id", "form", restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in pairs) == sorted((i or -1, t or "") for i, t in ROWS)
    assert {r.form for r in pairs} == {"plain", "psm", "spm"}


def test_a_hot_row_is_not_shuffled(documents):
    rows = [(1, "hot row, again and again")] * 600 + [(i, f"text {i}") for i in range(2, 300)]
    out = fill_in_middle(documents(rows), moved_percent=100)
    got = [r.output for r in out.where("doc_id = 1").collect()]
    assert got == [plain(1, "hot row, again and again")[5]] * 600 and out.count() == len(rows)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_the_sql_says_the_same(spark, documents, tmp_path):
    documents(ROWS).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256".split()
    found = queries.op13_fill_in_middle(spark, str(tmp_path)).select(names).collect()
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL['op13_fill_in_middle']})").fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert all(r.restored_sha256 for r in found)
