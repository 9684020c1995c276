import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.llm import queries
from factloom.llm.merkle import built, folded, leaf_of, manifest, ragged


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes, arity=8):
    """(top, path of each leaf as (position, siblings)) of a tree over ``nodes``."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for leaf, k in enumerate(place):
            run, at = runs[k // arity], k % arity
            paths[leaf].append((at, "".join(run[:at] + run[at + 1 :])))
            place[leaf] = k // arity
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows, arity=8):
    """(doc_id, leaf, top, root, proof) of (doc_id, text, lang) rows, as the fixture completes them."""
    groups = {}
    for i, text, lang in rows:
        groups.setdefault(lang, []).append((i, encoded(i, "src", lang, None, text)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climbed([d for _, d in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))], arity) for g in names}
    root, upper = climbed([trees[g][0] for g in names], arity)
    out = []
    for g, above in zip(names, upper, strict=True):
        ordered = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        out += [(i, d, trees[g][0], root, p + above) for (i, d), p in zip(ordered, trees[g][1], strict=True)]
    return out


def got(df):
    return sorted(((r.doc_id, r.leaf, r.top, r.root, [(s.position, s.siblings) for s in r.proof]) for r in df.collect()), key=repr)


@pytest.fixture
def rows():
    random.seed(5)
    out = [(i, f"text {i}", random.choice(["en", "en", "en", "de", "fr"])) for i in range(700)]
    out += [(7, "text 7", "en"), (None, None, None), (None, "x", "en"), (3, "", ""), (4, "lone", "é"), (5, "A" * 100_000, "zz"), (5, "A" * 100_000, "zz")]
    return out


@pytest.mark.parametrize(("arity", "part_rows"), [(8, 200_000), (8, 50), (2, 30), (3, 7)])
def test_proofs_match_a_plain_tree_however_parts_fall(documents, rows, arity, part_rows):
    df = manifest(documents(rows), arity=arity, part_rows=part_rows)
    assert got(df) == sorted(plain(rows, arity), key=repr)


def test_a_hot_key_and_single_rows(documents):
    hot = [(1, "same", "en")] * 400 + [(2, "other", "en"), (3, "one", "de")]
    assert got(manifest(documents(hot), part_rows=20)) == sorted(plain(hot), key=repr)
    assert got(manifest(documents([(9, "alone", "en")]))) == plain([(9, "alone", "en")])
    assert manifest(documents([])).count() == 0


def test_many_groups(documents):
    many = [(i, "t", f"g{i % 90}") for i in range(200)]
    assert got(manifest(documents(many), part_rows=15)) == sorted(plain(many), key=repr)


def test_tampering_is_found_and_clashing_names_carry(documents, rows):
    other = leaf_of([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text")])
    out = manifest(documents(rows), carried={"kind": other, "level": F.col("keep_id")}, part_rows=60)
    out = out.select("doc_id", "level", "leaf", "kind", "root", folded(F.col("leaf"), F.col("proof")).alias("true"), folded(F.col("kind"), F.col("proof")).alias("false")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.level == 7 and r.true == r.root and (r.false == r.root) == (r.kind == r.leaf)
    assert sum(r.kind != r.leaf for r in out) == 2


def test_parts_build_what_they_hold():
    leaves = [digest(str(k)) for k in range(100)]
    top, _ = climbed(leaves)
    assert built(leaves, 0, 100, 8)[-1].nodes == [top] and list(ragged(built(leaves, 0, 100, 8), 8)) == [(3, 0, 1, top)]
    middle = built(leaves[5:77], 5, 100, 8)
    assert [(s, n, len(x)) for s, n, x in middle] == [(5, 100, 72), (1, 13, 8)]
    assert [(k, i) for k, i, _, _ in ragged(middle, 8)] == [(0, 5), (0, 6), (0, 7), *((0, i) for i in range(72, 77)), *((1, i) for i in range(1, 9))]


def test_the_sql_is_a_plain_version_too(spark, documents, rows, tmp_path):
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL['op11_merkle_manifest']})").fetchall()
    found = [tuple(r) for r in queries.op11_merkle_manifest(spark, str(tmp_path)).select(names).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    tampered = {i for i, t, _ in rows if t and t != t.lower() and zlib.crc32(str("" if i is None else i).encode()) % 3 == 0}
    assert {r[0] for r in found if not r[-1]} == tampered
