import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from factloom.llm import exact_dedup, shared
from factloom.llm.exact_dedup import exact_groups
from factloom.llm.shared import Tables, attach, components
from factloom.llm.simhash_dedup import fingerprints_of, links, near_groups
from factloom.llm.spans import chunks, xxh64
from factloom.llm.substring_dedup import _compacted, dedup_substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_by_hand(documents, rows_of):
    rows = [(1, "Same  Text"), (5, "same  text"), (3, "SAME  TEXT"), (4, "same text"), (7, None), (2, ""), (9, "É"), (8, "é"), (None, "lone"), (4, "same text"), (6, "x" * 200_000)]
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if fold(u) == fold(t)]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert rows_of(exact_groups(documents(rows))) == sorted(want, key=repr)
    assert exact_groups(documents([])).count() == 0


def test_exact_groups_with_a_hot_group_and_no_python(documents, rows_of):
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(600)]
    out = exact_groups(documents(rows), salts=4)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 600 and sum(r.kept for r in got.values()) == 201
    assert all(got[i].keep_id == 599 and got[i].group_size == 400 for i in range(600) if i % 3)


def test_exact_groups_tells_texts_of_one_digest_apart(documents, rows_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_of", lambda body: F.left(F.sha2(body, 256), F.lit(1)), raising=False)
    rows = [*((i, f"Text {i % 40}") for i in range(120)), *((i, "hot") for i in range(120, 200)), (None, "text 3"), (None, None), (7, "text 7")]
    want = []
    for i, t in rows:
        ids = [j for j, u in rows if fold(u) == fold(t)]
        keep = max((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()[:1]))
    assert rows_of(exact_groups(documents(rows), salts=4)) == sorted(want, key=repr)


def test_exact_groups_sorts_no_texts_and_lets_executors_collect(documents, spark, monkeypatch):
    done, written, write, rested = [], [], Tables.write, shared.rested
    monkeypatch.setattr(Tables, "write", lambda self, df: (written.append(df), write(self, df), done.append("table"))[1])
    for module in (shared, exact_dedup):
        monkeypatch.setattr(module, "rested", lambda session: (done.append("rest"), rested(session)), raising=False)
    exact_groups(documents([(i, f"text {i % 5} " * 50) for i in range(50)])).collect()
    sorts = [n for df in written for n in nodes_of(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() in ("Window", "Sort")]
    assert sorts and not any("body" in n.children().apply(0).output().mkString(",") for n in sorts)
    assert not any("body" in df.columns for df in written)
    assert done == ["rest", "table", "rest", "table", "rest"]


def test_executors_collect_before_the_first_table_only(spark, monkeypatch):
    seen, rested = [], shared.rested
    monkeypatch.setattr(shared, "rested", lambda session: (seen.append(1), rested(session)))
    tables = Tables(spark)
    assert [tables.write(spark.range(n)).count() for n in (3, 0, 5)] == [3, 0, 5] and seen == [1]


def nodes_of(plan):
    return [plan, *(n for k in range(plan.children().size()) for n in nodes_of(plan.children().apply(k)))]


def test_xxh64_matches_the_library():
    random.seed(3)
    parts = [bytes(random.randrange(256) for _ in range(n)) for n in [*range(70), 300, 1000]]
    text = np.frombuffer(b"".join(parts) + b" " * 8, np.uint8)
    end = np.cumsum([len(p) for p in parts])
    assert xxh64(text, end - [len(p) for p in parts], end).tolist() == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def plain_fingerprint(text):
    words = WORDS.findall(fold(text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def fingerprints(texts):
    return np.concatenate([fingerprints_of(d, o) for _, _, d, o in chunks(pa.array(texts, pa.string()), limit=64)]).tolist()


def test_fingerprints_match_a_plain_version():
    texts = ["", None, " \t ", "a", "A b", "a b c", "a  b\nc d", "Ünï cödé ÄÖ x", "w" * 400 + " y z", "the same the same the same", "x\x0by\x0cz\x1cw q", " lead and trail "]
    assert fingerprints(texts) == [plain_fingerprint(t) for t in texts]


def reachable(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    return {n: root(n) for n in nodes}


def near_fingerprints(n, seed):
    random.seed(seed)
    centres = [random.getrandbits(64) for _ in range(6)]
    out = set()
    while len(out) < n:
        fp = random.choice(centres)
        for _ in range(random.choice([0, 1, 2, 3, 4, 6])):
            fp ^= 1 << random.randrange(64)
        out.add(fp)
    return sorted(out)


def linked(spark, fps, **how):
    signed = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    tables = Tables(spark)
    pairs = links(spark.createDataFrame(signed, "fp long, rep long"), tables, **how)
    found = dict(tuple(r) for r in components(pairs, tables).collect())
    return {i: found.get(i, i) for i in range(len(fps))}


def test_links_connect_what_brute_force_connects(spark):
    fps = near_fingerprints(250, 1)
    brute = reachable([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3], range(len(fps)))
    assert linked(spark, fps) == brute
    assert linked(spark, fps, segment_bits=1) == brute


def test_links_in_crowded_cells_meet_in_points(spark):
    fps = near_fingerprints(120, 2)
    brute = reachable([(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3], range(len(fps)))
    assert linked(spark, fps, dense=3) == brute


def test_near_groups(documents, rows_of):
    random.seed(5)
    body = [f"w{i}" for i in range(300)]
    near = body.copy()
    near[150] = "other"
    texts = [" ".join(body), " ".join(near), " ".join(body).upper(), None, "", " ", *(" ".join(f"v{random.random()}" for _ in range(40)) for _ in range(20)), " ".join(body)]
    rows = [(i + 10, t) for i, t in enumerate(texts)] + [(None, "only null ids here"), (12, texts[2])]
    fps = [plain_fingerprint(t) for _, t in rows]
    ids = [i for i, _ in rows]
    brute = reachable([(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3], range(len(rows)))
    groups = defaultdict(list)
    for k, r in brute.items():
        groups[r].append(ids[k])
    want = [(ids[k], f"{fps[k]:016x}", min((i for i in groups[r] if i is not None), default=None)) for k, r in brute.items()]
    assert rows_of(near_groups(documents(rows))) == sorted(want, key=repr)
    assert near_groups(documents([])).count() == 0


def test_components_of_chains_stars_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Tables(spark)).collect())
    want = reachable([e for e in edges if None not in e], {n for e in edges if None not in e for n in e})
    assert found == want
    assert components(spark.createDataFrame([], "a long, b long"), Tables(spark)).count() == 0


def test_attach_splits_hot_keys_off(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else str(i)) for i in range(4000)], "i long, k string")
    values = rows.groupBy("k").count()
    assert attach(rows, values, "k", "count", 4000).count() == 4000


def plain_substrings(rows, window):
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[k : k + window])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if i is not None and least[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substrings_match_a_plain_version(documents, rows_of):
    random.seed(9)
    passages = [[f"p{k}w{random.randrange(30)}" for _ in range(random.choice([12, 13, 14, 40]))] for k in range(6)]
    rows = [(1, None), (2, ""), (3, "a b"), (4, "und " * 60), (9, "und " * 30), (None, " ".join(passages[0]))]
    for i in range(30):
        words = []
        for _ in range(random.randrange(1, 5)):
            words += [f"u{random.randrange(9)}" for _ in range(random.randrange(20))] + random.choice(passages)
        rows.append((20 + i, random.choice([" ", "\n", " \t"]).join(words)))
    rows += [rows[-1], (25, "a text that repeats an id " + " ".join(passages[3])), (5, "same "), (6, "É " * 20), (7, "É " * 14)]
    four = ("doc_id", "n_words", "n_removed", "kept_sha256")
    for how in ({}, {"window": 4}, {"hash_bits": 6}, {"window": 4, "hash_bits": 2}):
        assert rows_of(dedup_substrings(documents(rows), **how).select(*four)) == plain_substrings(rows, how.get("window", 13)), how
    far = [(None if i is None else i * (1 << 56) - (1 << 61), t) for i, t in rows]
    assert rows_of(dedup_substrings(documents(far)).select(*four)) == plain_substrings(far, 13)
    assert dedup_substrings(documents([])).count() == 0


def test_clashing_windows_are_told_apart(documents, rows_of):
    """Documents share passages in pairs; with six bits of hash, nearly every window has the name of another one."""
    random.seed(2)
    rows = []
    for k in range(20):
        passage = [f"s{k}x{j}" for j in range(25)]
        for i in (k, 39 - k):
            rows.append((i, " ".join([f"d{i}y{j}" for j in range(7)] + passage + [f"d{i}z{j}" for j in range(7)])))
    want = plain_substrings(rows, 13)
    assert sum(r[2] for r in want) == 20 * 25
    assert rows_of(dedup_substrings(documents(rows), hash_bits=6).select("doc_id", "n_words", "n_removed", "kept_sha256")) == want


def test_paths_end_where_the_graph_branches(spark):
    """a-b-c-d and x-b-c-y share b-c: the nodes around it branch, and the long tail compacts over blocks and sources."""
    def edge(left, right, source, place):
        return (left * 10_000 + right, left, right, source, place, 2)

    chain = [edge(100 + k, 101 + k, 1 if k < 30 else 2, k if k < 30 else 5000 + k) for k in range(60)]
    ring = [edge(900, 901, 7, 0), edge(901, 902, 8, 0), edge(902, 900, 9, 0)]
    fork = [edge(1, 2, 3, 0), edge(2, 3, 3, 1), edge(3, 4, 3, 2), edge(10, 2, 4, 0), edge(3, 11, 4, 2)]
    far = [edge(300 + k, 301 + k, 5, 4090 + k) for k in range(12)]
    edges = spark.createDataFrame([*chain, *ring, *fork, *far], "edge long, left long, right long, source long, source_place int, n long")
    path = {(r.left, r.right): r.path for r in _compacted(edges, Tables(spark)).collect()}
    assert len(path) == len(edges.collect())
    for one in (chain, far):
        assert len({path[e[1:3]] for e in one}) == 1
    assert len({path[e[1:3]] for e in fork}) == 5


def test_hot_anchors_are_salted_by_document(spark):
    """A header stands at one place of every document; its occurrences are dealt to many salts."""
    from factloom.llm import substring_dedup as S

    header = " ".join(f"h{k}" for k in range(20))
    docs = spark.createDataFrame([(i, f"{header} {i} " + " ".join(f"u{i}x{j}" for j in range(9))) for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.dedup_substrings(docs).collect()}
    assert got == {0: 0} | {i: 20 for i in range(1, 300)}
    from factloom.llm.spans import mix

    assert len(set((mix(np.arange(300).astype(np.uint64)) % np.uint64(S.SALTS)).tolist())) > 50


def test_substrings_return_the_kept_text(documents):
    body = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r.kept for r in dedup_substrings(documents([(1, body), (2, f"new {body}\nend")]), keep_text=True).collect()}
    assert got == {1: body, 2: "new end"}
