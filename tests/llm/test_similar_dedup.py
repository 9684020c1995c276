import random

import corpus_pipeline
from factloom.llm import simhash_dedup
from factloom.llm.simhash_dedup import fingerprints, near_prints
from factloom.llm.similar_dedup import similar_groups
from tests.llm.test_dedup import WORDS, fold, reachable

FOLDER = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = WORDS.findall(fold(text))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def similar(texts, least=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    return [(a, b) for a in sets for b in sets if b < a and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def edited(rng, words, n):
    out = words.copy()
    for k in rng.sample(range(len(out)), n):
        out[k] = f"e{rng.random()}"
    return out


def test_groups_match_brute_force(documents, rows_of):
    """Copies at every distance from a text, chains of them, a group whose smallest id is near few, short and odd texts."""
    rng = random.Random(4)
    texts, n = {}, 0
    for _ in range(12):
        now = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        for k in range(8):
            texts[n := n + 1] = " ".join(edited(rng, now, k))
        for _ in range(4):
            now = edited(rng, now, 2)
            texts[n := n + 1] = " ".join(now)
    for t in ("a b", "A  B", "a b c", "", " ", None, "und " * 50, "und " * 90):
        texts[n := n + 1] = t
    order = list(texts)
    rng.shuffle(order)
    texts = dict(zip(order, texts.values(), strict=True))
    want = reachable(similar(texts), texts)
    assert len(set(want.values())) < len(texts) - 50
    assert rows_of(similar_groups(documents([*texts.items(), (None, texts[1])]))) == sorted([*want.items(), (None, None)], key=repr)
    assert similar_groups(documents([])).count() == 0


def test_stage_drops_near_copies_beyond_three_bits(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = reachable(similar(texts), texts)
    left = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect())
    assert left == sorted(i for i in texts if want[i] == i)
    assert not {145, 177} & set(left)


def test_stage_takes_fingerprints_first_and_verifies_them(spark, documents, rows_of, monkeypatch):
    """Pairs at three bits are candidates whether or not bands meet; a candidate that isn't similar links nothing."""
    rng = random.Random(9)
    texts = {}
    for g in range(6):
        words = [f"w{rng.randrange(9000)}" for _ in range(500)]
        texts |= {10 * g + k: " ".join(edited(rng, words, min(k, 1)) if k < 3 else edited(rng, words, 400)) for k in range(4)}
    texts |= {100: "", 101: None, 102: "  "}
    marks = {r.doc_id: r.fp & (1 << 64) - 1 for r in fingerprints(documents(texts.items()), words=5).collect()}
    near = [(a, b) for a in marks for b in marks if b < a < 100 and (marks[a] ^ marks[b]).bit_count() <= 3]
    pairs = near_prints(documents(texts.items()))
    assert len(near) >= 6 and reachable([(r.a, r.b) for r in pairs.collect()], texts) == reachable(near, texts)
    false = spark.createDataFrame([(13, 3)], "a long, b long")
    got = dict(rows_of(similar_groups(documents(texts.items()), miss=0.99, candidates=pairs.unionByName(false))))
    assert all(got[a] == got[b] for a, b in near) and got[13] == 13 and got[3] == 3
    asked = []
    monkeypatch.setattr(simhash_dedup, "near_prints", lambda *a, **k: asked.append(1) or near_prints(*a, **k))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(texts.items()), FOLDER).collect()}
    assert asked and left == {i for i in texts if i >= 100 or i % 10 in (0, 3)}
