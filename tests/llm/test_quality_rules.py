import random
import re
from collections import Counter

import duckdb
import pytest

from factloom.llm import quality_rules, queries
from factloom.llm.quality_rules import RULES, Model, Rule, estimated, measured, quality_votes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, covered = Counter(zip(words, words[1:], words[2:])), set()
    for k in range(len(words) - 2):
        if seen[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


ODD = [
    None, "", " \n\t ", "one", "a b", "a b c", "a b c a b c", "a a a", "a a a a", "a b c d a b c", "x\n x\nx\n\nx", "  lead\n  lead", "é 😀 é 😀 é 😀", "#*$%&|<> # word", "a b c d",
    "\x0b\x0c\r\n a \r b", "the same line\n" * 40, "w " * 3000,
]


@pytest.mark.parametrize("bits", [24, 8, 3])
def test_counts_match_a_plain_version(documents, monkeypatch, bits):
    """With few bits, texts have more words than places, or windows that share a hash."""
    monkeypatch.setattr(quality_rules, "PLACE_BITS", bits if bits != 24 else 24)
    random.seed(2)
    texts = ODD + [" ".join(random.choice("abcde") for _ in range(random.randrange(120))) for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:6] for r in measured(documents(list(enumerate(texts)))).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_windows_that_share_a_hash_are_told_apart(documents, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 62)  # two bits of hash: every text has clashes
    random.seed(3)
    texts = [" ".join(random.choice("abcdefg") for _ in range(n)) for n in range(3, 90)]
    got = {r.doc_id: r.n_repeat_words for r in measured(documents(list(enumerate(texts)))).collect()}
    assert got == {i: counts(t)[4] for i, t in enumerate(texts)}


def test_em_finds_the_accuracies_that_votes_were_drawn_by():
    random.seed(1)
    good, bad = (0.97, 0.9, 0.99, 0.8), (0.7, 0.5, 0.3, 0.6)
    patterns, truth = Counter(), []
    for _ in range(20_000):
        y = random.random() < 0.75
        votes = tuple(0 if random.random() < 0.1 else (1 if random.random() < (good[j] if y else 1 - bad[j]) else -1) for j in range(4))
        patterns[votes] += 1
        truth.append((y, votes))
    model = estimated(sorted(patterns.items()), 4, rounds=200)
    assert abs(model.share - 0.75) < 0.06
    assert all(abs(a - b) < 0.06 for a, b in zip(model.on_good, good, strict=True)) and all(abs(a - b) < 0.12 for a, b in zip(model.on_bad, bad, strict=True))
    right = sum((model.probability(v) >= 0.5) == y for y, v in truth) / len(truth)
    best = sum((Model(0.75, good, bad).probability(v) >= 0.5) == y for y, v in truth) / len(truth)
    assert right > best - 0.01


def prose(k, n=80):
    random.seed(k)
    return ". ".join(" ".join(random.choice(["the", "and", "of"]) if random.random() < 0.3 else "".join(random.choice("abcdeinorst") for _ in range(random.randrange(3, 9))) for _ in range(8)).capitalize() for _ in range(n // 8))


def test_votes_replace_the_filter(documents):
    rows = [(k, prose(k)) for k in range(150)]
    rows += [(200 + k, " ".join(w + "###" for w in prose(k).replace("the", "zha").split())) for k in range(20)]
    rows += [(300 + k, prose(k).upper().replace(" ", "!! ")) for k in range(20)]
    rows += [(400 + k, prose(k) + " # ## # * | & $ % #") for k in range(10)]  # one doubtful measure
    rows += [(500, None), (None, prose(999)), (501, "short"), (502, "same three words " * 200), (7, prose(7))]
    out = {r.doc_id: r for r in quality_votes(documents(rows)).collect()}
    assert all(out[k].kept for k in [*range(150), *range(400, 410), None])
    assert not any(out[k].kept for k in [*range(200, 220), *range(300, 320), 500, 501, 502])
    assert out[500].base_failed and out[501].base_failed and out[502].base_failed and not out[200].base_failed
    assert all(0 <= r.posterior <= 1 for r in out.values()) and quality_votes(documents(rows)).count() == len(rows)
    assert quality_votes(documents([])).count() == 0


def test_no_python_on_the_main_path(documents):
    plan = quality_votes(documents([(1, "a b c")]))._jdf.queryExecution().toString() + measured(documents([(1, "a b c")]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_a_corpus_without_faults_keeps_all(documents):
    out = quality_votes(documents([(k, prose(k)) for k in range(40)])).collect()
    assert all(r.kept for r in out)


def test_a_rule_votes_between_its_limits_or_not():
    assert estimated([], len(RULES)).share == 0.8
    assert [r.measure for r in RULES] == ["symbols", "repeated_words", "repeated_lines", "capitals", "common_words", "odd_length"]
    assert "ELSE 0" in str(Rule("x", 1, 2).vote()) or Rule("x", 1, 2).good < 2


def test_the_sql_says_the_same(spark, documents, tmp_path):
    rows = [(k, prose(k)) for k in range(60)] + [(100 + k, t) for k, t in enumerate(ODD)] + [(200 + k, prose(k).upper()) for k in range(9)] + [(None, prose(5)), (3, prose(3))]
    documents(rows).select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    found = queries.op12_quality_rules(spark, str(tmp_path)).select(names).collect()
    want = c.sql(f"SELECT {', '.join(names)} FROM ({queries.SQL['op12_quality_rules']})").fetchall()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
