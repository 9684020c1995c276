"""Cited sentences and their precision, the recognition probe, and streams that go on from a checkpoint."""

import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.functions.sentences import split_sentences
from factloom.operators import chunks as C
from factloom.operators import precision as PR
from factloom.operators import recognition as RE
from factloom.operators.completion import complete
from factloom.plans.articles import letter_embedder
from factloom.plans.runs import longest_completer
from factloom.streaming import runs as SR
from factloom.streaming import twins as ST

ARTICLES = [
    (1, "One fact [F1]. Another [F2, f3] one, Dr. Who said. [F4]\n\n# Heading [F9]\n- a bullet [F5]\n```\ncode. Not A sentence.\n```\nUncited text! (see [F6] ) Really [F7] ?"),
    (2, " ".join(f"Sentence number {k} is here [F{k}]." for k in range(170))), (3, "[F1]\n\n[F2]."), (4, None), (5, ""), (6, "No marks. At all."),
]


def stripped(s):
    s = re.sub(r"\[[Ff]\d+(?:\s*,\s*[Ff]?\d+)*\]", "", s)
    while True:
        t = s
        for a, b in (("  ", " "), (" .", "."), (" ,", ","), (" ;", ";"), (" :", ":"), (" !", "!"), (" ?", "?"), (" )", ")"), ("( ", "(")):
            t = t.replace(a, b)
        if t == s:
            return s.strip()
        s = t


@pytest.fixture
def sentences(spark):
    return PR.cited_sentences(spark.createDataFrame(ARTICLES, "doc_id int, text string"))


def test_every_sentence_stays_without_its_marks(sentences):
    got = {}
    for r in sorted(sentences.collect(), key=lambda r: (r.doc_id, r["index"])):
        got.setdefault(r.doc_id, []).append((r["index"], r.sentence, r.fact_ids))
    for i, text in ARTICLES:
        raw = [(stripped(s), sorted({int(x) for m in re.findall(r"\[[Ff]\d[^\]]*\]", s) for x in re.findall(r"\d+", m)})) for s in split_sentences(text)]
        assert got.get(i, []) == [(k + 1, s, ids) for k, (s, ids) in enumerate(x for x in raw if x[0])]
    assert 4 not in got and 5 not in got and len(got[2]) == 170


@pytest.mark.parametrize("kind", ["whole", "malformed", "twice", "missing", "extra"])
def test_a_batch_counts_only_with_its_own_indexes(spark, sentences, kind):
    def judge(prompt):
        lines = prompt.rpartition(PR.SENTENCES)[2].split("\n")
        numbers = [int(x.split(".")[0]) for x in lines]
        verdicts = [{"index": n, "supported": n % 2 == 0, "reason": f" no {n} "} for n in numbers]
        if numbers[0] == 81:  # the second batch of the long article
            if kind == "malformed":
                return '{"verdict": []}'
            verdicts = {"whole": verdicts, "twice": verdicts + verdicts[:1], "missing": verdicts[1:], "extra": [*verdicts, {"index": 161, "supported": True}]}[kind]
        return "verdict: " + json.dumps({"verdicts": verdicts})

    facts = spark.createDataFrame([(1, "facts of one"), (2, None)], "doc_id int, facts string")
    rows = {(r.doc_id, r["index"]): r for r in PR.judged_sentences(sentences, facts, lambda p: complete(p, judge)).collect()}
    assert len(rows) == sentences.count()
    for (i, n), r in rows.items():
        bad = kind != "whole" and i == 2 and 81 <= n <= 160
        assert r.supported == (n % 2 == 0 and not bad)
        assert r.reason == (None if r.supported else (PR.MALFORMED if kind == "malformed" else PR.WRONG_SET) if bad else f"no {n}")
    found = {r.doc_id: (r.sentences, r.supported) for r in PR.precision(PR.judged_sentences(sentences, facts, lambda p: complete(p, judge))).collect()}
    assert found[2] == (170, 85 if kind == "whole" else 45)


def test_a_failed_call_is_an_error_not_a_lower_precision(spark, sentences):
    def down(prompt):
        raise ValueError("down")

    with pytest.raises(Exception, match="precision call failed"):
        PR.judged_sentences(sentences, spark.createDataFrame([], "doc_id int, facts string"), lambda p: complete(p, down, attempts=1)).collect()


def test_trials_show_the_own_text_once_among_others(spark):
    entries = spark.createDataFrame([("f", f"n{k}", f"headline {k}\ntext of n{k}.") for k in range(6)] + [("g", "n0", "h\na"), ("g", "n1", "h\nb")], "field string, name string, text string")
    judges = spark.createDataFrame([("f", "n0"), ("f", "n1"), ("g", "n0"), ("f", "stranger")], "field string, judge string")
    drawn = RE.drawn_trials(entries, judges, trials=200).collect()
    assert len(drawn) == 600 and all(r.prompt is None for r in drawn if r.field == "g")
    slots, others = Counter(), Counter()
    for r in (r for r in drawn if r.field == "f"):
        texts = [p.partition("]\n")[2].strip() for p in r.prompt.split("\n[")[1:]]
        assert len(set(texts)) == 4 and texts[r.slot] == f"text of {r.judge}." and "headline" not in r.prompt
        slots[r.slot] += 1
        others.update(t for t in texts if t != f"text of {r.judge}.")
    assert min(slots.values()) > 60 and max(slots.values()) < 140 and max(others.values()) < 1.4 * min(n for t, n in others.items() if t not in ("text of n0.", "text of n1."))
    assert {(r.judge, r.trial, r.slot, r.prompt) for r in RE.drawn_trials(entries.repartition(3), judges, trials=200).collect()} == {(r.judge, r.trial, r.slot, r.prompt) for r in drawn}


def test_tasks_of_recognition_follow_the_pairs(spark):
    """A field of many pairs has its judges dealt to several tasks, and many small fields are dealt too; the draws stay the same."""
    rows = [("wide", f"n{k}", f"text {k}") for k in range(60)] + [(f"f{g}", f"n{k}", f"text {g} {k}") for g in range(40) for k in range(5)]
    entries = spark.createDataFrame(rows, "field string, name string, text string").coalesce(1)
    judges = entries.select("field", F.col("name").alias("judge"))
    few, many = RE.drawn_trials(entries, judges), RE.drawn_trials(entries, judges, task_bytes=1 << 16)
    said = lambda df: sorted(tuple(r) for r in df.collect())
    assert said(few) == said(many) and many.count() == 8 * 260
    placed = many.withColumn("task", F.spark_partition_id()).groupBy((F.col("field") == "wide").alias("wide"), "task").count().groupBy("wide").agg(F.count("*").alias("tasks"), F.max("count").alias("most")).collect()
    assert all(r.tasks > 8 and r.most < (480 if r.wide else 1600) / 4 for r in placed)


def test_recognition_is_held_against_chance(spark):
    entries = spark.createDataFrame([("f", f"n{k}", "h\n" + "t" * (k + 1)) for k in range(6)], "field string, name string, text string")
    judges = spark.createDataFrame([("f", "n5"), ("f", "n0"), ("f", "gone")], "field string, judge string")

    def completer_of(name):
        def fails(prompt):
            raise ValueError("down")

        return fails if name == "n0" else longest_completer(name)

    got = {r.judge: (r.trials, r.hits, r.accuracy, r.chance, r.above_chance) for r in RE.recognition(entries, judges, completer_of).collect()}
    assert got == {"n5": (8, 8, 1.0, 0.25, True), "n0": (8, 0, 0.0, 0.25, False), "gone": (0, 0, 0.0, 0.25, False)}


@pytest.fixture
def rocks(spark):
    for k, v in SR.ROCKS.items():
        spark.conf.set(k, v)
    yield
    for k in SR.ROCKS:
        spark.conf.unset(k)


def test_a_stream_goes_on_from_its_checkpoint(spark, rocks, tmp_path):
    rows = [(a, r, f"2024-01-01 00:{r:02d}:00", c) for r, (a, c) in enumerate([(1, 5), (1, 4), (2, 9), (1, 3), (1, 1), (2, 2), (2, 1), (1, 1)])]
    df = spark.createDataFrame(rows, "account long, request long, ts string, cost long").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("request < 4").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: SR.granted_requests(SR.stream_of(spark, f"{tmp_path}/in", files_per_batch=1), 10)
    first = {r.request: r.granted for r in SR.drained(stream(), "append", f"{tmp_path}/run").collect()}
    assert first == {0: True, 1: True, 2: True, 3: False}
    df.where("request >= 4").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    both = SR.drained(stream(), "append", f"{tmp_path}/run").collect()
    assert {r.request: r.granted for r in both} == {**first, 4: True, 5: False, 6: True, 7: False} and len(both) == 8
    assert {r.request: r.spent for r in both}[7] == 10 and len({r.batch for r in both}) == 2


def test_totals_and_seen_facts_go_on_too(spark, tmp_path):
    rows = [("a", "- Same  fact."), ("a", "- same fact"), ("b", "- other")]
    spark.createDataFrame(rows, "stage string, bullet string").write.parquet(f"{tmp_path}/in")
    read = lambda: SR.stream_of(spark, f"{tmp_path}/in").withColumns({"prompt_tokens": F.lit(2), "output_tokens": F.lit(1)})
    assert SR.drained(SR.seen_facts(read()), "append", f"{tmp_path}/seen").count() == 2
    assert {r.stage: r.calls for r in SR.drained(ST.running_tokens(read()), "complete", f"{tmp_path}/sum").collect()} == {"a": 2, "b": 1}
    spark.createDataFrame([("b", "- SAME fact"), ("c", "- new")], "stage string, bullet string").write.mode("append").parquet(f"{tmp_path}/in")
    assert SR.drained(SR.seen_facts(read()), "append", f"{tmp_path}/seen").count() == 3
    assert {r.stage: (r.calls, r.prompt_tokens) for r in SR.drained(ST.running_tokens(read()), "complete", f"{tmp_path}/sum").collect()} == {"a": (2, 4), "b": (2, 4), "c": (1, 2)}


def plain_segments(paragraphs, near, breaks, least, most):
    """Segments as lists of paragraph numbers, joined and cut one at a time, sizes measured on joined text."""
    segments = []
    for k in range(len(paragraphs)):
        segments.append([k]) if k == 0 or breaks[k] else segments[-1].append(k)
    size = lambda s: len("\n".join(paragraphs[k] for k in s))
    while len(segments) > 1 and (small := [k for k, s in enumerate(segments) if size(s) < least]):
        k = small[0]
        left, right = (near[segments[k][0]] if k else None), (near[segments[k + 1][0]] if k + 1 < len(segments) else None)
        k -= right is None or (left is not None and left >= right)
        segments[k : k + 2] = [segments[k] + segments[k + 1]]
    while large := [k for k, s in enumerate(segments) if size(s) > most and len(s) > 1]:
        s = segments[large[0]]
        at = min(range(1, len(s)), key=lambda i: near[s[i]])
        segments[large[0] : large[0] + 1] = [s[:at], s[at:]]
    return [n for n, s in enumerate(segments) for _ in s]


def test_segment_sizes_are_put_right():
    rng = random.Random(8)
    for _ in range(400):
        n = rng.randrange(1, 14)
        paragraphs = ["x" * rng.randrange(0, 40) for _ in range(n)]
        near = [-1.0] + [rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]) for _ in range(n - 1)]
        breaks, least, most = [1] + [int(x < 0.4) for x in near[1:]], rng.choice([0, 20, 60]), rng.choice([30, 80, 10_000])
        assert C.constrained([len(p) for p in paragraphs], near, breaks, least, most) == plain_segments(paragraphs, near, breaks, least, most)


def test_semantic_chunks_join_to_the_text_and_end_where_it_changes(spark):
    texts = [(1, "\n".join(["aaa bbb aaa"] * 4 + ["xyz zyx xyz"] * 4)), (2, None), (3, "one"), (4, "aaa\nzzz\naaa\nzzz")]
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    got = {}
    for r in C.semantic_chunks(docs, letter_embedder, least=0, most=1000, width=0, threshold=0.5).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [2, 1, 1, 4] and all("\n".join(got[i]) == (t or "") for i, t in texts)
    small = C.semantic_chunks(docs, letter_embedder, least=5, most=15, width=0, threshold=0.5).where("doc_id in (1, 4)").collect()
    assert all(r.characters <= 15 for r in small) and all(r.characters >= 5 for r in small if r.doc_id == 4)

    def down(batch):
        raise ValueError("no embeddings")

    with pytest.raises(Exception, match="no embeddings"):
        C.semantic_chunks(docs, down).collect()


def test_cited_sentences_are_numbered_without_a_shuffle(spark):
    from factloom.operators.precision import cited_sentences

    docs = spark.createDataFrame([(1, "It is so [F2]. [F3]\n\n[F1, 22]\n\nAnd so [F4]."), (2, None), (3, "")], "doc_id long, text string")
    got = cited_sentences(docs)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("doc_id", "index").collect()
    assert [r["index"] for r in rows] == list(range(1, len(rows) + 1)) and {r.doc_id for r in rows} == {1} and all(r.sentence for r in rows)
