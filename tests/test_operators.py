import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.text import hash_key
from factloom.operators import blocks as B
from factloom.operators import chunks as C
from factloom.operators import completion as CO
from factloom.operators import facts as FA
from factloom.operators import pipeline as P
from factloom.operators import structured as S
from factloom.operators import tournament as T
from factloom.operators import transcripts as TR
from factloom.operators import vectors as V


def test_bullets_with_continuations(spark):
    docs = spark.createDataFrame([(1, "x\n- a\n  more\n- b\n\n  stray\n* c"), (2, ""), (3, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.fact_no, r.bullet) for r in FA.bullet_entries(docs).collect())
    assert got == [(1, 1, "- a\n  more"), (1, 2, "- b"), (1, 3, "* c")]


def test_exact_facts_go_and_near_ones_are_flagged(spark):
    base = "the probe was launched in nineteen seventy seven from the cape by nasa engineers on a titan rocket"
    rows = [(1, 0, f"- {base}"), (1, 1, f"- {base.upper()}!"), (1, 2, f"- {base} today"), (1, 3, "- something else that shares no words with it"), (2, 0, f"- {base} today"), (1, 4, "...")]
    kept = FA.dedup_facts(spark.createDataFrame(rows, "doc_id int, n int, bullet string"), "doc_id", ["n"])
    got = {(r.doc_id, r.n): r.near_dup for r in FA.flag_near_duplicates(kept, "doc_id", "n").collect()}
    assert got == {(1, 0): False, (1, 2): True, (1, 3): False, (2, 0): False, (1, 4): False}


def test_near_flags_match_a_plain_loop():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    tokens = [[rng.choice(words) for _ in range(rng.randrange(3, 14))] for _ in range(300)]
    tokens += [t[:-1] + ["x"] for t in tokens[:150]]
    bits = np.array([FA._simhash(t) for t in tokens], np.int64).view(np.uint64)
    want = []
    for i, b in enumerate(tokens):
        near = False
        for j in range(i):
            a = tokens[j]
            if len(a) >= 5 and len(b) >= 5 and bin(int(bits[i]) ^ int(bits[j])).count("1") <= 10:
                near |= sum(t in a for t in b) / min(len(a), len(b)) >= 0.72
        want.append(near)
    assert FA.near_earlier(tokens, bits, block=64).tolist() == want


def test_routing_orphans_and_titles(spark):
    sections = spark.createDataFrame([(1, 1, "A!", [3, 1]), (1, 2, "B", [1, 2]), (1, 3, "a", [9])], "doc_id int, section int, title string, fact_ids array<int>")
    routed = FA.route_facts(sections, "doc_id")
    assert sorted((r.fact_id, r.section) for r in routed.collect()) == [(1, 1), (2, 2), (3, 1), (9, 3)]
    units = spark.createDataFrame([(1, k) for k in (1, 2, 5)], "doc_id int, fact_id int")
    assert [r.fact_id for r in FA.orphans(units, routed, "doc_id").collect()] == [5]
    assert sorted((r.section, r.title, r.fact_ids) for r in FA.merge_titles(sections, "doc_id").collect()) == [(1, "A!", [3, 1, 9]), (2, "B", [1, 2])]


@pytest.mark.parametrize("size", [7, 20, 1000])
def test_packing_is_lossless(spark, size):
    rows = [(1, "é漢字🙂\n" * 5 + "tail"), (2, ""), (3, None), (4, "x" * 50), (5, "\n\n\r\na")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    chunks = C.pack_documents(docs, size)
    assert C.covers(docs, chunks).count() == 0
    assert chunks.agg(F.max("characters")).first()[0] <= size
    fragments = docs.select("doc_id", C.bounded_fragments(F.col("text"), size).alias("f")).collect()
    assert all("".join(r.f or []) == (dict(rows)[r.doc_id] or "") for r in fragments)


def test_headings_lead_chunks_outside_fences(spark):
    text = "intro\n\n# One\na\n\n```\n# no\n```\n## Two\nb\n"
    rows = C.heading_chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_no").collect()
    assert [r.text for r in rows] == ["intro", "# One\na\n\n```\n# no\n```", "## Two\nb"]
    assert [r.line for r in C.heading_skeleton(spark.createDataFrame([(1, text)], "doc_id int, text string"), 1).collect()] == ["# One"]


def test_sentence_chunks_and_token_limit():
    assert C.sentence_chunks("One is. Two is. Three is.", 15) == ["One is. Two is.", "Three is."]
    parts = C.limit_tokens(["a b c d e f g h", "xxxxxxxxxxxx"], 4, len)
    assert "".join(parts) == "a b c d e f g hxxxxxxxxxxxx" and max(map(len, parts)) <= 4


def test_overlap_and_breaks(spark):
    chunks = spark.createDataFrame([(1, 1, "abc"), (1, 2, "def"), (2, 1, "x")], "doc_id int, chunk_no int, text string")
    assert sorted(r.text for r in C.with_overlap(chunks, 2).collect()) == ["abc", "bcdef", "x"]
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate([None, 0.9, 0.1, 0.9])], "g int, k int, s double")
    assert [r.part for r in C.semantic_breaks(rows, "g", "k", F.col("s"), width=0).orderBy("k").collect()] == [1, 1, 2, 2]


VTT = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c> [music] there\n\n00:00:02.000 --> 00:00:03.000\nhello there\nthere my friend\n\n00:00:09.000 --> 00:00:10.000\nNext part"


def test_transcripts():
    assert TR.clean(VTT) == "Hello there my friend\n\nNext part"
    assert TR.clean("plain prose, as it was") == "plain prose, as it was"
    assert TR.kind_of("1\n00:00:01,000 --> 00:00:02,000\nhi") == "srt"
    log = "[youtube] a: b\n[info] c\n[download] 100% of 1.2MiB in 00:01 at 3.0MiB/s Welcome to it\nmore"
    assert TR.kind_of(log) == "log" and TR.clean(log) == "Welcome to it\nmore"
    assert TR.kind_of("[youtube] only one\nprose") == "none"
    assert TR.joined("so we begin", "We begin now") == "so we begin now" and TR.joined("a b", "c d") is None


def test_blocks():
    text = "| a | b |\n|---|---|\n| 1 | 2 |\n\n```\n| no | x |\n|---|---|\n```\nRun #1\nK: v\nrun 2\nK: w\nRun #3\nK: x\nL: y\n<table><tr><td>c|d</td></tr></table>"
    kinds = [(b.kind, b.title, b.confidence) for b in B.extract(text)]
    assert kinds == [(0, "Table 1", 1.0), (2, "Run", 0.67), (1, "Table 1", 1.0)]
    assert B.extract(text)[2].markdown == "| c\\|d |\n| --- |"
    twice = B.extract("<table><tr><td>x</td></tr></table><TABLE><tr><td>y</td></tr></TABLE>")
    assert [b.markdown for b in twice] == ["| x |\n| --- |"]  # the second has no place
    assert B.extract("") == [] and B.record_series("A 1\nK: v\nA 2\nK: v") == []


def test_markdown_tables_in_frames_match_those_of_one_text(spark):
    texts = ["| a |\n|---|\n| 1 |\n| 2 |\nx\n| h |\n| h2 |\n|:-:|\n", "```\n| a |\n|---|\n```", "| a |\n| b |", "|---|\n|---|\n| x |", ""]
    rows = B.markdown_tables(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "table_no").collect()
    assert [(r.doc_id, r.markdown) for r in rows] == [(k, b.markdown) for k, t in enumerate(texts) for b in B.markdown_blocks(t)]


SCHEMA = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "string"}, "n": {"type": "number", "evaluation_config": {"metrics": [{"metric_id": "number_tolerance", "params": {"tolerance": 0.1}}]}}, "u": {"type": "string", "format": "uri"}, "l": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "boolean"}}}
GOLD = {"a": "x", "n": 1.0, "u": "https://www.e.org/p/", "l": [1, 2, 2], "b": True}


def test_structured_scores():
    good = S.score(SCHEMA, GOLD, '{"a":"x","n":1.05,"u":"http://e.org/p","l":[2,1,3],"b":true}')
    assert not good["errors"] and good["field_score"] == pytest.approx((4 + 2 / 3) / 5) and good["item_score"] == pytest.approx((4 + 2) / 7)
    extra = S.score(SCHEMA, GOLD, '{"a":"x","zz":1}')
    assert extra["errors"] == ["$/zz: unexpected field"] and extra["field_score"] == 0 and extra["fields"][0]["passed"]
    assert S.score(SCHEMA, GOLD, "not json")["errors"][0] == "prediction is invalid JSON"
    assert S.score({"type": "array"}, [], "[]")["field_score"] == 0
    assert S.last_object('x {"a": "}"} y {"b": {"c": 1}} {') == '{"b": {"c": 1}}' and S.last_object("{") == ""


def test_merge_sort_with_judges():
    names = [f"n{k:02}" for k in range(11)]
    rng = random.Random(4)
    assert T.merge_sort(rng.sample(names, 11), min) == names
    assert T.merge_sort(["b", "a"], lambda a, b: None) == ["b", "a"]
    asked = []
    T.merge_sort(names, lambda a, b: asked.append((a, b)) or a)
    assert len({tuple(sorted(p)) for p in asked}) == len(asked) <= 11 * 4


def test_compare_flips_and_errors(spark):
    forward = spark.createDataFrame([("a", "b", "a"), ("a", "c", "a"), ("b", "c", None)], "a string, b string, winner string")
    backward = spark.createDataFrame([("b", "a", "a"), ("c", "a", "c"), ("c", "b", "b")], "a string, b string, winner string")
    edges = T.compare(forward, backward)
    assert sorted((r.a, r.b, r.winner, r.flip, r.error) for r in edges.collect()) == [("a", "b", "a", False, False), ("a", "c", None, True, False), ("b", "c", None, False, True)]
    assert sorted(tuple(r) for r in T.records(edges).collect()) == [("a", 1, 0, 1), ("b", 0, 1, 0), ("c", 0, 0, 1)]


def test_cycles(spark):
    ring = spark.createDataFrame([("a", "b", "a", False, False), ("b", "c", "b", False, False), ("a", "c", "c", False, False), ("a", "d", "a", False, False), ("b", "d", "b", False, False)], "a string, b string, winner string, flip boolean, error boolean")
    assert sorted(tuple(r) for r in T.triples(ring).collect()) == [("a", "b", "c", True), ("a", "b", "d", False)]


def test_judges_and_known_hashes(spark):
    df = spark.createDataFrame([("",), ("a",), ("foobar",)], "t string").select(T.fnv1a_32("t").alias("h"))
    assert [r.h for r in df.collect()] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    pairs = T.assign_judges(spark.createDataFrame([("a", "b"), ("x", "y")], "a string, b string"), ["a", "b"])
    assert {r.a: r.judge for r in pairs.collect()}["a"] == "a"


def test_trials_and_degradations():
    for _, slots, own in T.recognition_trials("j", ["j", "k", "l", "m", "n"]):
        assert slots[own] == "j" and len(set(slots)) == 4
    assert T.degrade("truncate", "a b c d") == "a" and T.degrade("shuffle", "a\n\nb") == "b\n\na"
    assert T.degrade("shuffle", " a\n \t\nb\n\n\nc ") == "c\n\nb\n\na" and T.degrade("truncate", "one two") == "one two" and T.degrade("truncate", "") == ""
    assert T.degrade("listify", 'He said "no." Then 5.4 (why?) left') == '- He said "no."\n- Then 5.4 (why?)\n- left\n' and T.degrade("drop_ends", "A is. B is.") == "A is. B is."
    assert T.degrade("filler", "Ab.\n\n Cd.") == "It is important to note that, at the end of the day, ab.\n\nIn today's fast-paced world, one simply cannot deny that cd."
    assert T.degrade("drop_ends", "A is. B is. C is.") == "B is." and T.degrade("reverse_sentences", "A is. B is.") == "B is. A is."
    assert len(T.draw_triples(list("abcd"), 12)) == 12 and T.draw_triples(list("ab"), 3) == []


def test_clusters_and_choice():
    v = np.array([[1, 0], [0.99, 0.05], [0, 1], [0.04, 1]])
    assert V.linked(v, 0.9).tolist() == [0, 0, 2, 2] == V.linked(v, 0.9, block=1).tolist()
    chain = np.array([[np.cos(a), np.sin(a)] for a in np.linspace(0, 3, 40)])
    assert set(V.linked(chain, 0.99, block=7)) == {0}
    assert V.coalesce(list(v), [5, 1, 5, 5], 3) == [[0, 1], [2], [3]]
    assert V.agglomerate(list(v), [1, 1, 1, 1], 2) == [[0, 1], [2, 3]]
    assert V.representatives(v, 2) == [0, 2] or V.representatives(v, 2) == [1, 3] or len(V.representatives(v, 2)) == 2
    assert V.representatives(v, 9) == [0, 1, 2, 3]


def test_greedy_choice_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 5))
    u = V.unit(v)
    best, chosen = np.zeros(30), []
    for _ in range(6):
        gains = [sum(max(0, u[i] @ u[c] - best[i]) for i in range(30)) if c not in chosen else -1 for c in range(30)]
        pick = int(np.argmax(gains))
        chosen.append(pick)
        best = np.maximum(best, u @ u[pick])
    assert V.representatives(v, 6) == sorted(chosen)


def test_completion_retries_falls_back_and_reuses(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad")], "k int, prompt string")
    known = prompts.where("k = 2").select(hash_key(F.col("prompt")).alias("prompt_sha"), F.lit("old").alias("reply"))
    got = CO.complete(prompts, lambda p: "" if p == "bad" else p.upper(), known, attempts=2, fallback=lambda p: "fb").collect()
    assert sorted((r.k, r.reply, r.attempts, r.route) for r in got) == [(1, "A", 1, "primary"), (2, "old", 0, "cached"), (3, "A", 1, "primary"), (4, "fb", 3, "fallback")]
    assert CO.attempt(lambda p: 1 / 0, "x", bool, 2, None, 0) == (None, 2, "ZeroDivisionError")


def test_embedding_count_is_checked(spark):
    df = spark.createDataFrame([(k, "t" * k) for k in range(5)], "k int, text string")
    assert [len(r.embedding) for r in CO.embed(df, lambda ts: [[float(len(t))] for t in ts], batch=2).collect()] == [1] * 5
    with pytest.raises(Exception, match="vectors for"):
        CO.embed(df, lambda ts: []).collect()


def test_call_plan_of_eleven_chunks(spark):
    r = CO.call_plan(spark.createDataFrame([(1, 11)], "doc_id int, chunks long"), edit=True, attempts=3, limit=36).first()
    assert (r.mandatory, r.section_cap, r.headroom, r.rejected) == (34, 11, 2, False)


def test_templates_and_climbing():
    assert CO.render("{{a}} {{b}} {{c}}", {"a": "{{b}}", "b": "2"}) == "{{b}} 2 {{c}}"
    assert CO.valid_prompt("{{source}} {{facts}}") and not CO.valid_prompt("{{source}}")
    assert CO.hill_climb("abc", lambda p: 1.0, [lambda p: p[:-1], lambda p: p + "x"], 4) == ("a", 1.0)


def test_outlines_and_assignment(spark):
    text = "# T\nx\n## A\none\nFacts: F1, F2\n##  \nlost\n## B\nfact: F2, F9"
    sections = P.parse_outlines(spark.createDataFrame([(1, text)], "doc_id int, reply string"))
    assert sorted((r.section, r.title, r.intent, r.fact_ids, r.headline) for r in sections.collect()) == [(1, "A", "one ## lost", [1, 2], "T"), (2, "B", "", [2, 9], "T")]
    units = spark.createDataFrame([(1, k) for k in (1, 2, 3)], "doc_id int, fact_id int")
    assert sorted((r.section, r.fact_ids) for r in P.assign(units, sections).collect()) == [(1, [1, 2]), (3, [3])]
    bare = P.parse_outlines(spark.createDataFrame([(1, "# T\n## A\n## B")], "doc_id int, reply string"))
    assert sorted((r.section, r.fact_ids) for r in P.assign(units, bare).collect()) == [(1, [1, 2, 3]), (2, [1, 2, 3])]


def test_merge_refuses_lost_ids(spark):
    facts = spark.createDataFrame([(1, 1, "a", 1), (1, 2, "b", 1), (1, 3, "c", 3), (2, 1, "d", 1), (2, 2, "e", 1)], "doc_id int, fact_id int, bullet string, cluster int")
    got = P.merge_facts(facts, lambda p: "one [F1] [F2]" if p.startswith("a") else "one [F1]").collect()
    assert sorted((r.doc_id, r.fact_id, r.bullet) for r in got) == [(1, 1, "one [F1] [F2]"), (1, 3, "c"), (2, 1, "d"), (2, 2, "e")]


def test_repair_and_prior(spark):
    before = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.5), (3, "c", 0.5)], "doc_id int, text string, coverage double")
    after = spark.createDataFrame([(1, "A", 0.6), (2, "B", 0.5)], "doc_id int, text string, coverage double")
    assert sorted(r.text for r in P.repaired(before, after, "doc_id").collect()) == ["A", "b", "c"]
    assert sorted(r.text for r in P.repaired(before, after, "doc_id", strict=False).collect()) == ["A", "B", "c"]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "z")], "doc_id int, section int, body string")
    assert [r.prior for r in P.prior_sections(rows).orderBy("section").collect()] == ["", "x", "x\n\ny"]


def test_places_of_blocks_are_in_bytes():
    """A table in front of which, and in which, characters take several bytes; both kinds of table stay."""
    front = "é" * 31 + "\n"
    text = f"{front}| ä | b |\n|---|---|\n| 1 | 2 |\n<table><tr><td>ü</td></tr></table> é <table><tr><td>y</td></tr></table>"
    found = [(b.kind, b.start) for b in B.extract(text)]
    assert found == [(0, 63), *((1, len(text[:k].encode())) for k in (text.index("<table"), text.rindex("<table")))]


def test_facts_match_a_plain_version(spark):
    """Anchors by the regular expression of their boundaries, facts by their definition, in one block and in several."""
    import random
    import re

    from factloom.functions.text import token_pattern
    from factloom.operators import matching as MA

    rng = random.Random(4)
    word = lambda: rng.choice(["a", "ab", "3", "3.5", "1,234", "35", "é", "-", "b.", "x y", "", "B"])
    facts = [(k, [word() for _ in range(rng.randrange(3))], [[word() for _ in range(rng.randrange(1, 3))] for _ in range(rng.randrange(3))]) for k in range(40)]
    texts = [(k, " ".join(rng.choices(["a", "ab", "abc", "3", "3.5", "35.1", "1,234", "é", "b.", "X  y", ".3", "a3"], k=rng.randrange(9))) if k else None) for k in range(30)]
    norm = lambda t: MA._prepared(t or "")[0]
    has = lambda text, a: bool(norm(a)) and re.search(token_pattern(norm(a)), norm(text)) is not None
    want = [(k, 40, sum(all(has(t, a) for a in need) and (not groups or any(all(has(t, a) for a in g) for g in groups)) for _, need, groups in facts)) for k, t in texts]
    golden = spark.createDataFrame(facts, "fact_id int, anchors array<string>, any array<array<string>>")
    df = spark.createDataFrame(texts, "id int, text string")
    assert sorted(tuple(r) for r in MA.score_facts(df, golden, ["id"]).collect()) == want
    most, MA.FACT_BLOCK = MA.FACT_BLOCK, 7
    try:
        assert sorted(tuple(r) for r in MA.score_facts(df, golden, ["id"]).collect()) == want
    finally:
        MA.FACT_BLOCK = most
    assert {r.total for r in MA.score_facts(df, golden.limit(0), ["id"]).collect()} == {0}
