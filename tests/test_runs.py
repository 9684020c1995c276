"""Chunks of whole runs, sums over ranges, tournaments in rounds."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunks as C
from factloom.operators import rounds as R
from factloom.operators.numbering import sums_before
from factloom.operators.tournament import merge_sort
from factloom.plans.runs import broken_judge, longer_judge
from factloom.plans.tables import writer


@pytest.fixture
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def plain_pieces(text, size):
    """A walk of the tree of headings: a section that fits is a piece, else its own part is one and its children are walked."""
    root = {"level": 0, "start": 0, "end": len(text), "children": []}
    stack, nodes, start, fences = [root], [], 0, 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        m = re.match(r"(#{1,6})[\t ]+[^\t\n\f\r ]", line)
        if m and fences % 2 == 0:
            node = {"level": len(m[1]), "start": start, "end": len(text), "children": []}
            while stack[-1]["level"] >= node["level"]:
                stack.pop()["end"] = start
            stack[-1]["children"].append(node)
            stack.append(node)
            nodes.append(node)
        fences += bool(re.match(r"[\t ]*(```|~~~)", line))
        start += len(line)

    def walk(node, open_):
        if not open_ and node["end"] - node["start"] <= size:
            return [(node["start"], node["end"])]
        first = node["children"][0]["start"] if node["children"] else node["end"]
        title = node is root and len(root["children"]) == 1
        return [(node["start"], first)] + [p for c in node["children"] for p in walk(c, title)]

    parts = [text[a:b] for a, b in walk(root, True) if b > a]
    return [q for p in parts for q in ([p] if len(p) <= size else C._dense(p, size))]


THREE = "# Section One\n\nThis is the first section with some content.\nIt has multiple lines.\n\n# Section Two\n\nThe second.\n\n# Section Three\n\nThe third and last.\n"
TITLE = "# Title\n\nintro\n" + "".join(f"\n## Part {k}\n\ntext of part {k}\n" for k in range(7))


def pieces_of(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.doc_id, r.piece_no)):
        out[r.doc_id].append(r.text)
    return out


def test_headings_split_by_the_contract(docs_of):
    got = pieces_of(C.heading_pieces(docs_of([(1, THREE), (2, TITLE), (3, "no heading\nat all"), (4, ""), (5, None)]), 16_000))
    assert [p.split("\n")[0] for p in got[1]] == ["# Section One", "# Section Two", "# Section Three"]
    assert len(got[2]) == 8 and got[2][0] == "# Title\n\nintro\n\n" and got[3] == ["no heading\nat all"] and 4 not in got and 5 not in got


def test_sections_are_opened_only_where_they_do_not_fit(docs_of):
    text = "pre\n# A\n" + "a" * 30 + "\n## A1\n" + "b" * 30 + "\n### deep\ncc\n## A2\nshort\n# B\nsmall\n## B1\nsmall too\n"
    got = pieces_of(C.heading_pieces(docs_of([(1, text)]), 60))[1]
    assert [p.split("\n")[0] for p in got] == ["pre", "# A", "## A1", "## A2", "# B"] and "".join(got) == text
    got = pieces_of(C.heading_pieces(docs_of([(1, text)]), 20))[1]
    assert "".join(got) == text and all(len(p) <= 20 for p in got)


def test_pieces_match_a_walk_of_the_tree(docs_of):
    rng = random.Random(4)
    texts = []
    for k in range(150):
        lines = [rng.choice(["# h", "## h", "### h", "#### h", "```", "text", "more text here", "", "x" * 90]) for _ in range(rng.randrange(1, 25))]
        texts.append((k, "\n".join(lines)))
    for size in (10, 40, 400):
        got = pieces_of(C.heading_pieces(docs_of(texts), size))
        for k, t in texts:
            assert "".join(got[k]) == t and all(len(p) <= size for p in got[k])
            assert got[k] == plain_pieces(t, size), (t, size)


def test_a_run_numbers_all_chunks_and_isolates_sources(spark, docs_of):
    rng = random.Random(6)
    docs = [(k * 3, "\n".join(rng.choice(["# a", "## b", "some words", "y" * 50]) for _ in range(rng.randrange(0, 30)))) for k in range(60)] + [(1000, None)]
    df = docs_of(docs)
    run = C.pack_sources(df, 120, writer(spark), most_tokens=25)
    rows = sorted(run.collect(), key=lambda r: r.number)
    assert [r.number for r in rows] == list(range(1, len(rows) + 1)) and rows[7].chunk_id == "chunk-008"
    assert C.covers(df, run.withColumn("chunk_no", F.col("number"))).count() == 0
    assert [r.source for r in rows] == sorted(r.source for r in rows) and {r.doc_id: r.source for r in rows} == {i: n + 1 for n, (i, t) in enumerate(docs) if t}
    for i, t in docs:
        want = C.pack(plain_pieces(t or "", 100), 100)
        assert [r.text for r in rows if r.doc_id == i] == want
    plan = run._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("by", [(), ("g",)])
def test_sums_before_match_a_loop(spark, by):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(10)) for k in rng.sample(range(10_000), 800)]
    df = spark.createDataFrame(rows, "k long, g string, n long").repartition(5)
    got = {r.k: (r.total, r.place) for r in sums_before(df, ["k"], {"total": F.col("n"), "place": F.lit(1)}, writer(spark), by).collect()}
    total, place, want = Counter(), Counter(), {}
    for k, g, n in sorted(rows, key=lambda r: r[0]):
        key = g if by else ""
        want[k] = (total[key], place[key])
        total[key] += n
        place[key] += 1
    assert got == want


def contests(spark, rows):
    return spark.createDataFrame([(c, "merit", "about", n, k, t) for c, n, k, t in rows], "contest string, criterion string, source string, name string, seed int, text string")


def cyclic_judge(prompt):
    """Rock, paper and scissors by the length of the texts, whatever their slot."""
    a, _, b = prompt.rpartition("\n\nA:\n")[2].partition("\n\nB:\n")
    return f'noise {{"winner": "{"A" if (len(a) - len(b)) % 3 == 1 or (len(a) - len(b)) % 3 == 0 and len(a) > len(b) else "B"}", "reason": ""}}'


def verdict(judge, a, b):
    """(winner, flip, error) of two texts in both slots."""
    said = []
    for x, y in ((a, b), (b, a)):
        try:
            reply = judge(R.render(R.RUBRICS["merit"], {"source": "about", "a": x, "b": y}))
            said.append(x if '"winner": "A"' in reply else y)
        except ValueError:
            return None, False, True
    return (said[0], False, False) if said[0] == said[1] else (None, True, False)


@pytest.mark.parametrize("judge", [longer_judge, cyclic_judge, broken_judge])
def test_many_tournaments_match_the_plain_sort(spark, judge):
    rng = random.Random(3)
    rows = [(f"c{c}", f"n{k}", k, f"{c}-{k}-" + "t" * rng.randrange(12)) for c, n in enumerate((1, 2, 3, 5, 7, 8)) for k in range(n)]
    got = R.tournaments(contests(spark, rows), {"only": judge}, writer(spark), audit_triples=6)
    text = {(c, n): t for c, n, _, t in rows}
    ranking, edges = defaultdict(list), defaultdict(dict)
    for r in sorted(got.ranking.collect(), key=lambda r: r.rank):
        ranking[r.contest].append(r.name)
    for r in got.edges.collect():
        key = tuple(sorted((r.a, r.b)))
        assert key not in edges[r.contest] and r.label == ""
        edges[r.contest][key] = r
    for c in {r[0] for r in rows}:
        asked = {}

        def better(a, b, c=c, asked=asked):
            w, *_ = asked[tuple(sorted((a, b)))] = verdict(judge, text[c, a], text[c, b])
            return None if w is None else (a if w == text[c, a] else b)

        assert ranking[c] == merge_sort([n for x, n, *_ in rows if x == c], better)
        assert set(asked) <= set(edges[c])
        for (a, b), r in edges[c].items():
            w, flip, error = verdict(judge, text[c, a], text[c, b])
            assert (r.flip, r.error) == (flip, error) and (None if r.winner is None else text[c, r.winner]) == w
    wins = Counter()
    for c, found in edges.items():
        for (a, b), r in found.items():
            if not r.error:
                for n in (a, b):
                    wins[c, n, "ties" if r.winner is None else "wins" if r.winner == n else "losses"] += 1
    for r in R.standings(got.edges).collect():
        assert (r.wins, r.losses, r.ties) == tuple(wins[r.contest, r.name, x] for x in ("wins", "losses", "ties"))
    for r in got.audit.collect():
        assert not (judge is longer_judge and r.cyclic)
    for r in R.trust(got.edges, got.audit).collect():
        mine = edges[r.contest].values()
        assert r.comparisons == len(mine) and r.flip_rate == pytest.approx(sum(e.flip for e in mine) / len(mine)) and r.error_rate == pytest.approx(sum(e.error for e in mine) / len(mine))
        assert r.trustworthy == (r.flip_rate <= 0.25 and r.error_rate <= 0.15 and r.cycle_rate <= 0.15)


def test_a_judge_that_sees_slots_only_is_suspect_and_a_cycle_is_found(spark):
    rows = [("c", f"n{k}", k, "t" * (k + 1)) for k in range(6)]
    slot = R.tournaments(contests(spark, rows), {"a": lambda p: '{"winner": "A", "reason": "first"}'}, writer(spark))
    assert [r.name for r in slot.ranking.orderBy("rank").collect()] == [f"n{k}" for k in range(6)]
    only = R.trust(slot.edges, slot.audit).collect()[0]
    assert only.flip_rate == 1.0 and only.triples == 0 and not only.trustworthy
    rock = R.tournaments(contests(spark, rows[:3]), {"a": cyclic_judge}, writer(spark), audit_triples=2)
    assert [r.cyclic for r in rock.audit.collect()] == [True, True]


def test_a_panel_never_rules_on_itself(spark):
    rows = [("c", n, k, "t" * (k + 1)) for k, n in enumerate(["p", "q", "r", "s", "u"])]
    panel = {"p": longer_judge, "q": broken_judge, "x": longer_judge}
    got = R.tournaments(contests(spark, rows), panel, writer(spark), audit_triples=8)
    edges = got.edges.collect()
    assert all(e.label not in (e.a, e.b) for e in edges) and all(not e.error for e in edges if e.label != "q")
    counts = {r.judge: (r.comparisons, r.errors) for r in R.judge_counts(got.edges).collect()}
    assert sum(n for n, _ in counts.values()) == len(edges) and counts == {j: (sum(e.label == j for e in edges), sum(e.label == j and e.error for e in edges)) for j in counts}
    alone = R.tournaments(contests(spark, rows[:2]), {"p": longer_judge, "q": longer_judge}, writer(spark))
    assert [(e.label, e.winner) for e in alone.edges.collect()] == [("p (fallback)", "q")]


def test_draws_are_triples_of_different_names(spark):
    ranking = spark.createDataFrame([("c", k, f"n{k}") for k in range(1, 5)] + [("d", 1, "x"), ("d", 2, "y")], "contest string, rank int, name string")
    rows = R.drawn_triples(ranking, 300).collect()
    assert len(rows) == 300 and all(len({r.x, r.y, r.z}) == 3 for r in rows)
    seen = Counter(frozenset((r.x, r.y, r.z)) for r in rows)
    assert len(seen) == 4 and min(seen.values()) > 40 and R.drawn_triples(ranking, 0).count() == 0
    with pytest.raises(ValueError, match="over 3"):
        R.tournaments(contests(spark, [("c", f"n{k}", k, "t") for k in range(4)]), {"a": longer_judge}, writer(spark), most=3)
