from pyspark.sql import functions as F

from factloom.operators import evaluation as E
from factloom.operators.metrics import calibration


def test_calibration_of_planted_pairs(spark):
    digests = spark.createDataFrame([("d1", "First one. Second one. Third one.\n\nMore here. And here."), ("d2", "x")], "name string, text string")
    pairs = E.planted_pairs(digests, ("shuffle", "truncate", "listify"))
    longer = lambda p: '{"winner": "%s"}' % ("A" if len(p.split("\n\nB:\n")[0]) - 3 >= len(p.split("\n\nB:\n")[1]) else "B")
    always_a = E.planted_trials(pairs, lambda p: '{"winner": "A"}')
    r = calibration(always_a.withColumn("judge", F.lit("j")), "judge").first()
    assert r.bias_rate == 1.0 and not r.trustworthy and r.pairs == always_a.count() > 2
    truncated = E.planted_trials(pairs.where("kind = 'truncate'"), longer)
    assert calibration(truncated.withColumn("judge", F.lit("j")), "judge").first().trustworthy


def test_generation_tolerates_one_failure(spark):
    topics = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, brief string")
    of = {"good": lambda p: p * 2, "misses": lambda p: "" if p == "a" else p, "bad": lambda p: p if p == "a" else ""}
    got = E.generate(list(of), topics, of.__getitem__).collect()
    assert sorted((r.model, r.topic) for r in got) == [("good", "1"), ("good", "2"), ("good", "3"), ("misses", "2"), ("misses", "3")]


def test_digest_checks(spark):
    rows = spark.createDataFrame([("d", "Here is the digest. It cost 1,200 in 25 days though 30 were planned."), ("e", "Nothing.")], "name string, text string")
    got = {r.name: r for r in E.check_digests(rows, [("t", [["25"], ["30", "40"]]), ("u", [["2"]])], ["here is the"], ["TODO"], ["cost 1200"], (5, 50)).collect()}
    d = got["d"]
    assert (d.tensions, d.preamble, d.artifacts, d.fabricated, d.word_band_ok, d.unclean) == (["t"], ["here is the"], [], ["cost 1200"], True, True)
    assert got["e"].tensions == [] and not got["e"].word_band_ok


def test_outlines_of_clusters_and_headers(spark):
    clusters = spark.createDataFrame([(1, 3, [1]), (1, 7, [2, 3])], "doc_id int, cluster int, fact_ids array<int>")
    labels = E.parse_cluster_labels(spark.createDataFrame([(1, "C7: Old\n C7: Costs \nnoise")], "doc_id int, reply string"))
    assert [(r.section, r.title) for r in E.cluster_outline(clusters, labels).orderBy("section").collect()] == [(1, "Cluster 1"), (2, "Costs")]
    chunks = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, chunk_no int, text string")
    heads = spark.createDataFrame([(1, 0, "# H")], "doc_id int, line_no int, line string")
    assert sorted(r.prompt for r in E.context_headers(chunks, heads, lambda p: p.upper()).collect()) == ["# H\n\nA\n\na", "# H\n\nA\n\nb"]


def test_prompts_within_a_budget(spark):
    import pytest

    chunks = spark.createDataFrame([("1", "a"), ("2", "b")], "chunk_id string, text string")
    first = E.evaluate_prompt("T", chunks, str.upper, None, 2)
    assert sorted(r.reply for r in first.collect()) == ["T\nA", "T\nB"]
    with pytest.raises(ValueError, match="over the budget"):
        E.evaluate_prompt("T", chunks, str.upper, None, 1)
    assert E.evaluate_prompt("T", chunks, lambda p: "new", first.select("prompt_sha", "reply"), 0).where("route = 'cached'").count() == 2


def test_policies():
    assert E.route_digest({"a": "1", "b": "2"}) == E.route_digest({"b": "2", "a": "1"}) != E.route_digest({"a": "2"})
    assert E.facts_reuse(False, True, True, False) == "reuse_unverified" and E.facts_reuse(False, True, True, True) == "verify"
