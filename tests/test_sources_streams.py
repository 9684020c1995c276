import json

import pytest
from pyspark.sql import functions as F

from factloom.sources import files as S
from factloom.streaming import twins as R


def test_documents_are_read_once_and_normalized(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("﻿x\r\ny\r".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("z")
    (tmp_path / "c.txt").write_text("no")
    docs = S.read_documents(spark, [str(tmp_path), str(tmp_path / "a.md")]).orderBy("doc_id").collect()
    assert [r.text for r in docs] == ["x\ny\n", "z"]
    assert S.concat_sources(S.read_documents(spark, [str(tmp_path)])).first().text == "# Source 01\n\nx\ny\n\n\n# Source 02\n\nz"


def test_manifests(spark, tmp_path):
    (tmp_path / "001.md").write_text("one")
    (tmp_path / "002.md").write_text("two")
    chunk = lambda f: {"file": f, "tokens": 1, "start_line": 1, "end_line": 1}
    (tmp_path / "manifest.json").write_text(json.dumps({"source": "s", "chunks": [chunk("002.md"), chunk("001.md")], "total_chunks": 2}, indent=1))
    assert [r.text for r in S.read_manifest(spark, str(tmp_path)).orderBy("chunk_no").collect()] == ["two", "one"]
    (tmp_path / "manifest.json").write_text(json.dumps({"source": "s", "chunks": [chunk("../x.md")], "total_chunks": 1}))
    with pytest.raises(ValueError, match="bad manifest"):
        S.read_manifest(spark, str(tmp_path))


def test_fixtures_check_their_ids(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"task": "t", "allowed_labels": ["a"], "items": [{"id": "1", "text": "x", "gold_label": "a"}, {"id": "1", "text": "y", "gold_label": "a"}]}))
    with pytest.raises(ValueError, match="repeated"):
        S.read_fixture(spark, "labels", str(tmp_path / "f.json"))


def test_tasks_config_paths(spark, tmp_path):
    tasks = spark.createDataFrame([("a",), ("b",)], "id string")
    assert [r.id for r in S.select_tasks(tasks, skip=["a"]).collect()] == ["b"]
    for bad in ({"only": ["z"]}, {"only": ["a"], "skip": ["a"]}):
        with pytest.raises(ValueError):
            S.select_tasks(tasks, **bad)
    assert S.overlay({"a": 1, "n": {"x": 1, "y": 2}}, {"n": {"y": 3}}) == {"a": 1, "n": {"x": 1, "y": 3}}
    assert S.upsert_config("a: 1\n# c\nb: 2\n", {"b": ("9", "why"), "c": ("3", "new")}) == "a: 1\n# c\nb: 9  # why\nc: 3  # new\n"
    assert S.under(str(tmp_path), "x/y").endswith("x/y")
    with pytest.raises(ValueError):
        S.under(str(tmp_path), "../x")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", "short")], "doc_id int, chunk_no int, text string, gate string")
    assert S.publish(df, str(tmp_path / "p")) == (1, 1)
    S.write_chunks(df, str(tmp_path / "c"), "headings", "s")
    with pytest.raises(Exception, match="exist"):
        S.write_chunks(df, str(tmp_path / "c"), "headings", "s")
    assert S.render_table(df.select("doc_id", "text"), "T", "html").count("<tr>") == 3
    assert S.render_table(df.select("doc_id"), "T").endswith("| 2 |")
    with pytest.raises(ValueError, match="over 1"):
        S.render_table(df, "T", most=1)


def test_leaderboards_and_credits(spark):
    lines = spark.createDataFrame([("| Model | Score |",), ("|---|---|",), ("| m1 | 1,2 |",)], "line string")
    assert [tuple(r) for r in S.leaderboard(lines, 0, 1).collect()] == [("m1", 12.0)]
    payload = spark.createDataFrame([('{"items":[{"a":"1"},{"a":"2"}]}',)], "value string")
    assert [(r.available, r.pos) for r in S.credits_of(payload).collect()] == [(2, 0), (2, 1)]


def test_code_is_scanned_not_run():
    assert S.unsafe_reason("import os.path") == "import os.path" and S.unsafe_reason("eval('1')") == "call eval"
    assert S.unsafe_reason("def f(:") is None and S.unsafe_reason("import math") is None


def drain(df, mode, spark, name):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(90)
    finally:
        query.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", "start", 5), ("2024-01-01 00:00:02", "a", "done", 7), ("2024-01-01 00:00:09", "a", "start", 1), ("2024-01-01 00:00:00", "b", "start", 2)]
    src = tmp_path / "ledger"
    spark.createDataFrame([(t, s, a, n, n) for t, s, a, n in rows], "ts string, stage string, action string, prompt_tokens long, output_tokens long").select(F.col("ts").cast("timestamp").alias("ts"), "stage", "action", "prompt_tokens", "output_tokens").write.json(str(src))
    ledger = R.read_ledger(spark, str(src))
    got = drain(R.running_tokens(ledger), "complete", spark, "tokens")
    assert {r.stage: (r.prompt_tokens, r.calls) for r in got} == {"a": (13, 3), "b": (2, 1)}
    got = drain(R.gap_sessions(ledger, "stage"), "complete", spark, "sessions")
    assert sorted((r.stage, r.events) for r in got) == [("a", 1), ("a", 2), ("b", 1)]
    got = drain(R.progress(ledger), "update", spark, "progress")
    assert {r.stage: (r.begun, r.done) for r in got} == {"a": (2, 1), "b": (1, 0)}
    q = R.append_ledger(ledger, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_stream_dedup(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:00:00", "- A fact."), ("2024-01-01 00:00:01", "- a  fact"), ("2024-01-01 00:00:02", "- other")], "ts string, bullet string").write.json(str(tmp_path / "f"))
    facts = spark.readStream.schema("ts timestamp, bullet string").json(str(tmp_path / "f"))
    got = drain(R.dedup_facts(facts), "append", spark, "facts")
    assert len(got) == 2


def test_budget():
    assert R.split_budget(10, [3, 2]) == [6, 4] and R.split_budget(4, [3, 2]) is None
