"""Queries over whole runs: chunks of all sources, tournaments, calls that resume."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import recognition as RE
from ..operators import rounds as R
from ..operators.resume import Stages
from ..sources.storage import Versions
from .registry import Read, query
from .tables import stage_folder, writer

# Documents whose lines become headings of four levels and code fences, by their number.
_HEADED = """array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN ((i - 1) * 7 + doc_id) % 6 < 3 THEN repeat('#', cast(1 + ((i - 1) * 5 + doc_id) % 4 AS INT)) || ' ' || x
  WHEN ((i - 1) * 7 + doc_id) % 12 = 5 THEN '```' || chr(10) || x ELSE x END), chr(10))"""


def _headed(t: Read) -> DataFrame:
    def line(x, i):
        k = i * 7 + F.col("doc_id")
        return F.when(k % 6 < 3, F.concat(F.repeat(F.lit("#"), (1 + (i * 5 + F.col("doc_id")) % 4).cast("int")), F.lit(" "), x)).when(k % 12 == 5, F.concat(F.lit("```\n"), x)).otherwise(x)

    return t.documents.select("doc_id", F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line), "\n").alias("text"))


def _pieces(sizes: str) -> str:
    """CTEs that end in pieces (doc_id, size, piece_no, text): sections by their ends and parents, each looked up by itself; large ones packed line by line."""
    return f"""t AS (SELECT doc_id, {_HEADED} AS text FROM documents), sizes AS (SELECT unnest([{sizes}]) AS size),
  l AS (SELECT doc_id, i, ls[i] AS line, coalesce(sum(length(ls[i]) + 1) OVER before, 0) AS start, coalesce(sum(regexp_matches(ls[i], '^[\\t ]*(```|~~~)')::INT) OVER before, 0) AS fences
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t), range(1, len(ls) + 1) r(i) WINDOW before AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  h AS (SELECT doc_id, start, length(regexp_extract(line, '^(#{{1,6}})[\\t ]+[^\\t\\n\\f\\r ]', 1)) AS level FROM l WHERE regexp_matches(line, '^#{{1,6}}[\\t ]+[^\\t\\n\\f\\r ]') AND fences % 2 = 0),
  e AS (SELECT h.*, coalesce((SELECT min(g.start) FROM h g WHERE g.doc_id = h.doc_id AND g.start > h.start AND g.level <= h.level), length(text)) - start AS chars,
               (SELECT max(g.start) FROM h g WHERE g.doc_id = h.doc_id AND g.start < h.start AND g.level < h.level) AS parent FROM h JOIN t USING (doc_id)),
  tops AS (SELECT doc_id, count(*) AS n, min(start) AS title FROM e WHERE parent IS NULL GROUP BY doc_id),
  b AS (SELECT doc_id, size, 0 AS start FROM t, sizes WHERE text <> '' UNION
        SELECT c.doc_id, size, c.start FROM e c JOIN tops USING (doc_id) LEFT JOIN e p ON p.doc_id = c.doc_id AND p.start = c.parent, sizes WHERE c.parent IS NULL OR p.chars > size OR n = 1 AND c.parent = title),
  s AS (SELECT doc_id, size, start, substr(text, start + 1, coalesce(lead(start) OVER (PARTITION BY doc_id, size ORDER BY start), length(text)) - start) AS text FROM b JOIN t USING (doc_id)),
  big AS (SELECT doc_id, size, start, string_split(text, chr(10)) AS ls FROM s WHERE length(text) > size),
  cut AS (SELECT doc_id, size, start, i, CASE WHEN i < len(ls) THEN ls[i] || chr(10) ELSE ls[i] END AS line FROM big, range(1, len(ls) + 1) r(i)),
  f AS (SELECT doc_id, size, start, row_number() OVER (PARTITION BY doc_id, size, start ORDER BY i, k) AS n, substr(line, k * size + 1, size) AS part FROM cut, range(0, (length(line) + size - 1) // size) r(k)),
  packed AS (SELECT doc_id, size, start, n, 1 AS chunk, length(part) AS filled FROM f WHERE n = 1 UNION ALL
             SELECT f.doc_id, f.size, f.start, f.n, chunk + (filled + length(part) > f.size)::INT, CASE WHEN filled + length(part) > f.size THEN length(part) ELSE filled + length(part) END
             FROM packed p JOIN f ON f.doc_id = p.doc_id AND f.size = p.size AND f.start = p.start AND f.n = p.n + 1),
  every AS (SELECT doc_id, size, start, 1 AS chunk, text FROM s WHERE length(text) <= size UNION ALL
            SELECT doc_id, size, start, chunk, string_agg(part, '' ORDER BY n) FROM packed JOIN f USING (doc_id, size, start, n) GROUP BY doc_id, size, start, chunk),
  pieces AS (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id, size ORDER BY start, chunk) AS piece_no, text FROM every)"""


@query(f"""WITH RECURSIVE {_pieces("200, 1000, 5000")}
  SELECT doc_id, size, cast(piece_no AS INT) AS piece_no, cast(length(text) AS INT) AS characters, md5(text) AS md5 FROM pieces""")
def heading_budget(t: Read):
    """Headed documents in pieces of three budgets; pieces join to the text."""
    docs = _headed(t)
    parts = [C.heading_pieces(docs, size).select("doc_id", F.lit(size).alias("size"), "piece_no", "characters", F.md5("text").alias("md5")) for size in (200, 1000, 5000)]
    return reduce(DataFrame.unionByName, parts)


@query(f"""WITH RECURSIVE {_pieces("600")},
  run AS (SELECT doc_id, piece_no, text, 1 AS chunk_no, length(text) AS filled FROM pieces WHERE piece_no = 1 UNION ALL
          SELECT p.doc_id, p.piece_no, p.text, chunk_no + (filled + length(p.text) > 600)::INT, CASE WHEN filled + length(p.text) > 600 THEN length(p.text) ELSE filled + length(p.text) END
          FROM run r JOIN pieces p ON p.doc_id = r.doc_id AND p.piece_no = r.piece_no + 1),
  c AS (SELECT doc_id, chunk_no, string_agg(text, '' ORDER BY piece_no) AS text FROM run GROUP BY doc_id, chunk_no)
  SELECT (SELECT count(*) FROM documents d WHERE d.doc_id <= c.doc_id) AS source, doc_id, cast(chunk_no AS INT) AS chunk_no, format('chunk-{{:03d}}', row_number() OVER (ORDER BY doc_id, chunk_no)) AS chunk_id,
         cast(length(text) AS INT) AS characters, cast(ceil(length(text) / 4.0) AS BIGINT) AS tokens, sha256(text) AS sha256 FROM c""")
def packed_run(t: Read):
    """Chunks of 150 tokens at most, of all documents as one run, numbered over all of them."""
    run = C.pack_sources(_headed(t), 4000, writer(t.spark), most_tokens=150)
    return run.select(F.col("source").cast("long").alias("source"), "doc_id", "chunk_no", "chunk_id", "characters", "tokens", "sha256")


def longer_judge(prompt: str) -> str:
    """A deterministic stand-in for a judge: the longer text, or slot A if they are as long, which makes a flip."""
    a, _, b = prompt.rpartition("\n\nA:\n")[2].partition("\n\nB:\n")
    winner, text = ("A", a) if len(a) >= len(b) else ("B", b)
    return f'{{"winner": "{winner}", "reason": "it says \\"{text[:12]}\\""}}'


def broken_judge(prompt: str) -> str:
    """Fails on one text in five, by its length; else as ``longer_judge``."""
    if len(prompt) % 5 == 0:
        raise ValueError("no reply")
    return longer_judge(prompt)


def _contests(t: Read, criteria: tuple[str, ...]) -> DataFrame:
    """Suppliers in contests of eight, by their keys: contests grow with the table, and none of them does."""
    k = F.col("s_suppkey")
    text = F.concat("s_name", F.lit(" "), F.repeat(F.lit("x"), (F.pmod(F.floor(F.col("s_acctbal") / 500), F.lit(9)) + 1).cast("int")))
    rows = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), text.alias("text"), F.explode(F.array(*map(F.lit, criteria))).alias("criterion"))
    return rows.select(F.concat_ws(":", "criterion", F.floor(k / 8).cast("string")).alias("contest"), "criterion", F.lit("suppliers").alias("source"), "name", k.alias("seed"), "text")


@query("""WITH s AS (SELECT 'merit:' || cast(s_suppkey // 8 AS VARCHAR) AS contest, s_name AS name, s_suppkey, length(s_name) + ((cast(floor(s_acctbal / 500) AS BIGINT) % 9) + 9) % 9 AS len FROM supplier)
  SELECT contest, cast(row_number() OVER (PARTITION BY contest ORDER BY len DESC, s_suppkey) AS INT) AS rank, name FROM s""")
def tournament_ranking(t: Read):
    """Suppliers of each contest by a judge that takes the longer text; ties keep the seeds' order, as in a stable sort."""
    return R.tournaments(_contests(t, ("merit",)), {"judge": longer_judge}, writer(t.spark)).ranking


@query()
def panel_trust(t: Read):
    """A panel of three under each criterion; two judges bear the names of entrants, one fails at times."""
    judges = {"Supplier#000000001": longer_judge, "Supplier#000000002": broken_judge, "outsider": longer_judge}
    found = R.tournaments(_contests(t, ("merit", "comedy", "publish")), judges, writer(t.spark))
    counts = R.judge_counts(found.edges).groupBy("contest").agg(F.sort_array(F.collect_list(F.struct("judge", "comparisons", "errors"))).alias("c"))  # a row per judge
    said = F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["judge"], x["comparisons"].cast("string"), x["errors"].cast("string"))), " ")
    return R.trust(found.edges, found.audit).join(counts.select("contest", said.alias("judges")), "contest")


@query("""WITH RECURSIVE c AS (SELECT doc_id, text, cast(k AS INT) AS chunk_no, CASE WHEN k % 5 = 4 THEN '(missing) ' ELSE '' END || trim(substr(text, k * 350 + 1, 400), ' ' || chr(10)) AS part
    FROM documents, range(0, (length(text) + 349) // 350) r(k)),
  f AS (SELECT doc_id, -1 AS chunk_no, 0::BIGINT AS hit, 0::BIGINT AS cur, '' AS part FROM documents UNION ALL
        SELECT c.doc_id, c.chunk_no, CASE WHEN c.part = '' THEN 0 ELSE strpos(substr(text, cur + 1), c.part) END, cur + CASE WHEN c.part = '' THEN 0 ELSE strpos(substr(text, cur + 1), c.part) END, c.part
        FROM f JOIN c ON c.doc_id = f.doc_id AND c.chunk_no = f.chunk_no + 1),
  s AS (SELECT doc_id, chunk_no, hit > 0 AS found, cur, text, f.part FROM f JOIN documents USING (doc_id) WHERE chunk_no >= 0)
  SELECT doc_id, chunk_no, md5(part) AS md5, CASE WHEN found THEN cast(1 + length(substr(text, 1, cur - 1)) - length(replace(substr(text, 1, cur - 1), chr(10), '')) AS INT) ELSE 0 END AS start_line,
         CASE WHEN found THEN cast(1 + length(substr(text, 1, cur + length(part) - 2)) - length(replace(substr(text, 1, cur + length(part) - 2), chr(10), '')) AS INT) ELSE 0 END AS end_line FROM s""")
def chunk_line_spans(t: Read):
    """Lines of chunks that overlap and are trimmed; every fifth was changed, so that its source doesn't hold it."""
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    starts = F.sequence(F.lit(0), F.ceil(F.length("text") / 350).cast("int") - 1)
    rows = docs.where("text <> ''").select("doc_id", "text", F.explode(starts).alias("chunk_no"))
    part = F.trim(F.substring("text", F.col("chunk_no") * 350 + 1, F.lit(400)), F.lit(" \n"))
    chunks = rows.select("doc_id", "chunk_no", F.concat(F.when(F.col("chunk_no") % 5 == 4, "(missing) ").otherwise(""), part).alias("text"))
    return C.line_spans(docs, chunks).select("doc_id", "chunk_no", F.md5("text").alias("md5"), "start_line", "end_line")


def head_completer(prompt: str) -> str:
    """A deterministic stand-in for a model: the head of what it was asked."""
    return "- " + prompt[:60].replace("\n", " ")


@query("""WITH a AS (SELECT doc_id, 'Extract:' || chr(10) || text AS one, 'Extract:' || chr(10) || text || CASE WHEN doc_id % 7 = 0 THEN ' (revised)' ELSE '' END AS two FROM documents)
  SELECT 1 AS run, count(*) AS units, 0::BIGINT AS reused, count(DISTINCT one) AS called FROM a UNION ALL
  SELECT 2, count(*), count(*), 0 FROM a UNION ALL
  SELECT 3, count(*), count(*) FILTER (two IN (SELECT one FROM a)), count(DISTINCT two) FILTER (two NOT IN (SELECT one FROM a)) FROM a""")
def resumed_calls(t: Read):
    """Calls of three runs over all documents: none was made before; nothing changed; a seventh was revised."""
    stages = Stages(t.spark, stage_folder(t.spark), {"size": "whole", "algorithm": "1"})
    text = F.coalesce("text", F.lit(""))
    out = []
    for run, body in ((1, text), (2, text), (3, F.concat(text, F.when(F.col("doc_id") % 7 == 0, " (revised)").otherwise("")))):
        said = stages.run("extract", t.documents.select("doc_id", F.concat(F.lit("Extract:\n"), body).alias("prompt")), head_completer)
        out.append(said.agg(F.lit(run).alias("run"), F.count("*").alias("units"), F.count_if("reused").alias("reused"), F.count_distinct(F.when(~F.col("reused"), F.col("key"))).alias("called")))
    return reduce(DataFrame.unionByName, out)


@query("""SELECT doc_id, count(*) AS chunks, sum(length(substr(text, k * 500 + 1, 500)))::BIGINT AS characters FROM documents, range(0, (length(text) + 499) // 500) r(k) GROUP BY doc_id""")
def published_chunks(t: Read):
    """The chunks of all documents, read from the current generation after two were published."""
    rows = t.documents.select("doc_id", F.posexplode(C.bounded_fragments(F.coalesce("text", F.lit("")), 500)).alias("chunk_no", "text"))
    folder = Versions(t.spark, stage_folder(t.spark))
    folder.publish({"chunks": rows.where("chunk_no = 0")}, {"manifest.json": '{"mode": "first"}'})
    folder.publish({"chunks": rows}, {"manifest.json": '{"mode": "windows"}'})
    folder.clear()
    return t.spark.read.parquet(f"{folder.current()}/chunks").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("characters"))


def longest_completer(name: str):
    """A deterministic stand-in for a judge of its own texts: it names the longest one that it is shown, the first of several."""
    def reply(prompt: str) -> str:
        texts = [p.partition("]\n")[2].rstrip("\n") for p in prompt.split("\n[")[1:]]
        return f"I wrote number {max(range(len(texts)), key=lambda k: (len(texts[k]), -k))}."

    return reply


@query("""WITH s AS (SELECT s_suppkey // 8 AS g, s_name AS name, length(s_name || ' ' || repeat('x', cast(((cast(floor(s_acctbal / 500) AS BIGINT) % 9) + 9) % 9 + 1 AS INT))) AS len FROM supplier),
  x AS (SELECT g, name AS judge, len AS own, trial, ('0x' || substr(md5('1:' || g || ':' || name || ':' || trial), 1, 8))::BIGINT % 4 AS slot FROM s, range(0, 8) r(trial)),
  o AS (SELECT x.g, judge, own, trial, slot, len, row_number() OVER (PARTITION BY x.g, judge, trial ORDER BY md5('1:' || x.g || ':' || judge || ':' || trial || ':' || name), name) AS n FROM x JOIN s ON s.g = x.g AND name <> judge),
  p AS (SELECT g, judge, trial, own, slot, count(*) AS others, max(len) FILTER (n <= slot) AS before, max(len) FILTER (n > slot) AS after FROM o WHERE n < 4 GROUP BY ALL)
  SELECT cast(x.g AS VARCHAR) AS field, x.judge, count(*) AS trials, count(*) FILTER (others = 3 AND x.own > coalesce(before, 0) AND x.own >= coalesce(after, 0)) AS hits,
         count(*) FILTER (others = 3 AND x.own > coalesce(before, 0) AND x.own >= coalesce(after, 0)) / count(*) AS accuracy, 0.25::DOUBLE AS chance,
         count(*) FILTER (others = 3 AND x.own > coalesce(before, 0) AND x.own >= coalesce(after, 0)) / count(*) > 0.25 AS above_chance
  FROM x LEFT JOIN p ON p.g = x.g AND p.judge = x.judge AND p.trial = x.trial GROUP BY x.g, x.judge""")
def recognition_probe(t: Read):
    """Every supplier of a field of eight looks for its own text among three others, eight times, by the longest one."""
    text = F.concat(F.lit("# Headline\n"), F.col("s_name"), F.lit(" "), F.repeat(F.lit("x"), (F.pmod(F.floor(F.col("s_acctbal") / 500), F.lit(9)) + 1).cast("int")))
    entries = t.supplier.select(F.floor(F.col("s_suppkey") / 8).cast("string").alias("field"), F.col("s_name").alias("name"), text.alias("text"))
    return RE.recognition(entries, entries.select("field", F.col("name").alias("judge")), longest_completer)
