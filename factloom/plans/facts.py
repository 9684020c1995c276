"""Queries over facts, chunks, transcripts, blocks, vectors, sets and the pipeline."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.sentences import sentence_counts_udf
from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import completion as CO
from ..operators import facts as FA
from ..operators import matching as MA
from ..operators import pipeline as P
from ..operators import structured as S
from ..operators import transcripts as TR
from ..operators import vectors as V
from ..operators.numbering import sums_before
from .articles import sentences_sql
from .registry import Read, query
from .tables import writer


def _docs(t: Read):
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


_BULLETS = "'intro' || chr(10) || '- first ' || doc_id || chr(10) || '  goes on' || chr(10) || '* second' || chr(10) || 'plain' || chr(10) || '  stray' || chr(10) || '- ' || text"


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS n, lines[i] AS line FROM (SELECT doc_id, string_split({_BULLETS}, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i)),
  k AS (SELECT *, CASE WHEN regexp_matches(line, '^[-*+][\\t ]+') THEN 'b' WHEN regexp_matches(line, '^[\\t ]+[^\\t\\n\\f\\r ]') THEN 'c' ELSE 'x' END AS kind FROM l),
  g AS (SELECT *, count(*) FILTER (kind = 'b') OVER w AS fact_no, max(n) FILTER (kind = 'x') OVER w AS broken, max(n) FILTER (kind = 'b') OVER w AS began FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n))
  SELECT doc_id, fact_no, string_agg(line, chr(10) ORDER BY n) AS bullet, cast(min(n) AS INT) AS first_line, cast(max(n) AS INT) AS last_line FROM g WHERE kind <> 'x' AND began IS NOT NULL AND (broken IS NULL OR broken < began) GROUP BY doc_id, fact_no""")
def bullet_entries(t: Read):
    """C14 W01 K02 over the documents under a list."""
    text = F.concat(F.lit("intro\n- first "), F.col("doc_id").cast("string"), F.lit("\n  goes on\n* second\nplain\n  stray\n- "), F.col("text"))
    return FA.bullet_entries(_docs(t).select("doc_id", text.alias("text")))


_FNV_64 = "list_reduce(list_prepend(14695981039346656037::HUGEINT, [cast('0x' || substr(hex(encode(token)), 2 * i - 1, 2) AS HUGEINT) for i in range(1, strlen(token) + 1)]), lambda f, x: xor(f, x) * 1099511628211 % 18446744073709551616)"


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(regexp_replace(trim(regexp_replace(lower(ls[i]), '[\\t\\n\\f\\r ]+', ' ', 'g')), '^\\p{{P}}+|\\p{{P}}+$', '', 'g'), '') AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i)),
  kept AS (SELECT doc_id, line_no, list_filter([regexp_replace(x, '^\\p{{P}}+|\\p{{P}}+$', '', 'g') for x in string_split(trim(regexp_replace(k, '[\\t\\n\\f\\r ]+', ' ', 'g')), ' ')], lambda x: x <> '') AS tokens
           FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY line_no) AS n FROM l) WHERE n = 1 OR k = ''),
  t AS (SELECT doc_id, line_no, len(tokens) AS size, unnest(tokens) AS token FROM kept WHERE len(tokens) >= 5),
  h AS (SELECT token, {_FNV_64} AS hash FROM (SELECT DISTINCT token FROM t)),
  bits AS (SELECT doc_id, line_no, bit, 2 * count(*) FILTER ((hash // (1::HUGEINT << bit)) % 2 = 1) > any_value(size) AS one FROM t JOIN h USING (token), range(0, 64) b(bit) GROUP BY doc_id, line_no, bit),
  prints AS (SELECT doc_id, line_no, list(one ORDER BY bit) AS print FROM bits GROUP BY doc_id, line_no),
  near AS (SELECT DISTINCT b.doc_id, b.line_no FROM prints pa JOIN prints pb ON pa.doc_id = pb.doc_id AND pa.line_no < pb.line_no JOIN kept a ON a.doc_id = pa.doc_id AND a.line_no = pa.line_no JOIN kept b ON b.doc_id = pb.doc_id AND b.line_no = pb.line_no
           WHERE len(list_filter(list_zip(pa.print, pb.print), lambda z: z[1] <> z[2])) <= 10 AND len(list_filter(b.tokens, lambda x: list_contains(a.tokens, x))) >= 0.72 * least(len(a.tokens), len(b.tokens)))
  SELECT kept.doc_id, cast(kept.line_no AS INT) AS line_no, near.line_no IS NOT NULL AS near_dup FROM kept LEFT JOIN near ON near.doc_id = kept.doc_id AND near.line_no = kept.line_no""")
def near_dup_pairs(t: Read):
    """Lines of a document that are near to an earlier one; they stay and are flagged."""
    lines = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "bullet"))
    kept = FA.dedup_facts(lines, "doc_id", ["line_no"])
    return FA.flag_near_duplicates(kept, "doc_id", "line_no").select("doc_id", "line_no", "near_dup")


@query("""WITH s AS (SELECT doc_id, i AS section, regexp_replace(lower(w), '[^\\p{L}\\p{N}\\t\\n\\f\\r ]', '', 'g') AS norm, w AS title FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i), LATERAL (SELECT string_split(ls[i], ' ')[1] AS w)),
  g AS (SELECT doc_id, trim(regexp_replace(norm, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS norm, min(section) AS section, min_by(title, section) AS title, count(*) AS merged FROM s GROUP BY doc_id, trim(regexp_replace(norm, '[\\t\\n\\f\\r ]+', ' ', 'g')))
  SELECT doc_id, norm, section, title, merged FROM g""")
def title_merge(t: Read):
    """The first word of each line as a section's title."""
    rows = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    s = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("section"), F.split("line", " ")[0].alias("title"), F.array((F.col("i") + 1).cast("long")).alias("fact_ids"))
    return FA.merge_titles(s, "doc_id").select("doc_id", "norm", "section", "title", F.size("fact_ids").cast("long").alias("merged"))


_ROUTED = """u AS (SELECT conv_id, turn AS fact_id FROM conversations), s AS (SELECT conv_id, turn AS section, [turn % 3, turn + 1, turn] AS ids FROM conversations),
  e AS (SELECT conv_id, section, i, ids[i] AS fact_id FROM s, range(1, 4) r(i)), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, fact_id ORDER BY section, i) AS n FROM e)"""


@query(f"""WITH {_ROUTED} SELECT u.conv_id, u.fact_id, f.section FROM u LEFT JOIN f ON f.conv_id = u.conv_id AND f.fact_id = u.fact_id AND n = 1""")
def fact_routing(t: Read):
    """Turns as facts; a fact that two sections list stays with the first, one that none lists has no section."""
    c = t.conversations
    units = c.select("conv_id", F.col("turn").alias("fact_id"))
    sections = c.select("conv_id", F.col("turn").alias("section"), F.array(F.col("turn") % 3, F.col("turn") + 1, F.col("turn")).alias("fact_ids"))
    routed = FA.route_facts(sections, "conv_id")
    placed = units.join(routed.select("conv_id", "fact_id", "section"), ["conv_id", "fact_id"])
    return placed.unionByName(FA.orphans(units, routed, "conv_id").withColumn("section", F.lit(None).cast("long"))).select("conv_id", "fact_id", "section")


_CITED = "text || ' It holds [F1, 3,f6]. So [F' || (doc_id % 5 + 1) || ']  (  [F2] ) !'"


@query(f"""WITH a AS (SELECT doc_id, {_CITED} AS text FROM documents), f AS (SELECT doc_id, k AS fact_id FROM a, range(1, 7) r(k)),
  c AS (SELECT DISTINCT doc_id, cast(unnest(regexp_extract_all(array_to_string(regexp_extract_all(text, '\\[[Ff][0-9]+(?:\\s*,\\s*[Ff]?[0-9]+)*\\]'), ' '), '[0-9]+')) AS INT) AS fact_id FROM a),
  j AS (SELECT f.doc_id, f.fact_id, c.fact_id IS NOT NULL AS cited FROM f LEFT JOIN c ON c.doc_id = f.doc_id AND c.fact_id = f.fact_id)
  SELECT doc_id, count(*) AS total, count(*) FILTER (cited) AS cited, coalesce(string_agg(cast(fact_id AS VARCHAR), ',' ORDER BY fact_id) FILTER (NOT cited), '') AS missing FROM j GROUP BY doc_id""")
def citation_coverage(t: Read):
    """A16 X24 U04"""
    text = F.concat("text", F.lit(" It holds [F1, 3,f6]. So [F"), (F.col("doc_id") % 5 + 1).cast("string"), F.lit("]  (  [F2] ) !"))
    articles = _docs(t).select("doc_id", text.alias("text"))
    facts = articles.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("fact_id"))
    return MA.citation_coverage(articles, facts, "doc_id").withColumn("missing", F.array_join("missing", ","))


@query("""WITH o AS (SELECT doc_id, '# T ' || doc_id || chr(10) || 'pre' || chr(10) || '## A' || chr(10) || 'one' || chr(10) || 'Facts: F1, f2' || chr(10) || ' two ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '##  B' || chr(10) || 'fact: F3' ELSE '## B' END AS raw FROM documents)
  SELECT doc_id, 'T ' || doc_id AS headline, s AS section, CASE s WHEN 1 THEN 'A' ELSE 'B' END AS title, CASE s WHEN 1 THEN 'one two' ELSE '' END AS intent, CASE s WHEN 1 THEN '1,2' ELSE CASE WHEN doc_id % 2 = 0 THEN '3' ELSE '' END END AS fact_ids, true AS valid
  FROM o, range(1, 3) r(s)""")
def outline_parse(t: Read):
    """X25 K11 K12"""
    tail = F.when(F.col("doc_id") % 2 == 0, "##  B\nfact: F3").otherwise("## B")
    raw = F.concat(F.lit("# T "), F.col("doc_id").cast("string"), F.lit("\npre\n## A\none\nFacts: F1, f2\n two \n"), tail)
    rows = P.parse_outlines(_docs(t).select("doc_id", raw.alias("reply")))
    n = F.count("*").over(W.partitionBy("doc_id"))
    return rows.select("doc_id", "headline", F.col("section").cast("long").alias("section"), "title", "intent", F.array_join("fact_ids", ",").alias("fact_ids"), (F.col("headline").isNotNull() & n.between(1, 8)).alias("valid"))


_MERGE_LINES = "CASE event_id % 4 WHEN 0 THEN 'KEEP: [F' || event_id || '] as is' WHEN 1 THEN ' MERGED: both [F1] and [F' || (event_id % 3) || ']' WHEN 2 THEN 'CONTRADICTION: 3 against 4' ELSE 'C' || event_id || ': label' END"


@query(f"""WITH l AS (SELECT event_id, trim({_MERGE_LINES}) AS line FROM events)
  SELECT event_id, CASE WHEN regexp_matches(line, '^(KEEP|MERGED|CONTRADICTION):') THEN lower(regexp_extract(line, '^(KEEP|MERGED|CONTRADICTION):', 1)) WHEN regexp_matches(line, '^C[0-9]+:') THEN 'label' ELSE 'none' END AS kind,
         trim(regexp_extract(line, '^[A-Z0-9]+:(.*)$', 1)) AS body, len(list_filter([1, cast(event_id % 3 AS INT)], lambda x: NOT list_contains(list_transform(regexp_extract_all(line, 'F([0-9]+)', 1), lambda y: cast(y AS INT)), x))) = 0 AS preserves FROM l""")
def merge_output_parse(t: Read):
    """Lines of a merge reply, and whether they keep the ids that they must."""
    e = F.col("event_id")
    line = F.when(e % 4 == 0, F.concat(F.lit("KEEP: [F"), e.cast("string"), F.lit("] as is"))).when(e % 4 == 1, F.concat(F.lit(" MERGED: both [F1] and [F"), (e % 3).cast("string"), F.lit("]"))).when(e % 4 == 2, F.lit("CONTRADICTION: 3 against 4")).otherwise(F.concat(F.lit("C"), e.cast("string"), F.lit(": label")))
    rows = t.events.select("event_id", F.trim(line).alias("line"))
    word = F.regexp_extract("line", "^(KEEP|MERGED|CONTRADICTION):", 1)
    kind = F.when(word != "", F.lower(word)).when(F.col("line").rlike("^C[0-9]+:"), "label").otherwise("none")
    got = F.transform(F.regexp_extract_all("line", F.lit("F([0-9]+)"), 1), lambda s: s.cast("int"))
    needed = F.array(F.lit(1), (e % 3).cast("int"))
    return rows.select("event_id", kind.alias("kind"), F.trim(F.regexp_extract("line", "^[A-Z0-9]+:(.*)$", 1)).alias("body"), (F.size(F.array_except(needed, got)) == 0).alias("preserves"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
  s AS (SELECT *, sum(CASE WHEN before IS NULL OR us - before > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM e)
  SELECT user_id, cast(session AS BIGINT) AS session, count(*) AS events, max(us) - min(us) AS span_us FROM s GROUP BY user_id, session""")
def gap_sessions(t: Read):
    """A gap of over an hour ends a session."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = W.partitionBy("user_id").orderBy("us", "event_id")
    e = t.events.select("user_id", "event_id", us.alias("us")).withColumn("before", F.lag("us").over(w))
    s = e.withColumn("session", F.sum((F.col("before").isNull() | (F.col("us") - F.col("before") > 3_600_000_000)).cast("int")).over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), (F.max("us") - F.min("us")).alias("span_us"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS carried FROM events""")
def carry_forward(t: Read):
    """The last click's value holds until the next."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return t.events.select("event_id", F.last(F.when(F.col("event_type") == "click", F.col("value")), ignorenulls=True).over(w).alias("carried"))


_FENCED = "'# H' || chr(10) || '```py' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || text || chr(10) || '## Tail ' || doc_id || chr(10) || ' ~~~' || chr(10) || 'open'"
_LINES = f"l AS (SELECT doc_id, i - 1 AS n, lines[i] AS line FROM (SELECT doc_id, string_split({_FENCED}, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i)), m AS (SELECT *, regexp_matches(line, '^[\\t ]*(```|~~~)') AS fence FROM l), z AS (SELECT doc_id, n, line, fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 AS fenced FROM m)"


def _fenced(t: Read):
    text = F.concat(F.lit("# H\n```py\n# not a heading\n```\n"), F.col("text"), F.lit("\n## Tail "), F.col("doc_id").cast("string"), F.lit("\n ~~~\nopen"))
    return _docs(t).select("doc_id", text.alias("text"))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS lines, count(*) FILTER (fenced) AS fenced, cast(min(n) FILTER (fenced) AS INT) AS first_fenced FROM z GROUP BY doc_id")
def fence_state(t: Read):
    """W09"""
    return C.lines_of(_fenced(t)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("fenced").alias("fenced"), F.min(F.when(F.col("fenced"), F.col("line_no"))).alias("first_fenced"))


@query(f"""WITH {_LINES}, h AS (SELECT *, sum((regexp_matches(line, '^#{{1,6}}[\\t ]+[^\\t\\n\\f\\r ]') AND NOT fenced)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS chunk_no FROM z)
  SELECT doc_id, cast(chunk_no AS BIGINT) AS chunk_no, md5(regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY n), '^(?:[\\t\\f\\r ]*\\n)+', ''), '[\\t\\n\\f\\r ]+$', '')) AS md5, min_by(line, n) AS heading, cast(min(n) AS INT) AS start_line, cast(max(n) AS INT) AS end_line FROM h GROUP BY doc_id, chunk_no""")
def headings_chunk(t: Read):
    """Chunks led by headings; one inside a fence leads none."""
    return C.heading_chunks(_fenced(t)).select("doc_id", "chunk_no", F.md5("text").alias("md5"), "heading", "start_line", "end_line")


@query(f"""WITH {sentences_sql("SELECT doc_id, text FROM documents")},
  n AS (SELECT doc_id, count(*) AS careful FROM sent GROUP BY doc_id),
  e AS (SELECT doc_id, text, regexp_extract_all(text, '(?s)(.*?[.?!]+["''”’)\\]]*)(?:[\\s\x0B]|$)', 1) AS parts FROM documents)
  SELECT e.doc_id, coalesce(careful, 0)::INT AS careful, cast(len(list_filter(parts, lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13)) <> ''))
         + (trim(regexp_replace(text, '(?s)^.*[.?!]+["''”’)\\]]*([\\s\x0B]|$)', ''), ' ' || chr(10) || chr(9) || chr(13)) <> '')::INT AS INT) AS simple FROM e LEFT JOIN n USING (doc_id)""")
def sentence_split(t: Read):
    """Sentences by either splitter."""
    return _docs(t).select("doc_id", sentence_counts_udf("text").alias("n")).select("doc_id", "n.careful", "n.simple")


@query("""WITH s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, string_split(text, '. ') AS p FROM documents), range(1, len(p) + 1) r(i))
  SELECT doc_id, cast((n - 1) // 80 AS INT) AS batch, count(*) AS sentences, min(n) AS first_n, max(n) AS last_n FROM s GROUP BY ALL""")
def count_windows(t: Read):
    """Batches of eighty."""
    rows = _docs(t).select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("i", "s"))
    b = C.count_windows(rows, ["doc_id"], ["i"])
    return b.groupBy("doc_id", "batch").agg(F.count("*").alias("sentences"), F.min("n").cast("long").alias("first_n"), F.max("n").cast("long").alias("last_n"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, ls, i, CASE WHEN i < len(ls) THEN ls[i] || chr(10) ELSE ls[i] END AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), range(1, len(ls) + 1) r(i)),
  f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS n, substr(line, k * 1000 + 1, 1000) AS part FROM l, range(0, (length(line) + 999) // 1000) r(k)),
  p AS (SELECT doc_id, n, 1 AS chunk_no, length(part) AS filled FROM f WHERE n = 1 UNION ALL
        SELECT f.doc_id, f.n, chunk_no + (filled + length(part) > 1000)::INT, CASE WHEN filled + length(part) > 1000 THEN length(part) ELSE filled + length(part) END FROM p JOIN f ON f.doc_id = p.doc_id AND f.n = p.n + 1),
  c AS (SELECT doc_id, chunk_no, string_agg(part, '' ORDER BY n) AS text FROM p JOIN f USING (doc_id, n) GROUP BY doc_id, chunk_no)
  SELECT doc_id, cast(chunk_no AS INT) AS chunk_no, format('chunk-{:03d}', chunk_no) AS chunk_id, cast(length(text) AS INT) AS characters, sha256(text) AS sha256 FROM c""")
def greedy_pack(t: Read):
    """Lossless chunks of 1000 characters at most."""
    return C.pack_documents(_docs(t), 1000).select("doc_id", "chunk_no", "chunk_id", "characters", "sha256")


@query("""SELECT doc_id, i AS fragment, md5(substr(text, (i - 1) * 500 + 1, 500)) AS md5 FROM documents, range(1, cast(ceil(length(text) / 500.0) AS BIGINT) + 1) r(i)""")
def bounded_fragments(t: Read):
    """C10"""
    rows = _docs(t).select("doc_id", F.posexplode(C.bounded_fragments(F.col("text"), 500)).alias("i", "f"))
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("fragment"), F.md5("f").alias("md5"))


@query("""WITH f AS (SELECT doc_id, substr(text, (i - 1) * 500 + 1, 500) AS t FROM documents, range(1, cast(ceil(length(text) / 500.0) AS BIGINT) + 1) r(i))
  SELECT doc_id, count(*) AS total_chunks, sum(length(t))::BIGINT AS characters, sum(cast(ceil(length(t) / 4.0) AS BIGINT))::BIGINT AS total_tokens FROM f GROUP BY GROUPING SETS ((doc_id), ())""")
def manifest_rollup(t: Read):
    """Totals per document and over all."""
    rows = _docs(t).select("doc_id", F.explode(C.bounded_fragments(F.col("text"), 500)).alias("text")).withColumn("characters", F.length("text"))
    return C.manifest(rows)


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS len FROM v)"


@query(f"""WITH {_VEC}, w AS (SELECT *, lag(e) OVER o AS pe, lag(len) OVER o AS pl FROM n WINDOW o AS (PARTITION BY label ORDER BY vec_id)),
  s AS (SELECT vec_id, label, CASE WHEN pe IS NOT NULL THEN list_dot_product(e, pe) / (len * pl) END AS sim FROM w)
  SELECT vec_id, label, round(sim, 6) AS similarity, round(avg(sim) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM s""")
def smoothed_similarity(t: Read):
    """Similarity to the vector before, smoothed over neighbours."""
    w = W.partitionBy("label").orderBy("vec_id")
    e = t.embeddings.withColumn("before", F.lag("embedding").over(w))
    sim = F.when(F.col("before").isNotNull(), X.cosine(F.col("embedding"), F.col("before")))
    return C.semantic_breaks(e, "label", "vec_id", sim).select("vec_id", "label", F.round("similarity", 6).alias("similarity"), F.round("smooth", 6).alias("smooth"))


#: Vectors stand in groups of about fifty, as a document's facts do; the SQL of the queries that use them has the same
#: groups. The ``label_`` queries compare whole labels.
_GROUP = "cast(vec_id // 50 AS BIGINT)"


def _grouped(t: Read):
    return t.embeddings.withColumn("part", F.floor(F.col("vec_id") / 50).cast("long"))


@query(f"""WITH {_VEC}, g AS (SELECT *, {_GROUP} AS part FROM n)
  SELECT a.part, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) AS similarity FROM g a JOIN g b ON a.part = b.part AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.3""")
def cosine_pairs(t: Read):
    """J06 X23"""
    return V.cosine_pairs(_grouped(t), "part", "vec_id", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT label, cast(i - 1 AS INT) AS pos, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, len(embedding) + 1) r(i) GROUP BY label, i""")
def centroids(t: Read):
    """A20"""
    return V.centroids(t.embeddings, "label").withColumn("mean", F.round("mean", 6))


@query(f"""WITH RECURSIVE {_VEC}, g AS (SELECT *, {_GROUP} AS part FROM n),
  p AS (SELECT a.part, a.vec_id AS i, b.vec_id AS j FROM g a JOIN g b ON a.part = b.part WHERE a.vec_id = b.vec_id OR list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.5),
  r AS (SELECT part, i, j FROM p UNION SELECT r.part, r.i, p.j FROM r JOIN p ON p.part = r.part AND p.i = r.j)
  SELECT part, i AS vec_id, min(j) AS cluster FROM r GROUP BY part, i""")
def cosine_components(t: Read):
    """A21"""
    return V.clusters(_grouped(t), "part", "vec_id", 0.5)


@query(f"""WITH g AS (SELECT {_GROUP} AS part, label, vec_id, row_number() OVER (PARTITION BY {_GROUP}, label ORDER BY vec_id) - 1 AS pos, count(*) OVER (PARTITION BY {_GROUP}) AS total, count(*) OVER (PARTITION BY {_GROUP}, label) AS size FROM embeddings),
  c AS (SELECT *, greatest(1, cast(ceil(total / 8.0 * 1.5) AS INT)) AS cap FROM g)
  SELECT part, label, vec_id, cast(CASE WHEN size <= cap THEN 0 ELSE pos // cap END AS INT) AS piece FROM c""")
def split_clusters(t: Read):
    """Clusters over half more than an even share of eight sections split, in order."""
    g = _grouped(t)
    w = W.partitionBy("part", "label")
    rows = g.select("part", "label", "vec_id", (F.row_number().over(w.orderBy("vec_id")) - 1).alias("pos"), F.count("*").over(W.partitionBy("part")).alias("total"), F.count("*").over(w).alias("size")).withColumn("cap", V.split_size(F.col("total"), 8))
    return rows.select("part", "label", "vec_id", F.when(F.col("size") <= F.col("cap"), 0).otherwise(F.floor(F.col("pos") / F.col("cap"))).cast("int").alias("piece"))


@query(f"""WITH {_VEC}
  SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(list_dot_product(a.e, b.e) / (a.len * b.len), 6) AS similarity FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.3""")
def label_cosine_pairs(t: Read):
    """J06 X23 within labels, whatever their size."""
    return V.cosine_pairs(t.embeddings, "label", "vec_id", 0.3).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH RECURSIVE {_VEC},
  p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j FROM n a JOIN n b ON a.label = b.label WHERE a.vec_id = b.vec_id OR list_dot_product(a.e, b.e) / (a.len * b.len) >= 0.5),
  r AS (SELECT label, i, j FROM p UNION SELECT r.label, r.i, p.j FROM r JOIN p ON p.label = r.label AND p.i = r.j)
  SELECT label, i AS vec_id, min(j) AS cluster FROM r GROUP BY label, i""")
def label_cosine_components(t: Read):
    """A21 within labels, whatever their size."""
    return V.clusters(t.embeddings, "label", "vec_id", 0.5)


@query()
def coalesce_clusters(t: Read):
    """Labels of the table as clusters; small ones join their nearest, then the closest until five are left."""
    import numpy as np

    sizes = {r["label"]: r["n"] for r in t.embeddings.where("label is not null").groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    means = {(r["label"], r["pos"]): r["mean"] for r in V.centroids(t.embeddings, "label").collect()}  # labels x dimensions
    wide = 1 + max((pos for _, pos in means), default=-1)
    counts = [sizes[x] for x in labels]
    centres = [np.array([means[x, k] for k in range(wide)]) for x in labels]
    first = V.coalesce(centres, counts, 3)
    merged = [np.average([centres[k] for k in m], axis=0, weights=[counts[k] for k in m]) for m in first]
    final = V.agglomerate(merged, [sum(counts[k] for k in m) for m in first], 5)
    placed = [(labels[k], n) for n, group in enumerate(final) for g in group for k in first[g]]
    kind = dict(t.embeddings.dtypes)["label"]
    return t.embeddings.join(F.broadcast(t.spark.createDataFrame(placed, f"label {kind}, cluster int")), "label").select("label", "vec_id", "cluster")


@query()
def facility_topk(t: Read):
    """Five representatives of each label."""
    return V.choose(t.embeddings, "label", "vec_id", 5)


@query("SELECT a.doc_id, a.doc_id IN (SELECT doc_id FROM labels) AS in_labels FROM documents a")
def set_validation(t: Read):
    """Keys of one set that the other lacks, both ways."""
    d, keys = t.documents.select("doc_id"), t.labels.select("doc_id")
    return d.join(keys, "doc_id", "left_semi").withColumn("in_labels", F.lit(True)).unionByName(d.join(keys, "doc_id", "left_anti").withColumn("in_labels", F.lit(False)))


@query("""WITH k AS (SELECT doc_id, sha256('model-v1' || chr(10) || text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0)
  SELECT doc_id, k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c ON c.key = k.key""")
def cache_hit_miss(t: Read):
    """Which texts an embedding cache holds, by the hash of model and text."""
    k = _docs(t).select("doc_id", X.hash_key(F.lit("model-v1"), F.col("text"), separator="\n").alias("key"))
    stored = k.where("doc_id % 3 = 0").select("key").distinct()
    return k.join(stored.withColumn("hit", F.lit(True)), "key", "left").select("doc_id", "key", F.coalesce("hit", F.lit(False)).alias("hit"))


@query("""WITH c AS (SELECT conv_id, turn, '## chunk-' || lpad(cast(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 3, '0') || chr(10) || chr(10) || text AS part, text FROM conversations)
  SELECT conv_id, sha256(string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS sha256, count(*) AS chunks, sum(length(text))::BIGINT AS characters FROM c GROUP BY conv_id""")
def compiled_prefix(t: Read):
    """A27"""
    c = t.conversations.select("conv_id", F.col("turn").alias("chunk_no"), F.col("text").alias("reply"))
    sizes = c.groupBy("conv_id").agg(F.count("*").alias("chunks"), F.sum(F.length("reply")).alias("characters"))
    return P.compile_facts(c, "conv_id").select("conv_id", F.sha2("facts_text", 256).alias("sha256")).join(sizes, "conv_id")


@query("""SELECT item_id // 10 || '/' || item_id AS fact, row_number() OVER (ORDER BY item_id // 10, item_id) AS pos, sha256('# Source ' || lpad(cast(item_id % 100 AS VARCHAR), 2, '0') || chr(10) || chr(10) || text) AS sha256 FROM (SELECT item_id, min(text) AS text FROM (SELECT * FROM benchmark UNION ALL SELECT * FROM benchmark) GROUP BY item_id)""")
def golden_union(t: Read):
    """Facts named by chunk, each once, in order, numbered over ranges of them."""
    b = t.benchmark.unionByName(t.benchmark).groupBy("item_id").agg(F.min("text").alias("text"))
    chunk = F.floor(F.col("item_id") / 10).cast("long")
    head = F.concat(F.lit("# Source "), F.lpad((F.col("item_id") % 100).cast("string"), 2, "0"), F.lit("\n\n"), F.col("text"))
    facts = b.select(chunk.alias("chunk"), "item_id", F.sha2(head, 256).alias("sha256"))
    placed = sums_before(facts, ["chunk", "item_id"], {"before": F.lit(1).cast("long")}, writer(t.spark))
    return placed.select(F.concat_ws("/", F.col("chunk").cast("string"), F.col("item_id").cast("string")).alias("fact"), (F.col("before") + 1).alias("pos"), "sha256")


@query("""WITH g AS (SELECT user_id, event_type AS k, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY ALL), p AS (SELECT user_id, event_type AS k, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
  SELECT user_id, sum(least(coalesce(g.n, 0), coalesce(p.n, 0)))::BIGINT AS matched, sum(coalesce(g.n, 0) - least(coalesce(g.n, 0), coalesce(p.n, 0)))::BIGINT AS missed, sum(coalesce(p.n, 0) - least(coalesce(g.n, 0), coalesce(p.n, 0)))::BIGINT AS spurious FROM g FULL JOIN p USING (user_id, k) GROUP BY user_id""")
def multiset_spurious(t: Read):
    """Multiset match of even against odd events of a user: both sides count in one aggregate, so there is no join."""
    side = F.when(F.col("event_id") % 2 == 0, 1).otherwise(0)
    n = t.events.groupBy("user_id", "event_type").agg(F.sum(side).alias("g"), F.sum(1 - side).alias("p"))
    m = F.least("g", "p")
    return n.groupBy("user_id").agg(F.sum(m).alias("matched"), F.sum(F.col("g") - m).alias("missed"), F.sum(F.col("p") - m).alias("spurious"))


@query("""WITH c AS (SELECT doc_id, doc_id % 9 AS total, doc_id % 4 AS covered FROM documents)
  SELECT doc_id, 1 AS pass FROM c UNION ALL SELECT doc_id, 2 FROM c WHERE total >= 5 AND covered / total < 0.55""")
def escalation_union(t: Read):
    """K08 U07"""
    d = t.documents.select("doc_id")
    coverage = d.select("doc_id", (F.col("doc_id") % 9).alias("total"), (F.col("doc_id") % 4).alias("covered"))
    return P.escalate(d, lambda rows: rows, coverage, ["doc_id"]).select("doc_id", "pass")


@query("""SELECT d.doc_id, l.quality IS NULL AS parse_error, c.n AS reference_turns, CASE d.lang WHEN 'en' THEN 0.5 WHEN 'de' THEN 1.25 END AS cost FROM documents d LEFT JOIN labels l USING (doc_id) JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) c ON c.conv_id = d.doc_id""")
def judge_inputs(t: Read):
    """Source, reference and candidate by key, with the model's cost if it has one."""
    turns = t.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("reference_turns"))
    cost = F.create_map(F.lit("en"), F.lit(0.5), F.lit("de"), F.lit(1.25))
    rows = t.documents.select("doc_id", "lang").join(turns, "doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", F.col("quality").isNull().alias("parse_error"), "reference_turns", F.try_element_at(cost, F.col("lang")).alias("cost"))


@query("""WITH u AS (SELECT lang AS stage, doc_id AS unit, sha256(text) AS c FROM documents), s AS (SELECT stage, unit, CASE WHEN unit % 5 = 0 THEN 'old' ELSE c END AS c FROM u WHERE unit % 7 <> 0)
  SELECT u.stage, count(*) AS units, count(s.unit) AS reused FROM u LEFT JOIN s ON s.stage = u.stage AND s.unit = u.unit AND s.c = u.c GROUP BY u.stage""")
def reuse_counts(t: Read):
    """Stored responses that agree in all their hashes."""
    u = t.documents.select(F.col("lang").alias("stage"), F.col("doc_id").alias("unit"), F.sha2("text", 256).alias("content_sha"), F.lit("p1").alias("prompt_sha"), F.lit("u1").alias("upstream_sha"))
    stored = u.where("unit % 7 <> 0").withColumn("content_sha", F.when(F.col("unit") % 5 == 0, "old").otherwise(F.col("content_sha")))
    return CO.reuse_counts(u, stored)


@query()
def json_salvage(t: Read):
    """The last object of events' properties wrapped in noise."""
    noisy = F.concat(F.lit('So {not json} "{" then '), "props", F.lit(" and } done"))
    return t.events.select("event_id", S.last_object_udf(noisy).alias("object"), "props")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(((event_id % 3 = 0)::INT + 1 + (event_id % 2 = 0)::INT) / 3, 6) END AS field_score, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(((event_id % 3 = 0)::INT + 1 + 2.0 * (event_id % 2 = 0)::INT + 1 * (event_id % 2 = 1)::INT * 0) / 4, 6) END AS item_score FROM events""".replace("1 + (event_id % 2 = 0)::INT) / 3", "1 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0.5 END) / 3").replace("2.0 * (event_id % 2 = 0)::INT + 1 * (event_id % 2 = 1)::INT * 0", "CASE WHEN event_id % 2 = 0 THEN 2 ELSE 1 END"))
def structured_score(t: Read):
    """A label, a number within tolerance, and an array of two of which one may miss; every fifth reply lacks a field."""
    schema = {"type": "object", "required": ["name", "score", "tags"], "properties": {"name": {"type": "string"}, "score": {"type": "number", "evaluation_config": {"metrics": [{"metric_id": "number_tolerance", "params": {"tolerance": 0.5}}]}}, "tags": {"type": "array", "items": {"type": "string"}}}}
    e = F.col("event_id")
    gold = F.concat(F.lit('{"name":"n'), (e % 3).cast("string"), F.lit('","score":1.0,"tags":["a","b"]}'))
    tags = F.when(e % 5 == 0, "").when(e % 2 == 0, ',"tags":["b","a"]').otherwise(',"tags":["a","c"]')
    pred = F.concat(F.lit('{"name":"n0","score":1.25'), tags, F.lit("}"))
    return t.events.select("event_id", S.score_udf(schema)(gold, pred).alias("s")).select("event_id", F.round("s.field_score", 6).alias("field_score"), F.round("s.item_score", 6).alias("item_score"))


_PAGE_TABLE = '<p>x</p><table><tr><th>Name</th><th>N | M</th></tr><tr><td>a <b>b</b></td></tr></table>'


@query(f"SELECT page_id, 'Table 1' AS title, '| Name | N \\| M |' || chr(10) || '| --- | --- |' || chr(10) || '| a b |  |' AS markdown, cast(strlen(coalesce(html, '')) + 8 AS INT) AS start FROM pages")
def html_blocks(t: Read):
    """The pages, with a small table at the end of each."""
    text = F.concat(F.coalesce("html", F.lit("")), F.lit(_PAGE_TABLE))
    found = t.pages.select("page_id", F.explode(B.extract_udf(text)).alias("b"))
    return found.where("b.kind = 1").select("page_id", "b.title", "b.markdown", "b.start")


_TABLED = "'| h' || doc_id || ' | x |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || '```' || chr(10) || '| no | t |' || chr(10) || '|---|---|' || chr(10) || '```' || chr(10) || text"


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS n, lines[i] AS line FROM (SELECT doc_id, string_split({_TABLED}, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i)), m AS (SELECT *, regexp_matches(line, '^[\\t ]*(```|~~~)') AS fence FROM l),
  z AS (SELECT *, regexp_matches(line, '^\\s*\\|.*\\|\\s*$') AND NOT (fence OR sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1) AS is_row FROM m),
  r AS (SELECT *, sum((NOT is_row)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM z), h AS (SELECT *, lead(regexp_matches(line, '^\\s*\\|[\\s:|-]+\\|\\s*$') AND contains(line, '-')) OVER (PARTITION BY doc_id, run ORDER BY n) AS heads FROM r WHERE is_row),
  f AS (SELECT *, min(n) FILTER (heads) OVER (PARTITION BY doc_id, run) AS first_line FROM h)
  SELECT doc_id, cast(first_line AS INT) AS first_line, count(*) AS rows, string_agg(trim(line), chr(10) ORDER BY n) AS markdown, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS table_no FROM f WHERE n >= first_line GROUP BY doc_id, first_line""")
def block_union_dedup(t: Read):
    """Markdown tables of documents with one in front and one in a fence."""
    text = F.concat(F.lit("| h"), F.col("doc_id").cast("string"), F.lit(" | x |\n|---|---|\n| 1 | 2 |\n```\n| no | t |\n|---|---|\n```\n"), F.col("text"))
    return B.markdown_tables(_docs(t).select("doc_id", text.alias("text"))).withColumn("table_no", F.col("table_no").cast("long"))


@query("""SELECT doc_id, 'Item' AS title, '| # | Name | Size |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| 1 | n' || doc_id || ' | 5 |' || chr(10) || '| 2 | b |  |' || chr(10) || '| 3 | c | 7 |' AS markdown, 0.67 AS confidence FROM documents""")
def record_series(t: Read):
    """Three records of which one lacks a key."""
    text = F.concat(F.lit("Item #1\nName: n"), F.col("doc_id").cast("string"), F.lit("\nSize: 5\nitem 2\nName: b\nItem #3\nName: c\nSize: 7\nName: twice"))
    return _docs(t).select("doc_id", F.explode(B.extract_udf(text)).alias("b")).select("doc_id", "b.title", "b.markdown", "b.confidence")


@query("""SELECT doc_id, 'vtt' AS kind, 'so we begin ' || doc_id || chr(10) || chr(10) || 'after a pause' AS text FROM documents""")
def transcript_clean(t: Read):
    """Captions that overlap, then a pause."""
    raw = F.concat(F.lit("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n<c>so we</c> [music]\n\n00:00:02.000 --> 00:00:03.000\nSo we begin "), F.col("doc_id").cast("string"), F.lit("\n\n00:00:09,500 --> 00:00:10.000\nafter a pause\n"))
    return _docs(t).select("doc_id", TR.kind_udf(raw).alias("kind"), TR.clean_udf(raw).alias("text"))


@query()
def digest_pipeline(t: Read):
    """A27 A28 X25 K11 K12 P17 and the stages between, with a stand-in for the model: every document becomes a gated article."""
    return P.digest(_docs(t), P.first_line_completer, writer(t.spark)).select("doc_id", F.sha2("article", 256).alias("sha256"), "facts", "sections", "cited", "words", "gate")
