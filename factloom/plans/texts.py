"""Queries over single texts: counts, cleaning, specifics, parsing."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions.shingles import shingle_digests_udf, shingle_range_udf
from ..operators.chunks import spread
from ..operators.matching import tokens_held
from ..operators.tournament import degraded_udf
from .registry import Read, query

_WS = "[\\t\\n\\f\\r ]"
_SQUEEZE = f"trim(regexp_replace({{}}, '{_WS}+', ' ', 'g'))"
_NORM = _SQUEEZE.format("regexp_replace(lower(text), '([0-9]),([0-9])', '\\1\\2', 'g')")
_WORDS = f"CASE WHEN {_SQUEEZE.format('text')} = '' THEN 0 ELSE len(string_split({_SQUEEZE.format('text')}, ' ')) END"


def _docs(t: Read):
    return t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("""SELECT doc_id, cast(ceil(length(text) / 4.0) AS BIGINT) AS tokens, cast(strlen(text) AS INT) AS chars,
                 cast(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS INT) AS lines FROM documents""")
def doc_counts(t: Read):
    """Tokens, bytes (named chars) and lines of every document."""
    text = F.col("text")
    lines = F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
    return _docs(t).select("doc_id", X.token_estimate(text).alias("tokens"), F.octet_length(text).alias("chars"), lines.alias("lines"))


@query(f"SELECT doc_id, sha256({_NORM}) AS sha256, cast({_WORDS} AS INT) AS words FROM documents")
def norm_text_hash(t: Read):
    """X01 A29"""
    return _docs(t).select("doc_id", F.sha2(X.normalize(F.col("text")), 256).alias("sha256"), X.word_count(F.col("text")).alias("words"))


_BLOB = "'![a](data:image/png;base64,' || upper(substr(md5(cast(doc_id AS VARCHAR)), 1, 8)) || ')x' || repeat('QUJD', 200 + cast(doc_id % 100 AS INT)) || '== y '"


@query(f"""SELECT doc_id, cast(strlen(raw) - strlen(clean) AS INT) AS removed, sha256(clean) AS sha256 FROM (SELECT doc_id, raw,
           regexp_replace(regexp_replace(regexp_replace(raw, '!\\[[^\\]]*\\]\\(\\s*data:[^)]*\\)', '', 'g'),
           '(?i)<img[^>]*\\bsrc\\s*=\\s*["'']data:[^"'']*["''][^>]*>', '', 'g'), '[A-Za-z0-9+/]{{512}}[A-Za-z0-9+/]{{512}}[A-Za-z0-9+/]*={{0,2}}', '', 'g') AS clean
           FROM (SELECT doc_id, {_BLOB} || '<img src="data:x"> ' || text AS raw FROM documents))""")
def blob_strip(t: Read):
    """P01 over documents to which blobs of several lengths were added."""
    blob = F.concat(F.lit("![a](data:image/png;base64,"), F.upper(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8)), F.lit(")x"), F.repeat(F.lit("QUJD"), (F.lit(200) + F.col("doc_id") % 100).cast("int")), F.lit("== y "))
    raw = _docs(t).select("doc_id", F.concat(blob, F.lit('<img src="data:x"> '), F.col("text")).alias("raw")).withColumn("clean", X.strip_blobs(F.col("raw")))
    return raw.select("doc_id", (F.octet_length("raw") - F.octet_length("clean")).alias("removed"), F.sha2("clean", 256).alias("sha256"))


_SHINGLES = """w AS (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM {table}),
  s AS (SELECT DISTINCT {id}, array_to_string(words[i:i + 7], ' ') AS shingle FROM w, range(1, len(words) - 6) r(i) WHERE len(words) >= 8)"""


@query(f"WITH {_SHINGLES.format(id='doc_id', table='documents')} SELECT doc_id, count(*) AS shingles, min(shingle) AS first_shingle, max(shingle) AS last_shingle FROM s GROUP BY doc_id")
def word_shingles_8(t: Read):
    """W05"""
    rows = spread(_docs(t)).select("doc_id", shingle_range_udf(F.lower("text")).alias("s")).where("s.shingles > 0")
    return rows.select("doc_id", "s.shingles", "s.first_shingle", "s.last_shingle")


def overlap(docs, source, id_col: str, most: float):
    """Share of a text's distinct shingles that the source has, and whether the copy gate takes it out.

    Shingles are made once, as 128-bit digests, and each text's repeats are gone
    before they meet the source's, a table of any size: one outer join and one
    aggregate of the texts' rows, which stay where they are if Spark broadcasts
    the source.
    """
    known = source.select(F.explode(shingle_digests_udf(F.lower("text"))).alias("shingle")).distinct().withColumn("hit", F.lit(1))
    own = spread(docs).select(id_col, F.explode_outer(shingle_digests_udf(F.lower("text"))).alias("shingle"))
    counts = own.join(known, "shingle", "left").groupBy(id_col).agg(F.count("shingle").alias("shingles"), F.count("hit").alias("hits"))
    share = X.ratio(F.col("hits"), F.col("shingles"))
    return counts.select(id_col, "shingles", "hits", F.round(share, 6).alias("overlap"), (share > most).alias("copier"))


@query(f"""WITH {_SHINGLES.format(id='doc_id', table='documents')},
  bw AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM benchmark),
  b AS (SELECT DISTINCT array_to_string(words[i:i + 7], ' ') AS shingle FROM bw, range(1, len(words) - 6) r(i) WHERE len(words) >= 8)
  SELECT d.doc_id, count(s.shingle) AS shingles, count(b.shingle) AS hits, round(coalesce(count(b.shingle) / nullif(count(s.shingle), 0), 0), 6) AS overlap,
         coalesce(count(b.shingle) / nullif(count(s.shingle), 0), 0) > 0.06 AS copier
  FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN b ON b.shingle = s.shingle GROUP BY d.doc_id""")
def shingle_overlap_benchmark(t: Read):
    """The flagship: which documents copy the benchmark."""
    return overlap(_docs(t), t.benchmark, "doc_id", 0.06).orderBy(F.desc("overlap"), "doc_id")


_FACTS = "'## chunk-001' || chr(10) || '- The Voyager Probe cost $' || cast(doc_id AS VARCHAR) || ',250 and 9' || cast(doc_id % 7 AS VARCHAR) || '% of NASA staff, LYQM-85P, in New York City' || chr(10) || '- step 3 of 1234-567 for NATO' || chr(10) || text"
_LEAD = "'the','a','an','this','that','these','those','it','in','on','at','as','of','and','but','or','for','to','from','with','by','we','they','he','she','his','her','its','their'"
_SPECIFICS = f"""raw AS (SELECT doc_id, {_FACTS} AS text, text AS body FROM documents),
  plain AS (SELECT doc_id, body, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^[\\t\\f\\r ]*#')), chr(10)), '\\b(?:[0-9]*[A-Z][A-Z0-9]*-[A-Z0-9]{{3}}|[A-Z0-9]{{4}}-[0-9]*[A-Z][A-Z0-9]*)\\b', ' ', 'g') AS text FROM raw),
  found AS (SELECT doc_id, 1 AS kind, unnest(regexp_extract_all(text, '[$€£]?\\d[\\d,]*(?:\\.\\d+)?(?:%|[KMB])?')) AS s FROM plain
    UNION ALL SELECT doc_id, 2, unnest(regexp_extract_all(text, '\\b[A-Z]{{2,}}\\b')) FROM plain
    UNION ALL SELECT doc_id, 3, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+\\b')) FROM plain),
  ok AS (SELECT doc_id, kind, s FROM found WHERE kind = 2 OR kind = 1 AND (length(regexp_replace(s, '^[$€£]+', '')) >= 2 OR regexp_matches(s, '[$€£%]'))
    UNION ALL SELECT doc_id, 3, array_to_string(w, ' ') FROM (SELECT doc_id, CASE WHEN lower(ws[1]) IN ({_LEAD}) THEN ws[2:] ELSE ws END AS w
              FROM (SELECT doc_id, string_split({_SQUEEZE.format('s')}, ' ') AS ws FROM found WHERE kind = 3)) WHERE len(w) >= 2)"""


def _facts(t: Read):
    text = F.concat(F.lit("## chunk-001\n- The Voyager Probe cost $"), F.col("doc_id").cast("string"), F.lit(",250 and 9"), (F.col("doc_id") % 7).cast("string"), F.lit("% of NASA staff, LYQM-85P, in New York City\n- step 3 of 1234-567 for NATO\n"), F.col("text"))
    return spread(_docs(t)).select("doc_id", F.col("text").alias("body"), X.specifics(X.strip_id_codes(X.drop_heading_lines(text))).alias("found"))


@query(f"WITH {_SPECIFICS} SELECT doc_id, count(*) AS found, count(DISTINCT s) AS distinct_found, min(s) AS first_found, max(s) AS last_found FROM ok GROUP BY doc_id")
def specifics_extract(t: Read):
    """X04 X05 X06 P10 P11"""
    return _facts(t).select("doc_id", F.size("found").cast("long").alias("found"), F.size(F.array_distinct("found")).cast("long").alias("distinct_found"), F.array_min("found").alias("first_found"), F.array_max("found").alias("last_found"))


def _boundary_sql(norm: str, anchor: str) -> str:
    """X03 without look-around."""
    quoted = f"regexp_replace({anchor}, '([!-/:-@\\[-`{{-~])', '\\\\\\1', 'g')"
    left = f"CASE WHEN regexp_matches({anchor}, '^[0-9]') THEN '(?:^|[^0-9.]|(?:^|[^0-9])\\.)' WHEN regexp_matches({anchor}, '^[a-z]') THEN '(?:^|[^a-z])' ELSE '' END"
    right = f"CASE WHEN regexp_matches({anchor}, '[0-9]$') THEN '(?:$|[^0-9.]|\\.(?:$|[^0-9]))' WHEN regexp_matches({anchor}, '[a-z]$') THEN '(?:$|[^a-z])' ELSE '' END"
    return f"({anchor} <> '' AND regexp_matches({norm}, {left} || {quoted} || {right}))"


@query(f"""WITH {_SPECIFICS}, n AS (SELECT DISTINCT ok.doc_id, {_SQUEEZE.format("regexp_replace(lower(s), '([0-9]),([0-9])', '\\1\\2', 'g')")} AS norm FROM ok),
  article AS (SELECT doc_id, {_NORM} AS body FROM documents)
  SELECT doc_id, count(*) AS total, count(*) FILTER (strpos(body, norm) > 0 AND {_boundary_sql('body', 'norm')}) AS covered FROM n JOIN article USING (doc_id) WHERE norm <> '' GROUP BY doc_id""")
def specifics_coverage(t: Read):
    """Distinct normalized specifics of the facts, and how many the article has."""
    rows = _facts(t).select("doc_id", X.normalize(F.col("body")).alias("body"), F.array_distinct(F.transform("found", X.normalize)).alias("norms"))
    return rows.select("doc_id", F.inline(F.array(tokens_held("body", "norms")))).where("total > 0")  # a generator's input is made once, whatever follows


@query(f"""WITH l AS (SELECT doc_id, i, lines[i] AS line, regexp_replace({_SQUEEZE.format('lower(lines[i])')}, '^[[:punct:]\\p{{P}}]+|[[:punct:]\\p{{P}}]+$', '', 'g') AS k
             FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) AS n FROM l)
  SELECT doc_id, count(*) AS lines, count(*) FILTER (n = 1 OR k = '') AS kept, sha256(string_agg(line, chr(10) ORDER BY i) FILTER (n = 1 OR k = '')) AS sha256 FROM r GROUP BY doc_id""".replace("[[:punct:]\\p{P}]", "\\p{P}"))
def line_dedup(t: Read):
    """Of lines with one fact key in a document, the first stays; lines of a blank key all stay."""
    rows = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("k", X.fact_key(F.col("line")))
    first = F.row_number().over(W.partitionBy("doc_id", "k").orderBy("i")) == 1
    kept = rows.withColumn("keep", first | (F.col("k") == ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("keep"), F.struct("i", "line")))), lambda s: s["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("keep").alias("kept"), F.sha2(text, 256).alias("sha256"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www[.]', ''), '[?#].*$', ''), '/+$', '') AS norm FROM pages""")
def url_norm(t: Read):
    """X11"""
    return t.pages.select("page_id", X.url_normalize(F.col("url")).alias("norm"))


@query("""SELECT a.c_custkey AS id, round(1 - levenshtein(lower(a.c_name), lower(b.c_mktsegment || b.c_name)) / greatest(length(a.c_name), length(b.c_mktsegment || b.c_name)), 6) AS similarity
          FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1""")
def levenshtein_sim(t: Read):
    """X10"""
    b = t.customer.select((F.col("c_custkey") - 1).alias("id"), F.concat("c_mktsegment", "c_name").alias("other"))
    return t.customer.select(F.col("c_custkey").alias("id"), "c_name").join(b, "id").select("id", F.round(X.levenshtein_similarity(F.col("c_name"), F.col("other")), 6).alias("similarity"))


@query(f"""SELECT doc_id, {_SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(regexp_replace('# T ' || doc_id || chr(13) || chr(10) || '- *a* b_' || chr(10) || text, '\\r\\n?', chr(10), 'g'), '(?m)^#+[\\t\\n\\f\\r ]+', '', 'g'), '(?m)^[-*][\\t\\n\\f\\r ]+', '', 'g'), '[*_]', '', 'g')[length('T ' || doc_id) + 1:]")} AS canonical FROM documents""")
def canonicalize_md(t: Read):
    """P09 over documents under a heading and a bullet."""
    raw = F.concat(F.lit("# T "), F.col("doc_id").cast("string"), F.lit("\r\n- *a* b_\n"), F.col("text"))
    return _docs(t).select("doc_id", X.canonicalize(raw).alias("canonical"))


_STOPS = r"""regexp_extract_all(regexp_replace(text, '([.?!]["'')]*)([ \n\t]|$)', '\1' || chr(1) || '\2', 'g'), '[^\x01]+')"""
_ENDS = "trim({}, chr(9) || chr(10) || chr(12) || chr(13) || ' ')"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\t\n\f\r ]+') AS words, string_split(regexp_replace({_ENDS.format('text')}, '\n[\t\n\f\r ]*\n', chr(2), 'g'), chr(2)) AS p,
               list_filter(list_transform({_STOPS}, lambda x: {_ENDS.format('x')}), lambda x: x <> '') AS s FROM d)
  SELECT doc_id, md5(array_to_string(list_reverse(p), chr(10) || chr(10))) AS shuffled,
         md5(array_to_string(CASE WHEN len(words) * 45 // 100 < 1 THEN words ELSE words[1:len(words) * 45 // 100] END, ' ')) AS truncated,
         md5(coalesce(array_to_string(list_transform(s, lambda x: '- ' || x || chr(10)), ''), '')) AS listified,
         md5(CASE WHEN len(s) <= 2 THEN text ELSE array_to_string(s[2:len(s) - 1], ' ') END) AS without_ends FROM w""")
def degradations(t: Read):
    """Paragraphs in reverse, the first 45 % of words, every sentence a bullet, no first and last sentence."""
    rows = _docs(t).select("doc_id", degraded_udf("shuffle", "truncate", "listify", "drop_ends")("text").alias("worse"))
    return rows.select("doc_id", F.md5("worse.shuffle").alias("shuffled"), F.md5("worse.truncate").alias("truncated"), F.md5("worse.listify").alias("listified"), F.md5("worse.drop_ends").alias("without_ends"))


@query("""WITH l AS (SELECT doc_id, i AS line_no, list_transform(string_split(trim(lines[i]), '|'), lambda c: trim(c)) AS c0 FROM (SELECT doc_id, string_split(text || chr(10) || '| Model | Score |' || chr(10) || '|---|:-:|' || chr(10) || '| m' || doc_id || ' | 1,' || doc_id || '.5 pts |', chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i) WHERE contains(lines[i], '|')),
  a AS (SELECT doc_id, line_no, CASE WHEN c0[1] = '' THEN c0[2:] ELSE c0 END AS c1 FROM l), b AS (SELECT doc_id, line_no, CASE WHEN len(c1) > 0 AND c1[-1] = '' THEN c1[1:len(c1) - 1] ELSE c1 END AS c FROM a)
  SELECT doc_id, line_no, cast(len(c) AS INT) AS cells, c[1] AS head, try_cast(replace(regexp_extract(c[-1], '-?[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', '') AS DOUBLE) AS number
  FROM b WHERE len(list_filter(c, lambda x: NOT regexp_matches(x, '^:?-*:?$'))) > 0""")
def pipe_table_rows(t: Read):
    """X21 X20 over the documents' lines with a pipe and a small table added to each."""
    table = F.concat(F.col("text"), F.lit("\n| Model | Score |\n|---|:-:|\n| m"), F.col("doc_id").cast("string"), F.lit(" | 1,"), F.col("doc_id").cast("string"), F.lit(".5 pts |"))
    rows = _docs(t).select("doc_id", F.posexplode(F.split(table, "\n")).alias("i", "line")).where(F.contains("line", F.lit("|")))
    cells = rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), X.pipe_cells(F.col("line")).alias("c")).where("c is not null")
    return cells.select("doc_id", "line_no", F.size("c").alias("cells"), F.col("c")[0].alias("head"), X.first_number(F.element_at("c", -1)).alias("number"))


@query("""WITH c AS (SELECT conv_id, turn, role || ' says: ' || CASE turn % 4 WHEN 0 THEN 'Bug Report!' WHEN 1 THEN 'a question, or praise?' WHEN 2 THEN 'praiseworthy' ELSE 'Praise.' END AS raw FROM conversations),
  n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(raw), '[^\\p{L}\\p{N}\\t\\n\\f\\r ]+', ' ', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g')) AS norm FROM c),
  h AS (SELECT *, list_filter(['bug report', 'question', 'praise'], lambda a: contains(' ' || norm || ' ', ' ' || a || ' ')) AS hit FROM n)
  SELECT conv_id, turn, norm, CASE WHEN len(hit) = 1 THEN hit[1] END AS label FROM h""")
def label_parse(t: Read):
    """X07 X08"""
    said = F.when(F.col("turn") % 4 == 0, "Bug Report!").when(F.col("turn") % 4 == 1, "a question, or praise?").when(F.col("turn") % 4 == 2, "praiseworthy").otherwise("Praise.")
    raw = F.concat("role", F.lit(" says: "), said)
    return t.conversations.select("conv_id", "turn", X.label_normalize(raw).alias("norm"), X.parse_label(raw, ["bug report", "question", "praise"]).alias("label"))


@query(f"""WITH r AS (SELECT doc_id, chr(65279) || '# Head' || chr(13) || chr(10) || text || ' ABCD-12E 1234-567' AS raw FROM documents),
  s AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g') AS text FROM r),
  c AS (SELECT doc_id, text, regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda s: NOT regexp_matches(s, '^[\\t\\f\\r ]*#')), chr(10)), '\\b(?:[0-9]*[A-Z][A-Z0-9]*-[A-Z0-9]{{3}}|[A-Z0-9]{{4}}-[0-9]*[A-Z][A-Z0-9]*)\\b', ' ', 'g') AS clean, {_WORDS} AS words FROM s)
  SELECT doc_id, sha256(clean) AS sha256, cast(words AS INT) AS words, strlen(text) // greatest(words, 1) > 40 AS dense, trim(clean) <> '' AND NOT contains(lower(clean), 'could not be generated') AND NOT contains(lower(clean), 'empty response') AS reusable,
         words BETWEEN 20 AND 4000 AS in_band FROM c""")
def text_hygiene(t: Read):
    """P02 P10 P11 P13 P17 S02"""
    raw = F.concat(F.lit("﻿# Head\r\n"), F.col("text"), F.lit(" ABCD-12E 1234-567"))
    rows = _docs(t).select("doc_id", X.normalize_input(raw).alias("text")).withColumn("clean", X.strip_id_codes(X.drop_heading_lines(F.col("text")))).withColumn("words", X.word_count(F.col("text")))
    return rows.select("doc_id", F.sha2("clean", 256).alias("sha256"), "words", X.dense(F.col("text")).alias("dense"), X.reusable(F.col("clean")).alias("reusable"), F.col("words").between(20, 4000).alias("in_band"))


@query("SELECT doc_id, cast(ceil(length(text) / 4.0) AS BIGINT) AS tokens, cast(greatest(1, ceil(length(text) / 16000.0)) AS BIGINT) AS chunks_at_4000, 4000 * 4 AS size_chars, 200 * 4 AS overlap_chars FROM documents")
def token_estimate(t: Read):
    """Budgets in tokens are four times as many characters."""
    return _docs(t).select("doc_id", X.token_estimate(F.col("text")).alias("tokens"), F.greatest(F.lit(1), F.ceil(F.length("text") / 16000)).cast("long").alias("chunks_at_4000"), F.lit(16000).alias("size_chars"), F.lit(800).alias("overlap_chars"))


@query("""WITH l AS (SELECT doc_id, i, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), range(1, len(lines) + 1) r(i)),
  o AS (SELECT doc_id, i AS line_no, strlen(line) AS bytes, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset FROM l)
  SELECT doc_id, line_no, cast(bytes AS INT) AS bytes, cast(byte_offset AS BIGINT) AS byte_offset FROM o""")
def line_offsets(t: Read):
    """C13 C17"""
    rows = _docs(t).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    before = W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.octet_length("line").alias("bytes"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long").alias("byte_offset"))


@query("""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  r AS (SELECT conv_id, turn, n, coalesce(prev, '') AS winner, '{"winner": "' || CASE turn % 3 WHEN 0 THEN ' a ' WHEN 1 THEN 'B' ELSE 'C' END || '"} because "' || CASE WHEN turn % 2 = 0 THEN 'nothing of it' ELSE replace(substr(coalesce(prev, ''), 3, 15), '"', '') END || '" pick ' || (turn + 1) AS reply FROM c),
  q AS (SELECT *, regexp_extract_all(reply, '"([^"]{8,})"', 1) AS quotes FROM r)
  SELECT conv_id, turn, CASE WHEN upper(trim(regexp_extract(reply, '"winner": "([^"]*)"', 1))) IN ('A', 'B') THEN upper(trim(regexp_extract(reply, '"winner": "([^"]*)"', 1))) END AS verdict,
         CASE WHEN try_cast(regexp_extract(reply, '[0-9]+') AS INT) < n THEN try_cast(regexp_extract(reply, '[0-9]+') AS INT) END AS pick,
         len(list_filter(quotes, lambda x: contains(trim(regexp_replace(lower(winner), '[\\t\\n\\f\\r ]+', ' ', 'g')), trim(regexp_replace(lower(x), '[\\t\\n\\f\\r ]+', ' ', 'g'))))) > 0 AS grounded FROM q""")
def grounded_reasons(t: Read):
    """A turn's reply quotes the turn before it, or nothing."""
    by = W.partitionBy("conv_id")
    prev = F.coalesce(F.lag("text").over(by.orderBy("turn")), F.lit(""))
    rows = t.conversations.select("conv_id", "turn", prev.alias("winner"), F.count("*").over(by).alias("n"))
    said = F.when(F.col("turn") % 3 == 0, " a ").when(F.col("turn") % 3 == 1, "B").otherwise("C")
    quote = F.when(F.col("turn") % 2 == 0, "nothing of it").otherwise(F.replace(F.substring("winner", 3, 15), F.lit('"'), F.lit("")))
    reply = F.concat(F.lit('{"winner": "'), said, F.lit('"} because "'), quote, F.lit('" pick '), (F.col("turn") + 1).cast("string"))
    rows = rows.withColumn("reply", reply)
    verdict = F.upper(F.trim(F.regexp_extract("reply", '"winner": "([^"]*)"', 1)))
    return rows.select("conv_id", "turn", F.when(verdict.isin("A", "B"), verdict).alias("verdict"), X.first_integer(F.col("reply"), F.col("n")).alias("pick"), X.grounded(F.col("reply"), F.col("winner")).alias("grounded"))


@query("""WITH e AS (SELECT event_id, cast(floor(epoch(ts)) AS BIGINT) AS s, event_id % 4 AS k FROM events),
  x AS (SELECT event_id, CASE k WHEN 0 THEN s WHEN 1 THEN s * 1000 ELSE NULL END AS num, CASE k WHEN 2 THEN strftime(to_timestamp(s) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') WHEN 3 THEN 'soon' END AS txt, s FROM e),
  y AS (SELECT event_id, CASE WHEN num > 10000000000 THEN num // 1000 ELSE num END AS a, CASE WHEN txt LIKE '%Z' THEN s END AS b FROM x)
  SELECT event_id, coalesce(a, b) AS expires, CASE WHEN coalesce(a, b) IS NULL THEN 'none' ELSE (coalesce(a, b) % 864000) // 86400 || 'd ' || (coalesce(a, b) % 86400) // 3600 || 'h' END AS left_text FROM y""")
def expiry_coalesce(t: Read):
    """Epoch seconds, milliseconds (over 1e10) or RFC 3339, the first valid; and a span of time as text."""
    s, k = F.unix_seconds(F.col("ts").cast("timestamp")), F.col("event_id") % 4
    rows = t.events.select("event_id", F.when(k == 0, s).when(k == 1, s * 1000).alias("num"), F.when(k == 2, F.date_format(F.timestamp_seconds(s), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 3, "soon").alias("txt"))
    number = F.when(F.col("num") > 10_000_000_000, F.floor(F.col("num") / 1000)).otherwise(F.col("num")).cast("long")
    at = F.coalesce(number, F.unix_seconds(F.try_to_timestamp("txt", F.lit("yyyy-MM-dd'T'HH:mm:ssX"))))
    part = lambda most, unit: F.floor((F.col("expires") % most) / unit).cast("string")
    return rows.select("event_id", at.alias("expires")).withColumn("left_text", F.when(F.col("expires").isNull(), "none").otherwise(F.concat(part(864000, 86400), F.lit("d "), part(86400, 3600), F.lit("h"))))


@query("""SELECT event_id, cast(least(500 * pow(2, event_id % 6), 8000) AS BIGINT) AS delay_ms, CASE WHEN event_id % 5 IN (0, 1) THEN 'systemic' WHEN event_id % 5 IN (2, 3) THEN 'retryable' ELSE 'other' END AS error_class,
          CASE event_id % 3 WHEN 0 THEN 'merit' WHEN 1 THEN 'comedy' ELSE 'publish' END AS criterion,
          CASE WHEN event_id % 7 = 0 THEN 'skipped' WHEN event_id % 7 = 1 THEN 'error' WHEN event_id % 7 = 2 THEN 'unparseable' WHEN event_id % 2 = 0 THEN 'ok' ELSE 'wrong' END AS status, floor(value * 100 + 0.5) / 100 AS rounded,
          cast(len(list_filter(list_transform(string_split(trim(regexp_replace(lower(props), '[\\t\\n\\f\\r ]+', ' ', 'g')), ' '), lambda w: regexp_replace(w, '^\\p{P}+|\\p{P}+$', '', 'g')), lambda w: w <> '')) AS INT) AS tokens FROM events""")
def status_classes(t: Read):
    """X34 X37 X38 X40 X41 X42"""
    from ..operators.metrics import criterion, error_class, prediction_status

    e = F.col("event_id")
    code = F.when(e % 5 == 0, 401).when(e % 5 == 1, 402).when(e % 5 == 2, 429).when(e % 5 == 3, 503).otherwise(400)
    status = prediction_status(skipped=e % 7 == 0, error=e % 7 == 1, pred=F.when(e % 7 != 2, (e % 2).cast("string")), gold=F.lit("0"))
    return t.events.select("event_id", X.retry_delay_ms(e % 6 + 1).alias("delay_ms"), error_class(code).alias("error_class"), criterion(e % 3).alias("criterion"), status.alias("status"), X.confidence(F.col("value")).alias("rounded"), F.size(X.fact_tokens(F.col("props"))).alias("tokens"))
