"""Queries over articles: their sentences, and verdicts on these."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import chunks as C
from ..operators import evaluation as EV
from ..operators import pipeline as P
from ..operators import precision as PR
from ..operators.completion import complete
from .registry import Read, query
from .tables import writer

# Documents with citation marks behind every third period, and a paragraph that is nothing else.
_CITED = "regexp_replace(text, '\\. ([^.]*\\. [^.]*\\.)', ' [F' || doc_id % 9 || ', f3]. \\1', 'g') || chr(10) || chr(10) || '[F1, 22]' || chr(10) || '- a point [F2] .'"


def sentences_sql(source: str) -> str:
    """CTEs that end in sent (doc_id, pos, raw): the careful splitter's rules, each on its own: lines, then marks, then what is between these."""
    quotes = "'\"''([{'"
    return f"""src AS ({source}),
  lines AS (SELECT doc_id, i, trim(ls[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src), range(1, len(ls) + 1) r(i)),
  fences AS (SELECT *, line LIKE '```%' OR line LIKE '~~~%' AS fence, sum((line LIKE '```%' OR line LIKE '~~~%')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS marks FROM lines),
  kinds AS (SELECT *, CASE WHEN fence OR line = '' OR line LIKE '#%' THEN 'break' WHEN regexp_matches(line, '^([-*+] |[0-9]+\\. .)') AND (regexp_matches(line, '^[-*+]') OR length(line) >= 4) THEN 'bullet' ELSE 'plain' END AS kind
            FROM fences WHERE fence OR marks % 2 = 0),
  groups AS (SELECT *, count(*) FILTER (kind <> 'plain') OVER (PARTITION BY doc_id ORDER BY i) AS part FROM kinds),
  paras AS (SELECT doc_id, min(i) AS i, string_agg(line, ' ' ORDER BY i) AS s FROM groups WHERE kind = 'plain' GROUP BY doc_id, part),
  marks AS (SELECT doc_id, i, unnest(string_split_regex(s, '[.!?]')) AS part, unnest(regexp_extract_all(s, '[.!?]')) AS mark, generate_subscripts(string_split_regex(s, '[.!?]'), 1) AS k FROM paras),
  dots AS (SELECT doc_id, i, mark, cast(sum(length(part) + 1) OVER o AS BIGINT) AS p, ltrim(lead(part) OVER o, ' ' || chr(9)) AS after, lead(part) OVER o AS nxt, lead(mark) OVER o IS NULL AS last,
                  {" || ".join(f"coalesce(lag(part || mark, {n}) OVER o, '')" for n in range(5, 0, -1))} || part AS behind FROM marks WINDOW o AS (PARTITION BY doc_id, i ORDER BY k)),
  words AS (SELECT *, ltrim(regexp_extract(behind, '[^ \t\n\r]*$'), {quotes}) AS word FROM dots WHERE mark IS NOT NULL),
  ends AS (SELECT doc_id, i, p FROM words WHERE NOT (regexp_matches(behind, '[0-9]$') AND regexp_matches(nxt, '^[0-9]'))
           AND CASE WHEN after = '' THEN last ELSE substr(after, 1, 1) <> lower(substr(after, 1, 1)) AND lower(trim(rtrim(word, {quotes}), '.'))
               NOT IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sr', 'jr', 'st', 'vs', 'etc', 'e.g', 'i.e', 'u.s', 'u.k') AND (rtrim(word, {quotes}) = 'I' OR NOT regexp_matches(rtrim(word, {quotes}), '^[\\x00-\\x7F]$')) END),
  cuts AS (SELECT doc_id, i, p, lag(p, 1, 0) OVER (PARTITION BY doc_id, i ORDER BY p) AS before FROM (SELECT doc_id, i, p FROM ends UNION SELECT doc_id, i, length(s) FROM paras)),
  sent AS (SELECT doc_id, i * 1000000 + p AS pos, trim(substr(s, before + 1, p - before), ' ' || chr(9)) AS raw FROM cuts JOIN paras USING (doc_id, i) WHERE trim(substr(s, before + 1, p - before), ' ' || chr(9)) <> '' UNION ALL
           SELECT doc_id, i * 1000000, line FROM groups WHERE kind = 'bullet')"""


_STRIPPED = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\\[[Ff][0-9]+(?:[\\t\\n\\f\\r ]*,[\\t\\n\\f\\r ]*[Ff]?[0-9]+)*\\]', '', 'g'), ' +([.,;:!?)])', '\\1', 'g'), '\\( +', '(', 'g'), ' {2,}', ' ', 'g'), ' ' || chr(9))"


def precision_judge(prompt: str) -> str:
    """A deterministic stand-in for a judge: by the length of a batch's first sentence its reply is broken, misnumbered or whole; sentences of a length that three divides aren't supported."""
    lines = [re.match(r"([0-9]+)\. (.*)", x, re.S) for x in prompt.rpartition(PR.SENTENCES)[2].split("\n")]
    found = [(int(m[1]), m[2]) for m in lines if m]
    kind = len(found[0][1]) % 9
    if kind == 0:
        return "I would rather not say"
    shift = 1 if kind == 1 else 0
    return "so: " + json.dumps({"verdicts": [{"index": i + shift, "supported": len(s) % 3 != 0, "reason": " not in the facts "} for i, s in found]})


@query(f"""WITH {sentences_sql(f"SELECT doc_id, {_CITED} AS text FROM documents")},
  c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx, sentence FROM (SELECT doc_id, pos, {_STRIPPED} AS sentence FROM sent) WHERE sentence <> ''),
  b AS (SELECT *, (idx - 1) // 80 AS batch, first_value(length(sentence) % 9) OVER (PARTITION BY doc_id, (idx - 1) // 80 ORDER BY idx) AS kind FROM c)
  SELECT doc_id, count(*) AS sentences, count(*) FILTER (kind > 1 AND length(sentence) % 3 <> 0) AS supported, round(count(*) FILTER (kind > 1 AND length(sentence) % 3 <> 0) / count(*), 6) AS precision,
         count(*) FILTER (kind = 0) AS malformed, count(*) FILTER (kind = 1) AS wrong_set, md5(string_agg(sentence, chr(10) ORDER BY idx)) AS md5 FROM b GROUP BY doc_id""")
def cited_precision(t: Read):
    """Sentences of cited documents, marks stripped, judged in batches of eighty."""
    third = F.regexp_replace(F.coalesce("text", F.lit("")), F.lit(r"\. ([^.]*\. [^.]*\.)"), F.concat(F.lit(" [F"), (F.col("doc_id") % 9).cast("string"), F.lit(", f3]. $1")))
    docs = t.documents.select("doc_id", F.concat(third, F.lit("\n\n[F1, 22]\n- a point [F2] .")).alias("text"))
    write = writer(t.spark)
    sentences = write(PR.cited_sentences(docs))
    facts = t.documents.select("doc_id", F.col("source").alias("facts"))
    judged = write(PR.judged_sentences(sentences, facts, lambda prompts: write(complete(prompts, precision_judge))))
    told = judged.groupBy("doc_id").agg(F.count_if(F.col("reason") == PR.MALFORMED).alias("malformed"), F.count_if(F.col("reason") == PR.WRONG_SET).alias("wrong_set"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "sentence"))), lambda s: s["sentence"]), "\n")).alias("md5"))
    found = PR.precision(judged).withColumn("precision", F.round("precision", 6))
    return found.join(told, "doc_id")


def letter_embedder(texts: list[str]) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: how often a text has each letter from a to z."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


@query()
def semantic_budget(t: Read):
    """Documents in chunks of lines that are alike, of 300 to 1500 characters where they can be."""
    found = C.semantic_chunks(t.documents.select("doc_id", "text"), letter_embedder, least=300, most=1500, threshold=0.93)
    return found.select("doc_id", "chunk_no", "characters", "paragraphs", F.md5("text").alias("md5"))


_WORDS_OF = "CASE WHEN len(ws) = 0 THEN 'none' ELSE ws[1 + ({} * 7) % len(ws)] END"


def _w(k: int):
    return F.when(F.size("ws") == 0, "none").otherwise(F.get("ws", (F.lit(k * 7) % F.greatest(F.size("ws"), F.lit(1))).cast("int")))


def _mixed_sql() -> str:
    w = _WORDS_OF.format
    nl = " || chr(10) || "
    page = f"'<table><tr><th>' || {w(1)} || '</th><th>' || {w(2)} || '</th></tr>' || chr(10) || '<tr><td> ' || {w(3)} || '</td><td><b>' || {w(4)} || '</b></td></tr></table>'"
    series = f"'Entry #1'{nl}'Name: ' || {w(5)}{nl}'Size: ' || {w(6)}{nl}'Entry #2'{nl}'Name: ' || {w(7)}{nl}'Entry #3'{nl}'Size: ' || {w(8)}{nl}'Name: ' || {w(9)}"
    rows = f"'| ' || {w(10)} || ' | ' || {w(11)} || ' |'{nl}'|:--|---|'{nl}'| ' || {w(12)} || ' |  |'"
    again = f"'| ' || {w(1)} || ' | ' || {w(2)} || ' |'{nl}'| --- | --- |'{nl}'| ' || {w(3)} || ' | ' || {w(4)} || ' |'"
    told = f"'| # | Name | Size |'{nl}'| --- | --- | --- |'{nl}'| 1 | ' || {w(5)} || ' | ' || {w(6)} || ' |'{nl}'| 2 | ' || {w(7)} || ' |  |'{nl}'| 3 | ' || {w(9)} || ' | ' || {w(8)} || ' |'"
    return f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents),
  p AS (SELECT doc_id, strlen(text) + 1 AS base, {page} AS page, {series} AS series, {rows} AS rows, {again} AS again, {told} AS told FROM d)
  SELECT doc_id, 1 AS kind, 'Table 1' AS title, again AS markdown, 1.0::DOUBLE AS confidence, cast(base AS INT) AS start FROM p UNION ALL
  SELECT doc_id, 2, 'Entry', told, 0.67, cast(base + strlen(page) + 1 AS INT) FROM p UNION ALL
  SELECT doc_id, 0, 'Table 1', rows, 1.0, cast(base + strlen(page) + strlen(series) + 2 AS INT) FROM p"""


@query(_mixed_sql())
def mixed_blocks(t: Read):
    """Documents that go on with an HTML table, a record series and two tables of their own words; the last says what the first says."""
    nl = F.lit("\n")
    row = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    page = F.concat(F.lit("<table><tr><th>"), _w(1), F.lit("</th><th>"), _w(2), F.lit("</th></tr>\n<tr><td> "), _w(3), F.lit("</td><td><b>"), _w(4), F.lit("</b></td></tr></table>"))
    series = F.concat(F.lit("Entry #1\nName: "), _w(5), F.lit("\nSize: "), _w(6), F.lit("\nEntry #2\nName: "), _w(7), F.lit("\nEntry #3\nSize: "), _w(8), F.lit("\nName: "), _w(9))
    first = F.concat(row(_w(10), _w(11)), F.lit("\n|:--|---|\n| "), _w(12), F.lit(" |  |"))
    again = F.concat(row(_w(1), _w(2)), F.lit("\n| --- | --- |\n"), row(_w(3), _w(4)))
    docs = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("ws", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    mixed = docs.select("doc_id", F.concat("text", nl, page, nl, series, nl, first, F.lit("\n\n"), again).alias("text"))
    found = mixed.select("doc_id", F.explode(B.extract_udf("text")).alias("b")).select("doc_id", "b.*")
    return found.where("confidence >= 0.6").select("doc_id", "kind", "title", "markdown", "confidence", "start")


def _kept_sql(*groups: str) -> str:
    return " AND ".join(f"regexp_matches(norm, '(?:^|[^a-z])(?:{g})(?:$|[^a-z])')" for g in groups)


@query(f"""WITH d AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(lower(text), '([0-9]),([0-9])', '\\1\\2', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g')) AS norm FROM documents),
  c AS (SELECT doc_id, norm, list_filter([CASE WHEN {_kept_sql("the", "and")} THEN 'english' END, CASE WHEN {_kept_sql("der|die", "und|nicht")} THEN 'german' END, CASE WHEN {_kept_sql("le|la", "de", "que|et")} THEN 'romance' END], lambda x: x IS NOT NULL) AS tensions,
        list_filter([CASE WHEN contains(substr(norm, 1, 400), 'it is') THEN 'It is' END, CASE WHEN contains(substr(norm, 1, 400), 'is the') THEN 'is the' END], lambda x: x IS NOT NULL) AS preamble,
        list_filter([CASE WHEN contains(norm, '###') THEN '###' END, CASE WHEN contains(norm, ' | ') THEN '|' WHEN contains(norm, '|') THEN '|' END], lambda x: x IS NOT NULL) AS artifacts,
        list_filter([CASE WHEN contains(norm, 'license') THEN 'License' END], lambda x: x IS NOT NULL) AS fabricated,
        CASE WHEN norm = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[\\t\\n\\f\\r ]+', ' ', 'g')), ' ')) END AS words FROM d)
  SELECT doc_id, array_to_string(tensions, ',') AS tensions, array_to_string(preamble, ',') AS preamble, array_to_string(artifacts, ',') AS artifacts, array_to_string(fabricated, ',') AS fabricated,
         cast(words AS INT) AS words, words BETWEEN 50 AND 2000 AS word_band_ok, len(preamble) + len(artifacts) > 0 AS unclean FROM c""")
def digest_checks(t: Read):
    """Tensions, hygiene, fabrications and the word band of every document, read as a digest."""
    tensions = [("english", [["the"], ["and"]]), ("german", [["der", "die"], ["und", "nicht"]]), ("romance", [["le", "la"], ["de"], ["que", "et"]])]
    rows = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = EV.check_digests(rows, tensions, ["It is", "is the"], ["###", "|"], ["License"], (50, 2000))
    return found.select("doc_id", *(F.array_join(c, ",").alias(c) for c in ("tensions", "preamble", "artifacts", "fabricated")), F.col("words").cast("int").alias("words"), "word_band_ok", "unclean")


@query("""WITH s AS (SELECT conv_id, turn, role || ' ' || turn AS title, text AS body, coalesce(string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior FROM conversations)
  SELECT conv_id, md5('# Talk ' || conv_id || chr(10) || chr(10) || string_agg('## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY turn)) AS article, md5(string_agg(md5(prior), ',' ORDER BY turn)) AS prefixes, count(*) AS sections FROM s GROUP BY conv_id""")
def assembled_articles(t: Read):
    """Conversations as articles of their turns, and what each turn would be shown of those before it."""
    sections = t.conversations.select("conv_id", F.col("turn").alias("section"), F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), F.col("text").alias("body"))
    titles = sections.select("conv_id").distinct().withColumn("headline", F.concat(F.lit("Talk "), F.col("conv_id").cast("string")))
    prior = P.prior_sections(sections, "conv_id").groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", F.md5("prior").alias("p")))), lambda s: s["p"]), ",")).alias("prefixes"), F.count("*").alias("sections"))
    return P.assemble(titles, sections, "conv_id").select("conv_id", F.md5("article").alias("article")).join(prior, "conv_id")
