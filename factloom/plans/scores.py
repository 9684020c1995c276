"""Queries over verdicts, predictions, outcomes, comparisons and leaderboards."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import rankings as R
from ..operators import tournament as T
from ..operators.numbering import sums_before
from .registry import Read, query
from .tables import writer

_PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
          round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"""WITH v AS (SELECT user_id % 20 AS candidate, CASE event_type WHEN 'click' THEN ' Supported' WHEN 'view' THEN 'missed' ELSE event_type END AS verdict FROM events),
  c AS (SELECT candidate, count(*) FILTER (lower(trim(verdict)) = 'supported') AS tp, count(*) FILTER (lower(trim(verdict)) = 'missed') AS fn, count(*) FILTER (lower(trim(verdict)) NOT IN ('supported', 'missed')) AS fp FROM v GROUP BY candidate)
  SELECT candidate, tp AS supported, fn AS missed, fp AS not_in_source, {_PRF} FROM c""")
def micro_prf(t: Read):
    """A04 A05 O01"""
    said = F.when(F.col("event_type") == "click", " Supported").when(F.col("event_type") == "view", "missed").otherwise(F.col("event_type"))
    v = t.events.select((F.col("user_id") % 20).alias("candidate"), said.alias("verdict"))
    return _rounded(M.verdict_counts(v, "candidate"), "precision", "recall", "f1").orderBy(F.desc("f1"), "candidate")


_PREDICTED = """p AS (SELECT 'm' || (l.doc_id % 3) AS model, CASE WHEN quality = 1 THEN 'good' ELSE 'junk' END AS gold,
  CASE WHEN l.doc_id % 11 = 0 THEN NULL WHEN regexp_matches(text, '[#$%&*!|]{2}') OR regexp_matches(text, ' \\| ') OR l.doc_id % 7 = 0 THEN 'junk' ELSE 'good' END AS pred FROM labels l JOIN documents d USING (doc_id))"""


def _predictions(t: Read):
    junk = F.col("text").rlike("[#$%&*!|]{2}") | F.col("text").rlike(r" \| ") | (F.col("doc_id") % 7 == 0)
    pred = F.when(F.col("doc_id") % 11 == 0, None).when(junk, "junk").otherwise("good")
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id")
    return rows.select(F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"), F.when(F.col("quality") == 1, "good").otherwise("junk").alias("gold"), pred.alias("pred"))


@query(f"""WITH {_PREDICTED}, a AS (SELECT unnest(['good', 'junk', 'mixed']) AS label), m AS (SELECT DISTINCT model FROM p),
  c AS (SELECT model, label, (SELECT count(*) FROM p WHERE p.model = m.model AND gold = label) AS support, (SELECT count(*) FROM p WHERE p.model = m.model AND gold = label AND pred = label) AS tp,
               (SELECT count(*) FROM p WHERE p.model = m.model AND pred = label AND gold <> label) AS fp FROM m, a),
  s AS (SELECT *, support - tp AS fn FROM c),
  f AS (SELECT model, avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1 FROM s GROUP BY model)
  SELECT model, count(*) AS items, count(*) FILTER (pred = gold) AS correct, count(*) FILTER (pred IS NULL) AS unparseable, round(count(*) FILTER (pred = gold) / count(*), 6) AS accuracy, round(min(macro_f1), 6) AS macro_f1
  FROM p JOIN f USING (model) GROUP BY model""")
def confusion_macro_f1(t: Read):
    """Macro-F1 over all allowed labels, one of them without support."""
    scores = M.model_scores(_predictions(t), ["good", "junk", "mixed"])
    return _rounded(scores, "accuracy", "macro_f1").orderBy(F.desc("macro_f1"), F.desc("accuracy"), "model")


@query("""WITH p AS (SELECT l_suppkey AS model, l_orderkey AS problem, count(*) FILTER (l_returnflag <> 'R') AS passed, count(*) AS total, max((l_linestatus = 'F')::INT) AS blocked FROM lineitem GROUP BY ALL)
  SELECT model, sum(passed)::BIGINT AS passed, sum(total)::BIGINT AS total, count(*) FILTER (passed = total) AS solved, sum(blocked)::BIGINT AS blocked, round(sum(passed) / sum(total), 6) AS pass_rate FROM p GROUP BY model""")
def pass_rate_rank(t: Read):
    """A07 O07"""
    o = t.lineitem.select(F.col("l_suppkey").alias("model"), F.col("l_orderkey").alias("problem"), (F.col("l_returnflag") != "R").alias("passed"), (F.col("l_linestatus") == "F").alias("blocked"))
    return _rounded(M.pass_rates(o, "model", "problem"), "pass_rate").orderBy(F.desc("pass_rate"), F.desc("solved"), "model")


@query("""WITH x AS (SELECT role, conv_id % 5 = 0 AS skipped, string_split('noise' || chr(10) || CASE WHEN length(text) % 3 = 0 THEN '' ELSE text END || chr(10) || ' ' || (turn % 4) || '  ' || chr(10), chr(10)) AS lines, cast(length(text) % 4 AS VARCHAR) AS gold FROM conversations),
  y AS (SELECT role, skipped, gold, trim(list_filter(lines, lambda s: trim(s) <> '')[-1]) AS pred FROM x)
  SELECT role AS model, count(*) FILTER (NOT skipped) AS tasks, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND pred = gold) AS correct, round(count(*) FILTER (NOT skipped AND pred = gold) / nullif(count(*) FILTER (NOT skipped), 0), 6) AS accuracy FROM y GROUP BY role""")
def trace_accuracy_rank(t: Read):
    """A08 O08 X29"""
    out = F.concat(F.lit("noise\n"), F.when(F.length("text") % 3 == 0, "").otherwise(F.col("text")), F.lit("\n "), (F.col("turn") % 4).cast("string"), F.lit("  \n"))
    rows = t.conversations.select(F.col("role").alias("model"), (F.col("conv_id") % 5 == 0).alias("skipped"), F.trim(X.last_line(out)).alias("pred"), (F.length("text") % 4).cast("string").alias("gold"))
    ran = ~F.col("skipped")
    found = rows.groupBy("model").agg(F.count_if(ran).alias("tasks"), F.count_if("skipped").alias("skipped"), F.count_if(ran & (F.col("pred") == F.col("gold"))).alias("correct"))
    return found.withColumn("accuracy", F.round(X.ratio(F.col("correct"), F.col("tasks")), 6)).orderBy(F.desc("accuracy"), F.desc("correct"), "model")


@query("""WITH v AS (SELECT o_orderpriority AS judge, o_orderkey % 13 = 0 AS error, CASE WHEN o_custkey % 10 < 9 THEN 'good' ELSE 'bad' END AS first, CASE WHEN o_custkey % 11 < 10 THEN 'good' ELSE 'bad' END AS second, cast(o_orderkey % 3 AS INT) AS grounded FROM orders),
  c AS (SELECT judge, count(*) FILTER (NOT error) AS pairs, count(*) FILTER (error) AS errors, count(*) FILTER (NOT error AND first = 'good' AND second = 'good') AS robust, count(*) FILTER (NOT error AND first = 'good') AS naive, count(*) FILTER (NOT error AND first <> second) AS biased, sum(grounded) FILTER (NOT error) AS grounded FROM v GROUP BY judge)
  SELECT judge, pairs, errors, round(robust / pairs, 6) AS robust_rate, round(naive / pairs, 6) AS naive_rate, round(biased / pairs, 6) AS bias_rate, round(grounded / (2 * pairs), 6) AS grounded_rate, pairs > 0 AND robust / pairs >= 0.9 AND biased / pairs <= 0.2 AS trustworthy FROM c""")
def calibration_metrics(t: Read):
    """A09 P18"""
    trial = t.orders.select(F.col("o_orderpriority").alias("judge"), (F.col("o_orderkey") % 13 == 0).alias("error"), F.when(F.col("o_custkey") % 10 < 9, "good").otherwise("bad").alias("first"), F.when(F.col("o_custkey") % 11 < 10, "good").otherwise("bad").alias("second"), (F.col("o_orderkey") % 3).cast("int").alias("grounded"))
    return _rounded(M.calibration(trial, "judge"), "robust_rate", "naive_rate", "bias_rate", "grounded_rate")


#: Entrants of the comparison queries: one per nation, so that all pairs are few at every size.
_ENTRANTS = "e AS (SELECT n_nationkey AS k, n_name AS name FROM nation)"
_EDGES = f"""{_ENTRANTS}, x AS (SELECT a.name AS a, b.name AS b, a.k AS i, b.k AS j, (a.k * 7 + b.k * 3) % 5 AS r, (a.k + b.k) % 12 = 5 AS error FROM e a JOIN e b ON a.k < b.k),
  edges AS (SELECT a, b, CASE WHEN NOT error AND r <> 0 THEN CASE WHEN r = 1 THEN b ELSE a END END AS winner, NOT error AND r = 0 AS flip, error FROM x)"""


def _edges(t: Read):
    e = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    x = e.alias("a").join(e.alias("b"), F.col("a.k") < F.col("b.k")).select(F.col("a.name").alias("a"), F.col("b.name").alias("b"), ((F.col("a.k") * 7 + F.col("b.k") * 3) % 5).alias("r"), ((F.col("a.k") + F.col("b.k")) % 12 == 5).alias("error"))
    pick = lambda flip_to: F.when(~F.col("error"), F.when(F.col("r") == 1, F.col("b")).when((F.col("r") == 0) & F.lit(flip_to), F.col("b")).otherwise(F.col("a")))
    forward = x.select("a", "b", pick(False).alias("winner"))
    backward = x.select(F.col("b").alias("a"), F.col("a").alias("b"), pick(True).alias("winner"))
    return T.compare(forward, backward)


@query(f"""WITH {_EDGES}, s AS (SELECT a AS name, winner FROM edges WHERE NOT error UNION ALL SELECT b, winner FROM edges WHERE NOT error)
  SELECT name, count(*) FILTER (winner = name) AS wins, count(*) FILTER (winner <> name) AS losses, count(*) FILTER (winner IS NULL) AS ties FROM s GROUP BY name""")
def edges_wlt(t: Read):
    """A11 A12 D09 K15"""
    return T.records(_edges(t))


@query(f"""WITH {_EDGES}, w AS (SELECT least(a, b) AS p, greatest(a, b) AS q, winner FROM edges WHERE winner IS NOT NULL),
  tr AS (SELECT ab.p AS a, ab.q AS b, ac.q AS c, ab.winner AS x, ac.winner AS y, bc.winner AS z FROM w ab JOIN w ac ON ac.p = ab.p JOIN w bc ON bc.p = ab.q AND bc.q = ac.q),
  cy AS (SELECT count(*) AS triples, count(*) FILTER (NOT (x = a AND y = a OR x = b AND z = b OR y = c AND z = c)) AS cycles FROM tr),
  ed AS (SELECT count(*) AS comparisons, count(*) FILTER (flip) AS flips, count(*) FILTER (error) AS errors FROM edges)
  SELECT comparisons, triples, round(flips / comparisons, 6) AS flip_rate, round(errors / comparisons, 6) AS error_rate, round(cycles / triples, 6) AS cycle_rate,
         errors / comparisons <= 0.15 AND flips / comparisons <= 0.25 AND cycles / triples <= 0.15 AS trustworthy FROM ed, cy""")
def cycle_audit(t: Read):
    """K16 A10 P18"""
    edges = _edges(t)
    return _rounded(T.rates(edges, T.triples(edges)), "flip_rate", "error_rate", "cycle_rate")


@query(f"""WITH {_EDGES}, k AS (SELECT a, b, list_concat([ord(c) for c in string_split(least(a, b), '')], [0], [ord(c) for c in string_split(greatest(a, b), '')]) AS bytes,
        list_filter(['ALGERIA', 'BRAZIL', 'CHINA'], lambda j: j <> a AND j <> b) AS pool FROM edges),
  h AS (SELECT a, b, pool, list_reduce(list_prepend(2166136261::BIGINT, [x::BIGINT for x in bytes]), lambda f, x: xor(f, x) * 16777619 % 4294967296) & 2147483647 AS hash FROM k)
  SELECT a, b, pool[1 + hash % len(pool)] AS judge FROM h""")
def judge_assignment(t: Read):
    """The judge of each pair, never one of the two unless no other is left."""
    return T.assign_judges(_edges(t).select("a", "b"), ["ALGERIA", "BRAZIL", "CHINA"])


@query("""WITH r AS (SELECT role AS judge, cast(turn % 4 AS INT) AS slot, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE cast(length(text) % 4 AS INT) END AS picked FROM conversations)
  SELECT judge, count(*) AS trials, sum((picked IS NOT DISTINCT FROM slot)::INT)::BIGINT AS hits, round(avg((picked IS NOT DISTINCT FROM slot)::INT), 6) AS accuracy, 0.25 AS chance FROM r GROUP BY judge""")
def recognition_accuracy(t: Read):
    """An error is a miss."""
    rows = t.conversations.select(F.col("role").alias("judge"), (F.col("turn") % 4).cast("int").alias("slot"), F.when(F.col("conv_id") % 9 != 0, (F.length("text") % 4).cast("int")).alias("picked"), F.lit(4).alias("size"))
    return _rounded(T.recognition_accuracy(rows), "accuracy", "chance")


_BOARDS = """cells AS (SELECT p_type AS board, p_brand || ' model ' || p_name AS cell, p_retailprice AS score FROM part),
  roster AS (SELECT 'fam' || (k % 3) || '/' || k AS slug, k AS pos FROM range(11, 56) x(k)), aliases AS (SELECT 'brand#' || k AS alias, 'fam' || (k % 3) || '/' || k AS slug FROM range(11, 50) x(k)),
  hit AS (SELECT DISTINCT cell, min_by(slug, alias) OVER (PARTITION BY cell) AS slug FROM (SELECT DISTINCT cell FROM cells) c JOIN aliases ON contains(lower(cell), alias)),
  best AS (SELECT board, slug, CASE WHEN board LIKE '%S%' THEN min(score) ELSE max(score) END AS score FROM cells JOIN (SELECT cell, min(slug) AS slug FROM hit GROUP BY cell) USING (cell) GROUP BY board, slug)"""


def _scores(t: Read):
    ks = t.spark.range(11, 56).select(F.col("id").alias("k"))
    slug = F.concat(F.lit("fam"), (F.col("k") % 3).cast("string"), F.lit("/"), F.col("k").cast("string")).alias("slug")
    roster, aliases = ks.select(slug, F.col("k").alias("pos")), ks.where("k < 50").select(F.concat(F.lit("Brand#"), F.col("k").cast("string")).alias("alias"), slug)
    cells = t.part.select(F.col("p_type").alias("board"), F.concat("p_brand", F.lit(" model "), "p_name").alias("cell"), F.col("p_retailprice").alias("score"), F.col("p_type").contains("S").alias("lower_is_better"))
    return R.match_scores(cells, aliases, roster), cells.select("board", "lower_is_better").distinct(), roster


@query(f"WITH {_BOARDS} SELECT board, slug, round(score, 6) AS score FROM best")
def rankings_best_score(t: Read):
    """J10 A22"""
    return _rounded(_scores(t)[0], "score")


@query(f"""WITH {_BOARDS}, roles AS (SELECT board AS role, board, lag(board) OVER (ORDER BY board) AS ref FROM (SELECT DISTINCT board FROM cells)),
  ranked AS (SELECT role, ref, slug, row_number() OVER (PARTITION BY role ORDER BY CASE WHEN board LIKE '%S%' THEN score ELSE -score END, pos) AS rnk FROM roles JOIN best USING (board) JOIN roster USING (slug)),
  top1 AS (SELECT role AS ref, split_part(slug, '/', 1) AS taken FROM ranked WHERE rnk = 1)
  SELECT role, coalesce(min_by(slug, rnk) FILTER (taken IS NULL OR split_part(slug, '/', 1) <> taken), min_by(slug, rnk)) AS slug FROM ranked LEFT JOIN top1 USING (ref) GROUP BY role""")
def rankings_derive(t: Read):
    """Each role must differ in family from the first candidate of the role before it."""
    scores, boards, roster = _scores(t)
    roles = boards.select(F.col("board").alias("role"), "board", F.lag("board").over(W.orderBy("board")).alias("cross_family_with"))  # boards, a few
    return R.picks(R.candidates(scores, boards, roster, roles)).select("role", "slug")


_TOKENS = """WITH e AS (SELECT event_id, event_type AS stage, cast(sum(1 + event_id % 50) OVER (PARTITION BY event_type ORDER BY event_id) AS BIGINT) AS counter FROM events)"""


@query(f"""{_TOKENS}, d AS (SELECT stage, event_id, counter - lag(counter, 1, 0) OVER (PARTITION BY stage ORDER BY event_id) AS delta FROM e)
  SELECT stage, count(*) AS calls, sum(delta)::BIGINT AS tokens, max(delta) AS most FROM d GROUP BY stage""")
def ledger_deltas(t: Read):
    """Usage by stage from running counters: what one shows behind a call, less what it showed before."""
    calls = t.events.select("event_id", F.col("event_type").alias("stage"), (1 + F.col("event_id") % 50).alias("used"))
    counters = sums_before(calls, ["event_id"], {"before": F.col("used")}, writer(t.spark), by=["stage"]).withColumn("after", F.col("before") + F.col("used"))
    d = counters.withColumn("delta", F.col("after") - F.col("before"))
    return d.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("delta").alias("tokens"), F.max("delta").alias("most"))


_RESULTS = """r AS (SELECT user_id, 'model ' || user_id AS name, count(*) FILTER (event_id % 3 = 0) AS hits, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id),
  m AS (SELECT *, hits / n AS recall, kinds AS passed, n % 5 / 5 AS item_score, n % 3 / 3 AS field_score, hits / n AS f1, hits / n - 2.0 * (n % 4) / 10 AS composite, n % 6 AS tensions FROM r)"""


@query(f"""WITH {_RESULTS} SELECT name, row_number() OVER (ORDER BY recall DESC, name) AS by_recall, row_number() OVER (ORDER BY passed DESC, item_score DESC, field_score DESC, name) AS by_structure,
  row_number() OVER (ORDER BY f1 DESC, name) AS by_f1, row_number() OVER (ORDER BY composite DESC, tensions DESC, name) AS by_composite FROM m""")
def comparators(t: Read):
    """Users as models, ranked under four comparators."""
    n, hits = F.col("n"), F.col("hits")
    r = t.events.groupBy("user_id").agg(F.count_if(F.col("event_id") % 3 == 0).alias("hits"), F.count("*").alias("n"), F.count_distinct("event_type").alias("passed"))
    m = r.select(F.concat(F.lit("model "), F.col("user_id").cast("string")).alias("name"), (hits / n).alias("recall"), "passed", (n % 5 / 5).alias("item_score"), (n % 3 / 3).alias("field_score"), (hits / n).alias("f1"), (hits / n - F.lit(2.0) * (n % 4) / 10).alias("composite"), (n % 6).alias("tensions"))
    write = writer(t.spark)
    results, out = write(m), None
    for name, column in (("recall", "by_recall"), ("structured", "by_structure"), ("candidates", "by_f1"), ("digests", "by_composite")):
        one = R.ranked(results, name, write).select("name", F.col("rank").alias(column))
        out = one if out is None else out.join(one, "name")
    return out


@query("""WITH c AS (SELECT doc_id, greatest(1, cast(ceil(length(text) / 6000.0) AS BIGINT)) AS chunks FROM documents),
  p AS (SELECT doc_id, chunks, greatest(3, chunks) AS cap FROM c)
  SELECT doc_id, chunks, cap AS section_cap, chunks + 1 + 2 * cap AS mandatory, 3 * (chunks + 1 + 2 * cap) AS worst_case, least(2, greatest(0, 36 - (chunks + 1 + 2 * cap))) AS headroom, chunks + 1 + 2 * cap > 36 AS rejected, CASE WHEN chunks < 2 THEN 0 ELSE chunks * cast(ceil(log2(chunks)) AS BIGINT) END AS comparisons FROM p""")
def call_plan(t: Read):
    """A25 X39"""
    from ..operators.completion import call_plan as plan

    c = t.documents.select("doc_id", F.greatest(F.lit(1), F.ceil(F.length("text") / 6000)).cast("long").alias("chunks"))
    return plan(c, edit=True, attempts=3, limit=36).withColumn("comparisons", X.comparison_bound(F.col("chunks")))


@query("""WITH c AS (SELECT doc_id, greatest(1, cast(ceil(length(text) / 6000.0) AS BIGINT)) AS chunks, doc_id % 4 = 0 AS reused, doc_id % 10 = 3 AS failed, source FROM documents)
  SELECT source, sum(CASE WHEN reused THEN 0 ELSE chunks END + 2)::BIGINT AS planned, count(*) FILTER (failed) AS failures, count(*) FILTER (failed) * 2 >= count(*) AS aborted FROM c GROUP BY source""")
def budget_plan(t: Read):
    """A26 P21"""
    c = t.documents.select("source", F.greatest(F.lit(1), F.ceil(F.length("text") / 6000)).cast("long").alias("chunks"), (F.col("doc_id") % 4 == 0).alias("reused"), (F.col("doc_id") % 10 == 3).alias("failed"))
    failed = F.count_if("failed")
    return c.groupBy("source").agg(F.sum(F.when(F.col("reused"), 0).otherwise(F.col("chunks")) + 2).alias("planned"), failed.alias("failures"), (failed * 2 >= F.count("*")).alias("aborted"))


@query("""WITH v AS (SELECT conv_id, turn, turn // 3 AS batch FROM conversations), x AS (SELECT conv_id, batch, turn, CASE WHEN conv_id % 6 = 0 AND turn % 3 = 0 THEN turn + 1 ELSE turn END AS idx, length(text) % 2 = 0 AS ok FROM v JOIN conversations USING (conv_id, turn)),
  b AS (SELECT conv_id, batch, count(*) AS n, count(DISTINCT idx) = count(*) AND min(idx) = min(turn) AND max(idx) = max(turn) AS valid, count(*) FILTER (ok) AS ok FROM x GROUP BY ALL)
  SELECT conv_id, sum(n)::BIGINT AS total, sum(CASE WHEN valid THEN ok ELSE 0 END)::BIGINT AS supported, round(sum(CASE WHEN valid THEN ok ELSE 0 END) / sum(n), 6) AS precision FROM b GROUP BY conv_id""")
def sentence_precision(t: Read):
    """Verdicts come in numbered batches; a batch with a wrong set of indexes supports nothing."""
    idx = F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") % 3 == 0), F.col("turn") + 1).otherwise(F.col("turn"))
    x = t.conversations.select("conv_id", "turn", F.floor(F.col("turn") / 3).alias("batch"), idx.alias("idx"), (F.length("text") % 2 == 0).alias("ok"))
    valid = (F.countDistinct("idx") == F.count("*")) & (F.min("idx") == F.min("turn")) & (F.max("idx") == F.max("turn"))
    b = x.groupBy("conv_id", "batch").agg(F.count("*").alias("n"), valid.alias("valid"), F.count_if("ok").alias("ok"))
    found = b.groupBy("conv_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("valid"), F.col("ok")).otherwise(0)).alias("supported"))
    return found.withColumn("precision", F.round(X.ratio(F.col("supported"), F.col("total")), 6))


_ANCHORS = """g AS (SELECT item_id AS fact_id, ws[1] AS a1, ws[2] AS a2, ws[3] AS b1, ws[4] || ' ' || ws[5] AS b2
    FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[\\t\\n\\f\\r ]+', ' ', 'g')), ' ') AS ws FROM benchmark))"""


def _fact_recall_sql() -> str:
    from .texts import _NORM, _boundary_sql

    has = lambda a: f"strpos(norm, {a}) > 0 AND {_boundary_sql('norm', a)}"
    return f"""WITH {_ANCHORS}, d AS (SELECT doc_id, source, {_NORM} AS norm FROM documents),
      x AS (SELECT doc_id, source, {has('a1')} AND {has('a2')} AND ({has('b1')} OR {has('b2')}) AS covered FROM d, g)
      SELECT doc_id, source, count(*) AS total, count(*) FILTER (covered) AS covered, round(count(*) FILTER (covered) / count(*), 6) AS recall FROM x GROUP BY GROUPING SETS ((doc_id, source), (source))"""


@query(_fact_recall_sql())
def fact_recall(t: Read):
    """Golden facts of the benchmark in every document, per document and over all of a source.

    A fact needs all its anchors and any one of its alternatives. The fact list
    is broadcast behind a check of its length.
    """
    from ..operators.matching import score_facts

    words = F.split(X.squeeze(F.lower("text")), " ")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    golden = t.benchmark.select(F.col("item_id").alias("fact_id"), F.array(word(0), word(1)).alias("anchors"), F.array(F.array(word(2)), F.array(F.concat_ws(" ", word(3), word(4)))).alias("any"))
    scored = score_facts(t.documents.select("doc_id", "source", "text"), golden, ["doc_id", "source"])
    total, covered = F.sum("total"), F.sum("covered")
    return scored.groupingSets([["doc_id", "source"], ["source"]], "doc_id", "source").agg(total.alias("total"), covered.alias("covered"), F.round(X.ratio(covered, total), 6).alias("recall"))


@query("""WITH r AS (SELECT d.doc_id, d.source, quality, toxic, length(text) AS n, doc_id % 100 / 100.0 AS recall, doc_id % 13 / 100.0 AS overlap, doc_id % 4 AS tensions FROM documents d JOIN labels USING (doc_id)),
  q AS (SELECT *, list_filter([CASE WHEN recall < 0.2 THEN 'low recall' END, CASE WHEN overlap > 0.06 THEN 'copier' END, CASE WHEN tensions < 1 THEN 'flattened tensions' END, CASE WHEN toxic = 1 THEN 'hygiene' END, CASE WHEN n NOT BETWEEN 100 AND 20000 THEN 'word band' END, CASE WHEN quality = 0 THEN 'fabricates' END, CASE WHEN contains(lower(source), 'src1') THEN 'excluded' END], lambda x: x IS NOT NULL) AS reasons FROM r)
  SELECT doc_id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed, round(recall - 2.0 * overlap, 6) AS composite FROM q""")
def digest_score_gate(t: Read):
    """Composite score, gate with all reasons kept, order by composite and tensions."""
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("source").alias("name"), (F.col("doc_id") % 100 / 100).alias("recall"), (F.col("doc_id") % 13 / 100).alias("overlap"), (F.col("doc_id") % 4).alias("tensions_kept"), (F.col("toxic") == 1).alias("unclean"), F.length("text").alias("words"), F.when(F.col("quality") == 0, 9).otherwise(0).alias("fabrications"))
    reasons = M.gate_reasons(min_recall=0.2, max_overlap=0.06, min_tensions=1, clean=True, word_band=(100, 20_000), max_fabrications=1, exclude=("SRC1",))
    scored = rows.withColumn("r", reasons).withColumn("composite", F.round(F.col("recall") - 2.0 * F.col("overlap"), 6)).orderBy(F.desc("composite"), F.desc("tensions_kept"), "doc_id")
    return scored.select("doc_id", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("passed"), "composite")


@query("""SELECT doc_id, quality, toxic, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, toxic, n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)
          QUALIFY rank <= 5""")
def structured_rank(t: Read):
    """The five best of each language."""
    w = W.partitionBy("lang").orderBy(F.desc("quality"), "toxic", F.desc("n_chars"), "doc_id")
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id").withColumn("rank", F.row_number().over(w))
    return rows.where("rank <= 5").select("doc_id", "quality", "toxic", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT unnest(['Supplier#000000007', 'Supplier#000000003', 'Supplier#000000009']) AS name, unnest([0, 1, 2]) AS pos)
  SELECT s_suppkey, s_name, pos, lower(replace(s_name, '/', '-')) IN ('supplier#000000003') AS self_preference FROM supplier JOIN n ON s_name = name""")
def seed_selection(t: Read):
    """Entrants in the order named, with a warning for those that are a judge."""
    names = t.spark.createDataFrame([("Supplier#000000007", 0), ("Supplier#000000003", 1), ("Supplier#000000009", 2)], "s_name string, pos int")
    judge = F.lower(F.replace("s_name", F.lit("/"), F.lit("-"))).isin("supplier#000000003")
    return t.supplier.join(F.broadcast(names), "s_name").select("s_suppkey", "s_name", "pos", judge.alias("self_preference")).orderBy("pos")
