"""The operators applied to the driver's tables, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents")).drop("n_paths")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .langid import held_out
    from .quality import score_quality

    labels = _table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)).select("doc_id", F.col("quality").alias("label"))
    return score_quality(_table(spark, sf_dir, "documents"), labels).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import held_out, identify

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, docs.where(~held_out("doc_id", 4, 2))).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import minimax_shards

    return minimax_shards(_table(spark, sf_dir, "documents"), shards=24)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls, links_of

    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, links=links_of(pages))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .merkle import folded, leaf_of, manifest
    from .shared import A_TO_Z

    fields = ("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", A_TO_Z, A_TO_Z.lower())
    other = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    leaf = F.when(other, leaf_of([lower if f == "text" else F.col(f) for f in fields])).otherwise(leaf_of([F.col(f) for f in fields]))
    proved = manifest(_table(spark, sf_dir, "documents"), fields, carried={"given": leaf})
    proved = proved.withColumn("folded_root", folded(F.col("given"), F.col("proof")))
    siblings = F.sha2(F.array_join(F.col("proof.siblings"), ""), 256)
    return proved.select("doc_id", "leaf", F.col("top").alias("subroot"), "root", siblings.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_votes

    return quality_votes(_table(spark, sf_dir, "documents")).drop("posterior")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .fill_in_middle import fill_in_middle, restored

    moved = fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.col("output"), "restored_sha256": restored(F.col("output"), F.col("form"))}
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *(F.sha2(c, 256).alias(name) for name, c in digests.items()))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CRC32 = """xor(list_reduce(list_prepend(4294967295, [ord(c) for c in string_split({}, '') if c <> '']), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _walk(name: str, start: str, runs: str) -> str:
    """A recursive CTE that climbs a tree of eights: the digest that follows, and the siblings met."""
    return f"""{name} AS ({start} UNION ALL
            SELECT row, g, w.level + 1, idx // 8, (n + 7) // 8, sha256(array_to_string(run[1:idx % 8] || [h] || run[idx % 8 + 2:], '')),
                   siblings || array_to_string(run[1:idx % 8] || run[idx % 8 + 2:], '')
            FROM {name} w JOIN {runs} r USING (g) WHERE n > 1 AND r.level = w.level AND r.parent = w.idx // 8)"""


def _levels(name: str, leaves: str) -> str:
    return f"""{name} AS (SELECT g, 0 AS level, idx, n, leaf AS digest FROM {leaves} UNION ALL
            SELECT g, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY g, level, idx // 8, n),
        {name}_runs AS (SELECT g, level, idx // 8 AS parent, list(digest ORDER BY idx) AS run FROM {name} WHERE n > 1 GROUP BY ALL)"""


def _host(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"


def _path(url: str) -> str:
    return f"CASE WHEN instr({url}, '://') > 0 THEN regexp_extract(substr({url}, instr({url}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def _attribute(tag: str, name: str) -> str:
    values = ", ".join(f"nullif(regexp_extract({tag}, '(?is)\\s{name}\\s*=\\s*{q}', 1), '')" for q in ('"([^"]*)"', "''([^'']*)''", "([^\\s\"''>]+)"))
    value = f"coalesce({values}, '')"
    for entity, sign in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&amp;", "&")):
        value = f"replace({value}, '{entity}', '{sign}')"
    return f"trim({value})"


def _resolved(to: str, src: str) -> str:
    """A target against an url, by the rule: scheme, host, or folder of the url; dots are walked as a fold over one-step lists."""
    raw = f"(regexp_replace({_path(src)}, '[^/]*$', '') || regexp_extract({to}, '^[^?#]*'))"
    steps = f"list_filter(string_split(regexp_replace({raw}, '(/\\.{{1,2}})$', '\\1/'), '/'), lambda x: x <> '.')[2:]"
    walked = f"list_reduce(list_prepend([]::VARCHAR[], [[y] for y in {steps}]), lambda done, x: CASE WHEN x = ['..'] THEN done[1:greatest(len(done) - 1, 0)] ELSE done || x END)"
    folder = f"CASE WHEN {raw} LIKE '/%' THEN array_to_string({walked}, '/') ELSE {to} END"
    return f"""CASE WHEN {to} LIKE '//%' THEN 'x:' || {to} WHEN {to} LIKE '/%' THEN 'x://' || {_host(src)} || {to}
            WHEN instr({src}, '://') > 0 AND NOT regexp_matches({to}, '^([A-Za-z][A-Za-z0-9+.-]*:|[#?]|$)') THEN 'x://' || {_host(src)} || '/' || {folder} ELSE {to} END"""


SQL = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_FOLDED} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY body)""",
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, i, list_aggregate(words[i:i + 12], 'string_agg', ' ') AS body FROM d, range(1, len(words) - 11) r(i) WHERE len(words) >= 13),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY body) AS source FROM w) WHERE source < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT i + j) AS places FROM hit, range(0, 13) r(j) GROUP BY doc_id),
        kept AS (SELECT d.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
                        coalesce((SELECT string_agg(words[i], ' ' ORDER BY i) FROM range(1, len(words) + 1) r(i) WHERE places IS NULL OR NOT list_contains(places, i)), '') AS body
                 FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(body) AS kept_sha256 FROM kept""",
    "op9_url_filter": f"""
        WITH RECURSIVE pieces AS (
            SELECT url AS src, html, unnest(list_filter(regexp_extract_all(html, '(?is)<(?:link|meta)\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>'),
                lambda t: regexp_matches(t, '(?is)^<link\\s(?:.*\\s)?rel\\s*=\\s*(?:"(?:[^"]*\\s)?canonical(?:\\s[^"]*)?"|''(?:[^'']*\\s)?canonical(?:\\s[^'']*)?''|canonical[\\s>])')
                       OR regexp_matches(t, '(?is)^<meta\\s(?:.*\\s)?http-equiv\\s*=\\s*["'']?refresh["''\\s>]'))) AS tag
            FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
        aims AS (SELECT src, regexp_extract_all(html, '(?is)<base\\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS bases,
                        CASE WHEN regexp_matches(tag, '(?is)^<link') THEN {_attribute("tag", "href")} ELSE trim(regexp_extract({_attribute("tag", "content")}, '(?is)url\\s*=\\s*["'']?([^"'']*)', 1)) END AS target FROM pieces),
        based AS (SELECT src, target, list_filter([{_attribute("b", "href")} for b in bases], lambda h: h <> '')[1] AS base FROM aims),
        homes AS (SELECT DISTINCT src, base, CASE WHEN instr(coalesce({_resolved("base", "src")}, ''), '://') > 0 THEN {_resolved("base", "src")} ELSE src END AS home FROM based),
        targets AS (SELECT src, {_resolved("target", "home")} AS dst FROM based JOIN homes USING (src) WHERE based.base IS NOT DISTINCT FROM homes.base),
        urls AS (SELECT url FROM pages UNION SELECT dst FROM targets WHERE instr(dst, '://') > 0),
        parts AS (SELECT url, {_host("url")} AS host, {_path("url")} AS path FROM urls),
        ends AS (SELECT a.host || a.path AS a, b.host || b.path AS b FROM targets JOIN parts a ON a.url = src JOIN parts b ON b.url = dst WHERE instr(src, '://') > 0 AND instr(dst, '://') > 0),
        link AS (SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b),
        reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
        nodes AS (SELECT DISTINCT host || path AS node, host, path FROM parts),
        ruled AS (SELECT node, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
                  FROM nodes JOIN (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(verdict, h, p)
                  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
        spread AS (SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM reach JOIN ruled ON node = b GROUP BY a)
        SELECT page_id, host, path, ruled.rule, coalesce(ruled.verdict, spread.verdict, 'allow') AS verdict
        FROM pages p JOIN parts ON parts.url IS NOT DISTINCT FROM p.url LEFT JOIN ruled ON ruled.node = host || path LEFT JOIN spread ON spread.node = host || path AND host <> ''""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('+' || lang, '') AS g, {_leaf("text")} AS leaf,
                                    CASE WHEN {_CRC32.format("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0
                                    THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf("text")} END AS given FROM documents),
        leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM d),
        {_levels("nodes", "leaves")},
        tops AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, digest AS leaf FROM nodes WHERE n = 1),
        {_levels("upper", "tops")},
        {_walk("low", "SELECT row, g, 0 AS level, idx, n, given AS h, '' AS siblings FROM leaves", "nodes_runs")},
        {_walk("high", "SELECT row, '' AS g, 0 AS level, tops.idx, tops.n, h, siblings FROM low JOIN tops ON name = low.g WHERE low.n = 1", "upper_runs")}
        SELECT doc_id, d.leaf, tops.leaf AS subroot, digest AS root, sha256(siblings) AS proof_sha256, h AS folded_root, h = digest AS verified
        FROM d JOIN high USING (row) JOIN tops ON name = d.g, (SELECT digest FROM upper WHERE n = 1) WHERE high.n = 1""",
    "op12_quality_rules": r"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                                    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        windows AS (SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS times FROM d, range(1, len(words) - 1) r(i) WHERE len(words) > 3),
        covered AS (SELECT row, count(DISTINCT i + j) AS n_repeat_words FROM windows, range(0, 3) r(j) WHERE times > 1 GROUP BY row),
        m AS (SELECT row, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                     len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     length(regexp_replace(body, '\P{Lu}+', '', 'g')) AS n_capitals,
                     len(list_filter(words, lambda w: list_contains(string_split('the and of to in is that for was on der die und den das von ist nicht le la les de et des un une el los que y en', ' '), w))) AS n_common
              FROM d LEFT JOIN covered USING (row)),
        voted AS (SELECT *, [CASE WHEN n_words = 0 THEN 0 WHEN n_symbols / n_words <= 0.02 THEN 1 WHEN n_symbols / n_words >= 0.25 THEN -1 ELSE 0 END,
                             CASE WHEN n_words = 0 THEN 0 WHEN n_repeat_words / n_words <= 0.1 THEN 1 WHEN n_repeat_words / n_words >= 0.3 THEN -1 ELSE 0 END,
                             CASE WHEN n_lines = 0 THEN 0 WHEN n_dup_lines / n_lines <= 0.05 THEN 1 WHEN n_dup_lines / n_lines >= 0.4 THEN -1 ELSE 0 END,
                             CASE WHEN word_chars = 0 THEN 0 WHEN n_capitals / word_chars <= 0.1 THEN 1 WHEN n_capitals / word_chars >= 0.4 THEN -1 ELSE 0 END,
                             CASE WHEN n_words = 0 THEN 0 WHEN n_common / n_words >= 0.04 THEN 1 WHEN n_common / n_words <= 0.005 THEN -1 ELSE 0 END,
                             CASE WHEN n_words = 0 THEN 0 WHEN abs(word_chars / n_words - 5.5) <= 2.5 THEN 1 WHEN abs(word_chars / n_words - 5.5) >= 4 THEN -1 ELSE 0 END] AS votes FROM m),
        patterns AS (SELECT votes, count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS total FROM voted GROUP BY votes),
        em AS (SELECT 0 AS k, 0.8::DOUBLE AS share, [0.95::DOUBLE for x in range(6)] AS a, [0.4::DOUBLE for x in range(6)] AS b
            UNION ALL
            SELECT k + 1, (sum(n * p) + 0.8 * 0.01 * any_value(total)) / (1.01 * any_value(total)),
                   [""" + ", ".join(f"(coalesce(sum(n * p) FILTER (votes[{j}] > 0), 0) + 0.95 * 0.01 * any_value(total)) / (coalesce(sum(n * p) FILTER (votes[{j}] <> 0), 0) + 0.01 * any_value(total))" for j in range(1, 7)) + r"""],
                   [""" + ", ".join(f"(coalesce(sum(n * (1 - p)) FILTER (votes[{j}] < 0), 0) + 0.4 * 0.01 * any_value(total)) / (coalesce(sum(n * (1 - p)) FILTER (votes[{j}] <> 0), 0) + 0.01 * any_value(total))" for j in range(1, 7)) + r"""]
            FROM (SELECT k, votes, n, total, good / (good + bad) AS p FROM (SELECT *,
                share * list_product([CASE sign(votes[j]) WHEN 1 THEN a[j] WHEN -1 THEN 1 - a[j] ELSE 1 END for j in range(1, 7)]) AS good,
                (1 - share) * list_product([CASE sign(votes[j]) WHEN 1 THEN 1 - b[j] WHEN -1 THEN b[j] ELSE 1 END for j in range(1, 7)]) AS bad
                FROM em, patterns)) WHERE k < 30 GROUP BY k),
        judged AS (SELECT votes, share * list_product([CASE sign(votes[j]) WHEN 1 THEN a[j] WHEN -1 THEN 1 - a[j] ELSE 1 END for j in range(1, 7)]) AS good,
                          (1 - share) * list_product([CASE sign(votes[j]) WHEN 1 THEN 1 - b[j] WHEN -1 THEN b[j] ELSE 1 END for j in range(1, 7)]) AS bad
                   FROM em, patterns WHERE k = 30),
        failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good / (good + bad) >= 0.5 AS kept
        FROM failed JOIN judged USING (votes)""",
    "op13_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        drawn AS (SELECT *, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) for k in range(4)] AS draw FROM d),
        formed AS (SELECT *, CASE WHEN n = 0 OR regexp_matches(body, '<[PSM]>') OR draw[3] % 100 >= 90 THEN 'plain' WHEN draw[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
                          least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b FROM drawn),
        parts AS (SELECT *, substr(body, 1, a) AS prefix, substr(body, a + 1, b - a) AS middle, substr(body, b + 1) AS suffix FROM formed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE body END) AS output_sha256,
               sha256(body) AS restored_sha256
        FROM parts""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}
