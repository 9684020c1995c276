"""URL filters: block rules that reach the aliases of a page over redirect and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import A_TO_Z, Tables, attach, components

#: (verdict, host, path)
Rule = tuple[str, str, str]

# The rules of the query.
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Tags with their quoted attributes, and which of them are links: canonical among the tokens of rel, and refreshes.
TAG = r"(?is)<(?:link|meta)\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
CANONICAL = r"(?is)^<link\s(?:.*\s)?rel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s>])"
REFRESH = r"(?is)^<meta\s(?:.*\s)?http-equiv\s*=\s*[\"']?refresh[\"'\s>]"

BASE = r"(?is)<base\s(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
# Entities that an url may hold; the ampersand is read last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#x2F;", "/"), ("&#47;", "/"), ("&#38;", "&"), ("&amp;", "&"))

#: Up to so many rules go into the plan as literals; more are joined by host.
LITERAL_RULES = 200


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", "")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, quoted or not, without blanks at its ends and with its entities read; empty if there is none."""
    quoted = (r"\"([^\"]*)\"", "'([^']*)'", r"([^\s\"'>]+)")
    value = F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1), F.lit("")) for q in quoted], F.lit(""))
    for entity, sign in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(sign))
    return F.trim(value)


def _resolved(to: Column, src: Column) -> Column:
    """A target against an absolute url; what is no link has no ``://``."""
    own = F.concat(F.lit("x://"), host_of(src))
    # The url's folder and the target's path, split at /; a last . or .. leaves a folder.
    raw = F.concat(F.regexp_replace(path_of(src), "[^/]*$", ""), F.regexp_extract(to, "^[^?#]*", 0))
    steps = F.filter(F.split(F.regexp_replace(raw, r"/\.{1,2}$", "$0/"), "/", -1), lambda x: x != ".")
    root = F.array().cast("array<string>")
    walked = F.aggregate(F.slice(steps, 2, F.greatest(F.size(steps), F.lit(1))), root, lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    relative = F.concat(own, F.lit("/"), F.array_join(F.when(F.startswith(raw, F.lit("/")), walked).otherwise(F.split(to, "/", -1)), "/"))
    bare = ~to.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:|[#?]|$)") & (F.instr(src, "://") > 0)
    return F.when(to.startswith("//"), F.concat(F.lit("x:"), to)).when(to.startswith("/"), F.concat(own, to)).when(bare, relative).otherwise(to)


def links_of(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) urls of rel=canonical links and meta refreshes; targets are resolved against the page's base.

    That is the href of its first ``<base>`` that has one, itself resolved against
    the page's url, else that url. ``//host/path`` has the base's scheme, ``/path``
    its host, and what has no scheme at all is relative to the base's folder, with
    ``.`` and ``..`` taken out. Entities of attributes are read. Other schemes
    without ``://`` (mailto:) are no links, nor are ``#`` and ``?``.
    """
    html, tag = F.col(html_col), F.col("tag")
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), 0), lambda x: x.rlike(CANONICAL) | x.rlike(REFRESH))
    bases = F.filter(F.transform(F.regexp_extract_all(html, F.lit(BASE), 0), lambda x: _attribute(x, "href")), lambda x: x != "")
    refresh = F.trim(F.regexp_extract(_attribute(tag, "content"), r"(?is)url\s*=\s*[\"']?([^\"']*)", 1))
    target = F.when(tag.rlike(r"(?i)^<link"), _attribute(tag, "href")).otherwise(refresh)
    found = pages.where(html.isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.get(bases, F.lit(0)).alias("base"), F.explode(tags).alias("tag"))
    found = found.select("src", F.coalesce(_resolved(F.col("base"), F.col("src")), F.col("src")).alias("base"), target.alias("to"))
    found = found.withColumn("base", F.when(F.instr("base", "://") > 0, F.col("base")).otherwise(F.col("src")))
    return found.select("src", _resolved(F.col("to"), F.col("base")).alias("dst")).where("instr(dst, '://') > 0")


def _ruled(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (host, path, ...) with ``rule`` and ``ruled`` (verdict) of the longest rule that fits; of equally long ones, allow."""
    if not rules:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("ruled", F.lit(None).cast("string"))
    host, path = F.col("host"), F.col("path")
    if len(rules) <= LITERAL_RULES:
        best = None
        for verdict, h, p in sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0])):  # the first that fits
            fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            said = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("ruled"))
            best = F.when(fits, said) if best is None else best.when(fits, said)
        return rows.withColumn("best", best).withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.ruled")).drop("best")
    table = rows.sparkSession.createDataFrame(sorted(set(rules)), "verdict string, rule_host string, rule_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    urls = rows.select("host", "path").distinct()
    better = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("n"), F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("allow"))
    fit = (
        urls.withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("ruled")), better).alias("best"))
    )
    return rows.join(fit, ["host", "path"], "left").withColumn("rule", F.col("best.rule")).withColumn("ruled", F.col("best.ruled")).drop("best")


def judge_urls(pages: DataFrame, rules: list[Rule] = list(RULES), links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:  # noqa: B006
    """A verdict for every row of ``pages``: of its own longest rule, else of its aliases, else ``default``.

    A rule fits its host and all subdomains if the url's path starts with the
    rule's. Urls are one node if host and path agree. ``links`` (src, dst) are
    redirect and canonical links; urls that hang together over them, in either
    direction, are aliases. An url without a rule of its own takes the verdict of
    the rules that fit any of its aliases: allow if one allows, else block if one
    blocks. An own rule is never overruled.

    Returns page_id, host, path, rule (host and path; null without), verdict.
    Null url or one without ://: empty host and path, no rule, no alias. Null or
    repeated ids: each row returns. Empty tables: no rows, no links. Other columns
    are ignored.
    """
    rows = _ruled(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")), rules)
    said = F.coalesce(F.col("ruled"), F.lit(default))
    if links is not None:
        tables = Tables(pages.sparkSession)
        node = lambda c: F.concat(host_of(F.col(c)), path_of(F.col(c)))  # noqa: E731  a host has no /, and a path that isn't empty begins with one
        edges = tables.write(links.where("instr(src, '://') > 0 and instr(dst, '://') > 0").select(node("src").alias("a"), node("dst").alias("b")).where("a <> b").distinct())
        if edges.take(1):
            classes = components(edges, tables)
            nodes = _ruled(classes.withColumn("host", F.substring_index("node", "/", 1)).withColumn("path", F.expr("substring(node, length(host) + 1)")), rules)
            level = F.max(F.when(F.col("ruled") == "allow", 2).when(F.col("ruled") == "block", 1))
            spread = tables.write(nodes.groupBy("component").agg(level.alias("level"), F.count("*").alias("nodes")))
            held = spread.agg(F.coalesce(F.sum("nodes"), F.lit(0))).first()[0]  # a component may hold most nodes, and a node most rows
            taken = tables.write(attach(classes, spread, "component", "nodes", held).where("level is not null").select("node", F.when(F.col("level") == 2, "allow").otherwise("block").alias("spread")))
            loose = rows.where("ruled is not null or host = ''").withColumn("spread", F.lit(None).cast("string"))  # an own rule, or no host: no alias decides
            open_ = rows.where("ruled is null and host <> ''").withColumn("node", F.concat("host", "path"))
            sizes = tables.write(open_.groupBy("node").agg(F.count("*").alias("rows")).join(taken, "node", "left"))
            total = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
            rows = attach(open_, sizes, "node", "rows", total).drop("node", "rows").unionByName(loose)
            said = F.coalesce(F.col("ruled"), F.col("spread"), F.lit(default))
    return rows.select("page_id", "host", "path", "rule", said.alias("verdict"))
