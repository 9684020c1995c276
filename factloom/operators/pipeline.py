"""The digest pipeline: sources to chunks, facts, sections and a gated article, for all documents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from . import chunks as C
from . import facts as FA
from .completion import Completer, complete
from .metrics import run_gate
from .resume import Stages

EXTRACT, OUTLINE, SECTION = "Extract the facts of:\n", "Outline with fact ids:\n", "Write a section from:\n"


def compile_facts(responses: DataFrame, by: str = "doc_id") -> DataFrame:
    """Responses in order under "## chunk-NNN", with rules between; numbers are positions."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "reply"))), lambda s, i: F.concat(F.lit("## chunk-"), F.lpad((i + 1).cast("string"), 3, "0"), F.lit("\n\n"), s["reply"])), "\n\n---\n\n")
    return responses.groupBy(by).agg(text.alias("facts_text"))


def assemble(title: DataFrame, sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """The title, then each section's heading and body in order."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "title", "body"))), lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), s["body"])), "\n\n")
    return sections.groupBy(by).agg(body.alias("body")).join(title.hint("merge"), by).select(by, F.concat(F.lit("# "), F.col("headline"), F.lit("\n\n"), F.col("body")).alias("article"))


def parse_outlines(outlines: DataFrame, by: str = "doc_id", text_col: str = "reply") -> DataFrame:
    """(by, headline, section, title, intent, fact_ids): "# " title, "## " sections, "Facts:" lines; untitled sections go."""
    w = W.partitionBy(by).orderBy("i")
    lines = outlines.select(by, F.posexplode(F.split(text_col, "\n")).alias("i", "raw")).withColumn("t", F.trim("raw"))
    lines = lines.withColumn("section", F.sum(F.col("t").startswith("## ").cast("int")).over(w))
    head = lines.withColumn("h", F.when(F.col("t").startswith("# "), F.trim(F.substring("t", 3, 1 << 30))))
    headline = head.groupBy(by).agg(F.min_by("h", F.when(F.col("h").isNotNull() & (F.col("h") != ""), F.col("i"))).alias("headline"))
    is_facts = F.col("t").rlike("(?i)^facts?:")
    ids = F.transform(F.regexp_extract_all("t", F.lit("[Ff]([0-9]+)"), 1), lambda s: s.cast("int"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c[0], F.struct("i", c[1].alias("v"))))), lambda s: s["v"])
    inside = lines.where("section > 0")
    titles = F.min_by(F.trim(F.substring("t", 4, 1 << 30)), "i")
    plain = ~F.col("t").startswith("# ") & ~F.col("t").startswith("## ") & ~is_facts & (F.col("t") != "")
    found = inside.groupBy(by, "section").agg(titles.alias("title"), F.array_join(listed((plain, F.col("t"))), " ").alias("intent"), F.flatten(listed((is_facts, ids))).alias("fact_ids"))
    return found.where("title <> ''").join(headline.hint("merge"), by)


def assign(units: DataFrame, sections: DataFrame, by: str = "doc_id", most_sections: int = 8) -> DataFrame:
    """(by, section, title, fact_ids) with every fact in one section; facts that none lists make a last one.

    Without any ids in a document's outline, each of its sections has all facts.
    At the cap of sections, orphans join the last.
    """
    on = sections.withColumn("routed", F.max(F.size("fact_ids")).over(W.partitionBy(by)) > 0)
    routed = FA.route_facts(on.where("routed"), by).join(units.select(by, "fact_id").hint("merge"), [by, "fact_id"], "left_semi")
    last = on.groupBy(by).agg(F.max("section").alias("last"), F.count("*").alias("n"), F.first("routed").alias("routed"))
    left = FA.orphans(units, routed, by).join(last.where("routed").hint("merge"), by).select(by, F.when(F.col("n") >= most_sections, F.col("last")).otherwise(F.col("last") + 1).alias("section"), F.lit(1 << 30).alias("pos"), "fact_id")
    every = routed.select(by, "section", "pos", "fact_id").unionByName(left)
    unrouted = on.where("not routed").select(by, "section").join(units.select(by, "fact_id").hint("merge"), by).select(by, "section", F.col("fact_id").alias("pos"), "fact_id")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "fact_id"))), lambda s: s["fact_id"])
    grouped = every.unionByName(unrouted).groupBy(by, "section").agg(ids.alias("fact_ids"))
    return grouped.join(on.select(by, "section", "title").hint("merge"), [by, "section"], "left").na.fill({"title": "Further facts"})


def prior_sections(sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """Each section with all bodies before it."""
    before = W.partitionBy(by).orderBy("section").rowsBetween(W.unboundedPreceding, -1)
    return sections.withColumn("prior", F.array_join(F.collect_list("body").over(before), "\n\n"))


def escalate(base: DataFrame, second: Callable[[DataFrame], DataFrame], coverage: DataFrame, by: list[str], least: float = 0.55) -> DataFrame:
    """Units with five specifics or more and coverage under ``least`` get a second pass behind the first."""
    poor = coverage.where((F.col("total") >= 5) & (F.col("covered") / F.col("total") < least)).select(*by)
    return base.withColumn("pass", F.lit(1)).unionByName(second(base.join(poor, by, "left_semi")).withColumn("pass", F.lit(2)))


def repaired(before: DataFrame, after: DataFrame, by: str, strict: bool = True) -> DataFrame:
    """The repaired text if its coverage is higher; with ``strict`` off, also if it is the same."""
    rows = before.alias("b").join(after.alias("a"), by, "left")
    better = F.col("a.coverage") > F.col("b.coverage") if strict else F.col("a.coverage") >= F.col("b.coverage")
    return rows.select(by, F.when(better, F.col("a.text")).otherwise(F.col("b.text")).alias("text"), F.coalesce(better, F.lit(False)).alias("repaired"))


def merge_facts(facts: DataFrame, completer: Completer, by: str = "doc_id") -> DataFrame:
    """Clusters of two facts or more are merged by one call; a merge that loses a fact id is refused.

    ``facts`` (by, fact_id, bullet, cluster). A merged text stands at its first
    member's place; the others keep theirs.
    """
    groups = facts.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min("fact_id").alias("fact_id"), F.array_sort(F.collect_set("fact_id")).alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fact_id", "bullet"))), lambda s: F.concat(s["bullet"], F.lit(" [F"), s["fact_id"].cast("string"), F.lit("]"))), "\n").alias("prompt"))
    asked = complete(groups.where("n > 1").select(by, "cluster", "fact_id", "ids", "prompt"), completer)
    ok = F.coalesce(F.size(F.array_except(F.transform("ids", lambda i: i.cast("int")), X.citation_ids(F.col("reply")))) == 0, F.lit(False))
    merged = asked.where(ok).select(by, "cluster", F.col("fact_id").alias("home"), F.col("reply").alias("merged"))
    rows = facts.join(merged, [by, "cluster"], "left")
    return rows.where(F.col("merged").isNull() | (F.col("fact_id") == F.col("home"))).select(by, "fact_id", F.coalesce("merged", "bullet").alias("bullet"))


def digest(
    docs: DataFrame, completer: Completer, write: Callable[[DataFrame], DataFrame], size: int = 6000, by: str = "doc_id", stages: Stages | None = None,
) -> DataFrame:
    """Sources to gated articles: (by, article, facts, sections, cited, words, gate).

    Calls are at three places, each behind a filter and followed by ``write`` (a
    table), so that none is made twice; sections and what is placed in them are
    tables too, as several steps read them. Joins are by key and never broadcast:
    a file of few MB may hold millions of facts, which would meet in the driver. With ``stages``, replies are kept from run to run: a later run
    calls only for chunks, outlines and sections whose prompts have changed.

    A document's facts are one row of a table, in which an id is a place, so that
    listings and sections are made without bringing facts together again. Where
    ``write`` has ``drop``, tables are dropped when they are spent; the result reads two of them.
    """
    ask = (lambda stage, prompts: stages.run(stage, prompts, completer)) if stages else (lambda stage, prompts: complete(prompts, completer))
    drop = getattr(write, "drop", lambda table: None)
    packed = C.pack_documents(docs, size, by)
    found = write(ask("research", packed.select(by, "chunk_no", F.concat(F.lit(EXTRACT), "text").alias("prompt"))))
    entries = FA.bullet_entries(compile_facts(found, by), by, "facts_text")
    kept = FA.dedup_facts(entries, by, ["fact_no"]).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("fact_no", "bullet"))).alias("facts"))
    units = write(kept.select(by, F.size("facts").alias("total"), F.col("facts.bullet").alias("bullets")))
    drop(found)
    listing = F.array_join(F.transform("bullets", lambda b, i: F.concat(F.lit("[F"), (i + 1).cast("string"), F.lit("] "), b)), "\n")
    outline = write(ask("outline", units.select(by, F.concat(F.lit(OUTLINE), listing).alias("prompt"))))
    sections = write(parse_outlines(outline, by))
    drop(outline)
    placed = write(assign(units.select(by, F.explode(F.sequence(F.lit(1), "total")).alias("fact_id")), FA.merge_titles(sections, by), by))
    facts = F.array_join(F.transform("fact_ids", lambda i: F.concat(F.element_at("bullets", i), F.lit(" [F"), i.cast("string"), F.lit("]"))), "\n")
    chosen = units.select(by, "bullets").join(placed.hint("merge"), by)
    bodies = write(ask("section", chosen.select(by, "section", "title", F.concat(F.lit(SECTION), facts).alias("prompt"))))
    heads = sections.groupBy(by).agg(F.first("headline").alias("headline"))
    counts = write(heads.join(units.select(by, "total").hint("merge"), by).join(placed.groupBy(by).agg(F.count("*").alias("sections")).hint("merge"), by))
    for spent in (units, sections, placed):
        drop(spent)
    rows = assemble(counts.select(by, "headline"), bodies.withColumn("body", F.coalesce("reply", F.lit(""))), by).join(counts.drop("headline").hint("merge"), by)
    valid = F.filter(X.citation_ids(F.col("article")), lambda i: i.between(1, F.col("total")))
    share = X.ratio(F.when(F.col("article").isNull(), 0).otherwise(F.size(valid)).cast("long"), F.col("total").cast("long"))
    clean = X.strip_citations(F.col("article"))
    out = rows.select(by, clean.alias("article"), F.col("total").cast("long").alias("facts"), "sections", F.round(share, 6).alias("cited"), X.word_count(clean).alias("words"))
    return out.withColumn("gate", run_gate(F.col("cited"), F.col("cited"), F.lit(1.0), F.col("words"), min_cited=0.5))


def first_line_completer(prompt: str) -> str:
    """A deterministic stand-in for a model: facts are a chunk's sentences, outlines list all ids, sections repeat their facts."""
    from ..functions.sentences import simple_sentences

    head, _, body = prompt.partition("\n")
    if prompt.startswith(EXTRACT):
        return "\n".join(f"- {' '.join(s.split())}" for s in simple_sentences(body) if len(s) > 3)
    if prompt.startswith(OUTLINE):
        ids = [line[2 : line.index("]")] for line in body.split("\n") if line.startswith("[F")]
        half = (len(ids) + 1) // 2
        return "# Digest\n" + "".join(f"## Part {k + 1}\nWhat it says\nFacts: {', '.join('F' + i for i in part)}\n" for k, part in enumerate((ids[:half], ids[half:])) if part)
    return body


