"""Fill-in-middle: texts cut into units as rows, seeded cuts joined to them by unit ordinal, three parts put in another order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import Tables, attach, settled

#: What stands in front of each part of an output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(id_col: Column, seed: int = 1) -> list[Column]:
    """Four unsigned integers of an id: the first 8-digit groups of the hex sha256 of ``seed:id``; a null id is an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str | None = None, run: int = 1024, moved_percent: int = 90, spm_percent: int = 20, seed: int = 1) -> DataFrame:
    """Every row of ``docs`` with its text as a prefix, a suffix and a middle, in the order in which a model is to fill the middle.

    Units are code points, or the matches of ``unit``, a pattern that matches no
    empty text; what it leaves out is a unit per code point. Matches become rows
    (posexplode); window sums over a document's rows give how many units and code
    points stand before each; the two cuts, drawn between units from the id and
    the number of units, are joined to the row that holds their ordinal; a
    document's offsets are the least and the largest of what they find; substring
    takes the parts. A row is ``run`` code points, a match by itself with
    ``unit``: one row per code point would be some forty bytes for each byte of
    text, and a cut inside a run is as far behind its start as the ordinals are.

    A text keeps its form ``plain`` if it is empty, holds one of the three marks, or
    by draw (100 - ``moved_percent`` of ids); others are ``spm`` by draw
    (``spm_percent``: suffix, prefix, middle), else ``psm``. See ``restored``.

    Offsets return to texts by a digest of id and text, so rows repeated with both
    are cut alike, and keys with many rows aren't shuffled (``attach``). The rows
    of one document meet in one task of the window: its length over ``run``.

    Returns doc_id, n (units), form, prefix_chars, middle_chars (null if plain),
    output. Null text: empty, n 0. Null id: drawn from an empty one. Texts of
    one unit: empty parts beside it. Empty table: no rows. Other columns are ignored.
    """
    tables = Tables(docs.sparkSession)
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    body = F.col("body")
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    form = F.when((body == "") | marked | (h3 % 100 >= moved_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("form", form)
    plain, moved = rows.where("form = 'plain'"), rows.where("form <> 'plain'")

    step = 1 if unit else run
    matches = F.regexp_extract_all(body, F.lit(f"(?:{unit})|(?s:.)" if unit else f"(?s).{{1,{run}}}+"), F.lit(0))
    keyed = moved.withColumn("key", F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body), 256))
    chars = F.length("match")
    runs = (
        keyed.select("key", h1.alias("h1"), h2.alias("h2"), F.posexplode(matches).alias("run", "match"))
        .select("key", "h1", "h2", "run", chars.alias("chars"), (F.lit(1) if unit else chars).alias("units"))
        .groupBy("key", "h1", "h2", "run", "chars", "units").agg(F.count("*").alias("copies"))
    )
    before = W.partitionBy("key").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    units = tables.write(runs.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("units", "chars"))))

    counted = units.groupBy("key", "h1", "h2").agg(F.sum("units").alias("n"), F.sum("chars").alias("all_chars"), F.max("copies").alias("copies"))
    ends = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    requests = counted.select("key", "n", "all_chars", "copies", F.explode(F.array(F.least(*ends), F.greatest(*ends))).alias("ordinal"))
    found = requests.withColumn("run", F.expr(f"ordinal div {step}")).join(units.select("key", "run", "units_before", "chars_before"), ["key", "run"], "left")
    place = F.coalesce(F.col("chars_before") + F.col("ordinal") - F.col("units_before"), F.col("all_chars"))  # a cut behind the last unit has no row
    offsets = tables.write(found.groupBy("key", "n", "copies").agg(F.min(place).cast("int").alias("first"), F.max(place).cast("int").alias("last")))

    total = offsets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    cut = attach(keyed, offsets, "key", "copies", total)
    prefix, suffix = F.substring(body, F.lit(1), F.col("first")), F.substring(body, F.col("last") + 1, F.length(body))
    middle = F.substring(body, F.col("first") + 1, F.col("last") - F.col("first"))
    psm, spm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = cut.select("doc_id", "n", "form", F.col("first").cast("long").alias("prefix_chars"), (F.col("last") - F.col("first")).cast("long").alias("middle_chars"), F.when(F.col("form") == "psm", psm).otherwise(spm).alias("output"))
    none = F.lit(None).cast("long")
    left = plain.select("doc_id", (F.size(matches) if unit else F.length(body)).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), body.alias("output"))
    return settled(out.unionByName(left))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: its parts, told apart by the marks, which no moved text holds itself."""
    from_prefix, from_suffix, middle = (F.substring_index(output, mark, -1) for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(F.substring_index(from_prefix, SUFFIX, 1), middle, F.substring_index(from_suffix, MIDDLE, 1))
    spm = F.concat(F.substring_index(from_prefix, MIDDLE, 1), middle, F.substring_index(from_suffix, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
