"""Exact dedup: skew-safe combining of equal texts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Tables, attach, folded, rested, settled


def digest_of(body: Column) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(body, 256)


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """text_sha256, body, keep_id, group_size: one row for each text, dealt by its digest."""
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("text_sha256", "body", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.repartition("text_sha256").groupBy("text_sha256", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Every row of ``docs`` with the row of its group of equal texts that stays.

    Texts are equal when identical after lower-casing A-Z only; the largest id of
    a group stays. Three steps, each of which groups by the digest and the full
    text: Spark's partial aggregate combines the equal texts of one task, the
    salted groups (``salts`` per text, by a hash of the id) combine what tasks
    send, and the salt winners combine into one row per text. A group that is a
    third of all rows thus sends at most one row per task and salt. The winners
    return to the rows by digest. Digests that stand for more than one text, if
    there ever are any, are counted without the texts; only their rows are
    combined once more, and return by digest and text.

    Returns doc_id, keep_id, group_size (rows), kept, text_sha256. Null text: as
    the empty text. Null id: smaller than any id; in a group of null ids only,
    keep_id is null and its rows are kept. Rows repeated with one id and text are
    one document: all or none are kept, and group_size counts each. Empty table:
    no rows. Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    tables = Tables(spark)
    body = folded(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), body.alias("body")).withColumn("text_sha256", digest_of(F.col("body")))
    winners = tables.write(_combined(rows, salts).drop("body").withColumn("texts", F.count("*").over(W.partitionBy("text_sha256"))))
    rested(spark)
    marked = tables.write(rows.drop("body"))
    rested(spark)
    total, clashes = winners.agg(F.sum("group_size"), F.coalesce(F.max("texts"), F.lit(0)) > 1).first()
    out = attach(marked, winners.where("texts = 1").drop("texts"), "text_sha256", "group_size", total or 0)
    if clashes:
        apart = rows.join(winners.where("texts > 1").select("text_sha256").distinct(), "text_sha256", "left_semi")
        out = out.unionByName(apart.join(_combined(apart, salts), ["text_sha256", "body"]).drop("body"))
    return settled(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"))
