"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's docs. All but the last return the
columns of docs as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.bpe import encode_documents
from factloom.llm.decontaminate import decontaminated
from factloom.llm.exact_dedup import exact_groups
from factloom.llm.langid import accepted
from factloom.llm.queries import tokenizer
from factloom.llm.shared import Tables, folded, relieved, rested
from factloom.llm.simhash_dedup import near_groups


def eased(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage; before and after its own jobs and fits, the driver gives back what was freed, and so do the executors' heaps."""
    @wraps(stage)
    def run(spark: SparkSession, *args, **options) -> DataFrame:
        rested(spark)
        relieved(spark)
        out = stage(spark, *args, **options)
        rested(spark)
        relieved(spark)
        return out

    return run


@eased
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, languages: Collection[str] | None = None, least: float = 0.3) -> DataFrame:
    """Rejects texts without a letter, and those the model puts in no language of ``languages`` (any, by default) at ``least``.

    Learns from the documents' own lang; without one, texts with a letter stay.
    Null and empty texts go. Each row is decided by itself: null and repeated ids,
    repeated rows and other columns don't matter. An empty table stays empty.
    """
    return accepted(docs, docs, languages, least)


@eased
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one stays: that with the largest id.

    A null id is smaller than any other; of rows repeated with one id and text any
    one stays. Null and empty texts are equal. Texts that share an id but differ
    are judged apart. An empty table stays empty.
    """
    kept = exact_groups(docs).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).agg(F.count("*").alias("rows"))
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.sha2(folded(F.col("text")), 256).alias("own_text"))
    left = named.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_text") == F.col("kept_text")), "left_semi")
    if kept.where("rows > 1").take(1):
        left = left.dropDuplicates(["own_id", "own_text"])
    return left.select("row.*")


@eased
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of rows whose texts hang together by the similarity of their shingles one stays: that with the smallest id.

    Candidates come from SimHash fingerprints at 3 or fewer differing bits, and
    from bands of MinHash where fingerprints differ more; sets of shingles decide.
    Rows are told apart by a number of their own, not by their ids: a null id is
    larger than any other, and of equal ids any one is the smallest. Texts without
    words, and null, hang on none and stay. An empty table stays empty.
    """
    own = next(f"row_{k}" for k in range(len(docs.columns) + 1) if f"row_{k}" not in docs.columns)
    numbered = Tables(spark).write(docs.withColumn(own, F.monotonically_increasing_id()))
    groups = near_groups(numbered, own, words=words, similarity=similarity).withColumnRenamed("doc_id", own)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(own).alias("own"))).alias("first")
    kept = groups.join(numbered.select(own, "doc_id"), own).groupBy("component_id").agg(first).select(F.col("first.own").alias(own))
    return numbered.join(kept, own, "left_semi").select(docs.columns)


@eased
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go.

    Each row is decided by itself, in one pass; null and empty texts stay, null
    and repeated ids don't matter. An empty table stays empty.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@eased
def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of each row that is left, repeated ones too; a null text has none. An empty table stays empty."""
    return encode_documents(docs, tokenizer("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is a written table."""
    tables, docs = Tables(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Similarity, the language model and BPE are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
