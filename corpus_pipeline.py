"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, neardup, packing, secrets, toxicity
from tidewire.llm.common import store
from tidewire.llm.queries import tokenizer_added, tokenizer_ranks
from tidewire.tables import Tables

#: Near duplicates here share 80 percent of their shingles. A pair just at the bar is overlooked with a chance of about 1 in 9 million.
NEAR = neardup.Rule(percent=80, matches=8)

#: What every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half by the n-gram model that the labelled ones among them train."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, Tables(spark, sf_dir).labels)
    return toxicity.score_documents(docs, model, keep_text=True).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id. A repeated row stays once; rows without an id all stay."""
    docs = docs.select(*COLUMNS)
    dropped = neardup.near_duplicates(docs, NEAR).filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    kept = docs.join(dropped, "doc_id", "left_anti").withColumn("__text", F.xxhash64("text"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "__text", "text").orderBy("doc_id"))
    return kept.withColumn("__turn", turn).filter("doc_id is null or __turn = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.with_hits(docs.select(*COLUMNS), Tables(spark, sf_dir).benchmark).filter("__hits.n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars is that of the new text where one was replaced."""
    old = F.col("text").alias("__old")
    out = secrets.redact(docs.select(*COLUMNS, old))
    changed = ~F.col("text").eqNullSafe(F.col("__old"))
    return out.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document in sequences of at most 1024 ids."""
    return packing.pack_documents(docs, tokenizer_ranks(), added=tokenizer_added())


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]

#: Trained scores and tokenizer ids have no SQL form; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
