"""A training-corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared
folder and reads it again as the next stage's docs. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import minhash, mixing, packing, secrets, toxicity
from loomlog.llm.common import staged, table
from loomlog.llm.queries import BYTE_RANKS, BYTE_VOCABULARY, vocabulary
from loomlog.session import importable


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; null and empty texts stay."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest doc_id. Texts without words and rows without doc_id are nobody's
    copies; rows of one doc_id with different texts are documents of their own; of rows of one doc_id and text one stays."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    key = ["doc_id", "text_hash"]
    once = found.where("doc_id is not null").groupBy(*key).agg(F.bool_and("stays").alias("stays"), F.count("*").alias("m"))
    gone = once.where("not stays").select(*key)
    names = docs.columns
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(gone, key, "left_anti")
    again = staged(once.where("stays and m > 1").select(*key), "again")
    if again.isEmpty():
        return kept.select(*names)
    first = kept.join(again, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("row"))
    return kept.join(again, key, "left_anti").select(*names).unionByName(first.select("row.*"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, with its secrets replaced; a null text stays null."""
    out = secrets.redacted(docs, vocabulary(BYTE_RANKS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those without words are in no mix and go."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces; a null or empty text is one piece of the end id."""
    return packing.pack(docs, vocabulary(BYTE_VOCABULARY), end_id=0, capacity=2048)


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("secret_scans", hide_secrets), ("source_mix", mix_sources), ("best_fit_pack", pack)]
#: Toxicity scores, tokenizers and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
