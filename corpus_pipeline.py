"""The text pipeline over ``documents``: reject toxic documents, keep one of each group of near-duplicates, drop documents with benchmark passages, mask
secrets, encode.

Each stage calls one operator of ``flowsieve.llm`` and works on all rows the stage before kept. All but the last return the columns of their input. Stages on word shingles
take five words and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from flowsieve.llm.queries import toxicity_model
from flowsieve.llm.text import fresh, stash

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold stay. The model learns from the table's labels that are not held out."""
    out = fresh(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity_model(spark, sf_dir), out=out)
    return scored.where(F.col(out) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similarity the document with the smallest doc_id stays, once; rows without doc_id stand behind all others. Documents without words are in no group and stay."""
    found = near_dedup.near_duplicates(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    node = fresh(docs, "node")
    dropped = found.where("NOT kept").select(F.col("node").alias(node)).distinct()
    return docs.withColumn(node, near_dedup.node()).join(dropped, node, "left_anti").dropDuplicates(["doc_id", "text"]).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return secrets.redact(docs, stash(secrets.scan(docs).where("secret = 1").select("doc_id", "text_key", "candidate", "secret"), "secrets"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, token ids (binary, little-endian unsigned 32-bit) and their number. A document that does not decode to its text would fail
    the job. Columns of the added names are replaced."""
    docs = docs.drop("ids", "n_tokens")
    decoded = fresh(docs, "decoded")
    coded = bpe.decode(bpe.encode(docs), text=decoded)
    same = F.when(F.col(decoded) == F.coalesce("text", F.lit("")), F.col("ids")).otherwise(F.raise_error(F.concat(F.lit("not decoded to its text: "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("binary"))
    return coded.select(*docs.columns, same.alias("ids"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secret_scan", mask_secrets), ("bpe", encode)]

#: The forest, the grammar's weights and the tokenizer are beyond SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
