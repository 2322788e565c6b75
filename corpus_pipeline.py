"""The corpus pipeline: quality rules, near duplicates, secrets, source mixing, tokens.

Each stage is one operator at work on all that the stage before kept. ``run`` applies the stages to the documents of a
folder, writing each result as Parquet in the shared folder and reading it again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenceline.llm import byte_bpe, mixing, order_minhash, quality_rules, secret_scan
from fenceline.llm.util import read, shared_dir, unused

#: The vocabulary of the last stage.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _same_columns(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with another text, and its length where there is a column for it."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, learned from ``labels`` on these documents, keep. Rows without an id, which no later stage
    could address, go too."""
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    (out,) = unused(docs, "_quality")
    judged = quality_rules.judge(docs, rules, out=out)
    return judged.where(F.col(out)["kept"] & F.col("doc_id").isNotNull()).drop(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of the least id."""
    return order_minhash.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, what the scan found in them replaced by a mark."""
    (out,) = unused(docs, "_secrets")
    found = secret_scan.scan(docs, out=out)
    return _same_columns(found, secret_scan.redacted(F.col("text"), F.col(out)["all"])).drop(out)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out so that each source comes to its target."""
    mixed = mixing.apply_mix(docs, mixing.mix(docs))
    return _same_columns(mixed, F.col("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (little-endian 32-bit) and whether they decode to the text, a row a document of the mix."""
    shared = byte_bpe.encoder(spark, VOCABULARY, public_tokenizers.PATTERN)
    e = docs.select("doc_id", "source", byte_bpe.round_trip_column(shared).alias("t"))
    return e.select("doc_id", "source", "t.n_tokens", "t.ids", "t.exact")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("secret_scan", secrets), ("source_mixing", mixture), ("byte_bpe", tokens)]

#: Learned rules, sketches and byte-pair merges are beyond SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
