"""Exact token-length histogram: documents by encoded length, and suffix sums that answer every context limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .byte_bpe import encoder


def token_lengths(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of the text; null and empty texts have none."""
    shared = encoder(docs.sparkSession, path, pattern)

    @F.pandas_udf(LongType())
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(ids) // 4 for ids in shared.value.encode_each(text)], dtype="int64")

    return docs.withColumn(out, count(F.col(text_col)))


def length_histogram(lengths: DataFrame, col: str = "n_tokens") -> DataFrame:
    """One row for every length that occurs, with what a context limit of that length gives.

    length, n_docs; docs_at_least and tokens_at_least (documents of that length or more, and their tokens);
    docs_at_most, share_at_most (the quantile function read backwards); truncated_tokens (tokens kept if every document
    is cut at the length); total_docs, total_tokens. Documents are pre-aggregated where they are read, so the window
    sees one row a distinct length: never more than the longest document has tokens. Null lengths are left out.
    """
    # nulls go by their count of zero: a filter on the length itself would be pushed below the encoder and run it twice
    h = lengths.groupBy(F.col(col).cast("long").alias("length")).agg(F.count(col).alias("n_docs")).where("n_docs > 0")
    up = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    tokens = F.col("length") * F.col("n_docs")
    h = h.select(
        "length", "n_docs", F.sum("n_docs").over(up).alias("docs_at_least"), F.sum(tokens).over(up).alias("tokens_at_least"),
        F.sum("n_docs").over(everything).alias("total_docs"), F.sum(tokens).over(everything).alias("total_tokens"),
    )
    at_most = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return h.select(
        "length", "n_docs", "docs_at_least", "tokens_at_least", at_most.alias("docs_at_most"), (at_most / F.col("total_docs")).alias("share_at_most"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The least length that ``share`` of the documents do not exceed: one row ``length``, null for no documents."""
    return histogram.where(F.col("docs_at_most") >= F.lit(share) * F.col("total_docs")).agg(F.min("length").alias("length"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens kept if every document is cut at ``limit``: one row ``tokens``. Any limit, also one that no document has."""
    return histogram.agg(F.coalesce(F.sum(F.least(F.col("length"), F.lit(int(limit))) * F.col("n_docs")), F.lit(0)).alias("tokens"))
