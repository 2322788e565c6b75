"""Importance resampling: draw documents so that their word n-grams come to look like those of a target.

One scan a document hashes all its runs of 1 to n words: a ring keeps the running CRC states of the last n starts, each
word extends every state by a space and itself, and the states after each word are the features that end there. The
scan emits bucket numbers, written once as Parquet in the shared folder; counts, gains and weights are made of them, so
no text is read twice. Corpus and target are only ever known by their counts a bucket, a bounded number. Documents are
drawn by weight plus Gumbel noise of their ids, ranked by a histogram of scores and a window a score.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .util import cut, shared_dir

#: Buckets that features fall into; what reaches the driver is one count a bucket and table.
BUCKETS = 10_000
#: Words a feature has at most.
GRAMS = 2
#: Features that a scan holds as Python integers before they become an array.
HELD = 1 << 16

_word = re.compile(rb"[0-9a-z\x80-\xff]+")  # of text with A-Z lowered, in UTF-8: all beyond ASCII is a letter


def states(words: Iterable[bytes], n: int) -> Iterator[list[int]]:
    """For each word the CRC-32 of the runs of up to ``n`` words that end with it, longest first."""
    ring: list[int] = []
    crc = zlib.crc32
    for w in words:
        if len(ring) == n:
            del ring[0]
        tail = b" " + w
        ring = [crc(tail, s) for s in ring]
        ring.append(crc(w))
        yield ring


def scan_text(text: str | None, n: int = GRAMS, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words and the bucket of every feature, repeats included. Null text: none."""
    raw = (text or "").encode().lower()  # bytes: only A-Z change
    parts, held, words = [], [], 0
    for ring in states((m[0] for m in _word.finditer(raw)), n):
        words += 1
        held += ring
        if len(held) >= HELD:
            parts.append(np.array(held, np.uint32) % buckets)
            held = []
    parts.append(np.array(held, np.uint32) % buckets)
    return words, np.concatenate(parts).astype(_kind(buckets))


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


_SCAN = StructType([StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("buckets", BinaryType())])


def scan_column(text: Column, n: int = GRAMS, buckets: int = BUCKETS) -> Column:
    """Struct n_words, n_features, buckets (little-endian unsigned, 16 bits where they do)."""

    @F.pandas_udf(_SCAN)
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [scan_text(t, n, buckets) for t in texts]
        return pd.DataFrame({"n_words": [w for w, _ in rows], "n_features": [len(b) for _, b in rows], "buckets": [b.tobytes() for _, b in rows]})

    return scan(text)


def scanned(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the scan of its text, written once in the shared folder."""
    rows = docs.select(*[F.col(c) for c in keep], scan_column(F.col(text_col), n, buckets).alias("scan"))
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/features-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def bucket_counts(scans: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of ``scans(scan)``; each task sums its own rows first."""
    kind = _kind(buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return scans.select("scan.buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of every bucket floor(1000 ln of its share in the target over its share in the corpus), add-one smoothed.
    ``corpus`` and ``target`` are ``bucket_counts``: at most ``buckets`` rows each."""
    counts = []
    for side in (corpus, target):
        n = [0] * buckets
        for r in side.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    s, t = counts
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((b + 1) * (all_s + buckets) / ((a + 1) * (all_t + buckets)))) for a, b in zip(s, t)], np.int64)


def weight_column(gain: np.ndarray, bucket_col: Column, buckets: int = BUCKETS) -> Column:
    """Floored mean of the gains of a document's features, 0 for a document without."""
    kind = _kind(buckets)

    @F.pandas_udf(LongType())
    def weight(rows: pd.Series) -> pd.Series:
        ids = [np.frombuffer(x, kind) for x in rows]
        return pd.Series([int(gain[b].sum()) // len(b) if len(b) else 0 for b in ids], dtype="int64")

    return weight(bucket_col)


def noise_column(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, floored: of the first 32 bits of a digest of seed and id (null: an empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, share: tuple[int, int], id_col: str = "doc_id", eligible: str = "eligible", out: str = "rank") -> DataFrame:
    """``scored`` with the place of each drawn row, null for others: of N rows with ``eligible`` the floor(N * share) of highest
    ``score``, ties to smaller ids. A histogram of scores (thousandths of a logarithm, so some ten thousand values
    whatever the rows) gives each score its first place; inside a score rows are counted by id."""
    hist = scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    hist = hist.select("score", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"), F.expr(f"sum(n) over () * {int(share[0])}L div {int(share[1])}L").alias("drawn"))
    hist = cut(hist.where("above < drawn").select(F.col("score").alias("_score"), "above", "drawn"))
    inside = Window.partitionBy("score", eligible).orderBy(F.col(id_col).asc_nulls_last())
    rows = scored.withColumn("_inside", F.row_number().over(inside)).join(hist, F.col("score") == F.col("_score"), "left")
    place = F.col("above") + F.col("_inside")
    rank = F.when(F.col(eligible) & (place <= F.col("drawn")), place).cast("long")
    return rows.select(*[F.col(c) for c in scored.columns], rank.alias(out))


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7, n: int = GRAMS, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row a document: id, n_words, n_features, weight, score, rank (1 is the first drawn; null: not drawn).

    Null and empty texts have no features and weight 0; they and all of fewer than ``least_words`` words are scored but
    not drawn. Rows with equal ids have equal noise and are ranked in any order where their scores are equal too. A null
    id stands for an empty text and comes last among equals. No target text, or no document: all shares are smoothed
    ones. Other columns, whatever their names, are not read. Very long texts are scanned as a stream of words; what is
    held is two bytes a feature.
    """
    scans = scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"], n=n, buckets=buckets)
    wanted = target.select(scan_column(F.col(target_text_col), n, buckets).alias("scan"))
    gain = gains(bucket_counts(scans, buckets), bucket_counts(wanted, buckets), buckets)
    rows = scans.select(F.col("id").alias(id_col), "scan.n_words", "scan.n_features", weight_column(gain, F.col("scan.buckets"), buckets).alias("weight"))
    rows = cut(rows.withColumn("score", (F.col("weight") + noise_column(F.col(id_col), seed)).cast("long")))  # slim: five longs
    rows = rows.withColumn("eligible", F.col("n_words") >= least_words)
    return ranked(rows, share, id_col).drop("eligible")


def drawn(docs: DataFrame, resampled: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``resample`` drew, all their columns; ids must be unique."""
    return docs.join(resampled.where("rank is not null").select(F.col(id_col)), id_col, "left_semi")
