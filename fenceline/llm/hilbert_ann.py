"""Approximate nearest neighbours along shifted space-filling curves.

Unit vectors are projected to a few dimensions, many times, each time with another projection and another shift; the place
of a projection on a Hilbert curve is its key. Every ordering is range-partitioned by key, and a query looks at the
``WINDOW`` rows around its own place in each: a number that does not grow with the table. Rows travel as 8-bit copies
of their vectors; the few best of each window merge, and the best of those are reranked by the exact cosine of the
original vectors in double precision.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, LongType, StructField, StructType

from .util import cut

#: Orderings, dimensions of a projection, bits a dimension; rows around a query that it sees in each ordering.
ORDERINGS, DIMENSIONS, BITS, WINDOW = 64, 12, 4, 320
#: Rows that a task holds at once; of a window, the best that go on; of a query, the times k that are reranked exactly.
HELD_ROWS, BEST, RERANK = 8192, 8, 4
#: Windows that a range of keys holds, at least.
WINDOWS_A_RANGE = 16


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer ``cells`` (rows, dimensions), each below 2 ** bits.

    Axes become the transposed index by undoing rotations from the top bit down and then Gray-coding; the bits of all
    axes, interleaved, are the key. All rows go through every step together.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@cache
def curves(dimension: int, orderings: int = ORDERINGS, dimensions: int = DIMENSIONS, seed: int = 23) -> list[tuple[np.ndarray, np.ndarray]]:
    """(projection, shift) of each ordering: orthonormal rows, drawn by ``seed``."""
    rng = np.random.default_rng(seed)
    d = min(dimensions, dimension)
    return [(np.linalg.qr(rng.normal(size=(dimension, d)))[0].T, rng.uniform(0, 1, d)) for _ in range(orderings)]


def curve_keys(unit: np.ndarray, projection: np.ndarray, shift: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Keys of unit vectors. A projection of a random unit vector has deviation 1 / sqrt(dimension); four of those either way
    fill the grid, which the shift moves by up to a half of it."""
    z = unit @ projection.T * np.sqrt(unit.shape[1]) / 8 + 0.5
    return hilbert_keys(((np.clip(z, 0, 1) + shift) / 2 * ((1 << bits) - 1)).astype(np.int64), bits)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of vectors that are there, not empty, not zero and finite throughout, equal rows once. Null ids are left out."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return rows.where(F.exists("v", lambda x: x != 0)).distinct()


def _power(x: np.ndarray) -> np.ndarray:
    """The power of two of each row's greatest component: to divide by it is exact and keeps squares of very small or large
    numbers from being lost."""
    return np.ldexp(1.0, np.frexp(np.abs(x).max(1, keepdims=True))[1] - 1)


_CODED = StructType([StructField("keys", ArrayType(LongType())), StructField("code", BinaryType()), StructField("scale", FloatType())])


def coder(orderings: int):
    """Of a vector: its keys in every ordering, and its unit vector in 8-bit steps of ``scale``."""

    @F.pandas_udf(_CODED)
    def code(v: pd.Series) -> pd.DataFrame:
        keys, codes, scales = [None] * len(v), [b""] * len(v), np.zeros(len(v), np.float32)
        lengths = v.map(len).to_numpy()
        for n in set(lengths.tolist()):
            at = np.flatnonzero(lengths == n)
            x = np.stack(v.iloc[at].to_numpy())
            x = x / _power(x)
            unit = x / np.sqrt((x * x).sum(1, keepdims=True))
            places = np.stack([curve_keys(unit, p, s) for p, s in curves(n, orderings)], 1)
            scale = np.abs(unit).max(1) / 127
            steps = np.rint(unit / scale[:, None]).astype(np.int8)
            scales[at] = scale
            for i, k, c in zip(at.tolist(), places, steps):
                keys[i], codes[i] = k, c.tobytes()
        return pd.DataFrame({"keys": keys, "code": codes, "scale": scales})

    return code


class _Run:
    """Rows and queries of one ordering in order of key, held ``HELD_ROWS`` at a time."""

    def __init__(self, n: int, window: int):
        self.n, self.window, self.held = n, window, []

    def found(self, last: bool):
        """(query id, ids, scores) of queries whose window is complete, or of all if no more rows come; what later windows
        do not need is let go."""
        is_row = np.array([r for _, r, _, _ in self.held], bool)
        at = np.flatnonzero(is_row)
        rows, asked = len(at), np.flatnonzero(~is_row)
        place = np.searchsorted(at, asked)
        if not last:
            now = place + self.window // 2 <= rows
            asked, place = asked[now], place[now]
        width = min(self.window, rows)
        if width and len(asked):
            ids = np.array([i for i, _, _, _ in self.held])
            unit = np.frombuffer(b"".join(c for _, _, c, _ in self.held), np.int8).reshape(-1, self.n) * np.array([s for _, _, _, s in self.held], np.float32)[:, None]
            low = np.clip(place - self.window // 2, 0, rows - width)
            for k in range(0, len(asked), 64):
                q = asked[k : k + 64]
                near = at[low[k : k + 64, None] + np.arange(width)]
                score = np.matmul(unit[near], unit[q][:, :, None])[:, :, 0]
                score[ids[near] == ids[q][:, None]] = -np.inf
                best = np.argpartition(-score, BEST - 1, axis=1)[:, :BEST] if width > BEST else np.tile(np.arange(width), (len(q), 1))
                for i, b in enumerate(best):
                    b = b[score[i, b] > -np.inf]
                    yield ids[q[i]], ids[near[i, b]], score[i, b]
        if not last and rows > self.window:
            done, start = set(asked.tolist()), int(at[rows - self.window])
            self.held = [x for i, x in enumerate(self.held) if (i >= start or not x[1]) and i not in done]


def scan(batches, window: int):
    """Rows (n, ordering, id, is_row, code, scale) sorted by ordering and key: the best of each query's window."""

    def out(run: _Run, last: bool):
        got = list(run.found(last))
        if got:
            q, i, s = (np.concatenate(x) for x in zip(*((np.full(len(i), q), i, s) for q, i, s in got)))
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float32())], ["qid", "id", "rough"])

    now, run = None, None
    for b in batches:
        for n, ordering, *x in zip(*(b.column(c).to_pylist() for c in ("n", "ordering", "id", "is_row", "code", "scale"))):
            if (n, ordering) != now:
                if run:
                    yield from out(run, True)
                now, run = (n, ordering), _Run(n, window)
            run.held.append(x)
            if len(run.held) >= HELD_ROWS + 2 * window:
                yield from out(run, False)
    if run:
        yield from out(run, True)


@F.pandas_udf(DoubleType())
def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Row sums do not depend on where a row stands, so equal vectors have equal scores."""
    out = np.zeros(len(a))
    lengths = a.map(len).to_numpy()
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        x, y = np.stack(a.iloc[at].to_numpy()), np.stack(b.iloc[at].to_numpy())
        x, y = x / _power(x), y / _power(y)
        out[at] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    return pd.Series(out)


def neighbours(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", orderings: int = ORDERINGS, window: int = WINDOW) -> DataFrame:
    """query_id, rank, id_col, score: the ``k`` nearest rows found for each of ``queries`` (rows of ``rows``), itself left out.

    Vectors null, empty, zero or not finite take no part; vectors of different lengths have no cosine and are searched
    apart. Of equal vectors only the k + 1 of least id can be among the k nearest, so copies beyond that leave before
    anything is ordered: one vector that a third of the rows share costs nothing. Where a window meets an end of its
    ordering or of its range of keys it is moved inwards. Other columns are not read. An empty table gives no rows.
    """
    spark = rows.sparkSession
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    kept = usable(rows, id_col, vector_col).withColumn("r", copies).where(F.col("r") <= k + 1).drop("r")
    asked = usable(queries, id_col, vector_col)
    # queries travel with the rows, so both are ordered alike; a row may be both
    both = kept.withColumn("is_row", F.lit(True)).unionByName(asked.withColumn("is_row", F.lit(False)))
    both = cut(both.select("id", "v", "is_row", F.size("v").alias("n"), coder(orderings)("v").alias("c")))
    spread = both.select("id", "is_row", "n", "c.code", "c.scale", F.posexplode("c.keys").alias("ordering", "key"))
    # a range of keys holds many windows, so that few queries are near an end of one; small tables have few ranges
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), both.count() * orderings // (WINDOWS_A_RANGE * window)))
    ordered = spread.repartitionByRange(parts, "n", "ordering", "key", "id").sortWithinPartitions("n", "ordering", "key", "id", "is_row")
    found = ordered.select("n", "ordering", "id", "is_row", "code", "scale").mapInArrow(lambda it: scan(it, window), "qid long, id long, rough float")
    best = found.groupBy("qid", "id").agg(F.max("rough").alias("rough"))
    rank = lambda c: F.row_number().over(Window.partitionBy("qid").orderBy(F.col(c).desc(), "id"))
    best = best.withColumn("r", rank("rough")).where(F.col("r") <= RERANK * k).select("qid", "id")
    pair = best.join(both.where("is_row").select("id", "v"), "id").join(both.where("not is_row").select(F.col("id").alias("qid"), F.col("v").alias("q")), "qid")
    exact = pair.where(F.size("v") == F.size("q")).select("qid", "id", cosine("v", "q").alias("score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    out = exact.withColumn("rank", rank("score")).where(F.col("rank") <= k)
    return out.select(F.col("qid").alias("query_id"), "rank", F.col("id").alias(id_col), "score")
