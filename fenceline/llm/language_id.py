"""Language ID: a convolutional network over bytes, trained and applied in numpy.

Filters of several widths slide over fixed-length windows of bytes (a filter is one weight a byte value and offset, so a
convolution is a sum of table rows), the maximum of each filter goes through a softmax layer. A text is as many
windows as cover all its bytes; its score is the mean of the windows' probabilities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Bytes of a window; widths and number of filters of each; windows that go through the network together.
WINDOW, WIDTHS, FILTERS, TOGETHER = 256, (2, 3, 4), 12, 96
#: Windows overlap by a filter's reach, so that no n-gram is cut.
STRIDE = WINDOW - max(WIDTHS) + 1
#: The padding of a text shorter than a window: a byte that UTF-8 never uses.
PAD = 255
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]").search


def windows(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover ``data``: steps of STRIDE, the last window at the end."""
    x = np.frombuffer(data, np.uint8)
    if len(x) <= WINDOW:
        return np.concatenate([x, np.full(WINDOW - len(x), PAD, np.uint8)])[None]
    at = np.arange(0, len(x) - WINDOW, STRIDE)
    return np.lib.stride_tricks.sliding_window_view(x, WINDOW)[np.append(at, len(x) - WINDOW)]


@dataclass
class Network:
    """``tables[w]`` is (offset, byte, filter); ``out`` and ``bias`` the softmax layer; ``langs`` its classes."""

    langs: list[str]
    tables: dict[int, np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def pooled(self, x: np.ndarray, where: bool = False):
        """Greatest value of every filter in every window (and its position)."""
        best, at = [], []
        for w, t in self.tables.items():
            length = x.shape[1] - w + 1
            acc = np.take(t[0], x[:, :length], axis=0)
            for k in range(1, w):
                acc += np.take(t[k], x[:, k : k + length], axis=0)
            if where:
                at.append(acc.argmax(1))
            best.append(acc.max(1))
        return (np.concatenate(best, 1), at) if where else np.concatenate(best, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(self.pooled(x), 0) @ self.out + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def predict(self, texts) -> list[tuple[str, float]]:
        """(language, score) of whole texts; UNKNOWN and 0 for null or letterless ones, or without a learned language."""
        out: list = [(UNKNOWN, 0.0)] * len(texts)
        batch: list[np.ndarray] = []
        owner: list[int] = []
        sums = np.zeros((len(texts), max(1, len(self.langs))))
        counts = np.zeros(len(texts))

        def flush() -> None:
            x = np.concatenate(batch)
            who = np.repeat(owner, [len(b) for b in batch])
            for k in range(0, len(x), TOGETHER):
                np.add.at(sums, who[k : k + TOGETHER], self.probabilities(x[k : k + TOGETHER]))
            np.add.at(counts, who, 1)
            batch.clear()
            owner.clear()

        for i, t in enumerate(texts):
            if self.langs and t and _letter(t):
                batch.append(windows(t.encode()))
                owner.append(i)
                if len(batch) >= 64 or len(batch[-1]) > 500:
                    flush()
        if batch:
            flush()
        for i in np.flatnonzero(counts):
            p = sums[i] / counts[i]
            k = int(p.argmax())
            out[i] = (self.langs[k], float(min(1.0, p[k])))
        return out


def train(texts: list[str], langs: list[str], steps: int = 900, batch: int = 64, rate: float = 0.02, seed: int = 5) -> Network:
    """Fit by Adam on windows of ``texts``; classes are the languages that occur, each drawn equally often."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    net = Network(names, tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(names)))).astype(np.float32), np.zeros(max(1, len(names)), np.float32))
    if len(names) < 2:
        return net
    pools = [np.concatenate([windows(t.encode()) for t, g in zip(texts, langs) if g == name]) for name in names]
    params = [*net.tables.values(), net.out, net.bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        x = np.stack([pools[c][rng.integers(len(pools[c]))] for c in y])
        best, at = net.pooled(x, where=True)
        hidden = np.maximum(best, 0)
        z = hidden @ net.out + net.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(batch), y] -= 1
        p /= batch
        grads = []
        back = (p @ net.out.T) * (best > 0)
        rows, cols = np.arange(batch)[:, None], np.arange(FILTERS)[None]
        for n, (w, t) in enumerate(net.tables.items()):
            g = np.zeros_like(t)
            part = back[:, n * FILTERS : (n + 1) * FILTERS].astype(np.float32)
            for k in range(w):
                np.add.at(g[k], (x[rows, at[n] + k], cols), part)
            grads.append(g)
        grads += [hidden.T @ p, p.sum(0)]
        scale = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for q, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= (scale * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, per_language: int = 1200, chars: int = 1024, max_languages: int = 64, text_col: str = "text", lang_col: str = "lang") -> Network:
    """Train on a bounded sample of ``docs`` with language and a text of some letter: the ``per_language`` texts of least hash of
    each language, of each ``chars`` characters at a place that the hash picks. Texts count once, however many rows hold
    them. Where a dirty column holds more values, the ``max_languages`` most frequent ones are learned (ties to the lesser),
    so at most ``per_language * max_languages`` pieces of text reach the driver."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).alias("g"))
    langs = [r["g"] for r in rows.groupBy("g").count().orderBy(F.col("count").desc(), "g").limit(max_languages).collect()]
    if not langs:
        return train([], [])
    rows = rows.where(F.col("g").isin(langs) & F.col("t").rlike(r"\p{L}")).withColumn("h", F.xxhash64("t", F.lit(11)))
    # a rank limit is applied in every task before rows move, so a hot language is no large group
    least = rows.select("g", "h").distinct().withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("h"))).where(F.col("r") <= per_language)
    start = F.pmod(F.xxhash64("t", F.lit(12)), F.greatest(F.length("t") - chars + 1, F.lit(1))) + 1
    piece = F.col("t").substr(start.cast("int"), F.lit(chars))
    got = rows.join(F.broadcast(least.select("g", "h")), ["g", "h"]).groupBy("g", "h").agg(F.min(piece).alias("t")).toPandas()
    got = got[got["t"].map(lambda t: bool(_letter(t)))].sort_values(["g", "h"])
    return train(got["t"].tolist(), got["g"].tolist())


_PREDICTED = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])


def predict_column(net: Network, docs: DataFrame, text_col: str = "text") -> Column:
    """Struct (lang, score) of the whole text. The network is some 120 KB and a row a language, and is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf(_PREDICTED)
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(text.tolist()), columns=["lang", "score"])

    return predict(F.col(text_col))
