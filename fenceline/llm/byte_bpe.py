"""Byte-level BPE encoding and decoding with a segment tree.

A piece's byte positions are the leaves; a leaf holds the rank of the pair that starts there, an inner node the least
rank below it, so the leftmost best pair is found by walking down and a merge is three point updates: logarithmic each,
which keeps a piece of a hundred thousand letters cheap. Pieces repeat, so a worker keeps a bounded table of them.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

#: No pair.
NONE = 1 << 62
#: The same for arrays of 32-bit ranks.
NO_PAIR = (1 << 31) - 1
#: Pieces a worker remembers; the table starts anew when it is full, so memory is bounded.
REMEMBER = 400_000
#: Bytes of the longest piece that is encoded together with others.
WIDEST = 64


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order of a file of lines ``base64 rank``; ids are ranks, without gaps."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of least rank until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n == 0:
        return []
    width = 1 << max(0, (n - 1).bit_length())
    rank = ranks.get
    tree = [NONE] * (2 * width)
    tree[width : width + n - 1] = [rank(piece[i : i + 2], NONE) for i in range(n - 1)]
    for k in range(width - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        k = width + i
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            least = a if a <= b else b
            if tree[k] == least:
                return
            tree[k] = least

    while tree[1] != NONE:
        k, best = 1, tree[1]
        while k < width:
            k *= 2
            if tree[k] != best:  # the left child, unless only the right one has the least rank
                k += 1
        i = k - width
        j = after[i]
        end = after[j]
        after[i] = end
        put(j, NONE)
        if end < n:
            before[end] = i
            put(i, rank(piece[i : after[end]], NONE))
        else:
            put(i, NONE)
        if (p := before[i]) >= 0:
            put(p, rank(piece[p:end], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class PairRanks:
    """Ranks of pairs of ids, looked up for whole arrays."""

    def __init__(self, tokens: list[bytes]):
        ranks = {t: i for i, t in enumerate(tokens)}
        self.ranks, self.base = ranks, len(tokens)
        found = {}
        for merged, t in enumerate(tokens):
            for k in range(1, len(t)):
                a = ranks.get(t[:k])
                if a is not None and (b := ranks.get(t[k:])) is not None:
                    found[a * self.base + b] = merged
        self.keys = np.array(sorted(found), np.int64)
        self.merged = np.array([found[k] for k in self.keys.tolist()], np.int32)
        self.bytes = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        self.first = self(self.bytes.repeat(256), np.tile(self.bytes, 256)).reshape(256, 256)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)


def merge_many(pieces: list[bytes], width: int, pairs: PairRanks) -> list[bytes]:
    """``merge_piece`` for many pieces of 2 to ``width`` bytes (a power of two) at once: one segment tree a row, one merge a
    row and round. Gives the ids as little-endian 32-bit integers."""
    m, n = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width)
    ids = pairs.bytes[raw]
    at = np.arange(width)
    ids[at >= n[:, None]] = -1
    tree = np.full((m, 2 * width), NO_PAIR, np.int32)
    tree[:, width:-1] = np.where(at[1:] < n[:, None], pairs.first[raw[:, :-1], raw[:, 1:]], NO_PAIR)
    w = width
    while w > 1:
        tree[:, w // 2 : w] = np.minimum(tree[:, w : 2 * w : 2], tree[:, w + 1 : 2 * w : 2])
        w //= 2
    after = np.tile(np.arange(1, width + 2), (m, 1))
    before = np.tile(np.arange(-1, width), (m, 1))
    depth = width.bit_length() - 1
    live = np.arange(m)
    flat, two = tree.reshape(-1), 2 * width
    while len(live := live[tree[live, 1] != NO_PAIR]):
        root = live * two
        best = flat[root + 1]
        k = np.ones(len(live), np.int64)
        for _ in range(depth):
            k *= 2
            k += flat[root + k] != best  # the left child, unless only the right one has the least rank
        i = k - width
        j = after[live, i]
        end = after[live, j]
        p = before[live, i]
        ids[live, i] = best
        ids[live, j] = -1
        after[live, i] = end
        before[live, end] = i
        right = np.where(end < n[live], pairs(best, ids[live, np.minimum(end, width - 1)]), NO_PAIR)
        flat[root + width + j] = NO_PAIR
        flat[root + width + i] = right
        has = p >= 0
        flat[(root + width + p)[has]] = pairs(ids[live[has], p[has]], best[has])
        node = np.concatenate([width + i, width + j, width + p[has]])
        row = np.concatenate([root, root, root[has]])
        for _ in range(depth):
            node >>= 1
            child = row + 2 * node
            flat[row + node] = np.minimum(flat[child], flat[child + 1])
    mask = ids >= 0
    out = ids[mask].astype("<u4").tobytes()
    ends = np.concatenate([[0], 4 * mask.sum(1).cumsum()]).tolist()
    return [out[x:y] for x, y in zip(ends, ends[1:])]


class Known(dict):
    """Piece -> its ids; a piece that is not there is noted in ``unseen``."""

    def __init__(self):
        self.unseen: list[str] = []

    def __missing__(self, piece: str) -> None:
        self.unseen.append(piece)


class Encoder:
    """Encodes texts and decodes ids; cheap to ship (tokens and pattern), builds its tables where it first works."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self._known: dict[str, bytes] | None = None

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "_known": None}

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces: the many short ones together by width, long ones singly."""
        ranks, groups = self._pairs.ranks, {}
        for p in pieces:
            b = p.encode()
            if (whole := ranks.get(b)) is not None:
                self._known[p] = whole.to_bytes(4, "little")
            elif len(b) > WIDEST:
                self._known[p] = np.array(merge_piece(b, ranks), "<u4").tobytes()
            else:
                groups.setdefault(1 << (len(b) - 1).bit_length(), []).append((p, b))
        for width, group in groups.items():
            for k in range(0, len(group), 8192):
                part = group[k : k + 8192]
                self._known.update(zip((p for p, _ in part), merge_many([b for _, b in part], width, self._pairs)))

    def encode_each(self, texts) -> list[bytes]:
        """Ids of every text as little-endian 32-bit integers; null and empty texts: none."""
        if self._known is None:
            self._known, self._pairs, self._split = Known(), PairRanks(self.tokens), regex.compile(self.pattern).findall
        known, out, waiting, held = self._known, [], [], 0
        get = known.__getitem__

        def flush() -> None:
            if not waiting:
                return
            new = set(known.unseen)
            if len(known) + len(new) > REMEMBER:
                known.clear()
                new = set().union(*(pieces for _, pieces in waiting))
            self._learn(new)
            known.unseen.clear()
            for k, pieces in waiting:
                out[k] = b"".join(map(get, pieces))
            for p in [p for p in new if len(p) > WIDEST]:  # a long piece hardly comes again
                known.pop(p, None)
            waiting.clear()

        for t in texts:
            pieces = self._split(t) if t else []
            before = len(known.unseen)
            ids = list(map(get, pieces))
            if len(known.unseen) == before:
                out.append(b"".join(ids))
                continue
            waiting.append((len(out), pieces))
            out.append(b"")
            held += len(t)
            if held > 2_000_000:
                flush()
                held = 0
        flush()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_each([text])[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def encoder(spark: SparkSession, path: str, pattern: str):
    """A broadcast Encoder. The vocabulary file bounds what is sent: some 50,000 short tokens."""
    return spark.sparkContext.broadcast(Encoder(read_ranks(path), pattern))


def encode_column(shared, text_col: str = "text"):
    """Column of the ids of a text as binary, little-endian unsigned 32-bit; null text: empty."""

    @F.pandas_udf(BinaryType())
    def encode(text: pd.Series) -> pd.Series:
        e = shared.value
        return pd.Series(e.encode_each(text), dtype=object)

    return encode(F.col(text_col))


def decode_column(shared, ids_col: str):
    """Column of the bytes that the ids of ``encode_column`` stand for; an id outside the vocabulary is an error."""

    @F.pandas_udf(BinaryType())
    def decode(ids: pd.Series) -> pd.Series:
        e = shared.value
        return pd.Series([e.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], dtype=object)

    return decode(F.col(ids_col))


_DIGEST = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def digest_column(shared, text_col: str = "text"):
    """Struct n_tokens, ids_sha256, decoded_sha256: encodes, decodes the ids again and keeps only digests, so that
    neither ids nor decoded bytes travel back to the JVM."""

    @F.pandas_udf(_DIGEST)
    def digest(text: pd.Series) -> pd.DataFrame:
        e, rows, sha = shared.value, [], hashlib.sha256
        for raw in e.encode_each(text):
            ids = np.frombuffer(raw, "<u4")
            rows.append((len(ids), sha(raw).hexdigest(), sha(e.decode(ids.tolist())).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(F.col(text_col))


_ROUND_TRIP = StructType([StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("exact", BooleanType())])


def round_trip_column(shared, text_col: str = "text"):
    """Struct n_tokens, ids, exact: the ids, and whether decoding them gives the text's bytes again."""

    @F.pandas_udf(_ROUND_TRIP)
    def trip(text: pd.Series) -> pd.DataFrame:
        e = shared.value
        ids = e.encode_each(text)
        exact = [e.decode(np.frombuffer(x, "<u4").tolist()) == (t or "").encode() for t, x in zip(text, ids)]
        return pd.DataFrame({"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "exact": exact})

    return trip(F.col(text_col))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a binary column ``out`` of ids. Every row stays; null and empty texts have no ids."""
    return docs.withColumn(out, encode_column(encoder(docs.sparkSession, path, pattern), text_col))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with a binary column ``out``: the bytes that ``ids_col`` stands for."""
    return docs.withColumn(out, decode_column(encoder(docs.sparkSession, path, pattern), ids_col))
