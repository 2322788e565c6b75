"""MinHash near-dedup that keeps order: Order MinHash over occurrence-labelled word k-mers, verified by banded alignment.

A sketch takes the k-mers of least hash value (an occurrence number makes repeats differ) and joins them in the order
they have in the text, so texts agree on a sketch if they share those k-mers *in order*. Agreement on any of several
sketches makes a candidate; verified candidates are edges of which the classes are the connected components.

Candidates are not listed as pairs. The texts of a sketch value go to tiles, some pivots and some members each, and a tile
looks up the k-mers of a member among those of all its pivots at once; only pairs that share enough k-mers and are not
yet in one class are aligned. Sketch values of the same texts are one. Where a value holds more texts than ``PIVOTS``, a
round takes so many of them as pivots, which meet all others of the value and retire from it; rounds go on with more pivots
until no value holds two texts of different classes that have not met. Classes are those of verifying all candidates.

A meeting is verified on the whole texts. Labelled k-mers are unique in a text, so the best alignment of two k-mer
sequences is the longest increasing run of matched positions; only matches in the diagonal band that similarity
``threshold`` leaves room for are looked at. Similarity is shared k-mers in alignment over k-mers in either text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .util import WORD, components, counted, cut, observed, parts_of, unused

#: Words of a k-mer; similarity from which two texts are near duplicates.
K, THRESHOLD = 5, 0.8
#: Sketches, and k-mers in a sketch. At similarity 0.8 a sketch agrees with probability 0.8 ** 4 = 0.41 or so, all 24 fail
#: with 3e-6; at 0.3, which a shared passage may give, any agrees with 0.18.
SKETCHES, ELEMENTS = 24, 4
#: Pivots of a sketch value in the first round, and how many times more each further round takes; where no more texts are
#: left than that, all of them meet.
PIVOTS, GROWTH = 1024, 16
#: K-mers of the pivots, and of the members, of a tile about (8 bytes each): a sketch value of more is dealt out over more tiles.
TILE_KMERS = 200_000
#: Parts that the rows of one text are dealt into.
SALTS = 32
#: Rows of tiles (a few numbers each) up to which they are broadcast, 16 MB or so; beyond, the join shuffles.
BROADCAST_ROWS = 250_000

_words = re.compile(WORD).findall
_MIX = np.uint64(0xBF58476D1CE4E5B9)  # an odd constant; any will do


def _scramble(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


class _WordHash(dict):
    """Word -> 64-bit hash, the same in every process; starts anew when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash_of = _WordHash().__getitem__


def labelled_kmers(words: list[str], k: int = K) -> np.ndarray:
    """Hashes of the k-mers in text order, each with its occurrence number mixed in, so that none repeats. A text of
    fewer than k words (but some) is one k-mer."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of, words), np.uint64, len(words))
    k = min(k, len(h))
    m = len(h) - k + 1
    with np.errstate(over="ignore"):
        key = h[:m].copy()
        for i in range(1, k):
            key *= _MIX
            key += h[i : m + i]
        key = _scramble(key)
        s = np.sort(key)
        if (s[1:] == s[:-1]).any():
            order = np.argsort(key, kind="stable")
            s = key[order]
            at = np.arange(m)
            run = at - np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), at, 0))
            again = np.empty(m, np.uint64)
            again[order] = run.astype(np.uint64)
            key = np.where(again > 0, _scramble(key + again * _MIX), key)
    return key


def sketches(kmers: np.ndarray, count: int = SKETCHES, elements: int = ELEMENTS) -> np.ndarray:
    """``count`` keys of a text: each the ``elements`` k-mers of least value under its own hash, in text order."""
    n = len(kmers)
    if n == 0:
        return np.empty(0, np.int64)
    take = min(elements, n)
    seeds = np.arange(1, count + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        least = np.empty((count, take), np.int64)
        for k in range(0, count, step := max(1, 200_000 // n)):  # a few sketches at a time where the text is long
            v = (kmers ^ _scramble(seeds[k : k + step])[:, None]) * _MIX
            v ^= v >> np.uint64(32)
            least[k : k + step] = np.argpartition(v, take - 1, axis=1)[:, :take]
        least.sort(axis=1)
        key = seeds
        for x in kmers[least].T:
            key = _scramble(key * _MIX + x)
    return key.view(np.int64)


def increasing(at: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(at) < 2 or (np.diff(at) > 0).all():
        return len(at)
    tails: list[int] = []
    for x in at.tolist():
        k = bisect_left(tails, x)
        if k == len(tails):
            tails.append(x)
        else:
            tails[k] = x
    return len(tails)


class Aligner:
    """Aligns texts with one text: its k-mers are sorted once."""

    def __init__(self, kmers: np.ndarray, threshold: float = THRESHOLD):
        self.n, self.threshold = len(kmers), threshold
        self.order = np.argsort(kmers)
        self.sorted = kmers[self.order]

    def similarity(self, other: np.ndarray) -> float:
        """Shared in alignment over all k-mers; 0 where it is certain to be below the threshold. Two empty texts: 1."""
        n, m = self.n, len(other)
        if n == 0 or m == 0:
            return float(n == m)
        if min(n, m) < self.threshold * max(n, m):
            return 0.0
        at = np.minimum(np.searchsorted(self.sorted, other), n - 1)
        hit = np.flatnonzero(self.sorted[at] == other)
        mine = self.order[at[hit]]
        # shared >= t / (1 + t) * (n + m), so at most the rest is skipped on either side and bounds the way off the diagonal
        band = n + m - 2 * int(np.ceil(self.threshold / (1 + self.threshold) * (n + m) - 1e-9))
        mine = mine[np.abs(mine - hit) <= band]
        if len(mine) < self.threshold / (1 + self.threshold) * (n + m) - 1e-9:
            return 0.0
        shared = increasing(mine)
        return shared / (n + m - shared)


_SIG = StructType([StructField("n", IntegerType()), StructField("keys", ArrayType(LongType()))])


@F.pandas_udf(_SIG)
def signature(text: pd.Series) -> pd.DataFrame:
    """Number of k-mers and sketch keys of a text; null and empty texts have none."""
    sizes, keys = [], []
    for t in text:  # one text's k-mers at a time
        kmers = labelled_kmers(_words(t or ""))
        sizes.append(len(kmers))
        keys.append(sketches(kmers))
    return pd.DataFrame({"n": sizes, "keys": keys})


@F.pandas_udf(BinaryType())
def kmer_bytes(text: pd.Series) -> pd.Series:
    return pd.Series([labelled_kmers(_words(t or "")).tobytes() for t in text], dtype=object)


class Tile:
    """Pivots that members meet. ``meet`` gives the links between texts of labels that this tile has not joined before."""

    def __init__(self, threshold: float):
        self.threshold, self.nodes, self.labels, self.kmers = threshold, [], [], []
        self.aligners: dict[int, Aligner] = {}
        self.up: dict[int, int] = {}  # label -> label that it was joined to
        self.sorted: np.ndarray | None = None

    def root(self, label: int) -> int:
        while (over := self.up.get(label, label)) != label:
            self.up[label] = label = self.up.get(over, over)
        return label

    def add(self, node: int, label: int, kmers: np.ndarray) -> None:
        self.nodes.append(node)
        self.labels.append(label)
        self.kmers.append(kmers)

    def shared(self, kmers: np.ndarray) -> np.ndarray:
        """Of each pivot, how many of ``kmers`` it has; 0 for pivots that have too few of them to be similar.

        A similar pivot has at least threshold times as many as there are, so it has one of the rarest that are over. Where
        few pivots have any of those, only they are counted: texts of one sketch value that are unlike cost no counts.
        """
        if self.sorted is None:
            flat = np.concatenate(self.kmers)
            order = np.argsort(flat, kind="stable")
            self.sorted, self.owner = flat[order], np.repeat(np.arange(len(self.kmers), dtype=np.int32), [len(k) for k in self.kmers])[order]
            self.sizes = np.array([len(k) for k in self.kmers])
        low, high = np.searchsorted(self.sorted, kmers, "left"), np.searchsorted(self.sorted, kmers, "right")
        out = np.zeros(len(self.kmers), np.int64)
        n = high - low
        over = len(kmers) - int(np.ceil(self.threshold * len(kmers) - 1e-9)) + 1
        if over < len(kmers):
            rare = np.argpartition(n, over - 1)[:over]
            if n[rare].sum() <= len(self.kmers):
                for k in np.unique(self.owner[self._places(low[rare], n[rare])]).tolist():
                    out[k] = len(np.intersect1d(self.kmers[k], kmers, assume_unique=True))
                return out
        low, n = low[n > 0], n[n > 0]
        most = max(1, 4_000_000 // max(1, int(n.max(initial=1))))  # few k-mers at a time where many pivots have them
        for k in range(0, len(n), most):
            out += np.bincount(self.owner[self._places(low[k : k + most], n[k : k + most])], minlength=len(out))
        return out

    @staticmethod
    def _places(low: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Places from each ``low`` on, ``n`` of them."""
        return np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)

    def meet(self, node: int, label: int, kmers: np.ndarray):
        n, t = len(kmers), self.threshold
        shared = self.shared(kmers)
        enough = shared >= t / (1 + t) * (self.sizes + n) - 1e-9
        for k in np.flatnonzero(enough).tolist():
            a, b = self.root(label), self.root(self.labels[k])
            if a == b:
                continue
            if k not in self.aligners:
                self.aligners[k] = Aligner(self.kmers[k], t)
            if self.aligners[k].similarity(kmers) >= t:
                self.up[a] = b
                yield self.nodes[k], node


def _meet(batches, threshold: float):
    """Rows come sorted by tile, of each tile the pivots (own 1 or, where they are members of the tile too, 2) first."""
    import pyarrow as pa

    def links():
        now, tile, both, waiting = None, Tile(threshold), [], False
        names = ("key", "block", "part", "own", "node", "label", "kmers")
        for b in batches:
            for key, block, part, own, node, label, data in zip(*(b.column(k).to_pylist() for k in names)):
                if (key, block, part) != now:
                    if waiting:
                        for k in both:
                            yield from tile.meet(tile.nodes[k], tile.labels[k], tile.kmers[k])
                    now, tile, both, waiting = (key, block, part), Tile(threshold), [], True
                kmers = np.frombuffer(data, np.uint64)
                if own:
                    if own == 2:
                        both.append(len(tile.nodes))
                    tile.add(node, label, kmers)
                elif tile.nodes:
                    yield from tile.meet(node, label, kmers)
        for k in both:
            yield from tile.meet(tile.nodes[k], tile.labels[k], tile.kmers[k])

    source = links()
    while part := list(islice(source, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)], ["a", "b"])


def tiles(apart: DataFrame, tile_kmers: int = TILE_KMERS) -> DataFrame:
    """``apart(key, node, n, label, is_pivot)`` dealt out: (key, block, part, own, node, label). The pivots of a key are split into blocks
    and its texts into parts by their k-mers; every part meets every block. own: 0 a member, 1 a pivot, 2 a pivot of the only
    tile of its key, which is there once for both."""
    split = lambda n: F.greatest(F.lit(1), F.ceil(F.sum(n) / tile_kmers)).cast("int")
    sizes = apart.groupBy("key").agg(split(F.when(F.col("is_pivot"), F.col("n")).otherwise(F.lit(0))).alias("blocks"), split(F.col("n")).alias("parts"))
    rows = apart.join(sizes, "key")
    one = (F.col("blocks") == 1) & (F.col("parts") == 1)
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pivots = rows.where("is_pivot").select("key", of("blocks").alias("block"), each("parts").alias("part"), F.when(one, F.lit(2)).otherwise(F.lit(1)).alias("own"), "node", "label")
    members = rows.where(~(one & F.col("is_pivot"))).select("key", each("blocks").alias("block"), of("parts").alias("part"), F.lit(0).alias("own"), "node", "label")
    return pivots.unionByName(members)


def verified(apart: DataFrame, n_apart: int, docs: DataFrame, threshold: float = THRESHOLD, tile_kmers: int = TILE_KMERS) -> DataFrame:
    """Links (a, b) between texts of different labels of one key, enough to connect all that are similar; ``docs(node, body)``.

    The k-mers of a text are made once and go with it to its tiles; nothing is grouped in memory but the pivots of a tile.
    """
    asked, wanted = tiles(apart, tile_kmers), apart.select("node").distinct()
    if n_apart <= BROADCAST_ROWS:  # so few rows spare the shuffle of all other texts
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "node", "left_semi").groupBy("node").agg(F.max_by("body", F.xxhash64("body")).alias("body"))
    rows = texts.select("node", kmer_bytes("body").alias("kmers")).join(asked, "node")
    rows = rows.repartition("key", "block", "part").sortWithinPartitions("key", "block", "part", F.col("own").desc(), "node")
    return rows.select("key", "block", "part", "own", "node", "label", "kmers").mapInArrow(lambda it: _meet(it, threshold), "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, class_id (the least id of its class), n_copies (documents of the same words).

    Documents of the same words (white space aside) are one text, held by the least id; classes are over texts. Documents
    without words, null texts among them, are no duplicates of each other: each is a class of its own. Null ids are left
    out; rows of one id are one document (where texts differ, the one of the greatest hash). Other columns are not read.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("body"))
    normal = F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    hashed = F.when(F.length(normal) > 0, F.sha2(normal, 256)).otherwise(F.concat(F.lit("empty "), F.col("node").cast("string")))
    signed = rows.select("node", F.xxhash64("body").alias("x"), hashed.alias("hash"), signature("body").alias("s"))
    signed = cut(signed.groupBy("node").agg(F.max_by(F.struct("hash", "s"), "x").alias("d")).select("node", "d.hash", "d.s.n", "d.s.keys"))
    # copies of one text may be a third of all rows: the groups are pre-aggregated, and their rows meet the result by salt
    held = signed.groupBy("hash").agg(F.min("node").alias("held"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = signed.select("node", "hash", "n", "keys", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int").alias("salt"))
    member = salted.join(held, ["hash", "salt"], "left")
    member = cut(member.select("node", F.coalesce("held", "node").alias("held"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "n", "keys"))
    mine = member.where("node = held and n > 0")
    labels = text_classes(mine.select("node", "n", F.explode("keys").alias("key")), rows, threshold)
    out = member.select("node", "held", "n_copies").join(labels.select(F.col("node").alias("held"), "label"), "held", "left")
    return out.select(F.col("node").alias(id_col), F.coalesce("label", "held").alias("class_id"), "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one document of each class, that of the least id; all columns stay. Rows that repeat an id become one row,
    of the text that ``near_classes`` judges; rows without an id are left out."""
    kept = near_classes(docs, id_col=id_col, text_col=text_col, **kw).where(F.col(id_col) == F.col("class_id"))
    own, row = unused(docs, "_id", "_row")
    kept = kept.select(F.col(id_col).alias(own))
    rows = docs.join(kept, docs[id_col] == kept[own], "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return rows.groupBy(F.col(id_col).alias(own)).agg(F.max_by(whole, F.xxhash64(text_col)).alias(row)).select(f"{row}.*")


def text_classes(keys: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, tile_kmers: int = TILE_KMERS) -> DataFrame:
    """Classes (node, label) of the texts of ``keys(node, n, key)``, one row a sketch, that have a link; see the module."""
    mixed = F.bit_xor(F.xxhash64("node"))
    many = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), mixed.alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("m > 1")
    many = many.groupBy("m", "x", "lo", "hi").agg(F.min("key").alias("key"))  # sketch values of the same texts are one
    left = keys.join(many, "key").select("key", "node", "n")
    links, n_links, labels = None, 0, None
    while True:
        # texts left are those that were no pivot of the sketch value; where they are of one class there is nothing to find
        known = left.withColumn("label", F.col("node")) if labels is None else left.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        two = known.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).alias("p")).where("lo < hi")
        drawn = (F.pmod(F.xxhash64("node", "key"), F.lit(1 << 20)) * F.col("m") < F.lit(pivots << 20)) | (F.col("node") == F.col("p.node"))
        apart = known.join(two, "key").select("key", "node", "n", "label", drawn.alias("is_pivot"))
        apart, seen = observed(apart, n=F.count(F.lit(1)), left=F.sum((~F.col("is_pivot")).cast("long")))
        apart = apart.coalesce(parts_of(seen["n"]))
        if seen["n"]:
            found, n_found = counted(verified(apart, seen["n"], docs, threshold, tile_kmers))
            if n_found or links is None:
                n_links += n_found
                links = found if links is None else links.unionByName(found).coalesce(parts_of(n_links))
                labels = components(links)
        if not seen["left"]:
            return keys.sparkSession.createDataFrame([], "node long, label long") if labels is None else labels
        left, pivots = apart.where("not is_pivot").select("key", "node", "n"), pivots * GROWTH
