"""The trie of conversations: one node a distinct sequence of first turns, with what its subtree holds.

Conversations become arrays of turn digests (order of digests serves a trie as well as order of texts, and no text is
shuffled), range-sorted over the cluster by array and id. In a sorted partition the longest common prefix (LCP) of
neighbours says which nodes end and begin, so one sweep with a stack makes all nodes of the partition. A node that
neighbouring partitions share has the LCP of their boundary rows to tell it: it stays open, and a small second pass
stitches the open stacks together in order of partitions. Equal conversations are sorted by id, so a conversation that
very many share is split over partitions like all else.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut

#: Bytes of a turn's digest: half a SHA-256.
WIDTH = 16
#: Rows of an Arrow batch of nodes.
BATCH = 20_000
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn binary"
_SWEPT = _NODE + ", part int, k int, parent_k int, carried boolean, open boolean, size long, ends binary"


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; null role or text is empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role, text))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def turn_arrays(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns: array of (digest, size)) in order of turn, null first, equal ones by digest; size is the text's code
    points. Rows without a conversation are left out. Other columns are not read."""
    text = F.col(text_col)
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), text).alias("digest"), F.coalesce(F.length(text), F.lit(0)).alias("size")
    )
    rows = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def turn_texts(conversations: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(turn, role, text) of every distinct turn: what a node's ``turn`` stands for."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    return conversations.select(F.unhex(turn_digest(role, text)).alias("turn"), role.alias("role"), text.alias("text")).distinct()


def with_heads(arrays: DataFrame, group: int, turns: int) -> DataFrame:
    """``arrays`` with the first h turns of each conversation c replaced by those of conversation c - c % ``group``, where h is the
    CRC-32 of c in decimals modulo ``turns``: all that conversation has, if fewer, and none if there is none."""
    c = F.col("conv_id")
    heads = arrays.where(c % group == 0).select(c.alias("head"), F.slice("turns", 1, turns).alias("first"))
    h = (F.crc32(c.cast("string").cast("binary")) % turns).cast("int")
    none = F.array().cast(arrays.schema["turns"].dataType)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    rows = arrays.withColumn("head", c - c % group).join(heads, "head", "left")
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), rest).alias("turns"))


def common(a: bytes, b: bytes, width: int = WIDTH) -> int:
    """Turns that two keys share at their beginning: equal slices are compared whole, so few steps also for long keys."""
    low, high = 0, min(len(a), len(b)) // width
    if a[: high * width] == b[: high * width]:
        return high
    while low < high:  # the first ``low`` are equal, the first ``high`` + 1 are not
        mid = (low + high + 1) // 2
        if a[low * width : mid * width] == b[low * width : mid * width]:
            low = mid
        else:
            high = mid - 1
    return low


def range_sorted(arrays: DataFrame) -> DataFrame:
    """(conv_id, key, sizes) sorted over partitions by key and id, materialised; the key is the digests in a row."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = arrays.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["size"].cast("long")).alias("sizes"))
    return cut(rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))


def boundaries(rows: DataFrame) -> dict[int, tuple[int, int]]:
    """Of every partition with rows: the turns its first row shares with the row before it, and its last row with the row
    after it (-1 where there is none). Two rows a partition go through one task, two numbers a partition to the driver."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = last = None
        for b in batches:
            if b.num_rows:
                first = b.column(0)[0].as_py() if first is None else first
                last = b.column(0)[b.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        for b in batches:
            for part, first, last in zip(*(c.to_pylist() for c in b.columns)):
                out.append((part, -1 if before is None else common(before, first)))
                before = last
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in out], pa.int32()), "lcp": pa.array([n for _, n in out], pa.int64())})

    two = rows.select("key").mapInArrow(ends, "part int, first binary, last binary")
    lcps = two.repartition(1).sortWithinPartitions("part").mapInArrow(shared, "part int, lcp long").collect()
    return {r["part"]: (r["lcp"], after) for r, after in zip(lcps, [r["lcp"] for r in lcps[1:]] + [-1])}


class Sweep:
    """The stack sweep over one sorted partition. Nodes up to ``before`` turns on its first row's path began in a partition before,
    those up to ``after`` on its last row's go on in the next; these come out open, all others complete."""

    def __init__(self, before: int, after: int):
        self.before, self.after, self.rows = before, after, 0
        self.key = b""
        # of every node, by number
        self.conv, self.depth, self.parent, self.count, self.children, self.leaves, self.saved, self.size = (array("q") for _ in range(8))
        self.turn: list[bytes] = []
        self.ends: dict[int, bytearray] = {}
        self.open: list[tuple[int, bool, bool]] = []  # node, carried over from before, goes on
        self.stack: list[int] = []

    def _push(self, depth: int, conv: int, turn: bytes, size: int) -> None:
        self.parent.append(self.stack[-1] if self.stack else -1)
        for column, value in ((self.conv, conv), (self.depth, depth), (self.count, -self.rows), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.size, size)):
            column.append(value)
        self.stack.append(len(self.conv) - 1)
        self.turn.append(turn)

    def _pop(self, goes_on: bool) -> None:
        node = self.stack.pop()
        up, depth = self.parent[node], self.depth[node]
        self.count[node] += self.rows
        if up >= 0:
            self.conv[up] = min(self.conv[up], self.conv[node])
        carried = depth <= self.before and bool(self.first[node])
        if carried or goes_on:
            self.open.append((node, carried, goes_on))
            return
        if not self.children[node]:
            self.leaves[node] = 1
        self.saved[node] += (self.count[node] - 1) * self.size[node]
        if up >= 0:
            self.children[up] += 1
            self.leaves[up] += self.leaves[node]
            self.saved[up] += self.saved[node]

    def row(self, conv: int, key: bytes, sizes: list[int]) -> None:
        begins = not self.rows
        if begins:
            self.first = bytearray()
            shared = -1
        else:
            shared = common(self.key, key)
        while len(self.stack) > shared + 1:
            self._pop(False)
        for depth in range(len(self.stack), len(key) // WIDTH + 1):
            self._push(depth, conv, key[(depth - 1) * WIDTH : depth * WIDTH] if depth else b"", sizes[depth - 1] if depth else 0)
            self.first.append(begins)
        top = self.stack[-1]
        self.conv[top] = min(self.conv[top], conv)
        held = self.ends.get(top)
        if held is None:
            self.ends[top] = bytearray(b"%d" % conv)
        else:
            held += b",%d" % conv
        self.key, self.rows = key, self.rows + 1

    def batches(self, part: int) -> Iterator[pa.RecordBatch]:
        """All nodes, when all rows have been seen."""
        if not self.rows:
            return
        while self.stack:
            self._pop(len(self.stack) - 1 <= self.after)
        n = len(self.conv)
        column = {c: np.frombuffer(getattr(self, c), np.int64) for c in ("conv", "depth", "parent", "count", "children", "leaves", "saved", "size")}
        k = np.full(n + 1, -1)  # place of open nodes; the last stands for no parent
        for at, (node, _, _) in enumerate(self.open):
            k[node] = at
        flags = {node: (carried, on) for node, carried, on in self.open}
        up = column["parent"]
        for x in range(0, n, BATCH):
            s = slice(x, min(n, x + BATCH))
            nodes = range(s.start, s.stop)
            under = k[up[s]]
            known = (up[s] >= 0) & (under < 0)
            ends = [self.ends.get(i) for i in nodes]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column["conv"][s]), pa.array(column["depth"][s]), pa.array(column["conv"][up[s]], mask=~known), pa.array(column["count"][s]), pa.array(column["children"][s]),
                    pa.array(column["leaves"][s]), pa.array(column["saved"][s]), pa.array([EMPTY if e is None else hashlib.sha256(e).hexdigest() for e in ends], pa.string()), pa.array(self.turn[s], pa.binary()),
                    pa.array(np.full(len(nodes), part, np.int32)), pa.array(k[s].astype(np.int32), mask=k[s] < 0), pa.array(under.astype(np.int32), mask=under < 0),
                    pa.array([flags[i][0] if i in flags else None for i in nodes], pa.bool_()), pa.array([flags[i][1] if i in flags else None for i in nodes], pa.bool_()),
                    pa.array(column["size"][s]), pa.array([bytes(e or b"") if i in flags else None for i, e in zip(nodes, ends)], pa.binary()),
                ],
                [c.split()[0] for c in _SWEPT.split(", ")],
            )


def swept(rows: DataFrame, shared: dict[int, tuple[int, int]]) -> DataFrame:
    """Nodes of every partition of ``range_sorted`` rows, materialised: complete ones (``k`` is null; under an open parent its
    ``parent_k`` in place of its conversation) and open ones."""
    known = rows.sparkSession.sparkContext.broadcast(shared)  # two numbers a partition

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        work = Sweep(*known.value.get(part, (-1, -1)))
        for b in batches:
            for conv, key, sizes in zip(*(c.to_pylist() for c in b.columns)):
                work.row(conv, key, sizes)
        yield from work.batches(part)

    return cut(rows.select("conv_id", "key", "sizes").mapInArrow(sweep, _SWEPT))


class _Open:
    """A node that goes over partition boundaries, as far as it has been seen."""

    def __init__(self, r: dict):
        self.conv, self.size, self.turn, self.depth = r["conv_id"], r["size"], r["turn"], r["depth"]
        self.count = self.children = self.leaves = self.saved = 0
        self.sha, self.any = hashlib.sha256(), False
        self.places: list[tuple[int, int]] = []
        self.below: list[_Open] = []

    def add(self, r: dict) -> None:
        self.conv = min(self.conv, r["conv_id"])
        self.count += r["n_convs"]
        self.children += r["n_children"]
        self.leaves += r["n_leaves"]
        self.saved += r["saved_tokens"]
        self.places.append((r["part"], r["k"]))
        if r["ends"]:
            self.sha.update(b"," + r["ends"] if self.any else r["ends"])
            self.any = True

    def close(self, up: _Open | None) -> None:
        if not self.children:
            self.leaves = 1
        self.saved += (self.count - 1) * self.size
        if up is not None:
            up.conv = min(up.conv, self.conv)
            up.children += 1
            up.leaves += self.leaves
            up.saved += self.saved
            up.below.append(self)


def stitched(nodes: DataFrame) -> DataFrame:
    """The open nodes of ``swept`` put together, materialised: whole nodes (``part`` is null), and for every place (part, k) that one
    was seen at its conversation. One task takes them in order of partitions; they are at most two paths, as far as
    neighbours share them, a partition. Ids that end at a node come as one text a partition."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        names = [c.split() for c in (_NODE + ", part int, k int").split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(names)], [n for n, _ in names])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: dict[int, _Open] = {}
        rows: list[tuple] = []
        for b in batches:
            for r in b.to_pylist():
                node = stack.pop(r["depth"]) if r["carried"] else _Open(r)
                node.add(r)
                if r["open"]:
                    stack[r["depth"]] = node
                    continue
                up = stack.get(r["depth"] - 1)
                node.close(up)
                waiting = [] if up is not None else [(node, None)]
                while waiting:  # the root is whole: all below it have their parent now
                    x, over = waiting.pop()
                    rows.append((x.conv, x.depth, over, x.count, x.children, x.leaves, x.saved, x.sha.hexdigest(), x.turn, None, None))
                    rows += [(x.conv, *[None] * 8, p, k) for p, k in x.places]
                    waiting += [(y, x.conv) for y in x.below]
        for x in range(0, len(rows), BATCH):
            yield out(rows[x : x + BATCH])

    opened = nodes.where("k is not null").select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn", "part", "k", "carried", "open", "size", "ends")
    return cut(opened.repartition(1).sortWithinPartitions("part", "k").mapInArrow(stitch, _NODE + ", part int, k int"))


def trie(arrays: DataFrame) -> DataFrame:
    """Nodes of the trie of ``arrays(conv_id, turns)`` (ids unique, turns as of ``turn_arrays``): conv_id (the smallest member, a member
    being a conversation that begins with the node's turns), depth, parent_conv_id (its parent's; the root: null),
    n_convs (members), n_children, n_leaves (nodes without children in its subtree, itself included), saved_tokens (over
    the subtree, each node's members but one times its last text's code points), ends_sha256 (of the comma-joined ids,
    ascending, of members that end here), turn (its last turn's digest; ``turn_texts`` has the text).

    A conversation without turns ends at the root. No conversations give no nodes. A task holds a hundred bytes a node of
    its partition and one conversation's digests.
    """
    rows = range_sorted(arrays)
    nodes = swept(rows, boundaries(rows))
    whole = stitched(nodes)
    places = whole.where("part is not null").select("part", F.col("k").alias("parent_k"), F.col("conv_id").alias("over"))
    names = [c.split()[0] for c in _NODE.split(", ")]
    done = nodes.where("k is null").join(places, ["part", "parent_k"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    return done.select(*names).unionByName(whole.where("part is null").select(*names))
