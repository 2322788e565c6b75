"""Token ids as grammar-compressed shards (Re-Pair) that can be read from any place.

Documents are range-sorted by id over the cluster, encoded by the tokenizers library and packed into shards of whole
documents. In a shard pairs of neighbouring symbols that occur often are replaced by new symbols, again and again; the
file holds the rules, the length of every symbol's expansion and the symbols left. No pair goes over a document's end,
so a document is a slice of symbols, and expansion lengths lead to any token inside without decoding what is before it.
Files go through a temporary name and are moved into place when they are whole.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import cut, shared_dir
from .warc import _fs, _write

#: Tokens after which a shard is closed: some tens of MB while its grammar is made.
SHARD_TOKENS = 1 << 20
#: Times a pair occurs in a shard, at least, to become a rule.
LEAST = 16
#: A round of rules that shortens a shard by less than this share is not made, and the shard is done.
WORTH = 1 / 128
#: Chunks of text in each of the two tables that a worker remembers ids in: when the new one is full it becomes the old
#: one, and what is met again moves on to the next.
REMEMBER = 500_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 24
#: Begins a file.
MAGIC = b"REPAIR01"
NEVER = np.int32(1 << 30)
_SECTIONS = (("ids", "<i8", "docs"), ("null", "u1", "docs"), ("tokens", "<i8", "docs"), ("symbols", "<i8", "docs"), ("terminals", "<u4", "terminals"), ("left", "<u4", "rules"), ("right", "<u4", "rules"), ("length", "<i8", "rules"))


class LibraryEncoder:
    """Ids of texts as the tokenizers library gives them; strings of special tokens in a text are ordinary text.

    The vocabularies meant here split a text before they merge, always before a single space that begins a word and after a
    run of letters. So a text is cut at such places into chunks, chunks that are new are encoded by the
    library, many in one text, and chunks that come again are looked up. ``chunked`` says whether a vocabulary works that
    way (byte-level with the usual pattern); for others every text is encoded whole.
    """

    # whole runs of common letters, all else up to white space, white space as the pattern takes it
    _chunks = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]++(?!\w)| ?\S+|\s+(?!\S)|\s+")
    _unsure = re.compile("[\x1c-\x1f]")  # white space to one side only
    # a space or line feed at an end or beside other white space, or the unsure characters
    _white = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    _odd_spaces = rf"\A[ \n]|[ \n]\z|[ \n][{_white}]|[{_white}][ \n]|[\x{{1c}}-\x{{1f}}]"

    def __init__(self, text: str):
        self.text, self._ready = text, False
        steps = json.loads(text).get("pre_tokenizer") or {}
        self.chunked = steps.get("type") == "ByteLevel" and steps.get("use_regex", True) and not steps.get("add_prefix_space")

    def __getstate__(self):
        return {"text": self.text, "chunked": self.chunked, "_ready": False}

    def _start(self) -> None:
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(self.text)
        self._library.encode_special_tokens = True
        self._known, self._ready = _Known(), True
        if not self.chunked:
            return
        self._feed = int(self._whole(["\n"])[0][0])
        space = self._library.id_to_token(int(self._whole([" "])[0][0]))  # how the vocabulary writes a space
        vocabulary = self._library.get_vocab()
        self._space = np.zeros(max(vocabulary.values()) + 1, bool)
        self._space[[i for t, i in vocabulary.items() if t.startswith(space)]] = True

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str]) -> None:
        """Encode new chunks. Those that begin with a space stand side by side in one text and begin where a token begins with a space;
        others have line feeds between them, but for those with other white space at an end."""
        alone = [c for c in chunks if c[-1].isspace() or (c[0] != " " and c[0].isspace())]
        self._known.update(zip(alone, (x.tobytes() for x in self._whole(alone))))
        rest = chunks.difference(alone)
        spaced, bare = [c for c in rest if c[0] == " "], [c for c in rest if c[0] != " "]
        for k in range(0, len(spaced), 2000):
            part = spaced[k : k + 2000]
            ids = self._whole(["".join(part)])[0]
            begins = (4 * np.flatnonzero(self._space[ids])).tolist()
            self._put(part, ids, begins, [*begins[1:], 4 * len(ids)])
        for k in range(0, len(bare), 2000):
            part = bare[k : k + 2000]
            ids = self._whole(["\n".join(part)])[0]
            feeds = (4 * np.flatnonzero(ids == self._feed)).tolist()
            self._put(part, ids, [0, *(x + 4 for x in feeds)], [*feeds, 4 * len(ids)])

    def _put(self, chunks: list[str], ids: np.ndarray, begins: list[int], ends: list[int]) -> None:
        if not len(begins) == len(ends) == len(chunks):
            raise ValueError("chunks were merged with what is beside them")
        raw = ids.tobytes()
        self._known.update(zip(chunks, map(raw.__getitem__, map(slice, begins, ends))))

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """Ids of every text; null and empty ones have none.

        Texts whose spaces and line feeds all stand singly between words are cut as bytes and their chunks numbered by Arrow, so
        that each distinct chunk of many texts is looked up once and its ids are gathered for all its places.
        """
        if not self._ready:
            self._start()
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        if not self.chunked:
            return self._whole(texts.to_pylist())
        self._known.age()
        odd = np.asarray(pc.match_substring_regex(texts, self._odd_spaces))
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        at = np.flatnonzero(odd)
        for k, raw in zip(at.tolist(), self._encode_each(texts.take(pa.array(at)).to_pylist())):
            out[k] = np.frombuffer(raw, "<u4")
        at = np.flatnonzero(~odd)
        flat, ends = self._encode_words(texts.take(pa.array(at)))
        for k, x, y in zip(at.tolist(), [0, *ends], ends):
            out[k] = flat[x:y]
        return out

    def _encode_words(self, texts: pa.StringArray) -> tuple[np.ndarray, list[int]]:
        """Ids of texts of single spaces and line feeds one after the other, and where each text's end. Chunks begin with their space,
        line feeds stand alone, and so does what begins with a full stop or comma after a letter."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        if not len(texts) or offsets[-1] == offsets[0]:
            return np.zeros(0, np.uint32), [0] * len(texts)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        feed, small = data == 10, data | 32
        letter = (small >= 97) & (small <= 122)
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # À to ÿ, but for two signs
        begins = (data == 32) | feed
        begins[1:] |= feed[:-1] | (letter[:-1] & ((data[1:] == 44) | (data[1:] == 46)))
        at = offsets[:-1] - offsets[0]
        begins[at[at < len(data)]] = True
        starts = np.flatnonzero(begins)
        chunks = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data)).astype(np.int32)), pa.py_buffer(data))
        coded = chunks.dictionary_encode()
        ids = self._look_up(coded.dictionary.to_pylist())
        index = coded.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        length = lengths[index]
        flat = _gather(np.frombuffer(b"".join(ids), "<u4"), (np.cumsum(lengths) - lengths)[index], length)
        ends = np.concatenate([[0], np.cumsum(length)])
        return flat, ends[np.searchsorted(starts, offsets[1:] - offsets[0])].tolist()

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as little-endian 32-bit integers."""
        known = self._known
        ids = list(map(known.__getitem__, chunks))
        if known.unseen:
            self._learn(set(known.unseen))
            known.unseen.clear()
            ids = list(map(known.__getitem__, chunks))
        return ids

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, chunk by chunk, as little-endian 32-bit integers."""
        split = [None if self._unsure.search(t) else self._chunks.findall(t) for t in texts]
        ids = iter(self._look_up([c for chunks in split if chunks for c in chunks]))
        return [self._whole([t])[0].tobytes() if chunks is None else b"".join(islice(ids, len(chunks))) for t, chunks in zip(texts, split)]


class _Known(dict):
    """Chunk -> its ids; one that only the old table has moves over, one that is in neither is noted in ``unseen``."""

    def __init__(self):
        self.unseen: list[str] = []
        self._old: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes | None:
        ids = self._old.get(chunk)
        if ids is None:
            self.unseen.append(chunk)
        else:
            self[chunk] = ids
        return ids

    def age(self) -> None:
        if len(self) > REMEMBER:
            self._old = dict(self)
            self.clear()


def grammar(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST, worth: float = WORTH) -> dict[str, np.ndarray]:
    """Re-Pair of documents of ``sizes`` tokens each: terminals, rules (left, right; symbols below the number of terminals are
    those, others rules in order), length of each rule's expansion, the symbols left and how many each document has.

    A round counts all pairs and replaces those that occur ``least`` times or more: where two overlap, the more frequent
    one (the first of a run) goes first and the other waits for the next round. A pair that is left with fewer
    replacements than ``least`` waits too.
    """
    terminals, seq = _dense(ids)
    symbols = len(terminals)
    ends = np.cumsum(sizes[sizes > 0]) - 1  # places of last symbols
    left, right = [], []
    while len(seq) > 1:
        kind, shift = (np.uint32, 16) if symbols < 1 << 16 else (np.uint64, 32)
        key = (seq[:-1].astype(kind) << kind(shift)) | seq[1:]
        key[ends[:-1]] = over = np.iinfo(kind).max  # no pair of symbols, as there are too few of them
        sorted_ = np.sort(key)
        edge = np.flatnonzero(np.append(sorted_[1:] != sorted_[:-1], True))
        times = np.diff(edge, prepend=-1)
        often = np.flatnonzero((times >= least) & (sorted_[edge] != over))
        if not len(often):
            break
        pairs = sorted_[edge[often]][np.argsort(-times[often], kind="stable")]
        rank = _ranks(key, pairs)
        first = rank < NEVER
        first[1:] &= rank[1:] < rank[:-1]
        first[:-1] &= rank[:-1] <= rank[1:]
        at = np.flatnonzero(first)
        chosen = rank[at]
        used = np.bincount(chosen, minlength=len(pairs)) >= least
        good = used[chosen]
        at, chosen = at[good], chosen[good]
        if len(at) < worth * len(seq) or not len(at):
            break
        if symbols + len(pairs) >= 1 << 16:
            seq = seq.astype(np.uint32)
        left.append((pairs[used] >> kind(shift)).astype(np.uint32))
        right.append((pairs[used] & kind((1 << shift) - 1)).astype(np.uint32))
        seq[at] = (symbols + np.cumsum(used) - 1)[chosen]
        symbols += int(used.sum())
        at += 1
        seq = np.delete(seq, at)
        ends = ends - np.searchsorted(at, ends, "right")
    left, right = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in (left, right))
    counts = np.zeros(len(sizes), np.int64)
    counts[sizes > 0] = np.diff(ends, prepend=-1)
    return {"terminals": terminals, "left": left, "right": right, "length": _lengths(len(terminals), left, right)[len(terminals) :], "symbols": counts, "seq": seq}


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the ids as places among them."""
    top = int(ids.max()) + 1 if len(ids) else 0
    if top > 1 << 24:
        terminals, seq = np.unique(ids, return_inverse=True)
    else:
        there = np.zeros(top, bool)
        there[ids] = True
        terminals = np.flatnonzero(there)
        seq = (np.cumsum(there) - 1).astype(np.uint16 if len(terminals) <= 1 << 16 else np.uint32)[ids]
    return terminals.astype(np.uint32), seq.astype(np.uint16 if len(terminals) <= 1 << 16 else np.uint32)


def _ranks(key: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Place of every key in ``pairs``, or NEVER, by a table of hashes that stays in the processor's cache. Of pairs that share a
    hash the first is found; the others wait for another round."""
    bits = max(12, int(len(pairs) - 1).bit_length() + 4)
    mix = lambda x: (x.astype(np.uint32) ^ (x >> x.dtype.type(x.dtype.itemsize * 4)).astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)
    table = np.zeros(1 << bits, np.int32)
    table[mix(pairs)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
    rank = table[mix(key)]
    rank[pairs[rank] != key] = NEVER
    return rank


def _lengths(terminals: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Tokens that every symbol stands for. Rules only name symbols before them, so runs of rules whose symbols are all known
    are done at once."""
    out = np.ones(terminals + len(left), np.int64)
    for a, b in _runs(terminals, left, right):
        out[terminals + a : terminals + b] = out[left[a:b]] + out[right[a:b]]
    return out


def _runs(terminals: int, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    needs = np.maximum(left, right).astype(np.int64) - terminals  # the last rule that each rule needs
    a = 0
    while a < len(left):
        late = np.flatnonzero(needs[a:] >= a)
        b = a + int(late[0]) if len(late) else len(left)
        yield a, b
        a = b


def shard_bytes(doc_ids: list[int | None], docs: list[np.ndarray], least: int = LEAST, worth: float = WORTH) -> bytes:
    """A file of whole documents: header, sections, symbols of 16 or 32 bits."""
    sizes = np.array([len(d) for d in docs], np.int64)
    g = grammar(np.concatenate(docs) if docs else np.zeros(0, np.uint32), sizes, least, worth)
    g |= {"ids": np.array([i or 0 for i in doc_ids], np.int64), "null": np.array([i is None for i in doc_ids], np.uint8), "tokens": sizes}
    head = {"docs": len(docs), "terminals": len(g["terminals"]), "rules": len(g["left"]), "width": g["seq"].dtype.itemsize}
    text = json.dumps(head).encode().ljust(120)
    return b"".join([MAGIC, text, *(g[name].astype(kind).tobytes() for name, kind, _ in _SECTIONS), g["seq"].astype(f"<u{head['width']}").tobytes()])


class Shard:
    """A file of ``shard_bytes``: its tables are read when it is opened, symbols only where they are asked for."""

    def __init__(self, path: str):
        fs, at = _fs(path)
        self._file = fs.open_input_file(at)
        if self._file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.head = json.loads(self._file.read(120))
        for name, kind, count in _SECTIONS:
            n = self.head[count] * np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(self._file.read(n), kind))
        self._begin = self._file.tell()
        self.starts = np.concatenate([[0], np.cumsum(self.tokens)])  # of documents, in tokens
        self._places = np.concatenate([[0], np.cumsum(self.symbols)])
        self._all = np.concatenate([np.ones(len(self.terminals), np.int64), self.length])
        self._table: np.ndarray | None = None

    def close(self) -> None:
        self._file.close()

    def _symbols(self, a: int, b: int) -> np.ndarray:
        width = self.head["width"]
        self._file.seek(self._begin + a * width)
        return np.frombuffer(self._file.read((b - a) * width), f"<u{width}")

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        if self._table is None:  # the expansions of all symbols in a row, each made of two before it
            n = len(self.terminals)
            self._at = np.concatenate([[0], np.cumsum(self._all)])
            table = np.empty(self._at[-1], np.uint32)
            table[:n] = self.terminals
            for a, b in _runs(n, self.left, self.right):
                both = np.stack([self.left[a:b], self.right[a:b]], 1).reshape(-1)
                table[self._at[n + a] : self._at[n + b]] = _gather(table, self._at[both], self._all[both])
            self._table = table
        return _gather(self._table, self._at[symbols], self._all[symbols])

    def tokens_at(self, start: int, stop: int) -> np.ndarray:
        """Tokens from ``start`` up to ``stop`` of the shard. Of the documents that hold them only the symbols in between are expanded."""
        start, stop = max(0, start), min(int(self.starts[-1]), stop)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.starts, start, "right")) - 1
        b = int(np.searchsorted(self.starts, stop, "left"))
        symbols = self._symbols(int(self._places[a]), int(self._places[b]))
        ends = int(self.starts[a]) + np.cumsum(self._all[symbols])
        x, y = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[x - 1]) if x else int(self.starts[a])
        return self._expand(symbols[x:y])[start - before : stop - before]

    def document(self, k: int) -> np.ndarray:
        return self.tokens_at(int(self.starts[k]), int(self.starts[k + 1]))

    def all(self) -> np.ndarray:
        return self._expand(self._symbols(0, int(self._places[-1])))


def _gather(table: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Runs of ``table`` one after the other."""
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, table.dtype)
    return table[np.repeat(at - ends + length, length) + np.arange(ends[-1])]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, least: int = LEAST, worth: float = WORTH) -> DataFrame:
    """Encode ``docs`` and write shards in ``folder`` in ascending order of id: (part, shard, path, n_docs, n_tokens), materialised, in
    whose order documents stand. ``tokenizer`` is a file of the library, read at the driver and sent along; ``end_id`` is
    appended to every document.

    Null ids come first, rows of one id in order of their texts' digests. Null and empty texts have no ids but the end's.
    A shard holds whole documents, so one longer than ``shard_tokens`` has a shard of its own length. Other columns are
    not read. A task that runs again writes the same files.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(LibraryEncoder(f.read()))  # a vocabulary: a few MB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        held: list[np.ndarray] = []
        n = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, held, n, done
            path = f"{folder}/tokens-{part:06d}-{done:06d}.rp"
            _write(path, iter([shard_bytes(ids, held, least, worth)]))
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((part, pa.int32()), (done, pa.int32()), (path, pa.string()), (len(ids), pa.int64()), (n, pa.int64()))], ["part", "shard", "path", "n_docs", "n_tokens"])
            ids, held, n, done = [], [], 0, done + 1
            return out

        for doc, tokens in _encoded(batches, shared.value, end_id):
            ids.append(doc)
            held.append(tokens)
            n += len(tokens)
            if n >= shard_tokens:
                yield close()
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    return cut(rows.select("id", "text").mapInArrow(write, "part int, shard int, path string, n_docs long, n_tokens long"))


def _encoded(batches: Iterator[pa.RecordBatch], encoder: LibraryEncoder, end_id: int | None) -> Iterator[tuple[int | None, np.ndarray]]:
    end = np.array([] if end_id is None else [end_id], np.uint32)
    for b in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0), np.int64))
        k = 0
        while k < b.num_rows:
            stop = max(k + 1, int(np.searchsorted(sizes, (sizes[k - 1] if k else 0) + TOGETHER)))
            part = b.slice(k, stop - k)
            yield from ((i, np.concatenate([x, end])) for i, x in zip(part.column(0).to_pylist(), encoder.encode(part.column(1))))
            k = stop


def with_starts(shards: DataFrame) -> DataFrame:
    """``shards`` with ``start``, the tokens of all shards before: sums over partitions first, then inside each."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return shards.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "part").withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside")


def read_shards(shards: DataFrame, tasks: int, ids: bool = False) -> DataFrame:
    """Documents of the files of ``shards(path, start)``: doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)
    and, if asked for, the ids themselves (binary)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(path)
                raw, at = memoryview(shard.all().astype("<u4").tobytes()), (4 * shard.starts).tolist()
                slices = [raw[x:y] for x, y in zip(at, at[1:])]
                columns = [pa.array(shard.ids, mask=shard.null.astype(bool)), pa.array(shard.starts[:-1] + start), pa.array(shard.tokens), pa.array([zlib.crc32(s) for s in slices], pa.int64())]
                if ids:
                    columns.append(pa.array([s.tobytes() for s in slices], pa.binary()))
                shard.close()
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if ids else "")
    return shards.select("path", "start").repartition(tasks, "path").mapInArrow(read, schema)


def token_range(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """(start, ids) of the tokens from ``start`` up to ``stop`` of the whole corpus, a row a shard that holds some: only those files are
    opened, and in them only the symbols in between expanded."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(path)
                ids = shard.tokens_at(start - at, stop - at)
                shard.close()
                yield pa.RecordBatch.from_pydict({"start": pa.array([max(at, start)], pa.int64()), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    hit = shards.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    return hit.select("path", "start").mapInArrow(read, "start long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None, ids: bool = False, **kw) -> DataFrame:
    """Write ``docs`` to shards in ``folder`` (a new one in the shared folder by default) and read the documents back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    shards = write_shards(docs, folder, tokenizer, end_id, **kw)
    tasks = max(2, min(shards.count(), 4 * spark.sparkContext.defaultParallelism))
    return read_shards(with_starts(shards), tasks, ids)
