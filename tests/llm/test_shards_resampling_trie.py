"""Grammar-compressed shards, importance resampling and the conversation trie: brute force, round trips, odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fenceline.llm import importance, prefix_trie, queries, re_pair

LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, tie string, scan string, score string, rank string, size string, start string"
FOREIGN = ("x",) * 7


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, *FOREIGN) for r in rows], SCHEMA)


def whole_library():
    t = Tokenizer.from_file(LIBRARY)
    t.encode_special_tokens = True
    return t


def odd(rng):
    long = " ".join(f"w{rng.randrange(9000)}" for _ in range(30_000)) + "x" * 3000 + "\n" * 50
    return [(7, "same same"), (7, "same same"), (1, None), (2, ""), (None, "no id"), (None, None), (3, " \t\n "), (5, long), (4, "<|endoftext|> und Übermaß, café's 漢字\x1c \x85 x"), (-9, "minus")]


# op 11

PIECES = st.lists(st.sampled_from(["a", "Bc", "don't", "é", "漢", " ", "  ", "\n", "\t", "\r\n", ".", ",", "...", "7", "½", "_", "'s", "\x1c", "\x85", " ", "́", "ªb", "😀", "<|endoftext|>", "x.y", "(z)"]), max_size=30)


@settings(max_examples=1500, deadline=None)
@given(PIECES)
def test_chunks_encode_as_whole_texts(parts):
    text = "".join(parts)
    got = ENCODER.encode([text, None, "", text])
    for other in (" ".join(parts), "x" + "\n".join(parts) + "é."):
        assert ENCODER.encode([other])[0].tolist() == LIBRARY_.encode(other, add_special_tokens=False).ids
    assert got[0].tolist() == got[3].tolist() == LIBRARY_.encode(text, add_special_tokens=False).ids
    assert not len(got[1]) and not len(got[2])


ENCODER, LIBRARY_ = re_pair.LibraryEncoder(open(LIBRARY, encoding="utf-8").read()), whole_library()


def test_whole_encoding_where_chunks_are_not_known_to_work():
    other = re_pair.LibraryEncoder(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert not other.chunked
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    assert other.encode(["Some words, here", None])[0].tolist() == t.encode("Some words, here", add_special_tokens=False).ids


@pytest.mark.parametrize("least, top", [(2, 6), (2, 3), (3, 100_000), (2, 1)])
def test_grammar_round_trip(tmp_path, least, top):
    rng = np.random.default_rng(least * top)
    docs = [rng.integers(0, top, n).astype(np.uint32) for n in (0, 1, 2, 5000, 3, 0, 700, 700)] + [np.tile(rng.integers(0, top, 9).astype(np.uint32), 300)]
    ids = [None, 4, -3, 2**40, 5, 6, 7, 7, 8]
    path = tmp_path / "a.rp"
    path.write_bytes(re_pair.shard_bytes(ids, docs, least, 0.0))
    s, flat = re_pair.Shard(str(path)), np.concatenate(docs)
    assert s.all().tolist() == flat.tolist() and s.starts.tolist() == np.cumsum([0, *map(len, docs)]).tolist()
    assert [None if n else i for i, n in zip(s.ids.tolist(), s.null.tolist())] == ids
    assert all(s.document(k).tolist() == d.tolist() for k, d in enumerate(docs))
    for _ in range(60):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2).tolist())
        assert s.tokens_at(a, b).tolist() == flat[a:b].tolist()
    assert len(s.tokens_at(5, 5)) == 0 and s.tokens_at(-4, 10**9).tolist() == flat.tolist()
    # every rule stands for what it says
    n = len(s.terminals)
    expand = lambda x: [int(s.terminals[x])] if x < n else expand(int(s.left[x - n])) + expand(int(s.right[x - n]))
    assert [len(expand(n + k)) for k in range(min(200, len(s.left)))] == s.length[:200].tolist()


def test_grammar_uses_what_repeats():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 50_000, 400).astype(np.uint32)
    docs = [np.concatenate([rng.integers(0, 50_000, 50).astype(np.uint32), passage]) for _ in range(64)]
    g = re_pair.grammar(np.concatenate(docs), np.array([450] * 64), least=16)
    # the passage is one symbol or few a document: pairs are of tokens, pairs of those, and so on
    assert len(g["seq"]) < 64 * 75 and g["length"].max() >= 50
    with pytest.raises(ValueError):
        re_pair.Shard(__file__)


def test_shards_of_odd_documents(spark, tmp_path):
    rng = random.Random(4)
    rows = odd(rng) + [(100 + i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(80)))) for i in range(300)]
    docs = frame(spark, rows).repartition(5)
    folder = str(tmp_path / "shards")
    shards = re_pair.with_starts(re_pair.write_shards(docs, folder, LIBRARY, 2, shard_tokens=2000)).cache()
    got = sorted(re_pair.read_shards(shards, 3, ids=True).collect(), key=lambda r: r["start"])
    encode = lambda t: LIBRARY_.encode(t or "", add_special_tokens=False).ids + [2]
    want = Counter((i, tuple(encode(t))) for i, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    order = [r["doc_id"] for r in got]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    at, corpus = 0, []
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]) // 4, zlib.crc32(r["ids"]))
        at += r["n_tokens"]
        corpus += np.frombuffer(r["ids"], "<u4").tolist()
    assert shards.count() > 8  # many shards, and any range of the corpus from them
    for a, b in ((0, 1), (1999, 4001), (at - 5, at + 5), (700, 700)):
        parts = sorted(re_pair.token_range(shards, a, b).collect(), key=lambda r: r["start"])
        assert [x for p in parts for x in np.frombuffer(p["ids"], "<u4").tolist()] == corpus[a:b]
    assert re_pair.round_trip(docs.limit(0), LIBRARY, 2).collect() == []


# op 12


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def resampled(docs, target, percent=25, least=20):
    hashed = lambda t: Counter(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1])
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(hashed(x))
    for x in target:
        t.update(hashed(x))
    a, b, out, pool = sum(s.values()), sum(t.values()), {}, []
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (a + 10_000) / ((s[k] + 1) * (b + 10_000))))
    for i, x in docs:
        words, fs = features(x)
        weight = sum(gain(zlib.crc32(f.encode()) % 10_000) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(fs), weight, score, None]
        if len(words) >= least:
            pool.append((-score, i))
    for k, (_, i) in enumerate(sorted(pool)[: len(pool) * percent // 100]):
        out[i][3] = k + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab 7é", min_size=1, max_size=4).map(str.encode), max_size=12), st.integers(1, 4))
def test_ring_of_states_is_the_crc_of_every_run(words, n):
    want = [[zlib.crc32(b" ".join(words[a : k + 1])) for a in range(max(0, k + 1 - n), k + 1)] for k in range(len(words))]
    assert [list(r) for r in importance.states(words, n)] == want


def test_scan_in_pieces_is_the_scan(monkeypatch):
    text = " ".join(f"Wört{i % 977} x" for i in range(3000))
    whole = importance.scan_text(text)
    monkeypatch.setattr(importance, "HELD", 64)
    again = importance.scan_text(text)
    assert whole[0] == again[0] == 6000 and (whole[1] == again[1]).all() and whole[1].dtype == np.uint16
    assert importance.scan_text("a b", 2, 1 << 20)[1].dtype == np.uint32


def test_resampling_brute_force(spark):
    rng = random.Random(8)
    near = [f"t{i}" for i in range(60)]
    far = [f"F{i}É" for i in range(60)]
    docs = [(i, " ".join(rng.choice(near if i % 3 == 0 else far) for _ in range(rng.randrange(5, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a third of all rows are copies
    docs += [(5001, None), (5002, ""), (5003, "?!"), (None, "no id " * 30), (5004, " ".join(near) * 300)]
    target = [" ".join(rng.choice(near) for _ in range(30)) for _ in range(20)] + [None, ""]
    want = resampled(docs, target)
    frame_ = frame(spark, docs).repartition(6)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    out = importance.resample(frame_, wanted)
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in out.collect()}
    assert got == want
    n = sum(v[3] is not None for v in want.values())
    kept = importance.drawn(frame_, out)
    assert kept.columns == frame_.columns and kept.count() == n  # a drawn null id would match nothing
    weights = [[v[1] for i, v in want.items() if i is not None and i < 300 and (i % 3 == 0) == like] for like in (True, False)]
    assert sorted(weights[0])[10] > max(weights[1])  # documents like the target weigh more, but for the one with many copies


def test_ties_and_repeated_rows_are_ranked_by_id(spark):
    rows = spark.createDataFrame([(i, 5, True) for i in range(7)] + [(3, 5, True), (50, 9, True), (51, 9, False)], "doc_id long, score long, eligible boolean")
    out = importance.ranked(rows, (50, 100))
    assert sorted((r["rank"], r["doc_id"]) for r in out.where("rank is not null").collect()) == [(1, 50), (2, 0), (3, 1), (4, 2)]


def test_resampling_of_empty_tables(spark):
    none = frame(spark, [])
    some = frame(spark, [(1, "a b " * 20), (2, "b c " * 20), (3, None), (4, "d e " * 20), (5, "f g " * 20)])
    assert importance.resample(none, some).collect() == []
    got = importance.resample(some, none, share=(1, 2)).collect()
    assert len(got) == 5 and sum(r["rank"] is not None for r in got) == 2


# op 13


def trie_brute(paths):
    """Nodes of {conv: [(role, text), ...]} in the contract's columns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.add((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children), leaves, saved, sha))
    return out


def paths_of(rows, group=100, turns=6):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:2])] for c, v in by.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % turns
        out[c] = own.get(c - c % group, [])[:h] + v[h:]
    return out


def as_rows(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return [tuple(r[n] for n in names) for r in df.collect()]


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "what?", "ja " * 40, ""])))
    return rows


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_trie_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = conversations(rng, 240)
    rows += [(c, t, "user", f"common {t}") for c in range(1000, 1120) for t in range(5)]  # one conversation that a third share
    rows += [(300, None, None, None), (300, 1, "user", None), (None, 1, "user", "no conversation"), (301, 4, "é", "naïve 漢字"), (5000, 0, "user", "long " * 5000)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "conv_id long, turn long, role string, text string, turns string, head string, size string").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        nodes = prefix_trie.trie(prefix_trie.with_heads(prefix_trie.turn_arrays(table), 100, 6)).cache()
        got = as_rows(nodes)
        texts = {r["turn"]: (r["role"], r["text"]) for r in prefix_trie.turn_texts(table).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    paths = paths_of(rows)
    assert len(got) == len(set(got)) and set(got) == trie_brute(paths)
    for r in nodes.where("depth > 0").collect():
        assert texts[bytes(r["turn"])] == paths[r["conv_id"]][r["depth"] - 1]


def test_trie_of_turnless_deep_and_no_conversations(spark):
    kind = "conv_id long, turns array<struct<digest:string,size:int>>"
    turn = lambda k: (hashlib.sha256(str(k).encode()).hexdigest()[:32], k)
    arrays = spark.createDataFrame([(7, []), (3, []), (9, [turn(k) for k in range(2000)]), (8, [turn(k) for k in range(1999)])], kind)
    got = as_rows(prefix_trie.trie(arrays))
    assert len(got) == 2001 and max(r[1] for r in got) == 2000
    root = next(r for r in got if r[1] == 0)
    assert root == (3, 0, None, 4, 1, 1, sum(range(1999)), hashlib.sha256(b"3,7").hexdigest())
    assert prefix_trie.trie(spark.createDataFrame([], kind)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a" * 16, b"b" * 16]), max_size=9), st.lists(st.sampled_from([b"a" * 16, b"b" * 16]), max_size=9))
def test_common_turns(a, b):
    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert prefix_trie.common(b"".join(a), b"".join(b)) == n


# the registered queries over a small folder


def test_registered_queries_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in queries.op12_importance(spark, folder).collect()}
    assert got == resampled(docs, target)
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    nodes = as_rows(queries.op13_prefix_trie(spark, folder))
    assert len(nodes) == len(set(nodes)) and set(nodes) == trie_brute(paths_of(rows))
    at, want = 0, {}
    for i, t in sorted(docs):
        ids = np.array(LIBRARY_.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op11_re_pair(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want


def test_all_three_are_registered():
    assert {"op11_re_pair", "op12_importance", "op13_prefix_trie"} <= set(queries.queries())
