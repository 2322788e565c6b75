"""The corpus pipeline against a brute-force version of all its stages."""

import base64
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from fenceline.llm import quality_rules, secret_scan

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
from tests.llm.test_documents import classes, jaccard, prose, water  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(43)
    rows, labels = [], []
    for i in range(260):
        bad = i % 5 == 0
        text = prose(rng, rng.randrange(20, 90), 6000)
        if bad:
            text = text.upper()
        if i % 17 == 3:
            text += "\ntoken = " + hashlib.sha1(str(i).encode()).hexdigest()
        if i % 9 == 4 and rows:
            text = rows[-1][1] + (" more" if i % 2 else "")
        rows.append((i, text, "en", rng.choice(["a", "b", "b", "b", "c", None]), len(text)))
        labels.append((i, 0 if bad else 1, 0))
    rows += [(900, None, None, "a", 0), (901, "", "en", None, 0), (None, prose(rng, 50), "en", "a", 5), (902, "few words", "en", "c", 9)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def ratios(c):
    per = lambda a, b: a / max(b, 1)
    letters = c["n_upper"] + c["n_lower"]
    return {
        "words": float(c["n_words"]), "chars_per_word": per(c["word_chars"], c["n_words"]), "symbols_per_word": per(c["n_symbols"], c["n_words"]), "marks_per_word": per(c["n_marks"], c["n_words"]),
        "dup_line_share": per(c["n_dup_lines"], c["n_lines"]), "repeat_share": per(c["n_repeat_words"], c["n_words"]), "distinct_share": per(c["n_distinct_words"], c["n_words"]),
        "upper_share": per(c["n_upper"], letters), "digit_share": per(c["n_digits"], c["word_chars"]),
    }


def brute_force(rows, rules):
    kept = []
    for r in rows:
        c = dict(zip(quality_rules.COUNTS, quality_rules.count_text(r[1])))
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        x = pd.DataFrame([ratios(c)])
        if r[0] is not None and not failed and not any(rule.covers(x)[0] for rule in rules.rules):
            kept.append(r)
    text = {r[0]: r[1] for r in kept}
    same = classes(text, [(a, b) for a, b in itertools.combinations(text, 2) if jaccard(text[a], text[b]) >= 0.8])
    kept = [r for r in kept if same[r[0]] == r[0]]
    clean = []
    for r in kept:
        t = r[1]
        spans = sorted([m.span() for m in re.finditer(secret_scan.ASSIGN, t) if len(m[2]) >= 12] + [m.span() for m in re.finditer("[0-9a-f]{16,}", t)])
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        clean.append((r[0], out + t[at:], r[3]))
    sizes = collections.Counter()
    for i, t, s in clean:
        sizes[s] += len(WORDS.findall(t))
    goal, final = water(sizes), []
    for s in sizes:
        budget = int(np.floor(goal[s] + 0.5))
        epochs, rest = divmod(budget, sizes[s])
        for i, t, _ in sorted((x for x in clean if x[2] == s), key=lambda x: int(hashlib.md5(f"{x[0]}:17".encode()).hexdigest()[:15], 16)):
            n = len(WORDS.findall(t))
            part = max(0, min(n, rest))
            rest -= part
            final += [(i, s, t)] * epochs + ([(i, s, t)] if part == n and n else [(i, s, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:part]))] if part else [])
    return final


def test_pipeline_equals_brute_force(spark, folder):
    at, rows = folder
    tiktoken = pytest.importorskip("tiktoken")
    with open(corpus_pipeline.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{at}/documents.parquet")
    rules = quality_rules.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    want = sorted((i, s or "", own.encode_ordinary(t)) for i, s, t in brute_force(rows, rules))
    out = corpus_pipeline.run(spark, at).collect()
    assert all(r["exact"] for r in out)
    assert sorted((r["doc_id"], r["source"] or "", np.frombuffer(r["ids"], "<u4").tolist()) for r in out) == want
    assert len(want) > 100


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for rows in (docs.limit(0), docs.where("doc_id < 12 or doc_id > 899")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, at)
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * docs.count()
    clashing = docs.where("doc_id < 40 or doc_id > 899")
    for name in ("_quality", "_secrets", "_base", "_tokens", "_candidates", "_id", "_size", "_taken", "_epoch", "_row", "__id", "size", "taken", "label"):
        clashing = clashing.withColumn(name, F.lit(f"own {name}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:  # columns that stages use for themselves come out as they went in
        out = stage(spark, clashing, at)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in clashing.columns if c not in docs.columns), name
    assert "near" in corpus_pipeline.STAGES[1][0] and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
