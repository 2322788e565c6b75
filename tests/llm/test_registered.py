"""The registered queries over a small folder: their columns and rows, and SQL where there is some."""

import collections

import numpy as np
import pytest

from fenceline.llm import language_id, queries, secret_scan

FOLDER = "/root/testdata/sf0.001"
#: Columns of each query and the table that it has a row of, if it has.
EXPECTED = {
    "op1_quality_rules": ("doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "documents"),
    "op2_secret_scan": ("doc_id n_assign n_access n_hex base_sha256 spans", "documents"),
    "op3_source_mixing": ("doc_id size source_size target taken", "documents"),
    "op4_language_id": ("doc_id held_out lang_pred score", "documents"),
    "op5_warc_normaliser": ("page_id payload_bytes payload_digest record_type refers_to", "pages"),
    "op6_token_counts": ("length n_docs docs_at_least tokens_at_least docs_at_most share_at_most truncated_tokens total_docs total_tokens", None),
    "op7_hilbert_ann": ("query_id rank vec_id score", None),
    "op8_byte_bpe": ("doc_id n_tokens ids_sha256 decoded_sha256", "documents"),
    "op9_html_cut": ("page_id url text n_chars", "pages"),
    "op10_order_minhash": (None, "documents"),
    "op11_re_pair": ("doc_id start n_tokens ids_crc32", "documents"),
    "op12_importance": ("doc_id n_features weight score rank", "documents"),
    "op13_prefix_trie": ("conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", None),
}


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


@pytest.mark.parametrize("name", EXPECTED)
def test_rows_and_columns(spark, name):
    columns, source = EXPECTED[name]
    out = queries.queries()[name](spark, FOLDER)
    assert columns is None or set(columns.split()) <= set(out.columns)
    rows = out.toPandas()
    assert len(rows) == table(spark, source).count() if source else len(rows) > 0
    if name == "op7_hilbert_ann":  # against brute force: five of each query, and nine in ten of the right ones
        vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, "embeddings").collect() if r["embedding"] is not None}
        ids = np.array(sorted(vectors))
        unit = np.stack([vectors[i] / np.linalg.norm(vectors[i]) for i in ids])
        hits = 0
        for q in ids[ids % 50 == 0]:
            near = [i for i in ids[np.argsort(-(unit @ unit[np.searchsorted(ids, q)]), kind="stable")] if i != q][:5]
            hits += len(set(near) & set(rows[rows["query_id"] == q]["vec_id"]))
        assert hits >= 0.9 * 5 * (ids % 50 == 0).sum()
    if name == "op6_token_counts":
        lengths = queries.op8_byte_bpe(spark, FOLDER).toPandas()["n_tokens"]
        assert dict(zip(rows["length"], rows["n_docs"])) == dict(collections.Counter(lengths))


@pytest.mark.parametrize("name", ["base_quality_counts", "base_secret_spans", "op3_source_mixing", "op12_importance", "op13_prefix_trie"])
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got = queries.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = c.sql(queries.oracle_sql()[name]).select(*map(duckdb.ColumnExpression, columns)).fetchall()
    text = lambda r: tuple("" if v is None else str(v) for v in r)
    assert collections.Counter(map(text, want)) == collections.Counter(text(tuple(r[x] for x in columns)) for r in got.collect())


def test_network_against_loops():
    """Every window, filter and offset by hand."""
    net = language_id.train(["aé words of one sort " * 30, "other letters xyz " * 40], ["a", "b"], steps=5)
    for text in ("short", "ü" * 300, "mixed words, and éé more of them " * 25):
        data = np.frombuffer(text.encode(), np.uint8)
        starts = [0] if len(data) <= language_id.WINDOW else [*range(0, len(data) - language_id.WINDOW, language_id.STRIDE), len(data) - language_id.WINDOW]
        sums = np.zeros(2)
        for s in starts:
            window = [int(data[s + k]) if s + k < len(data) else language_id.PAD for k in range(language_id.WINDOW)]
            pooled = [max(sum(float(t[k, window[p + k], f]) for k in range(w)) for p in range(language_id.WINDOW - w + 1)) for w, t in net.tables.items() for f in range(language_id.FILTERS)]
            z = [sum(max(0.0, h) * float(net.out[i, c]) for i, h in enumerate(pooled)) + float(net.bias[c]) for c in range(2)]
            e = np.exp(np.array(z) - max(z))
            sums += e / e.sum()
        p = sums / len(starts)
        (lang, score), = net.predict([text])
        assert lang == net.langs[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-5)


def test_words_get_no_allowance_for_chance():
    few = {3: 2, 40: 1}
    assert secret_scan._least(few, 0.05) is not None and secret_scan._least(few, 0.05, allowing=False) is None
    many = {b: 5 for b in range(secret_scan.BINS)}
    assert secret_scan._least(many, 0.05, allowing=False) == 0.0
