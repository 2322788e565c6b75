"""Operators over pages and embeddings, the pipeline, and the registered queries."""

import base64
import hashlib
import html
import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from fenceline.llm import hilbert_ann, html_cut, queries, warc

# op 5


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def pages(spark, rows):
    clash = ", record_type string, _to string, _key string, sha string, id string"
    return spark.createDataFrame([(*r, *"xxxxxxx") for r in rows], "page_id long, url string, html string, payload string, refers_to string" + clash)


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bodies = ["", "a\r\n\r\nWARC/1.1\r\n", "é😀" * 500, "x" * 300_000, None]
    rows = [(i, f"http://x/ {i}\n", rng.choice(bodies)) for i in range(60)] + [(61, None, "lonely"), (None, "u", "x" * 300_000), (70, "u", "twice"), (70, "u", "twice")]
    out = warc.round_trip(pages(spark, rows), folder=f"file://{tmp_path}/w", url_col="url").collect()
    text = {i: (h or "") for i, _, h in rows}
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is None:
            assert (r["record_type"], r["refers_to"]) == ("response", None)
            continue
        body = text[r["page_id"]].encode()
        last = max(i for i, t in text.items() if i is not None and t.encode() == body)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), b32(body))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == last else ("revisit", last))
        assert r["payload"] == (body if r["page_id"] == last else None)
    assert warc.round_trip(pages(spark, [])).count() == 0


def test_short_payloads_are_responses(spark):
    out = warc.round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()
    assert {r["page_id"]: r["refers_to"] for r in out} == {1: None, 2: None, 3: 4, 4: None}


def test_normaliser_gives_each_record_a_member(tmp_path):
    import zlib

    recs = [warc.record("response", i, "http://x", bytes([65 + i]) * (i * 90_000), b32(bytes([65 + i]) * (i * 90_000)), None) for i in range(6)]
    z = zlib.compressobj(wbits=31)
    (tmp_path / "raw-1.warc.gz").write_bytes(z.compress(b"".join(recs)) + z.flush())
    n = warc.normalise(str(tmp_path / "raw-1.warc.gz"), str(tmp_path / "r.warc.gz"), str(tmp_path / "r.idx"))
    assert n == 6 and list(warc.read_indexed(str(tmp_path / "r.warc.gz"), str(tmp_path / "r.idx"))) == recs
    assert list(warc.records(warc._inflate(str(tmp_path / "r.warc.gz")))) == recs
    (tmp_path / "raw-2.warc.gz").write_bytes((lambda c: c.compress(recs[5][:-9]) + c.flush())(zlib.compressobj(wbits=31)))
    with pytest.raises(ValueError):
        warc.normalise(str(tmp_path / "raw-2.warc.gz"), str(tmp_path / "s.warc.gz"), str(tmp_path / "s.idx"))


# op 7


def test_hilbert_keys_are_a_curve():
    for d, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        order = cells[np.argsort(hilbert_ann.hilbert_keys(cells, bits))]
        assert len(set(hilbert_ann.hilbert_keys(cells, bits).tolist())) == len(cells)
        assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()  # neighbours on the curve are neighbours in space


def exact(rows, query, k=5):
    q = np.array(query[1])
    s = [(-float((np.array(v) * q).sum() / np.linalg.norm(v) / np.linalg.norm(q)), i) for i, v in rows if i != query[0]]
    return [i for _, i in sorted(s)[:k]]


def test_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).round(3).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] + [0.0] * 15) for i in range(40)]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] + [1.0] * 15), (3004, [1.0, 2.0]), (3005, []), (None, [1.0] * 16), (3050, None)]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows + odd], "vec_id long, embedding array<double>, id string, score string")
    out = hilbert_ann.neighbours(df, df.where("vec_id % 50 = 0"), window=64).collect()
    got = {}
    for r in out:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [r for r in rows if r[0] % 50 == 0]
    assert set(got) == {r[0] for r in asked}
    hit = 0
    for q in asked:
        mine = [i for _, i, _ in sorted(got[q[0]])]
        hit += len(set(mine) & set(exact(rows, q)))
        assert [r for r, _, _ in sorted(got[q[0]])] == [1, 2, 3, 4, 5] and q[0] not in mine
    assert hit / (5 * len(asked)) >= 0.9
    assert [i for _, i, _ in sorted(got[2000])] == [2001, 2002, 2003, 2004, 2005]  # copies, by id


def test_recall_with_production_parameters(spark):
    """Directions without any structure, four times as many as a query sees at once in all its windows' rows of one ordering."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = hilbert_ann.neighbours(df, df.where("vec_id % 50 = 0")).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosines = unit[::50] @ unit.T
    cosines[np.arange(120), np.arange(0, 6000, 50)] = -2
    best = np.argsort(-cosines, axis=1)[:, :5]
    assert len(out) == 600 and np.mean([r["vec_id"] in best[r["query_id"] // 50] for r in out]) >= 0.9
    assert all(abs(r["score"] - cosines[r["query_id"] // 50, r["vec_id"]]) < 1e-12 for r in out)


def test_windows_are_streamed_and_fixed():
    """Held in small pieces, every query sees the rows around it, as many as the window and no more."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    n, window, rows = 8, 20, []
    for i in range(3000):
        rows.append((n, 0, i, True, rng.integers(-127, 128, n).astype(np.int8).tobytes(), 1.0))
        if i % 7 == 0:
            rows.append((n, 0, i, False, rows[-1][4], 1.0))
    names = ("n", "ordering", "id", "is_row", "code", "scale")
    batches = [pa.RecordBatch.from_pydict({c: [r[k] for r in rows[a : a + 501]] for k, c in enumerate(names)}) for a in range(0, len(rows), 501)]
    got = {}
    hilbert_ann.HELD_ROWS, held = 100, hilbert_ann.HELD_ROWS
    try:
        for b in hilbert_ann.scan(iter(batches), window):
            for q, i, s in zip(*(c.to_pylist() for c in b.columns)):
                got.setdefault(q, {})[i] = s
    finally:
        hilbert_ann.HELD_ROWS = held
    code = {r[2]: np.frombuffer(r[4], np.int8).astype(float) for r in rows}
    assert set(got) == set(range(0, 3000, 7))
    for q, found in got.items():
        low = min(max(0, q + 1 - window // 2), 3000 - window)
        near = [i for i in range(low, low + window) if i != q]
        want = sorted((float(code[i] @ code[q]) for i in near), reverse=True)[: hilbert_ann.BEST]
        assert set(found) <= set(near) and sorted(found.values(), reverse=True)[:7] == want[:7]


def test_lengths_and_sizes_of_numbers(spark):
    rows = [(0, [3.0, 4.0]), (1, [3e300, 4e300]), (2, [4e-320, 3e-320]), (3, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 1.0]), (4, [0.0, 2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in hilbert_ann.neighbours(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [r[:3] for r in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 4), (50, 2, 3)]
    assert got[0][3] == pytest.approx(1) and got[1][3] == pytest.approx(0.96, abs=1e-3) and got[2][3] == pytest.approx(1) and got[3][3] == 0


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in hilbert_ann.neighbours(df, df.where("vec_id % 50 = 0")).collect()] == [(0, 1, 7)]
    assert hilbert_ann.neighbours(df.limit(0), df.limit(0)).count() == 0


# op 9


def test_minimum_cut_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 7)
        s, t = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        e = [(i, j, rng.randint(0, 5)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.6]
        cost = lambda side: sum(t[i] if side[i] else s[i] for i in range(n)) + sum(c for i, j, c in e if side[i] != side[j])
        assert cost(html_cut.minimum_cut(s, t, e)) == min(map(cost, itertools.product([True, False], repeat=n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><div class="logo">Site</div></header><nav><ul><li><a href="/a">Menu one</a></li><li><a>Menu two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, accept them all please.</div><aside><p>Side story about other things.</p></aside>
<article><h1>Head &amp; line</h1><p>First   text, with
<b>bold</b>&nbsp;words.<br>Next.<p>Second &lt;text&gt; here.</p><div class="ad">Buy this now.</div><form><label>Mail</label><input></form>
<ul><li>A point in the list.</li></ul></article>
<section id="comments"><article><p>I am a reader and I disagree, really.</p></article></section><!-- <p>gone</p> --><footer>&copy; x</footer></body></html>"""


def test_page_with_every_kind_of_boilerplate():
    w = html_cut.train([PAGE] * 5)
    assert html_cut.extract(PAGE, w) == "Head & line\nFirst text, with bold words. Next.\nSecond <text> here.\nA point in the list."
    assert html_cut.extract(None, w) == html_cut.extract("", w) == html_cut.extract("<script>x", w) == ""
    assert html_cut.extract(PAGE, np.array(html_cut.PRIOR)) == html_cut.extract(PAGE, w)


def test_long_and_broken_pages():
    w = html_cut.train([])
    body = "".join(f"<p>Sentence number {i}, which is long enough to be text.</p><div>x{i}" for i in range(3000))
    out = html_cut.extract("<article>" + body, w)
    assert out.count("Sentence") == 3000
    for broken in ("<", "<<p>", "</p></div>text", "<p", "<!--", "<a href='", "&#xfffffff;", "<p>" * 2000):
        html_cut.extract(broken, w)


@pytest.mark.parametrize("page", ["<a " * 350_000 + '"', "<div>" * 20_000 + "</p>" * 20_000, "<svg>" * 50_000, '<a ">' * 200_000, "<a '\">\" \"" * 100_000, "<svg></svg" * 60_000, '<p class="' * 100_000, "</svg " * 100_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    assert "<" not in html_cut.extract(page, np.array(html_cut.PRIOR))
    assert time.process_time() - began < 5


def test_undecided_pages_take_little_time():
    rng = random.Random(3)
    page = "".join(f"<div>{' '.join(['word,' if rng.random() < 0.3 else 'word'] * rng.randrange(1, 30))}</div>" for _ in range(6_000))
    began = time.process_time()
    html_cut.extract(page, np.array(html_cut.PRIOR))
    assert time.process_time() - began < 20


def test_unclosed_quote_and_names_of_classes():
    w = np.array(html_cut.PRIOR)
    assert html_cut.extract('<article><p title="x>Hello there, a text.</p><p>More.</p></article>', w) == "Hello there, a text.\nMore."
    assert html_cut.extract('<article><div class="text-ad-free">Kept.</div><div class="ad-slot">Gone.</div><div id="site_footer">Gone.</div></article>', w) == "Kept."


class Plain(HTMLParser):
    """The marks of a well-formed page read by the standard library's parser: article text that no boilerplate element holds."""

    def __init__(self):
        super().__init__()
        self.open, self.now, self.out = [], [], []

    def cut(self):
        tags = [t for t, _ in self.open]
        text = " ".join("".join(self.now).split())
        hidden = any(t in ("nav", "aside", "footer", "form") or c in ("ad", "comments") for t, c in self.open)
        if text and "article" in tags and not hidden:
            self.out.append(text)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag in ("b", "a"):
            return
        self.cut()
        self.open.append((tag, dict(attrs).get("class")))

    def handle_endtag(self, tag):
        if tag in ("b", "a"):
            return
        self.cut()
        self.open.pop()

    def handle_data(self, data):
        if not self.open or self.open[-1][0] not in ("script", "style"):
            self.now.append(data)


def random_page(rng):
    word = lambda: rng.choice(["text", "&amp;", "more", "x&nbsp;y", "<b>bold</b>", "end.", "so,", "é😀"])
    some = lambda n: " ".join(word() for _ in range(rng.randrange(3, n)))
    junk = lambda: rng.choice([
        f"<nav><ul><li><a href='/'>{some(6)}</a></li></ul></nav>", f'<div class="ad">{some(12)}</div>', f"<aside><p>{some(20)}</p></aside>", f"<form><div>{some(9)}</div></form>",
        "<script>var a = '<p>no</p>';</script>", "<style>p{}</style>", f'<div class="comments"><article><p>{some(20)}</p></article></div>',
    ])
    body = "".join(junk() if rng.random() < 0.2 else rng.choice([f"<p>{some(60)}.</p>", f"<h2>{some(7)}</h2>", f"<blockquote>{some(30)}</blockquote>", f"<div>{some(40)}</div>"]) for _ in range(rng.randrange(1, 12)))
    return f"<html><body>{junk()}<article><h1>{some(6)}</h1>{body}</article>{junk()}<footer>{some(8)}</footer></body></html>"


def test_extraction_equals_another_parser():
    rng = random.Random(29)
    pages = [random_page(rng) for _ in range(250)]
    w = html_cut.train(pages[:100])
    for page in pages:
        plain = Plain()
        plain.feed(page)
        plain.cut()
        assert html_cut.extract(page, w) == "\n".join(plain.out)


def test_the_cut_decides_where_nothing_is_marked():
    """Pages of bare divs: no mark tells the article; what the classifier learned from marked pages and the ties do."""
    rng = random.Random(31)
    w = html_cut.train([random_page(rng) for _ in range(200)])
    sentence = lambda: " ".join(rng.choice(["some", "word", "of", "prose,", "that", "goes", "on"]) for _ in range(rng.randrange(25, 60))) + "."
    right = wrong = by_itself = 0
    for _ in range(100):
        menu = "".join(f'<div><a href="/{k}">Link {k}</a></div>' for k in range(8))
        text = [sentence() if rng.random() < 0.85 else "A short line." for _ in range(12)]
        page = f"<body><div>{menu}</div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div>{menu}</div></body>"
        found = html_cut.blocks(page)
        assert not any(b.main or b.chrome for b in found)  # the plain rule would keep nothing
        labels = html_cut.label_blocks(found, w)
        alone = html_cut.log_odds(found, w) > 0
        truth = [b.text in text for b in found]
        right += sum(a == b for a, b in zip(labels, truth))
        by_itself += sum(a == b for a, b in zip(alone, truth))
        wrong += sum(a != b for a, b in zip(labels, truth))
    assert right / (right + wrong) >= 0.95 and right > by_itself


def test_marks_that_are_missing_are_made_up_for():
    """Held-out pages with the marks of half of their elements hidden: the rule of marks alone loses what it cannot see."""
    rng = random.Random(37)
    pages = [random_page(rng) for _ in range(400)]
    w = html_cut.train(pages[:250])
    assert max(abs(w[len(html_cut.FEATURES) :])) < 8  # no mark decides alone
    cut = rule = n = 0
    for k, page in enumerate(pages[250:]):
        hidden = lambda number, k=k: random.Random(1000 * k + number).random() < 0.5
        found, whole = html_cut.blocks(page, hidden), html_cut.blocks(page)
        truth = [b.main and not b.chrome for b in whole]
        cut += sum(a == b for a, b in zip(html_cut.label_blocks(found, w), truth))
        rule += sum((b.main and not b.chrome) == t for b, t in zip(found, truth))
        n += len(truth)
        assert html_cut.label_blocks(whole, w) == truth
    assert cut / n > 0.9 and cut > rule


def test_classes_of_an_article_do_not_mark_it():
    w = np.array(html_cut.PRIOR)
    for name in ("post tag-search", "post category-social", "hentry tags-footer"):
        assert html_cut.extract(f'<nav><a>Menu</a></nav><article class="{name}"><p>A sentence of the article, with some words.</p><p>And <math><mi>x</mi></math> more.</p></article>', w) == "A sentence of the article, with some words.\nAnd x more."


def test_pages_column(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None), (3, "", "")], "page_id long, url string, html string")
    w = html_cut.fit(df)
    out = df.select("page_id", html_cut.extract_column(w).alias("t")).collect()
    assert [r["t"] for r in out if r["page_id"] != 1] == ["", "", ""] and html.unescape("&amp;") in out[0]["t"]
    assert len(html_cut.fit(df.limit(0))) == len(html_cut.FEATURES + html_cut.MARKS)


# registered queries


def test_all_thirteen_are_registered():
    numbered = sorted((n for n in queries.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in numbered] == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())
