"""HTML extraction by minimum cut.

A page becomes its blocks of text in order. A logistic classifier, which sees text, elements and places, and what the page's
authors mark, gives each block a probability of being content; what either label would cost becomes the capacity of its
edge to source or sink. Neighbours in page order and neighbours in the document tree are tied by smoothness edges. The
minimum cut of that graph is the cheapest labelling. How much marks weigh is learned like all else: from pages that mark
their article, with the marks of a share of their elements hidden, so that text and place must make up for them.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements by what they mean for the text.
#: Their content is no text of the page.
RAW = "script style noscript template textarea title iframe svg object select option button canvas audio video head"
#: They begin and end blocks.
BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
#: Elements that a start tag of the same name closes.
SELF_CLOSING = "p li dt dd tr td th option"
#: Elements, and words of class, id and role, that mark what is not the article.
CHROME_TAGS = "nav footer aside form menu dialog fieldset"
CHROME_WORDS = (
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer bottom sidebar aside rail widget related recommended share sharing social comment comments disqus replies reply "
    "discussion respond form search pagination pager tags toolbar copyright legal complementary contentinfo"
)
MAIN_TAGS = "article main"
MAIN_WORDS = "article main content post entry story body text"

_raw, _block, _void, _self = (frozenset(x.split()) for x in (RAW, BLOCK, VOID, SELF_CLOSING))
_chrome_tags, _chrome_words, _main_tags, _main_words = (frozenset(x.split()) for x in (CHROME_TAGS, CHROME_WORDS, MAIN_TAGS, MAIN_WORDS))
_name = re.compile(r"[a-zA-Z][^\s/>]*")
_quote_or_end = re.compile(r"[\"'>]")
_named = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_word = re.compile(r"[a-z]+")

#: What the classifier sees of a block: its text, its element, its place in page and tree, its neighbours.
FEATURES = ("bias", "log_words", "stops", "links", "heading", "paragraph", "list_item", "depth", "first", "last", "near_words", "family_words")
#: And of its authors' marks: the block is in an element of the article and in none of what is no article; is in neither, on a page
#: whose article holds at least SHARE of the other words; is in an element of what is no article. The first two also times
#: how much of the page is marked as no article.
MARKS = ("article", "outside", "chrome", "article_marked", "outside_marked")
SHARE = 0.2
#: What the weights are before any page is seen, and how firmly (a ridge towards them).
PRIOR = (-2.8, 0.45, 0.8, -3.0, 0.3, 1.0, -0.5, -0.05, -0.5, -1.0, 0.35, 0.2, 2.0, -2.0, -4.0, 2.0, -2.0)
FIRM = 0.3
#: Shares of its elements whose marks a page hides while weights are learned from it; each page has one of them.
HIDDEN = (0.0, 0.25, 0.5, 0.75, 1.0)
#: Capacity that ties neighbours in page order, and neighbours under one parent.
NEXT, SIBLING = 0.35, 0.35


@dataclass
class Block:
    text: str
    parent: int
    main: bool
    chrome: bool
    features: tuple[float, ...]


def tags(page: str):
    """(text before, name, is end, attributes) of the tags of a page, name "" for comments and declarations and None at the end.

    Every character is looked at a bounded number of times, whatever the page holds. A quote hides ``>`` up to its
    partner; from the first tag on that never ends that way, a tag ends at its next ``>``. Without one it goes to the
    end of the page. Of script and the like, all up to the end tag is left out.
    """
    pos, start, size, quotes, unclosed = 0, 0, len(page), True, set()
    last = {q: page.rfind(q) for q in "\"'"}
    while (at := page.find("<", pos)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield page[start:at], "", False, ""
            pos = start = size if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            yield page[start:at], "", False, ""
            pos = start = size if end < 0 else end + 1
            continue
        is_end = page[at + 1 : at + 2] == "/"
        m = _name.match(page, at + 1 + is_end)
        if not m:  # a sign, not a tag
            pos = at + 1
            continue
        name, end = m[0].lower(), m.end()
        if quotes:
            while (q := _quote_or_end.search(page, end)) and q[0] != ">":
                end = page.find(q[0], q.end()) + 1 if q.end() <= last[q[0]] else q.end()
            quotes = q is not None
            end = q.start() if q else page.find(">", m.end())
        else:
            end = page.find(">", end)
        if end < 0:
            end = size
        attributes = page[m.end() : end]
        yield page[start:at], name, is_end, attributes
        pos = start = min(size, end + 1)
        if name in _raw and name != "head" and not is_end and not attributes.endswith("/") and name not in unclosed:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, pos)
            if close:
                pos = start = close.start()
            elif name in ("script", "style", "textarea", "title"):
                pos = start = size
            else:
                unclosed.add(name)
    yield page[start:], None, False, ""


def _marked(attributes: str) -> tuple[bool, bool]:
    """Whether class, id or role name the article, and whether they name what is no article: by a whole name, or by the first or
    last part of a hyphenated one (``site-footer``, ``ad_slot``)."""
    main = chrome = False
    for value in _named.findall(attributes):
        for one in value.strip("\"'").lower().split():
            parts = _word.findall(one)
            if parts:
                ends = {parts[0], parts[-1]}
                main = main or not _main_words.isdisjoint(ends)
                # an article's header is its title
                chrome = chrome or not _chrome_words.isdisjoint(ends - {"header"} if not _main_words.isdisjoint(ends) else ends)
    return main, chrome


def blocks(page: str, hidden: Callable[[int], bool] = lambda number: False) -> list[Block]:
    """Blocks of text of a page, in order, empty ones left out. Any text is a page; unclosed and stray tags are fine. Of elements whose
    number is ``hidden`` neither names nor classes mark anything."""
    out: list[tuple] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, number, main, chrome
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked, in_link, number = 0, False, 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, *stack[-1], len(stack), min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def close(name: str) -> None:
        while (top := stack.pop()[0]) != name:
            opened[top] -= 1
        opened[name] -= 1

    for piece, name, is_end, attributes in tags(page):
        if piece:
            parts.append(piece)
            if in_link:
                linked += len(piece)
        if name == "br":
            parts.append(" ")
        elif name == "a":
            in_link = not is_end
        elif name not in _block:
            continue
        elif is_end:
            end_block()
            if opened[name]:
                close(name)
        else:
            end_block()
            if stack[-1][0] == "p":  # no block lies in a paragraph
                close("p")
            if name in _self and stack[-1][0] == name:
                close(name)
            if name not in _void:
                number += 1
                _, _, main, chrome = stack[-1]
                if not hidden(number):
                    # what an article is filed under (``tag-search``) says nothing against it
                    own, marked = _marked(attributes) if attributes and name not in _main_tags else (False, False)
                    main = main or name in _main_tags or (own and not marked)
                    chrome = chrome or name in _chrome_tags or (name == "header" and not main) or (marked and name not in ("body", "html"))
                stack.append((name, number, main, chrome))
                opened[name] += 1
    end_block()
    return _described(out)


def _described(found: list[tuple]) -> list[Block]:
    words = [text.count(" ") + 1 for text, *_ in found]
    size = [float(np.log1p(n)) for n in words]
    family: Counter[int] = Counter()
    for n, (_, _, parent, *_) in zip(words, found):
        family[parent] += n
    out = []
    for i, (text, tag, parent, main, chrome, depth, links) in enumerate(found):
        stops = sum(map(text.count, ".!?;:,"))
        near = (size[i - 1] if i else 0.0) + (size[i + 1] if i + 1 < len(found) else 0.0)
        place = (i + 0.5) / len(found)
        out.append(Block(text, parent, main, chrome, (
            1.0, size[i], min(1.0, 8 * stops / words[i]), links, float(tag[:1] == "h" and len(tag) == 2), float(tag in ("p", "blockquote", "pre")), float(tag in ("li", "td", "dd")),
            float(np.log1p(depth)), max(0.0, 1 - place / 0.15), max(0.0, 1 - (1 - place) / 0.15), near / 2, float(np.log1p(family[parent])),
        )))
    return out


def minimum_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut (the smallest such side).

    source[i], sink[i]: capacities from the source to i and from i to the sink; edges (i, j, capacity) hold both ways.
    Nodes whose own capacities outweigh all their edges are settled first, which adds to their neighbours' capacities;
    what is left gets augmenting paths by levels.
    """
    n = len(source)
    pull = [a - b for a, b in zip(source, sink)]
    ties: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        ties[i][j] = ties[i].get(j, 0) + c
        ties[j][i] = ties[j].get(i, 0) + c
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(pull[i]) > sum(ties[i].values()):
            label[i] = pull[i] > 0
            for j, c in ties[i].items():
                del ties[j][i]
                pull[j] += c if label[i] else -c
                queue.append(j)
            ties[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return label  # type: ignore[return-value]
    # residual capacities; -1 is the source, -2 the sink
    room: dict[int, dict[int, int]] = {i: dict(ties[i]) for i in left} | {-1: {}, -2: {}}
    for i in left:
        if pull[i] > 0:
            room[-1][i] = pull[i]
            room[i][-1] = 0
        else:
            room[i][-2] = -pull[i]
            room[-2][i] = 0
    while True:
        level = {-1: 0}
        queue = deque([-1])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if -2 not in level:
            break
        following = {i: iter(room[i]) for i in level}
        path = [-1]
        while path:
            i = path[-1]
            if i == -2:
                flow = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= flow
                    room[b][a] += flow
                cut_at = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if room[a][b] == 0)
                following[path[cut_at]] = iter(room[path[cut_at]])
                del path[cut_at + 1 :]
                continue
            for j in following[i]:
                if room[i][j] > 0 and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()
                level[i] = -1
    for i in left:
        label[i] = i in level
    return label  # type: ignore[return-value]


def seen(found: list[Block]) -> np.ndarray:
    """FEATURES and MARKS of the blocks of a page, a row a block."""
    chrome, main = np.array([b.chrome for b in found], bool), np.array([b.main for b in found], bool)
    words = np.array([b.text.count(" ") + 1 for b in found])
    article = main & ~chrome
    outside = ~main & ~chrome & bool(article.any() and words[article].sum() >= SHARE * words[~chrome].sum())
    marked = min(1.0, 4 * float(chrome.mean()))
    return np.concatenate([np.array([b.features for b in found], float), np.stack([article, outside, chrome, article * marked, outside * marked], 1)], 1)


def log_odds(found: list[Block], weights: np.ndarray) -> np.ndarray:
    """Of being content, by the classifier alone."""
    return seen(found) @ weights


def label_blocks(found: list[Block], weights: np.ndarray) -> list[bool]:
    """True for content: the minimum cut of a page's graph."""
    if not found:
        return []
    z = np.clip(log_odds(found, weights), -8, 8)
    cost = np.logaddexp(0, np.stack([-z, z]))  # of calling it content, of calling it boilerplate
    units = np.rint(1000 * cost).astype(int)
    edges = [(i, i + 1, int(1000 * NEXT)) for i in range(len(found) - 1) if found[i].chrome == found[i + 1].chrome]
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if (j := last.get(b.parent)) is not None:
            edges.append((j, i, int(1000 * SIBLING)))
        last[b.parent] = i
    # cut off from the source (content) costs what calling it boilerplate costs
    return minimum_cut(units[1].tolist(), units[0].tolist(), edges)


def extract(page: str | None, weights: np.ndarray) -> str:
    """Main text of a page: content blocks joined by a line feed; empty for null, empty or contentless pages."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, label_blocks(found, weights)) if keep)


def examples(page: str, at_most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What a page teaches: rows of ``seen`` with the marks of some of its elements hidden, and whether its authors' marks, all of them,
    say that the block is content: in an article or main element and in none that marks navigation, adverts, forms or
    comments. A page without such an element teaches nothing. Of more than ``at_most`` blocks evenly many are taken."""
    whole = blocks(page)
    if not any(b.main for b in whole):
        return np.zeros((0, len(PRIOR))), np.zeros(0)
    key = zlib.crc32(page.encode())
    rate = HIDDEN[key % len(HIDDEN)]
    rows = seen(blocks(page, lambda number: zlib.crc32(b"%d:%d" % (key, number)) < rate * 2**32))
    few = np.unique(np.linspace(0, len(whole) - 1, at_most).astype(int)) if at_most and at_most < len(whole) else np.arange(len(whole))
    return rows[few], np.array([b.main and not b.chrome for b in whole], float)[few]


def newton(x: np.ndarray, y: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Weights of the logistic classifier by Newton's method with a ridge towards PRIOR; without any row they are PRIOR."""
    w = np.array(PRIOR)
    if not len(x):
        return w
    share = 200.0 / len(x) if len(x) > 200 else 1.0  # so that the prior weighs the same for any sample
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = share * x.T @ (p - y) + FIRM * (w - PRIOR)
        h = share * (x * (p * (1 - p))[:, None]).T @ x + FIRM * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def train(pages: list[str]) -> np.ndarray:
    """Weights from a few pages."""
    parts = [examples(p) for p in pages]
    return newton(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])) if parts else np.array(PRIOR)


def fit(pages: DataFrame, max_pages: int = 400, max_blocks: int = 100, html_col: str = "html") -> np.ndarray:
    """Train on ``max_pages`` pages at most, those of the least hashes, and ``max_blocks`` blocks of each, whatever the size of the table.
    Pages become examples in tasks; only these numbers reach the driver, a few MB at most."""

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, page in zip(b["h"], b["html"]):
                x, y = examples(page, max_blocks)
                if len(x):
                    yield pd.DataFrame({"h": h, "x": x.tolist(), "y": y})

    rows = pages.where(F.col(html_col).isNotNull()).select(F.col(html_col).alias("html"), F.xxhash64(html_col, F.lit(2)).alias("h"))
    key = rows.select("h").distinct().orderBy("h").limit(max_pages)
    few = rows.join(F.broadcast(key), "h").dropDuplicates(["h"])
    got = sorted(few.select("h", "html").mapInPandas(teach, "h long, x array<double>, y double").collect(), key=lambda r: (r["h"], r["x"], r["y"]))
    return newton(np.array([r["x"] for r in got], float).reshape(-1, len(PRIOR)), np.array([r["y"] for r in got], float))


def extract_column(weights: np.ndarray, html_col: str = "html"):
    @F.pandas_udf(StringType())
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([extract(p, weights) for p in page], dtype=object)

    return text(F.col(html_col))
