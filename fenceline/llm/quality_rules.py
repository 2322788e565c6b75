"""Quality rules: a decision list of threshold conjunctions, learned by sequential covering from labelled statistics.

Rules for the bad class are grown term by term for the best information gain on two thirds of the labelled rows, pruned
from the end on the other third, and kept while they are precise there; rows that a rule covers leave both sets. The
list comes out as one ordered Spark conditional expression over the statistics, so applying it costs no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .util import WORD

#: Counts over one text. The first five are the base; the rest feed the learned rules.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks")
#: Characters counted as symbols, and as further marks.
SYMBOLS = "#*$%&|<>"
MARKS = "!|?=_~^@"
#: Windows of so many words count as repeated.
WINDOW = 5

_words = re.compile(WORD).findall
_upper, _lower, _digit = re.compile(r"[A-ZÀ-ÖØ-Þ]").findall, re.compile(r"[a-zß-öø-ÿ]+").findall, re.compile(r"[0-9]").findall


def repeated_words(words: list[str], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more, its first occurrence included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width))))
    seen: set = set()
    twice = {w for w in windows if w in seen or seen.add(w)} if len(set(windows)) < len(windows) else ()
    if not twice:
        return 0
    hit = np.fromiter((w in twice for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for i in range(width):
        cover[i : i + len(hit)] |= hit
    return int(cover.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text; null counts as empty."""
    if not text:
        return (0,) * len(COUNTS)
    words = _words(text)
    seen: set = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line in seen:
            lines, dup = lines + 1, dup + 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            seen.add(line)
    lower = sum(map(len, _lower(text)))
    return (
        len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words), lines, len(set(words)),
        len(_upper(text)), lower, len(_digit(text)), sum(map(text.count, MARKS)),
    )


_SCHEMA = StructType([StructField(c, LongType()) for c in COUNTS])


@F.pandas_udf(_SCHEMA)
def text_counts(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_text(t) for t in text], columns=list(COUNTS), dtype="int64")


def features(c: dict | DataFrame | None = None, col=F.col) -> dict[str, Column]:
    """Statistics the rules may test, as functions of COUNTS; ``col`` gives a count."""
    per = lambda a, b: col(a) / F.greatest(b, F.lit(1))
    letters = col("n_upper") + col("n_lower")
    return {
        "words": col("n_words").cast("double"),
        "chars_per_word": per("word_chars", col("n_words")),
        "symbols_per_word": per("n_symbols", col("n_words")),
        "marks_per_word": per("n_marks", col("n_words")),
        "dup_line_share": per("n_dup_lines", col("n_lines")),
        "repeat_share": per("n_repeat_words", col("n_words")),
        "distinct_share": per("n_distinct_words", col("n_words")),
        "upper_share": per("n_upper", letters),
        "digit_share": per("n_digits", col("word_chars")),
    }


@dataclass(frozen=True)
class Rule:
    """Reject where every (statistic, ">=" or "<=", threshold) holds."""

    terms: tuple[tuple[str, str, float], ...]

    def covers(self, x: pd.DataFrame) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for name, op, at in self.terms:
            v = x[name].to_numpy()
            hit &= v >= at if op == ">=" else v <= at
        return hit

    def column(self, stats: dict[str, Column]) -> Column:
        hit = F.lit(True)
        for name, op, at in self.terms:
            hit = hit & (stats[name] >= at if op == ">=" else stats[name] <= at)
        return hit

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {t:g}" for n, o, t in self.terms)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...] = field(default=())

    def keep(self, stats: dict[str, Column]) -> Column:
        """when(rule 1, false).when(rule 2, false)...otherwise(true)."""
        out = None
        for r in self.rules:
            out = F.when(r.column(stats), F.lit(False)) if out is None else out.when(r.column(stats), F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _grow(x: pd.DataFrame, bad: np.ndarray, cuts: dict[str, np.ndarray], max_terms: int) -> list:
    """Add the term of the best information gain until no good row is covered."""
    hit, terms = np.ones(len(x), bool), []
    while len(terms) < max_terms and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None, None)
        for name, at in cuts.items():
            v = x[name].to_numpy()
            p_low = np.searchsorted(np.sort(v[hit & bad]), at, side="right")
            n_low = np.searchsorted(np.sort(v[hit & ~bad]), at, side="right")
            p_below = np.searchsorted(np.sort(v[hit & bad]), at, side="left")
            n_below = np.searchsorted(np.sort(v[hit & ~bad]), at, side="left")
            for op, p, n in (("<=", p_low, n_low), (">=", p0 - p_below, n0 - n_below)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (name, op, float(at[k])), v)
        if best[1] is None:
            break
        terms.append(best[1])
        hit &= best[2] >= best[1][2] if best[1][1] == ">=" else best[2] <= best[1][2]
    return terms


def learn(x: pd.DataFrame, bad: np.ndarray, max_rules: int = 24, max_terms: int = 4, min_precision: float = 0.9, min_cover: int = 3, seed: int = 7) -> DecisionList:
    """Grow and prune rules that find ``bad`` rows. One class only, or too few rows: no rules.

    ``min_precision`` holds on the rows kept apart for pruning (where a rule covers none of them it is dropped), so a rule
    that hits clean documents is not emitted.
    """
    bad = np.asarray(bad, bool)
    if bad.sum() < 2 * min_cover or (~bad).sum() < 2 * min_cover:
        return DecisionList()
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(x)) % 3 == 0
    grow, prune, g_bad, p_bad = x[~part], x[part], bad[~part], bad[part]
    cuts = {c: np.unique(np.quantile(x[c], np.linspace(0, 1, 201))) for c in x.columns}
    rules: list[Rule] = []
    while len(rules) < max_rules and g_bad.sum() >= min_cover:
        terms = _grow(grow, g_bad, cuts, max_terms)
        if not terms:
            break

        def worth(t: list) -> tuple[float, int]:
            hit = Rule(tuple(t)).covers(prune)
            p, n = int((hit & p_bad).sum()), int((hit & ~p_bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0), p

        tried = [terms[:k] for k in range(1, len(terms) + 1)]
        best = max(tried, key=lambda t: (round(worth(t)[0], 3), worth(t)[1]))
        value, p = worth(best)
        rule = Rule(tuple(best))
        g_hit = rule.covers(grow)
        if (value + 1) / 2 < min_precision or p < 1 or (g_hit & g_bad).sum() < min_cover:
            break
        rules.append(rule)
        p_hit = rule.covers(prune)
        grow, g_bad, prune, p_bad = grow[~g_hit], g_bad[~g_hit], prune[~p_hit], p_bad[~p_hit]
    return DecisionList(tuple(rules))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> tuple[pd.DataFrame, np.ndarray]:
    """Statistics and badness of at most ``max_labelled`` labelled documents, those of the least hashed ids. Rows that repeat
    an id are one document (where texts differ, the one of the greatest hash), so no more rows than that reach the driver."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    few = one.orderBy(F.xxhash64("_id", F.lit(3)), "_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")  # at most max_labelled ids
    rows = rows.groupBy("_id", "_label").agg(F.max_by("_text", F.xxhash64("_text")).alias("_text"))
    rows = rows.select("_id", "_label", text_counts("_text").alias("_c"))
    got = rows.select("_id", "_label", *[v.alias(k) for k, v in features(col=lambda c: F.col("_c")[c]).items()]).toPandas()
    got = got.sort_values("_id").reset_index(drop=True)
    return got.drop(columns=["_id", "_label"]), (got["_label"] == 0).to_numpy()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, **kw) -> DecisionList:
    """Learn from a bounded sample: ``max_labelled`` rows, whatever the size of the tables."""
    return learn(*labelled_sample(docs, labels, max_labelled), **kw)


def judge(docs: DataFrame, rules: DecisionList, text_col: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` and a struct ``out``: COUNTS, base_failed, kept.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. Null and empty texts have no
    words and fail. Every row of ``docs`` stays, repeated rows too; its other columns pass through untouched.
    """
    counted = docs.withColumn(out, text_counts(F.col(text_col)))
    c = lambda name: F.col(out)[name]
    failed = (c("n_words") < 10) | (100 * c("n_repeat_words") > 20 * c("n_words"))
    kept = ~failed & rules.keep(features(col=c))
    return counted.withColumn(out, F.struct(*[c(k).alias(k) for k in COUNTS], failed.alias("base_failed"), kept.alias("kept")))
