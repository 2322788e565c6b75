"""Secret scans, in DataFrame functions only: fixed patterns, and a randomness test battery over long tokens.

Every token of 20 characters or more is read as digits of the encoding that its characters tell (upper-case hex, base32,
base36 of either case, letters of one or both cases, base64, and base64's alphabet for what is left) and tested for being
uniformly random: chi-squared uniformity of the alphabet, number of runs above and below the middle, serial correlation at
lag one, and in encodings that words have too the share of letters common in words. The two-sided p values are combined by Fisher's method. A secret
gives p values spread evenly over 0 to 1, an identifier or a word gives p near 0; so in every stratum of encoding and
length, the tokens above 0.5 tell how many are random, and the threshold is the least p at which the estimated share of
false discoveries among what lies above stays within ``fdr``. How many are random is known up to chance only: an excess
that chance explains counts as none, down to p of ``FLOOR``, so that thin strata keep their secrets; but not in encodings
that words have too, where the excess is of words. Short tokens, which the tests can hardly tell, so get a
higher threshold than long ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .util import cut, unused

#: The patterns of the base. Matches are taken leftmost and not overlapping, then tested for length.
ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Maximal runs, so asking for 16 in the pattern finds the same as dropping shorter runs afterwards, at less cost.
HEX = r"[0-9a-f]{16,}"
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
#: Candidates of the battery: maximal runs of the characters of base64 and its variants.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Encodings as (kind, what the whole token matches, what must occur in it, alphabet), first match counts.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("random16", "^[0-9A-F]+$", ("[0-9]", "[A-F]"), DIGITS + "ABCDEF"),
    ("random32", "^[A-Z2-7]+$", ("[2-7]", "[A-Z]"), UPPER + "234567"),
    ("random36", "^[a-z0-9]+$", ("[0-9]", "[g-z]"), DIGITS + LOWER),
    ("random64", "^[A-Za-z0-9+/]+$", ("[0-9]", "[A-Z]", "[a-z]"), UPPER + LOWER + DIGITS + "+/"),
    ("random36u", "^[A-Z0-9]+$", ("[0-9]", "[A-Z]"), DIGITS + UPPER),
    ("random26", "^[a-z]+$", (), LOWER),
    ("random26u", "^[A-Z]+$", (), UPPER),
    ("random52", "^[A-Za-z]+$", (), UPPER + LOWER),
    ("random64any", "^[A-Za-z0-9+/]+$", (), UPPER + LOWER + DIGITS + "+/"),  # the rest, so that no token leaves untested
)
#: Encodings that words, identifiers and paths have too, and the letters that make up most of words in Latin script.
WORDED, COMMON = ("random26", "random26u", "random52", "random64any"), "aeinorst"
#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", *(e[0] for e in ENCODINGS))
#: Steps in which p is counted for the thresholds.
BINS = 200
#: Least p that is accepted on the strength of chance alone, and the deviations and tokens that chance may explain.
FLOOR, DEVIATIONS, FEW = 0.02, 1.645, 3.0


def _spans(text: Column, pattern: str, long_enough: Column | None = None) -> Column:
    """Array of (start, end, token) of all matches, in code points; ``long_enough``, an array of booleans a match, drops.

    The pieces between the matches give the places: ends are running sums of piece and match lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,token:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["1"])
        end = start + F.length(x["0"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["0"].alias("token"))).alias("out"))

    parts = F.zip_with(found, F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda m, g: F.struct(m.alias("0"), g.alias("1")))
    all_spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    if long_enough is not None:
        all_spans = F.transform(F.filter(F.arrays_zip(all_spans.alias("s"), long_enough.alias("ok")), lambda x: x["ok"]), lambda x: x["s"])
    return F.when(F.size(found) > 0, all_spans).otherwise(empty)


def _two_sided(z: Column) -> Column:
    """Share of a normal beyond +-z (Abramowitz and Stegun 7.1.26), 1e-12 at least."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(F.least(poly * F.exp(-x * x), F.lit(1.0)), F.lit(1e-12))


def battery(tokens: Column) -> Column:
    """For an array of (start, end, token): each as (start, end, kind, band, p).

    ``band`` is the binary logarithm of the length; p the combined p value of uniform randomness.
    """

    def encoding(token: Column) -> Column:
        out = None
        for kind, whole, parts, alphabet in ENCODINGS:
            fits = reduce(lambda a, b: a & b, [token.rlike(x) for x in (whole, *parts)])
            value = F.struct(F.lit(kind).alias("kind"), F.lit(alphabet).alias("alphabet"))
            out = F.when(fits, value) if out is None else out.when(fits, value)
        return out

    def common(token: Column) -> Column:  # deviations from the share that uniformly random letters have of these
        letters, share = F.length(F.regexp_replace(token, "[^A-Za-z]", "")), len(COMMON) / 26
        hits = F.length(token) - F.length(F.translate(token, COMMON + COMMON.upper(), ""))
        return (hits - letters * share) / F.sqrt(F.greatest(letters, F.lit(1)) * share * (1 - share))

    url = lambda c: F.translate(c, "-_", "+/")
    a = F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), url(t["token"]).alias("token")))
    a = F.transform(a, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), encoding(t["token"]).alias("e")))
    a = F.transform(a, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["e"]["kind"].alias("kind"), F.length(t["e"]["alphabet"]).cast("double").alias("a"), F.length(t["token"]).alias("n"),
        F.when(t["e"]["kind"].isin(*WORDED), common(t["token"])).alias("common"),
        F.transform(F.split(t["token"], ""), lambda c: (F.call_function("instr", t["e"]["alphabet"], c) - 1).cast("double")).alias("v"),
    ))

    def tests(t: Column) -> Column:
        v, n, size = t["v"], t["n"].cast("double"), t["a"]
        squares = F.aggregate(F.sequence(F.lit(0), size.cast("int") - 1), F.lit(0.0), lambda acc, k: acc + F.pow(F.size(F.filter(v, lambda x: x == k)).cast("double"), F.lit(2.0)))
        uniform = (squares * size / n - n - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        high = F.transform(v, lambda x: F.when(x * 2 >= size, F.lit(1.0)).otherwise(F.lit(0.0)))
        n1 = F.aggregate(high, F.lit(0.0), lambda acc, x: acc + x)
        pairs = lambda x, f: F.zip_with(F.slice(x, F.lit(1), t["n"] - 1), F.slice(x, F.lit(2), t["n"] - 1), f)
        runs = 1 + F.aggregate(pairs(high, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda acc, x: acc + x)
        middle = (size - 1) / 2
        lag = F.aggregate(pairs(v, lambda x, y: (x - middle) * (y - middle)), F.lit(0.0), lambda acc, x: acc + x)
        return F.struct(
            *[t[c].alias(c) for c in ("start", "end", "kind", "n")], uniform.alias("uniform"), runs.alias("runs"), n1.alias("n1"),
            (lag / ((size * size - 1) / 12) / F.sqrt(n - 1)).alias("serial"), t["common"].alias("common"),
        )

    def combined(t: Column) -> Column:
        n, n1 = t["n"].cast("double"), t["n1"]
        mean = 2 * n1 * (n - n1) / n
        sd = F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(1e-9)))
        half = -(F.log(_two_sided(t["uniform"])) + F.log(_two_sided((t["runs"] - 1 - mean) / sd)) + F.log(_two_sided(t["serial"])))
        half = half - F.coalesce(F.log(_two_sided(t["common"])), F.lit(0.0))
        return F.struct(*[t[c].alias(c) for c in ("start", "end", "kind")], F.floor(F.log2(n)).cast("int").alias("band"), half.alias("half"), t["common"].isNotNull().alias("four"))

    def p_value(t: Column) -> Column:  # Fisher: chi-squared of six (four tests: eight) degrees of freedom, beyond twice ``half``
        fourth = F.when(t["four"], F.pow(t["half"], F.lit(3.0)) / 6).otherwise(F.lit(0.0))
        return F.struct(*[t[c].alias(c) for c in ("start", "end", "kind", "band")], (F.exp(-t["half"]) * (1 + t["half"] + t["half"] * t["half"] / 2 + fourth)).alias("p"))

    return F.transform(F.transform(F.transform(a, tests), combined), p_value)


def thresholds(scanned: DataFrame, fdr: float = 0.05, col: str = "candidates") -> dict[tuple[str, int], float]:
    """Least accepted p by (kind, band). Counts come from all candidates; a row a stratum and bin reaches the driver, at
    most 9 encodings x 32 bands x BINS whatever the corpus holds."""
    c = scanned.select(F.explode(col).alias("c")).select("c.kind", "c.band", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    counts: dict = {}
    for r in c.groupBy("kind", "band", "bin").count().collect():
        counts.setdefault((r["kind"], r["band"]), {})[r["bin"]] = r["count"]
    out = {}
    for stratum, bins in counts.items():
        best = _least(bins, fdr, stratum[0] not in WORDED)
        if best is not None:
            out[stratum] = best
    return out


def _least(bins: dict[int, int], fdr: float, allowing: bool = True) -> float | None:
    """Least accepted p of a stratum of ``bins`` (bin: tokens), None where it holds none to accept.

    The count above 0.5 and that below differ by chance even if all are random; where that is allowed for, the allowance
    is the upper 95 % of it.
    """
    upper = sum(n for b, n in bins.items() if 2 * b >= BINS)
    chance = DEVIATIONS * (2 * upper) ** 0.5 + FEW if allowing else 0.0
    accepted, best = 0, None
    for b in range(BINS - 1, -1, -1):
        accepted += bins.get(b, 0)
        false = accepted - 2 * upper * (1 - b / BINS)
        if accepted and false - (chance if b >= FLOOR * BINS else 0.0) <= fdr * accepted:
            best = b / BINS
    return best


def scan(docs: DataFrame, text_col: str = "text", out: str = "secrets", fdr: float = 0.05, keep_text: bool = True) -> DataFrame:
    """``docs`` (without its text unless ``keep_text``) with a struct ``out``: base and all, arrays of (start, rank, end, kind) in order of start, then kind.

    ``base`` holds what the fixed patterns find; ``all`` adds random tokens that no base span touches. Null texts count
    as empty. Every row stays, equal rows alike, other columns pass through; ``docs`` is materialised once with its spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    name = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    base = F.array_sort(F.concat(
        name(_spans(text, ASSIGN, F.transform(values, lambda v: F.length(v) >= ASSIGN_CHARS)), "assign"),
        name(F.filter(_spans(text, ACCESS), lambda s: s["end"] - s["start"] >= ACCESS_CHARS), "access"),
        name(_spans(text, HEX), "hex"),
    ))
    base_, tokens, candidates = unused(docs, "_base", "_tokens", "_candidates")
    found = docs.withColumn(base_, base).withColumn(tokens, _spans(text, TOKEN))
    free = F.filter(tokens, lambda t: ~F.exists(base_, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    found = found.withColumn(candidates, battery(free)).drop(tokens, *[] if keep_text else [text_col])
    return _decide(cut(found), fdr, out, base_, candidates)


def _decide(found: DataFrame, fdr: float, out: str, base: str, candidates: str) -> DataFrame:
    least = thresholds(found, fdr, candidates)
    limit = None
    for (kind, band), p in sorted(least.items()):
        one = lambda c, kind=kind, band=band: (c["kind"] == kind) & (c["band"] == band)
        limit = [*(limit or []), (one, p)]

    def accepted(c: Column) -> Column:
        return reduce(lambda a, b: a | b, [f(c) & (c["p"] >= p) for f, p in limit]) if limit else F.lit(False)

    rank = F.create_map(*[F.lit(x) for pair in ((k, i) for i, k in enumerate(KINDS)) for x in pair])
    more = F.transform(F.filter(candidates, accepted), lambda c: F.struct(c["start"].alias("start"), F.element_at(rank, c["kind"]).alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")))
    both = F.struct(F.col(base).alias("base"), F.array_sort(F.concat(base, more)).alias("all"))
    return found.withColumn(out, both).drop(base, candidates)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (overlapping ones as one) replaced by ``mark``; null stays null."""

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
