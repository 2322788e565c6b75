"""Constant references and definitions in Ruby files.

A pushdown lexer goes through one text: its stack of modes holds what the text is inside of (code, a string that code may
stand in, a here-document, a brace), so code in strings in code is read to any depth. A flat pass over its tokens gives
events with the scope (class or module) they stand in. All that follows from events (which scopes are definitions, class names of
associations, what is local to a file, the meaning of a name) is column expressions and joins.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names

# Words of the language.
OPENERS = frozenset("class module def begin case do if unless while until for".split())
LOOPS = frozenset("while until for".split())
CONDITIONS = frozenset("if unless while until rescue".split())
VALUES = frozenset("end self true false nil redo retry return break next super yield __FILE__ __LINE__ __dir__".split())
KEYWORDS = OPENERS | CONDITIONS | VALUES | frozenset("alias and BEGIN defined? else elsif ensure END in not or then undef when".split())
SENT = frozenset("+ - * / % ** == != === =~ !~ <=> < > <= >= << >> & | ^ !".split())
ASSIGNS = frozenset("= += -= *= /= %= **= ||= &&= |= &= ^= <<= >>=".split())
CLOSERS = {"(": ")", "[": "]", "{": "}", "<": ">"}
ASSOCIATIONS = ("belongs_to", "has_many", "has_one", "has_and_belongs_to_many")
#: Calls that change nothing of what a class or module does.
QUIET = frozenset({"private_constant"})

SCHEMA = "kind string, name string, namespace array<string>, line long, col long, end_line long, end_col long, scope long, own long, kept long"


class Event(NamedTuple):
    """What a text holds at a place. kind: reference, definition, association, or behaviour (of the scope). Lines count from 1, columns
    from 0 in bytes; the end column is that after the last character, from 1. ``scope`` is the class or module that it
    stands in (0: the file), ``own`` the one that a definition opens (null: a constant is assigned). A name that is also a
    superclass of a class around is meant as there: ``kept`` is how many of the namespaces that leaves (null: all)."""

    kind: str
    name: str
    namespace: list[str]
    line: int
    col: int
    end_line: int
    end_col: int
    scope: int
    own: int | None
    kept: int | None = None


class Token(NamedTuple):
    """kind: newline, word, label, const, value (number, variable, string), symbol, mark. ``begins``: an operand may begin here;
    ``spaced``: white space stands before it; ``depth``: modes and brackets around it."""

    kind: str
    text: str
    start: int
    end: int
    begins: bool
    spaced: bool
    depth: int


_code = re.compile(
    r"""(?P<space>[ \t\r\f\v]+|\\\r?\n)|(?P<newline>\n)|(?P<comment>\#[^\n]*)
    |(?P<heredoc><<(?P<dash>[~-]?)(?P<quote>["'`]?)(?P<tag>[^\W\d]\w*)(?P=quote))
    |(?P<number>0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?[ri]*)
    |(?P<const>(?:::)?[A-ZÀ-ÖØ-Þ]\w*(?:::[A-ZÀ-ÖØ-Þ]\w*(?![\w]*[?!]?\())*)
    |(?P<word>[^\W\dA-ZÀ-ÖØ-Þ]\w*(?:[?!](?![=~])|[?!](?===|=~|=>))?)
    |(?P<variable>@@?\w+|\$(?:\w+|[^\s\w]))
    |(?P<symbol>:(?=")|:(?:[^\W\d]\w*[?!=]?(?![=~>])|[^\W\d]\w*|\[\]=?|[+\-*/%<>=!~^&|]+))
    |(?P<quoted>["'`])
    |(?P<percent>%(?P<form>[wWiIqQrsx]?)(?P<opens>[^\w\s=]))
    |(?P<slash>/)
    |(?P<mark><=>|===|\*\*=|\|\|=|&&=|<<=|>>=|\.\.\.|==|=~|!~|!=|<=|>=|&&|\|\||\*\*|[-+*/%|&^]=|<<|>>|&\.|->|=>|\.\.|::|[-+*/%<>=!~^&|?:.,;(){}\[\]])
    |(?P<other>.)""",
    re.X | re.S,
)
_def_name = re.compile(r"\s*(?:(?P<on>self|[A-Z]\w*(?:::[A-Z]\w*)*|\w+)\s*\.\s*)?(?P<name>[^\W\d]\w*(?:[?!]|=(?=\())?|[^\s\w(;]+)")
_endless = re.compile(r"\s*(?:\([^)\n]*\))?\s*=(?![=~>])")


class _Mode(NamedTuple):
    """What the lexer is inside of. ``closes`` ends it; ``opens`` is what nests in it; ``code``: whether it may hold ``#{}``."""

    kind: str  # code, brace, inner (code in a string), string, heredoc
    closes: str = ""
    opens: str = ""
    code: bool = True
    start: int = 0
    symbol: bool = False


def tokens(text: str) -> Iterator[Token]:
    """The tokens of a text; a text that is no Ruby gives what looks like them."""
    modes, waiting, brackets = [_Mode("code")], [], 0
    pos, n = 0, len(text)
    begins, spaced, last = True, False, ("newline", "")
    pieces = False  # the open string holds code

    def token(kind: str, value: str, start: int, end: int, then: bool) -> Token:
        nonlocal begins, spaced, last
        t = Token(kind, value, start, end, begins, spaced, len(modes) + brackets)
        begins, spaced, last = then, False, (kind, value)
        return t

    while pos < n:
        mode = modes[-1]
        if mode.kind == "heredoc":
            end = re.compile(mode.closes, re.M).search(text, pos)
            inner = _inner(text, pos, end.start() if end else n) if mode.code else -1
            if inner >= 0:
                modes.append(_Mode("inner"))
                pos, begins = inner, True
                continue
            pos = end.end() if end else n
            modes.pop()
            begins, last = True, ("newline", "")
            continue
        if mode.kind == "string":
            deep = 0
            while pos < n:
                c = text[pos]
                if c == "\\":
                    pos += 2
                elif mode.code and text.startswith("#{", pos):
                    break
                elif c == mode.closes and not deep:
                    break
                else:
                    deep += (c == mode.opens) - (c == mode.closes and deep > 0) if mode.opens else 0
                    pos += 1
            if text.startswith("#{", pos) and mode.code and pos < n and text[pos] != mode.closes:
                modes.append(_Mode("inner"))
                pos, begins, pieces = pos + 2, True, True
                continue
            modes.pop()
            body = "" if pieces else text[mode.start : pos]
            pieces, pos = False, pos + 1
            if mode.symbol:
                yield token("symbol", body, mode.start - 2, pos, False)
            elif text.startswith(":", pos) and not text.startswith("::", pos) and mode.closes in "\"'":
                pos += 1
                yield token("label", body + ":", mode.start - 1, pos, True)
            else:
                yield token("value", body, mode.start - 1, pos, False)
            continue
        if last[0] == "newline" and (text.startswith("=begin", pos) or text.startswith("__END__", pos)) and (pos == 0 or text[pos - 1] == "\n"):
            end = re.compile(r"^=end\b[^\n]*", re.M).search(text, pos) if text[pos] == "=" else None
            pos = end.end() if end else n
            continue
        m = _code.match(text, pos)
        kind, value, start = m.lastgroup, m[0], pos
        kind = {"dash": "heredoc", "quote": "heredoc", "tag": "heredoc", "form": "percent", "opens": "percent"}.get(kind, kind)
        # an operator, or the beginning of a literal after a word that takes it as an argument
        literal = begins or (last[0] == "word" and spaced and m.end() < n and not text[m.end()].isspace())
        pos = m.end()
        if kind in ("space", "comment", "other"):
            spaced = spaced or kind == "space"
        elif kind == "newline":
            yield token("newline", "\n", start, pos, True)
            modes += [_Mode("heredoc", closes, code=code) for closes, code in reversed(waiting)]
            waiting = []
        elif kind == "heredoc":
            if begins or (last[0] == "word" and spaced):
                waiting.append((rf"^{'[ ]*[\t ]*' if m['dash'] else ''}{m['tag']}$", m["quote"] != "'"))
                yield token("value", "", start, pos, False)
            else:
                pos = start + 2
                yield token("mark", "<<", start, pos, True)
        elif kind in ("quoted", "slash", "percent") and (kind == "quoted" or literal):
            opens = m["opens"] if kind == "percent" else value
            raw = value == "'" or (kind == "percent" and m["form"] in ("w", "i", "q", "s"))
            modes.append(_Mode("string", CLOSERS.get(opens, opens), opens if opens in CLOSERS else "", not raw, pos))
            pieces = kind != "quoted"  # its text stands for no name
        elif kind in ("slash", "percent"):
            pos = start + 1
            yield token("mark", text[start], start, pos, True)
        elif kind == "symbol" and value == ":" and (begins or spaced):
            modes.append(_Mode("string", '"', start=pos + 1, symbol=True))
            pos += 1
        elif kind == "symbol" and not (begins or spaced or last[1] in ("(", "[", "{", ",")):
            pos = start + 1
            yield token("mark", ":", start, pos, True)
        elif kind == "symbol":
            yield token("symbol", value[1:], start, pos, False)
        elif kind in ("number", "variable"):
            yield token("value", value, start, pos, False)
        elif kind in ("word", "const") and text.startswith(":", pos) and not text.startswith("::", pos) and not value.startswith("::") and last[1] not in (".", "&.", "?"):
            pos += 1
            yield token("label", value + ":", start, pos, True)
        elif kind == "word":
            if value == "def" and last[1] not in (".", "&."):
                yield token("word", value, start, pos, True)
                if d := _def_name.match(text, pos):
                    pos = d.end()
                    if (on := d["on"]) and on[0].isupper():
                        yield token("const", on, d.start("on"), d.end("on"), False)
                    yield token("endless" if _endless.match(text, pos) else "defined", d["name"], d.start("name"), pos, False)
                continue
            known = value in KEYWORDS and last[1] not in (".", "&.")
            yield token("word", value, start, pos, known and value not in VALUES)
        elif kind == "const":
            yield token("const", value, start, pos, False)
        else:
            inner = value == "}" and mode.kind == "inner"
            if value == "{":
                modes.append(_Mode("brace"))
            elif value == "}" and len(modes) > 1:
                modes.pop()
            if inner:
                begins, pieces = False, True
                continue
            brackets += (value in "([") - (value in ")]") if len(value) == 1 else 0
            yield token("mark", value, start, pos, value not in (")", "]", "}"))


def _inner(text: str, start: int, stop: int) -> int:
    """Where code begins in a string's text, or -1."""
    pos = start
    while (pos := text.find("#{", pos, stop)) >= 0:
        before = len(text[:pos]) - len(text[:pos].rstrip("\\"))
        if before % 2 == 0:
            return pos + 2
        pos += 2
    return -1


def scan(text: str, associations: tuple[str, ...] = ASSOCIATIONS) -> list[Event]:
    """The events of a text, in order of where they are known."""
    out: list[Event] = []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    plain = text.isascii()
    spaces: list[list[str]] = [[]]  # names around, of every scope
    scopes, blocks = [0], []  # scopes that are open; blocks that wait for their end: the scope they close, or None
    active: set[int] = set()
    above: dict[int, set[str]] = {}  # names of superclasses, of classes
    local: set[str] = set()
    pending, header, loop, params, closed = "", None, False, False, ""
    call: dict | None = None
    last = before = Token("newline", "\n", 0, 0, True, False, 1)

    def place(at: int) -> tuple[int, int]:
        line = bisect_right(starts, at)
        from_ = starts[line - 1]
        return line, at - from_ if plain else len(text[from_:at].encode())

    def put(kind: str, name: str, start: int, end: int, scope: int, own: int | None = None) -> None:
        (line, col), (end_line, end_col) = place(start), place(end)
        like = next((c for c in scopes if name in above.get(c, ())), None) if kind == "reference" else None
        out.append(Event(kind, name, spaces[scope], line, col, end_line, end_col + 1, scope, own, None if like is None else len(spaces[like]) - 1))

    def finish() -> None:
        nonlocal call
        if call and (call["class"] or call["first"]):
            put("reference" if call["class"] else "association", call["class"] or call["first"], call["start"], call["end"], call["scope"])
        call = None

    for t in tokens(text):
        kind, value = t.kind, t.text
        follows = last.text in (".", "&.") and last.kind == "mark"
        if header is not None and (kind == "newline" or (value == ";" and kind == "mark") or (kind == "word" and value == "end" and not follows)):
            scopes.append(header)  # the class's own text begins after its first line
            header = None
        if call and (kind == "newline" or value == ";" or (kind == "word" and value in ("if", "unless", "do", "end"))) and t.depth <= call["depth"] and last.text not in (",", "=>", "(") and last.kind != "label":
            finish()
        if pending and (kind != "const" or last.text != pending):  # of a name that only running the code would tell
            blocks.append(None)
            pending = ""
        scope = scopes[-1]
        acts = False
        if kind == "newline":
            loop = False
            if last.kind != "newline":
                last, before = t, last
            continue
        if call:
            call["end"] = t.end
        if params and value not in closed:
            if kind == "word":
                local.add(value)
        elif kind == "mark":
            if params:
                params = False
            elif value == "->":  # its parameters go up to its body
                params, closed = True, ("{", "do")
            elif value == "|" and last.text in ("{", "do"):
                params, closed = True, ("|",)
            elif value in SENT and (value == "!" or not t.begins) and not (value == "<" and header is not None):
                acts = True
            elif value in ASSIGNS and last.kind == "word" and before.text not in (".", "&."):
                local.add(last.text)
        elif kind == "word":
            params = False
            if follows:
                acts = last.text == "."
            elif value in ("class", "module") and t.begins:
                pending = value
                if re.match(r"\s*<<", text[t.end : t.end + 40]):
                    blocks.append(None)
                    pending = ""
            elif value in OPENERS:
                if value == "do" and loop:
                    loop = False
                elif not (value in CONDITIONS and not t.begins) and last.text != "alias":
                    blocks.append(None)
                    loop = value in LOOPS
                acts = value == "def"
            elif value == "end":
                if blocks and (ended := blocks.pop()) is not None and ended in scopes:
                    del scopes[scopes.index(ended) :]
            elif value not in KEYWORDS and value not in QUIET and last.text not in ("alias", "undef") and not (before.text == "alias" and last.kind == "word"):
                following = re.match(r"[ \t]*([-+*/%|&^<>]{0,2}|\|\||&&|\*\*)=(?![=~>])", text[t.end : t.end + 40])
                acts = not following and value not in local
                if following:
                    local.add(value)
                if value in associations:
                    finish()
                    call = {"start": t.start, "end": t.end, "first": "", "class": "", "scope": scope, "depth": t.depth, "args": 0}
                    acts, last, before = True, t, last
                    active.add(scope)
                    continue
        elif kind == "endless" and blocks:
            blocks.pop()
        elif kind == "symbol" and call and last.end == call["start"] + len(text[call["start"] : last.end]) and (last.kind == "word" or last.text == "(") and not call["args"]:
            call["first"] = value
        elif kind == "value" and call and last.text in ("class_name:", "=>") and text[t.start] in "'\"" and value and (last.text != "=>" or before.text == "class_name") and _beside(t, call):
            call["class"] = value
        elif kind == "const":
            name, end = value, t.end
            called = text.startswith("(", t.end) or follows
            if pending and last.text == pending and last.kind == "word":
                own = len(spaces)
                full = name.removeprefix("::")
                put("definition", name if name.startswith("::") else "::" + "::".join([*spaces[scope], name]), t.start, end, scope, own)
                spaces.append([*spaces[scope], full])
                blocks.append(own)
                pending, header = "", own
            elif called:
                acts = last.text != "&."
                if not follows and (up := name.rpartition("::")[0]):
                    put("reference", up, t.start, t.start + len(up), scope)
            elif value.startswith("::") and not t.begins and not t.spaced:
                pass  # of what is no constant: the name is not known
            elif t.begins and re.match(r"[ \t]*(\|\|)?=(?![=~>])", text[t.end : t.end + 40]):
                put("definition", "::" + "::".join([*spaces[scope], name.removeprefix("::")]), t.start, end, scope)
            else:
                if call and last.text in ("class_name:", "=>") and (last.text != "=>" or before.text == "class_name") and re.match(r"\.name\b", text[end : end + 6]) and _beside(t, call):
                    call["class"] = name
                if header is not None:
                    above.setdefault(header, set()).add(name)
                put("reference", name, t.start, end, scope)
        if call and kind != "mark" and last.start >= call["start"] and not (kind == "symbol" and call["first"] == value):
            call["args"] += 1
        if acts:
            active.add(scope)
        last, before = t, last
    finish()
    for scope in sorted(active):
        out.append(Event("behaviour", "", spaces[scope], 0, 0, 0, 0, scope, None))
    return out


def _beside(t: Token, call: dict) -> bool:
    """Whether a token is an argument of the call itself and not of what stands in its arguments."""
    return t.depth <= call["depth"] + 1


#: Tasks a core that sources are dealt to.
TASKS = 4


def parse(sources: DataFrame, associations: tuple[str, ...] = ()) -> DataFrame:
    """(path, and the fields of Event) of ``sources(path, kind, text)``; templates give their code's references at 0:0. In spec
    files nothing counts as behaviour. Null texts give nothing."""
    known = (*ASSOCIATIONS, *associations)
    code = F.when(F.col("kind") == "erb", names.template_code(F.col("text"))).otherwise(F.col("text"))
    fields = list(Event._fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *e) for path, text in zip(b["path"], b["code"]) for e in scan(text or "", known)]
            out = pd.DataFrame(rows, columns=["path", *fields])
            yield out.assign(own=out["own"].astype("Int64"), kept=out["kept"].astype("Int64"))

    # dealt by path first: texts of a few MB may be one split, and a scan takes far longer than the reading
    dealt = sources.select("path", code.alias("code")).repartition(TASKS * sources.sparkSession.sparkContext.defaultParallelism, "path")
    out = dealt.mapInPandas(run, "path string, " + SCHEMA)
    quiet = F.col("path").contains("_spec.rb") | F.col("path").contains("/spec/")
    out = out.where(~(quiet & (F.col("kind") == "behaviour")))
    template = F.col("path").endswith(".erb")
    return out.select(*[F.when(template, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) if c in ("line", "col", "end_line", "end_col") else F.col(c) for c in out.columns])


def unresolved(parsed: DataFrame, acronyms: list[str] | None = None, definition_mode: bool = False) -> DataFrame:
    """References (ref_id, path, name, namespace, line, col, end_line, end_col); an association refers to the class its name stands for. A
    namespace of a reference's own name is no place to look for it.

    By path convention, references to what their own file defines leave: a definition of A::B defines A too, and the
    first place of a name in a file counts. The last candidate of a reference that the file defines decides. A
    definition is a reference to itself where it stands at that first place; one that opens a name again is local. In
    definition mode every reference stays and definitions are none.
    """
    name = F.when(F.col("kind") == "association", names.class_case(F.col("name"), acronyms)).otherwise(F.col("name"))
    around = F.when(F.col("kind") == "reference", F.filter("namespace", lambda n: n != name)).otherwise(F.col("namespace"))
    if not definition_mode:
        around = F.when(F.col("kept").isNotNull(), F.slice("namespace", F.lit(1), F.col("kept").cast("int"))).otherwise(around)
    rows = parsed.where("kind <> 'behaviour'").withColumn("namespace", around).withColumn("name", name)
    columns = ("path", "name", "namespace", "line", "col", "end_line", "end_col")
    number = F.xxhash64("path", "line", "col", "name", "kind").alias("ref_id")
    if definition_mode:
        return rows.where("kind <> 'definition'").select(number, *columns).distinct()
    here = F.struct("line", "col")
    outer = F.transform(names.nesting(F.split(F.regexp_replace("name", "^::", ""), "::")), lambda n: F.concat(F.lit("::"), n))
    first = rows.where("kind = 'definition'").select("path", F.explode(outer).alias("known"), here.alias("at")).groupBy("path", "known").agg(F.min("at").alias("at"))
    known = first.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("known", "at"))).alias("known"))
    rows = rows.join(known, "path", "left")
    hits = F.filter(names.candidates(F.col("name"), F.col("namespace")), lambda c: F.coalesce(F.map_contains_key("known", c), F.lit(False)))
    place = F.try_element_at("known", F.try_element_at(hits, F.lit(-1)))
    opens = (F.col("kind") == "definition") & F.col("own").isNotNull()
    kept = rows.where(F.when(F.col("kind") == "definition", opens & (place == here)).otherwise(place.isNull()))
    return kept.select(number, *columns).distinct()


def definitions(parsed: DataFrame) -> DataFrame:
    """constants(fq_name, defining_file) that files define in so many words: constants that are assigned, and classes and modules whose
    own text defines a method or calls one (``private_constant`` apart). One that only holds other classes, or is
    opened for its name's sake, defines nothing; templates define nothing."""
    found = parsed.where("kind = 'definition'").where(~F.col("path").endswith(".erb"))
    active = parsed.where("kind = 'behaviour'").select("path", F.col("scope").alias("own")).distinct()
    opened = found.where("own is not null").join(active, ["path", "own"], "left_semi")
    both = found.where("own is null").select("name", "path").unionByName(opened.select("name", "path"))
    return both.select(F.col("name").alias("fq_name"), F.col("path").alias("defining_file")).distinct()

