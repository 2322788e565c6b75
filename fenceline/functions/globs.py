"""Globs as regular expressions, so that a filter on a path stays in the JVM and is pushed to the scan of names."""

from __future__ import annotations

import re


def path_glob(glob: str) -> str:
    """A glob over paths: * and ? stay inside a directory, ** crosses, {a,b} are choices, [..] classes."""
    return _translate(glob, crossing=False)


def name_glob(glob: str) -> str:
    """A glob over whole names, as shells match file names: * and ? match slashes too."""
    return _translate(glob, crossing=True)


def _translate(glob: str, crossing: bool) -> str:
    out, i, depth = [], 0, 0
    star, any_one = (".*", ".") if crossing else ("[^/]*", "[^/]")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/") and not crossing:
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(star)
        elif c == "?":
            out.append(any_one)
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", r"\\") + "]")
            i = end
        elif c == "{" and not crossing:
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def split_rules(globs: list[str]) -> tuple[list[str], list[str]]:
    """(deny, allow) of ignore globs as expressions; a leading ! allows. A glob that is no expression matches nothing."""
    deny, allow = [], []
    for g in globs:
        try:
            re.compile(x := name_glob(g[1:] if g.startswith("!") else g))
        except re.error:
            continue
        (allow if g.startswith("!") else deny).append(x)
    return deny, allow
