"""Commands over a source tree: python -m fenceline.cli [--root DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import baseline, graph, resolve, rules, usage
from .operators.lineage import settled
from .plans import commands, moves
from .plans.project import CONFIG_FILES, Project, open_project
from .sources import files as trees
from .sources import packages as package_files
from .sources import ruby, sinks
from .sources.cache import drop_cache


def _lines(df: DataFrame, *cols: str) -> list[str]:
    """Sorted lines of a result that a person reads."""
    return [" ".join(str(r[c]) for c in cols) for r in df.select(*cols).distinct().orderBy(*cols).toLocalIterator()]


def _check(p: Project, args) -> tuple[Iterable[str], int]:
    files = p.paths if not args.files else usage.intersect_files(p.paths, trees.expand(p.paths, args.files))
    result = commands.check(p.refs, p.packages, p.recorded, p.world, files, args.ignore_recorded, p.public_files, tuple(args.disable or ()))
    if args.json:
        pieces, well = commands.document(result)
        return _document(p, pieces, args.output), int(not well)
    rows = settled(commands.report_lines(result))
    bad = not rows.where("line <> 'No violations detected!'").isEmpty()
    return _rows(rows.orderBy("part", "line")), int(bad)


def _rows(rows: DataFrame) -> Iterator[str]:
    """The last column of sorted rows, as they come: a partition of them is here at a time."""
    for r in rows.toLocalIterator():
        yield r[-1]


def _document(p: Project, pieces: list, output: str | None) -> Iterable[str]:
    """A document of ``pieces``, written by tasks to a file below the root, or streamed to the screen."""
    if output:
        sinks.write_document(p.sources.sparkSession, p.root, output, pieces)
        return [f"Written to {output}"]

    def stream() -> Iterator[str]:
        for piece in pieces:
            if isinstance(piece, str):
                yield piece
                continue
            rows, separator = piece
            for k, text in enumerate(_rows(rows)):
                yield separator + text if k else text

    return Whole(stream())


class Whole:
    """Pieces of one text, to be printed without anything between them."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces = pieces

    def __iter__(self) -> Iterator[str]:
        return iter(self.pieces)


def _references(p: Project, args) -> tuple[Iterable[str], int]:
    """What each file refers to: its constants and their files, as text or as one JSON map, to the screen or to a file."""
    if args.json:
        return _document(p, commands.references_document(p.refs), args.output), 0
    rows = commands.references_lines(p.refs)
    return (_document(p, [(rows, "\n"), "\n"], args.output) if args.output else _rows(rows)), 0


def _validate(p: Project, args) -> tuple[list[str], int]:
    rows = graph.validate(p.packages, p.edges, p.world).orderBy("error_type", "message").collect()
    if args.json:
        return [json.dumps(r.asDict()) for r in rows], int(bool(rows))
    return [r["message"] for r in rows] or ["Packages are valid"], int(bool(rows))


def _update(p: Project, args) -> tuple[list[str], int]:
    """Record what check would report: of all files, or merged into the record of the files or their whole packages that are asked for."""
    if args.whole_packages and not args.files:
        raise SystemExit("--whole-packages needs files")
    files = None
    if args.files:
        files = usage.intersect_files(p.paths, trees.expand(p.paths, args.files))
        if args.whole_packages:
            files = usage.expand_to_packages(p.owners, files).select("path")
    scope = commands.Scope(files, args.constant, args.type, args.package)
    out = commands.update(p.refs, p.packages, p.record, p.world, scope, p.public_files, tuple(args.disable or ()))
    new, strict = settled(out.record), settled(rules.strict_messages(out.strict))
    stats = baseline.update_stats(p.record, new).first().asDict()
    sinks.write_records(new, args.root, None if scope.narrow() else p.record)
    lines = [r["message"] for r in strict.orderBy("message").toLocalIterator()]
    if lines:
        lines.append(f"{len(lines)} strict mode violation(s) detected. These violations must be fixed for `check` to succeed.")
    said = {"violations_added": "violation(s) added", "violations_removed": "violation(s) removed", "files_changed": "file(s) modified", "files_added": "file(s) added", "files_deleted": "file(s) deleted"}
    parts = [f"{stats[k]} {v}" for k, v in said.items() if stats[k]]
    name = package_files.RECORD_FILE
    return [*lines, f"Successfully updated {name} files: {', '.join(parts)}" if parts else f"No changes to {name} files."], 0


def _unnecessary(p: Project, args) -> tuple[list[str], int]:
    out = [f"{a} -> {b}" for a, b in (x.split(" ") for x in _lines(usage.unnecessary_dependencies(p.edges, p.refs), "from_package", "to_package"))]
    return out or ["No unnecessary dependencies"], int(bool(out))


def _dependents(p: Project, args) -> tuple[list[str], int]:
    implicit = usage.implicit_dependents(p.recorded, args.package)
    return ["Explicit:", *_lines(usage.dependents(p.edges, args.package), "package"), "Implicit (violations):", *_lines(implicit, "referencing_package", "violation_type", "n_constants")], 0


def _rewrite(p: Project, args, edges: DataFrame) -> tuple[list[str], int]:
    """Write the package files whose edges changed."""
    old, new = p.edges.select("from_package", "to_package"), settled(edges)
    touched = new.exceptAll(old).unionByName(old.exceptAll(new)).select(F.col("from_package").alias("name")).distinct()
    changed = package_files.with_edges(p.packages, new).join(settled(touched), "name", "left_semi")
    return _lines(sinks.write_packages(changed, args.root), "package", "action") or ["Nothing to change"], 0


def _edge(p: Project, args) -> DataFrame:
    return p.sources.sparkSession.createDataFrame([tuple(args.files[:2])], "from_package string, to_package string")


def _lint(p: Project, args) -> tuple[list[str], int]:
    return _lines(sinks.write_packages(p.packages, args.root).unionAll(sinks.write_records(p.record, args.root)), "package", "action"), 0


def _suggest_all(p: Project, args) -> tuple[list[str], int]:
    want = usage.suggested_dependencies(p.refs, args.package).select(F.lit(args.package).alias("from_package"), F.col("package").alias("to_package"))
    return _rewrite(p, args, p.edges.where(F.col("from_package") != args.package).unionByName(want))


def _redefinitions(p: Project, args) -> tuple[Iterable[str], int]:
    """The report of what the application defines again. Its own definitions are the project's, so ignored ones do not count."""
    if not p.settings.definition_mode:
        raise SystemExit("list-redefinitions needs definition mode (experimental_parser: true)")
    found = p.constants.select("fq_name", F.col("defining_file").alias("path"))
    for folder in (args.stdlib, args.gems):
        outside = ruby.definitions(ruby.parse(trees.sources(trees.contents(trees.tree(p.sources.sparkSession, folder), folder))))
        found = found.unionByName(outside.select("fq_name", F.concat(F.lit(folder.rstrip("/") + "/"), "defining_file").alias("path")))
    out = usage.redefinitions(found, args.stdlib.rstrip("/") + "/", args.gems.rstrip("/") + "/")
    return _document(p, commands.redefinitions_document(out, args.stdlib, args.gems), args.output), 0


def _move(p: Project, args) -> tuple[Iterable[str], int]:
    """Move files, or all below a directory, to a package."""
    files = p.listed.select("path")
    done = moves.move(p.sources.sparkSession, p.root, files, trees.expand(files, args.files), p.packages, args.package)
    return ["=" * 100, "File Operations", *_rows(moves.lines(done))], 0


def _plan_move(p: Project, args) -> tuple[Iterable[str], int]:
    files = p.listed.select("path")
    return _lines(moves.steps(moves.plan(files, trees.expand(files, args.files), p.packages, args.package), files), "source", "destination", "action"), 0


COMMANDS = {
    "lint": _lint,
    "add-dependency": lambda p, a: _rewrite(p, a, usage.add_edges(p.edges, _edge(p, a))),
    "remove-dependency": lambda p, a: _rewrite(p, a, usage.remove_edges(p.edges, _edge(p, a))),
    "add-dependencies": _suggest_all,
    "update-dependencies-for-constant": lambda p, a: _rewrite(p, a, usage.add_edges(p.edges, usage.missing_edges_for_constant(p.refs, p.edges, p.packages, a.constant))),
    "remove-unnecessary-dependencies": lambda p, a: _rewrite(p, a, usage.remove_edges(p.edges, usage.unnecessary_dependencies(p.edges, p.refs))),
    "list-redefinitions": _redefinitions,
    "move": _move,
    "plan-move": _plan_move,
    "check": _check,
    "validate": _validate,
    "update": _update,
    "check-unnecessary-dependencies": _unnecessary,
    "list-dependents": _dependents,
    "suggest-dependencies": lambda p, a: (_lines(usage.suggested_dependencies(p.refs, a.package), "package"), 0),
    "missing-dependencies-for-constant": lambda p, a: (_lines(usage.missing_edges_for_constant(p.refs, p.edges, p.packages, a.constant), "from_package", "to_package"), 0),
    "list-packages": lambda p, a: ([r["name"] for r in p.packages.select("name").orderBy(F.length("name").desc(), "name").toLocalIterator()], 0),
    "list-included-files": lambda p, a: (_lines(p.paths, "path"), 0),
    "list-definitions": lambda p, a: (_lines(resolve.ambiguous(p.constants) if a.ambiguous else p.constants, "fq_name", "defining_file"), 0),
    "list-references": _references,
    "for-file": lambda p, a: (_lines(p.owners.where(F.col("path").isin(*a.files)), "path", "package"), 0),
}


def _below(path: str, root: str) -> str:
    """A path as the tree has it: relative to the root, also where it is given from the top or with a dot."""
    top = root.rstrip("/") if "://" in root else os.path.abspath(root)
    return path.removeprefix(top + "/").removeprefix("./")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fenceline")
    parser.add_argument("--root", default=".")
    parser.add_argument("command", choices=[*COMMANDS, "all", "check-contents", "create", "init", "delete-cache"])
    parser.add_argument("files", nargs="*")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--ignore-recorded", action="store_true")
    parser.add_argument("--ambiguous", action="store_true")
    parser.add_argument("--whole-packages", action="store_true", help="update: all files of the packages of the files asked for")
    parser.add_argument("--config", action="append", help="name of the configuration file; the first that is there counts")
    parser.add_argument("--disable", action="append", choices=[r.name for r in rules.RULES])
    for name in ("--package", "--constant", "--type", "--stdlib", "--gems", "--cache", "--output", "--faults"):
        parser.add_argument(name)
    args = parser.parse_intermixed_args(argv)  # files may stand after options
    args.files = [_below(f, args.root) for f in args.files]
    if args.command == "create":
        print(package_files.scaffold(args.root, args.files[0]))
        return 0
    configs = tuple(args.config or CONFIG_FILES)
    if args.command == "init":
        print("Created " + " and ".join(f"'{path}'" for path in package_files.init(args.root, configs[0])))
        return 0
    spark = SparkSession.builder.appName("fenceline").getOrCreate()
    if args.command == "delete-cache":
        if not args.cache:
            parser.error("delete-cache needs --cache")
        drop_cache(spark, args.cache)
        return 0
    replaced = (args.files[0], sys.stdin.read()) if args.command == "check-contents" else None
    for journal in moves.journals(args.root):
        print("\n".join(["Finishing an earlier move", *_rows(moves.lines(moves.finish(spark, args.root, journal)))]))
    project = open_project(spark, args.root, configs, replaced, args.cache, args.faults)
    code = 0
    for name in ("check", "validate") if args.command == "all" else ("check",) if replaced else (args.command,):
        lines, bad = COMMANDS[name](project, args)
        for line in lines:
            print(line, end="" if isinstance(lines, Whole) else "\n")
        if isinstance(lines, Whole):
            print()
        code |= bad
    return code


if __name__ == "__main__":
    sys.exit(main())
