"""Source trees as tables. A tree is listed level by level: the directories of a level are dealt to tasks, what they hold is
filtered, and only directories that are not pruned make the next level. Contents are read in tasks, where they are asked for."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs, names
from ..operators.lineage import settled
from . import stores

# What is looked at, and directories that are not, unless configuration says otherwise.
INCLUDE = ("**/*.{rb,rake,erb}",)
EXCLUDE = ("{bin,node_modules,script,tmp,vendor}/**/*",)
PRUNED = ("node_modules/**/*", "vendor/**/*", "tmp/**/*", ".git/**/*", "public/**/*", "bin/**/*", "log/**/*", "sorbet/**/*")
#: Bytes of files that one task reads about.
READ_BYTES = 32 << 20
#: Directories that one task lists about.
DIRECTORIES_A_TASK = 64
#: Bytes of contents in one batch about; one file is never split.
BATCH_BYTES = 8 << 20


def tree(spark: SparkSession, root: str, pruned: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(path, size) of the files below ``root``, path relative, materialised. A directory that matches one of ``pruned`` is not looked
    into, so nothing below it is ever listed; files are pruned only with a directory above them. One round a level."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for d in b.column(0).to_pylist() for r in stores.children(root, d)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.bool_(), pa.int64()))], ["path", "folder", "size"])

    files, level, n = [], spark.createDataFrame([("",)], "path string"), 1
    while n:
        parts = 1 + (n - 1) // DIRECTORIES_A_TASK
        found = settled(level.repartition(parts, "path").mapInArrow(listed, "path string, folder boolean, size long"))
        files.append(found.where("not folder").select("path", "size"))
        level = found.where("folder").where(~_any(F.col("path"), pruned)).select("path")
        n = level.count()
    out = files[0]
    for f in files[1:]:
        out = out.unionByName(f)
    return out


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of ``files(path, size)`` below ``root``, read in tasks; files that are gone meanwhile leave."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, texts, size = [], [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                content = stores.read(root, path)
                if content is None:
                    continue
                paths.append(path)
                texts.append(content)
                size += len(content)
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])
                    paths, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.binary())], ["path", "content"])

    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return files.select("path").repartition(1 + total // READ_BYTES, "path").mapInArrow(read, "path string, content binary")


def _any(path, patterns: tuple[str, ...] | list[str]):
    hit = F.lit(False)
    for p in patterns:
        hit = hit | path.rlike(globs.path_glob(p))
    return hit


def included(files: DataFrame, include=INCLUDE, exclude=EXCLUDE) -> DataFrame:
    """Files that are included and not excluded. Pruning is of directories and the listing's (``tree``)."""
    p = F.col("path")
    return files.where(_any(p, include) & ~_any(p, exclude))


def parsable(files: DataFrame) -> DataFrame:
    """Files of a type that can be parsed."""
    return files.where(names.file_type(F.col("path")).isNotNull())


def sources(files: DataFrame) -> DataFrame:
    """(path, kind, digest, text) of files that can be parsed: templates as the code in them."""
    text = F.decode("content", "UTF-8")
    kind = names.file_type(F.col("path"))
    return files.withColumn("kind", kind).where("kind is not null").select("path", "kind", names.digest(F.col("content")).alias("digest"), text.alias("text"))


def override(sources_: DataFrame, path: str, text: str) -> DataFrame:
    """One file's text replaced, as when it comes from an editor and not from disk."""
    one = sources_.sparkSession.createDataFrame([(path, text)], "path string, text string").select("path", names.file_type(F.col("path")).alias("kind"), names.digest(F.col("text")).alias("digest"), "text")
    return sources_.join(one.select("path"), "path", "left_anti").unionByName(one)


def expand(files: DataFrame, asked: list[str]) -> DataFrame:
    """Files asked for by name or by a directory above them."""
    hit = F.lit(False)
    for a in asked:
        hit = hit | (F.col("path") == a.rstrip("/")) | F.col("path").startswith(a.rstrip("/") + "/")
    return files.where(hit)


def public_files(sources_: DataFrame, definition_mode: bool = False) -> DataFrame:
    """Paths of files that carry the public mark in their first lines; of a template these are lines of its code. In definition
    mode templates carry none."""
    template = F.col("kind") == "erb"
    text = F.when(template, names.template_code(F.col("text"))).otherwise(F.col("text"))
    return sources_.where(~(template & F.lit(definition_mode)) & (names.public_marks(text) > 0)).select("path")


def acronyms(text: str | None) -> list[str]:
    """Acronyms of an inflections file, one small text: the second piece of each line that names one."""
    pieces = (re.split(r"['\"\\]", line) for line in (text or "").split("\n") if ".acronym" in line)
    return sorted({p[1] for p in pieces if len(p) > 1 and p[1]})
