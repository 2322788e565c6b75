"""Writing package files, records and documents below a root.

Package files and records are a data source of their own (``df.write.format(...)``): tasks write each file beside its place
under another name, as a stream; only when all tasks are done are the files moved into place, and if one fails nothing
is. A document of many rows is written by the tasks that hold its rows and put together by one task, as a stream.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.lineage import settled
from . import packages as texts
from . import stores

#: Text that a task holds before it writes it.
CHUNK = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote: (name so far, place) of every file, and files that are to go. Two names a package."""

    files: list[tuple[str, str]] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)


class _FileWriter(DataSourceWriter):
    """Files of rows that come sorted by file. ``pieces`` makes the texts of a file's rows, one after the other."""

    def __init__(self, options: dict):
        self.root, self.command = options["root"], options.get("command", "update")

    def place(self, row) -> str:
        raise NotImplementedError

    def pieces(self, rows: Iterator) -> Iterator[str]:
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Written:
        out, rows = Written(), iter(iterator)
        row = next(rows, None)
        try:
            while row is not None:
                place, held = self.place(row), row

                def same() -> Iterator:
                    nonlocal row
                    while row is not None and self.place(row) == place:
                        yield row
                        row = next(rows, None)

                if self.gone(held):
                    out.gone.append(place)
                    for _ in same():
                        pass
                    continue
                part = stores.part_name(place)
                out.files.append((part, place))
                stores.write(self.root, part, _chunks(self.pieces(same())))
        except BaseException:
            self._undo(out)
            raise
        return out

    def gone(self, row) -> bool:
        return False

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            for part, place in m.files if m else ():
                stores.move(self.root, part, place)
            for place in m.gone if m else ():
                stores.delete(self.root, place)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                self._undo(m)

    def _undo(self, m: Written) -> None:
        for part, _ in m.files:
            stores.delete(self.root, part)


def _chunks(pieces: Iterator[str]) -> Iterator[bytes]:
    held, size = [], 0
    for p in pieces:
        held.append(p)
        size += len(p)
        if size > CHUNK:
            yield "".join(held).encode()
            held, size = [], 0
    yield "".join(held).encode()


def _file(package: str, name: str) -> str:
    return name if package == "." else f"{package}/{name}"


class RecordWriter(_FileWriter):
    """Groups of a record sorted by package, defining package and constant. A row without a constant says that the package has no record."""

    def place(self, row) -> str:
        return _file(row["referencing_package"], texts.RECORD_FILE)

    def gone(self, row) -> bool:
        return row["constant_name"] is None

    def pieces(self, rows: Iterator) -> Iterator[str]:
        groups = (((r["referencing_package"]), (r["defining_package"], r["constant_name"], r["violations"], r["files"])) for r in rows)
        return texts.record_pieces(groups, self.command)


class PackageWriter(_FileWriter):
    """Packages (name, client_keys, dependencies), a row a file."""

    def place(self, row) -> str:
        return _file(row["name"], texts.PACKAGE_FILE)

    def pieces(self, rows: Iterator) -> Iterator[str]:
        for r in rows:
            raw = json.loads(r["client_keys"]) if r["client_keys"] else {}
            raw.pop("dependencies", None)
            if r["dependencies"]:
                raw["dependencies"] = list(r["dependencies"])
            yield texts.package_text(raw)


class RecordSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_records"

    def schema(self) -> str:
        return texts.RECORD_SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RecordWriter(dict(self.options))


class PackageSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "package_files"

    def schema(self) -> str:
        return "name string, client_keys string, dependencies array<string>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PackageWriter(dict(self.options))


def _save(rows: DataFrame, source: type[DataSource], root: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(source)
    rows.write.format(source.name()).mode("append").options(root=root, **options).save()


def write_records(grouped: DataFrame, root: str, old: DataFrame | None = None, command: str = "fenceline update") -> DataFrame:
    """Write a file a package below ``root`` and delete those of ``old`` packages that have none any more: (package, action). A
    package's groups come to one task sorted and pass through it one at a time, so a record of any size is written in
    constant memory. If a task fails, old files stay as they were."""
    names = [c.split()[0] for c in texts.RECORD_SCHEMA.split(", ")]
    rows = grouped.select(*names)
    done = rows.select(F.col("referencing_package").alias("package")).distinct().withColumn("action", F.lit("written"))
    if old is not None:
        lost = old.select("referencing_package").distinct().join(rows.select("referencing_package").distinct(), "referencing_package", "left_anti")
        lost = settled(lost)  # of the files that are about to go
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields[1:]]
        rows = rows.unionByName(lost.select("referencing_package", *none))
        done = done.unionByName(lost.select(F.col("referencing_package").alias("package"), F.lit("deleted").alias("action")))
    done = settled(done)
    _save(rows.repartition("referencing_package").sortWithinPartitions("referencing_package", "defining_package", "constant_name"), RecordSink, root, command=command)
    return done


def write_packages(changed: DataFrame, root: str) -> DataFrame:
    """Write the package files of ``changed`` (PACKAGES rows) below ``root``: the keys they were read with, ``dependencies`` as it is
    now, in canonical order. (package, action)."""
    done = settled(changed.select(F.col("name").alias("package"), F.lit("written").alias("action")))
    _save(changed.select("name", "client_keys", "dependencies").repartition("name").sortWithinPartitions("name"), PackageSink, root)
    return done


def write_document(spark: SparkSession, root: str, path: str, pieces: list[str | tuple[DataFrame, str]]) -> None:
    """Write one text file of ``pieces``: strings, and tables of one column with the separator of their rows, in the order they are
    sorted in. Each task writes the rows it holds to a file of its own; one task then streams all files into one beside
    its place and moves it there. Only names of files pass through the driver, one a partition."""
    plan: list[tuple[str, str, str]] = []  # kind, text or name of a part, separator

    def parts(rows: DataFrame, separator: str) -> list:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            values = (v for b in batches for v in b.column(0).to_pylist())
            first = next(values, None)
            if first is None:
                return
            name = stores.part_name(path)

            def text() -> Iterator[str]:
                yield first
                for v in values:
                    yield separator
                    yield v

            stores.write(root, name, _chunks(text()))
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": pa.array([name])})

        return [r["name"] for r in settled(rows.mapInArrow(write, "part int, name string")).orderBy("part").collect()]

    for p in pieces:
        if isinstance(p, str):
            plan.append(("text", p, ""))
        else:
            plan += [("part", name, p[1] if k else "") for k, name in enumerate(parts(*p))]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = stores.part_name(path)

            def stream() -> Iterator[bytes]:
                for kind, text, separator in plan:
                    yield separator.encode()
                    if kind == "text":
                        yield text.encode()
                    else:
                        yield from stores.chunks(root, text)

            stores.write(root, whole, stream())
            stores.move(root, whole, path)
            for kind, text, _ in plan:
                if kind == "part":
                    stores.delete(root, text)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path])})

    # a task that is run again after its parts are gone finds the document in its place
    done = settled(spark.range(1, numPartitions=1).mapInArrow(join, "path string"))
    assert done.count() == 1
