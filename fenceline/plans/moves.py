"""Moving files to a package, so that a crash in the middle can be made good.

A move has two phases: the plan is written to a journal below the root and closed with a mark; only then are files
renamed, by tasks, each rename to be done twice without harm. The journal goes when all is done. A later run finishes a
closed journal before anything else, and drops one that was never closed, as nothing was renamed by it.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import resolve
from ..operators.lineage import settled
from ..sources import packages as package_files
from ..sources import sinks, stores

#: Where journals are, below the root.
JOURNALS = ".fenceline/moves"
#: Fixed value: a list of files by path that another tool keeps at the root, whose paths follow the files.
PATH_LIST = ".rubocop_todo.yml"
_STEPS = "source string, destination string, action string"


def plan(files: DataFrame, asked: DataFrame, packages: DataFrame, target: str) -> DataFrame:
    """(source, destination) of moving ``asked(path)`` to the package ``target``: each file keeps its place below its package (one of the
    root package its whole path), and its spec goes along if ``files(path)`` has it. Package files and records, and files
    already there, stay."""
    homes = packages.where("name <> '.'").select(F.col("name").alias("directory"))
    kept = F.element_at(F.split("path", "/"), -1).isin(package_files.PACKAGE_FILE, package_files.RECORD_FILE)
    moving = asked.select("path").where(~kept)
    homed = resolve.nearest(moving, homes)
    inner = F.when(F.col("directory").isNull(), F.col("path")).otherwise(F.expr("substring(path, length(directory) + 2)"))
    spec = F.when(F.col("directory").isNull(), names.spec_path(inner)).otherwise(F.concat("directory", F.lit("/"), names.spec_path(inner)))
    specs = homed.where(inner.rlike("^(app|lib)/")).select(spec.alias("path")).join(files.select("path"), "path", "left_semi")
    rows = resolve.nearest(moving.unionByName(specs).distinct(), homes).where(~F.col("directory").eqNullSafe(F.lit(target)))
    return rows.select(F.col("path").alias("source"), F.concat(F.lit(target + "/"), inner).alias("destination"))


def steps(planned: DataFrame, files: DataFrame) -> DataFrame:
    """(source, destination, action) of ``plan``: move, or skip where the destination is there, be it on disk or another file's, or the
    source is not. What is neither here nor there leaves."""
    here, there = (files.select(F.col("path").alias(c), F.lit(True).alias(f"has_{c}")) for c in ("source", "destination"))
    rows = planned.distinct().join(here, "source", "left").join(there, "destination", "left").where("has_source or has_destination")
    # of several files that would come to one place the least goes there
    first = rows.where("has_source").groupBy("destination").agg(F.min("source").alias("first"))
    rows = rows.join(first, "destination", "left")
    moves: Column = F.col("has_source") & F.col("has_destination").isNull() & (F.col("source") == F.col("first"))
    return rows.select("source", "destination", F.when(moves, F.lit("move")).otherwise(F.lit("skip")).alias("action"))


def begin(planned: DataFrame, root: str) -> str:
    """Write the plan to a new journal and close it. Its name."""
    journal = f"{JOURNALS}/{uuid.uuid4().hex}"
    rows = planned.select(F.to_json(F.struct("source", "destination", "action")).alias("line")).orderBy("line")
    sinks.write_document(planned.sparkSession, root, f"{journal}/plan.jsonl", [(rows, "\n")])
    stores.write(root, f"{journal}/closed", iter([b""]))
    return journal


def journals(root: str) -> list[str]:
    """Journals that a run left; ones that were never closed are dropped."""
    out = []
    for path, folder, _ in stores.children(root, JOURNALS):
        if folder and stores.exists(root, f"{path}/closed"):
            out.append(path)
        elif folder:
            _drop(root, path)
    return sorted(out)


def _drop(root: str, journal: str) -> None:
    for name in ("closed", "plan.jsonl"):  # without its mark the rest says nothing
        stores.delete(root, f"{journal}/{name}")
    stores.delete_directory(root, journal)


def finish(spark: SparkSession, root: str, journal: str) -> DataFrame:
    """Do what a closed journal says, or the rest of it: (source, destination, action, replaced), materialised; ``replaced`` counts the
    path's places in the list of paths. Then the journal goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, destination, action in zip(*(c.to_pylist() for c in b.columns)):
                if action == "move":
                    stores.move(root, source, destination)
            yield b

    text = f"{root.rstrip('/')}/{journal}/plan.jsonl"
    rows = spark.read.schema(_STEPS).json(text if re.match(r"\w+:/", text) else "file://" + stores.store(text)[1])
    done = settled(rows.repartition("source").mapInArrow(run, _STEPS))
    counts = settled(done.where("action = 'move'").repartition(1).sortWithinPartitions("source").mapInArrow(_rewriter(root), "source string, replaced long"))
    _drop(root, journal)
    return done.join(counts, "source", "left").select("source", "destination", "action", F.coalesce("replaced", F.lit(0)).alias("replaced"))


def _rewriter(root: str):
    """The one task that makes the list of paths follow the files that moved. A path counts where it stands by itself, so that a second
    run finds nothing to replace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {s: d for b in batches for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
        text = stores.read(root, PATH_LIST)
        if text is None or not places:
            return
        counts = dict.fromkeys(places, 0)

        def follow(m: re.Match) -> str:
            if m[0] not in places:
                return m[0]
            counts[m[0]] += 1
            return places[m[0]]

        new = re.sub(r"[^\s'\"]+", follow, text.decode())
        if any(counts.values()):
            part = stores.part_name(PATH_LIST)
            stores.write(root, part, iter([new.encode()]))
            stores.move(root, part, PATH_LIST)
        yield pa.RecordBatch.from_pydict({"source": pa.array(list(counts), pa.string()), "replaced": pa.array(list(counts.values()), pa.int64())})

    return run


def lines(done: DataFrame) -> DataFrame:
    """What a person is told, (line), of ``finish``."""
    moved = F.format_string("Moving file %s to %s", "source", "destination")
    skipped = F.format_string("[SKIP] Not moving %s, %s already exists", "source", "destination")
    said = F.format_string(f"Replaced %d occurrence(s) of %s in {PATH_LIST}", "replaced", "source")
    rows = done.select("source", F.when(F.col("action") == "move", F.array(F.struct(F.lit(0).alias("part"), moved.alias("line")), F.struct(F.lit(1).alias("part"), F.when(F.col("replaced") > 0, said).alias("line")))).otherwise(F.array(F.struct(F.lit(0).alias("part"), skipped.alias("line")))).alias("l"))
    return rows.select("source", F.explode("l").alias("l")).select("source", "l.part", "l.line").where("line is not null").orderBy("part", "source").select("line")


def namespaced(packages: DataFrame, target: str) -> bool:
    """Whether files of ``target`` stand in a namespace of its own, so that a file moved there would not fit."""
    own = resolve.automatic_namespaces(packages.where(F.col("name") == target))
    return not own.where("namespace <> ''").isEmpty()


def move(spark: SparkSession, root: str, files: DataFrame, asked: DataFrame, packages: DataFrame, target: str) -> DataFrame:
    """Finish what an earlier run left, then plan and do this move."""
    if packages.where(F.col("name") == target).isEmpty():
        raise ValueError(f"Cannot move to '{target}': package not found")
    if namespaced(packages, target):
        raise ValueError(f"Cannot move files into '{target}': its files stand in a namespace of its own, which moved files would lack")
    return finish(spark, root, begin(steps(plan(files, asked, packages, target), files), root))
