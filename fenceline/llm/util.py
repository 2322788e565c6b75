"""Small helpers the operators share: the word pattern, lineage cuts, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Slim rows (a few longs) that one task takes in iterative jobs: some tens of MB.
ROWS_A_TASK = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with more underscores before them where ``df`` has such columns (in either case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a new local folder
    (tests), and any other master an error, as executors would not see such a folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder and cut the lineage, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut(df)`` and its number of rows, counted as they are written. The rows are in as few partitions as that number asks for;
    few rows then take no exchange to be grouped or joined with each other. For slim rows only."""
    df, seen = observed(df, n=F.count(F.lit(1)))
    return df.coalesce(parts_of(seen["n"])), seen["n"]


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
    """``cut(df)`` and aggregates of its rows (no row: 0), made as they are written and not by a job of their own."""
    seen = Observation()
    df = cut(df.observe(seen, *[c.alias(k) for k, c in measures.items()]))
    return df, {k: seen.get[k] or 0 for k in measures}


def parts_of(n: int) -> int:
    return 1 + n // ROWS_A_TASK


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long, long; any direction, repeats allowed).

    Returns (node, label), label the least node of the component; only nodes that occur in an edge. Every round takes
    the least label among a node and its neighbours and then the label of that label (pointer jumping), so long
    chains close in logarithmically many rounds. Null ends are ignored. No edges give no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both, n = counted(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    both = cut(both).coalesce(parts_of(n))  # each round reads these, so they lie in few files
    # a cut forgets how rows lie; coalesce says it again, so that one partition stays one without exchanges
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))).coalesce(parts_of(n))
    for _ in range(max_rounds if n else 0):
        by = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b")
        near = by.groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        step = labels.join(near, "node").select("node", F.least("label", "l").alias("next"), "label")
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        new = step.join(hop, "next").select("node", F.least("next", "up").alias("label"), F.col("label").alias("old"))
        new, seen = observed(new, changed=F.sum((F.col("label") != F.col("old")).cast("long")))
        labels = new.select("node", "label").coalesce(parts_of(n))
        if not seen["changed"]:
            break
    else:
        if n:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return labels
