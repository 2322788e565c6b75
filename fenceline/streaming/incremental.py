"""Violations of references as they arrive: micro-batches through the same rules, written as they are found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import rules
from ..operators.rules import World
from ..schema import REFERENCES


def watch(spark: SparkSession, refs_dir: str, packages: DataFrame, out_dir: str, checkpoint: str, world: World = World(), once: bool = True) -> StreamingQuery:
    """Check every new file of references in ``refs_dir`` and append its violations to ``out_dir``, a folder a batch.

    The checkpoint remembers files that are done, and a batch overwrites its own folder, so a batch that is tried again
    after a failure counts once. Violations are distinct within a batch.
    """
    arriving = spark.readStream.schema(REFERENCES).parquet(refs_dir)

    def check(batch: DataFrame, number: int) -> None:
        rules.violations(batch, packages, world).write.mode("overwrite").parquet(f"{out_dir}/batch={number}")

    writer = arriving.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
