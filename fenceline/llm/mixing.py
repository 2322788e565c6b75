"""Mixing sources to target weights, in DataFrame functions only.

Every document gets a hash-random key; each source is range-sorted by it (ranges of the key, so that no source, however
hot, lands in one task), token counts are summed as a distributed prefix sum (range totals first, then inside a range),
and the source is cut at its exact budget. A budget above the source's size repeats the source in whole epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import WORD, cut, unused

#: Rows a key range holds about; windows sort one range at a time.
ROWS_PER_RANGE = 4_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets of ``sizes(source, source_size)``, one row a source.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes. A target stops at ``cap``
    times its source's size; the excess goes to the others by weight until none is above. That fixed point is one level:
    target = min(cap * size, weight * level). Sources sorted by cap * size / weight are capped up to the first whose
    ratio is not below the level that the rest would get, which running sums give without iterating. All sizes zero, or
    no rows: targets zero, or none. One row a source goes through one window; sources are few against documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ring = F.array(*[F.lit(int(x)) for x in weights])
    w = sizes.withColumn("weight", F.element_at(ring, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * cap)
    ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(ratio), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ratio), F.lit(0))
    )
    w = w.withColumn("level", level)
    w = w.withColumn("level", F.max(F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.col("level"))).over(everything))
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.coalesce("level", F.lit(0.0)))
    return w.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 17, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row a document: id, source, size (words; null text: 0), source_size, target, taken (words, repeats counted).

    ``taken`` is the whole epochs' share plus, in the last epoch, what of the document lies below the budget in key
    order: whole documents first, then one cut document a source. A source's taken words are its target rounded. Rows
    with equal ids are told apart by size only; equal rows are interchangeable. Null ids take part as one key. Other
    columns of ``docs``, whatever their names, are not read.
    """
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long").alias("size"),
    )
    # 60 bits of a digest: random, the same in every run and engine
    digest = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    slim = cut(slim.withColumn("key", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")))
    ranges = max(1, -(-slim.count() // rows_per_range))
    # the key is uniform, so equal widths of its upper 31 bits hold about equally many rows
    at = F.expr(f"shiftright(key, 29) * {ranges}L div {1 << 31}L")
    slim = slim.withColumn("range", at).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    totals = slim.groupBy("s", "range").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("in_range"))
    sizes = totals.groupBy("s").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("in_range").alias("source_size"))
    goals = source_targets(sizes.select("source", "source_size"), weights, cap)
    goals = goals.withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("source")
    budget = F.floor(F.col("target") + 0.5)
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)))
    goals = goals.withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    order = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("s", "range", F.coalesce(F.sum("in_range").over(order), F.lit(0)).alias("start")).join(goals, "s")
    inside = Window.partitionBy("s", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = slim.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("start") - F.col("before")))
    return ranked.join(starts, ["s", "range"]).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target",
        (F.col("epochs") * F.col("size") + last).cast("long").alias("taken"),
    )


def apply_mix(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mixed corpus: rows of ``docs`` with all their columns, repeated for each epoch; the last copy of a document
    that the budget cuts keeps its first words only. ``taken`` comes from ``mix``. Ids must be unique; rows without one are left out."""
    own, size, kept, epoch = unused(docs, "_id", "_size", "_taken", "_epoch")
    t = taken.select(F.col(id_col).alias(own), F.col("size").alias(size), F.col("taken").alias(kept)).where(F.col(kept) > 0)
    rows = docs.join(t, docs[id_col] == t[own])
    rows = rows.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.ceil(F.col(kept) / F.col(size)).cast("int"))))
    left = F.col(kept) - (F.col(epoch) - 1) * F.col(size)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), left.cast("int")), "")
    text = F.when(left >= F.col(size), F.col(text_col)).otherwise(head)
    return rows.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
