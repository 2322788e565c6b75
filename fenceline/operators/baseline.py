"""Recorded violations: what is new, what is stale, what may not be recorded, and the record itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import IDENTIFIER
from . import rules
from .lineage import kept


def unnest(record: DataFrame) -> DataFrame:
    """Identifiers of a nested record (referencing_package, defining_package, constant_name, violations, files): every type
    with every file of a group. Recorded violations are never strict."""
    rows = record.withColumn("violation_type", F.explode("violations")).withColumn("file", F.explode("files"))
    return rows.select("violation_type", F.lit(False).alias("strict"), "file", "constant_name", "referencing_package", "defining_package").distinct()


def reportable(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Violations that are not recorded. A strict one never is: its identifier says strict."""
    return found.join(recorded.select(*IDENTIFIER), list(IDENTIFIER), "left_anti")


def stale(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded identifiers that were not found, also those of files that were not looked at."""
    return recorded.select(*IDENTIFIER).distinct().join(found.select(*IDENTIFIER), list(IDENTIFIER), "left_anti")


def strict(found: DataFrame) -> DataFrame:
    return found.where("strict")


def violation_count(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: reportable + stale + strict; a strict violation counts twice."""
    parts = [reportable(found, recorded).select(F.lit(1).alias("x")), stale(found, recorded).select(F.lit(1).alias("x")), strict(found).select(F.lit(1).alias("x"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(F.count("x").alias("n_violations"))


def scoped(found: DataFrame, constant: str | None = None, violation_type: str | None = None, defining_package: str | None = None) -> DataFrame:
    """Violations that an update is narrowed to."""
    for column, value in (("constant_name", constant), ("violation_type", violation_type), ("defining_package", defining_package)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def narrowed(found: DataFrame, constant: str | None = None, violation_type: str | None = None, defining_package: str | None = None) -> DataFrame:
    """``scoped`` for ``rules.broken``."""
    if violation_type is not None:
        found = rules.breaking(found, sum(3 << 2 * i for i, rule in enumerate(rules.RULES) if rule.name == violation_type))
    return scoped(found, constant, None, defining_package)


def compared(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """``rules.once(broken)`` against a record, kept: its columns, and ``recorded`` with the bits that the record has of this place
    (file, constant and packages). What only the record knows is a row of nulls but for these. One join tells what is new
    and what is stale; neither texts nor a row a violation go through it."""
    bit = rules.bits(F.col("violation_type"), F.col("strict"))
    ids = recorded.select("constant_name", "defining_package", "referencing_package", F.col("file").alias("referencing_file"), bit.alias("bit"))
    ids = ids.where("bit <> 0").groupBy(*rules.PLACE).agg(F.bit_or("bit").alias("recorded"))
    return kept(found.join(ids, list(rules.PLACE), "full_outer"))


def fresh(both: DataFrame) -> DataFrame:
    """``rules.broken`` of what ``compared`` has and the record has not. A strict one never is recorded: its identifier says strict."""
    left = F.col("broken").bitwiseAND(F.bitwise_not(F.coalesce("recorded", F.lit(0))))
    return both.where("broken is not null").withColumn("broken", left).drop("recorded").where("broken <> 0")


def gone(both: DataFrame, recorded: DataFrame) -> DataFrame:
    """IDENTIFIER rows of the record that were not found; a type that no rule has never is."""
    rows = both.where("recorded is not null").groupBy(*rules.PLACE).agg(F.bit_or("recorded").alias("recorded"), F.bit_or("broken").alias("found"))
    known = rules.identified(rows.withColumn("broken", F.expr("recorded & ~coalesce(found, 0)")))
    odd = recorded.select(*IDENTIFIER).where(rules.bits(F.col("violation_type"), F.col("strict")) == 0).distinct()
    return known.unionByName(odd)


def bare(both: DataFrame) -> DataFrame:
    """``rules.broken`` of strict violations in what was compared."""
    return rules.breaking(both.where("broken is not null"), rules.STRICT)


def tally(both: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: new + stale + strict, as ``violation_count``."""
    n = lambda df: df.agg(F.coalesce(F.sum(F.bit_count("broken")), F.lit(0)).alias("n"))
    parts = n(fresh(both)).unionAll(gone(both, recorded).agg(F.count(F.lit(1)).alias("n"))).unionAll(n(bare(both)))
    return parts.agg(F.sum("n").cast("long").alias("n_violations"))


def gathered(found: DataFrame) -> DataFrame:
    """``grouped`` for ``rules.broken`` (equal references need not be joined): types are bits, so that only files are gathered. Rows are
    dealt once, by group."""
    keys = ["referencing_package", "defining_package", "constant_name"]
    # strict breaches are left out by themselves: a reference may break one rule strictly and another one not
    rows = rules.breaking(found, rules.PLAIN).select(*keys, "referencing_file", "broken").repartition(*keys)
    out = rows.groupBy(*keys).agg(F.bit_or("broken").alias("b"), F.sort_array(F.collect_set("referencing_file")).alias("files"))
    types = sorted((rule.name, 1 << 2 * i) for i, rule in enumerate(rules.RULES))
    some = F.array_compact(F.array(*[F.when(F.col("b").bitwiseAND(F.lit(x)) != 0, F.lit(name)) for name, x in types]))
    return out.select(*keys, some.alias("violations"), "files")


def grouped(found: DataFrame) -> DataFrame:
    """The record to write: for every referencing package, defining package and constant the sorted types and files.
    Strict violations are not recorded. Types and files are made distinct before they are gathered."""
    keys = ["referencing_package", "defining_package", "constant_name"]
    rows = found.where(~F.col("strict")).select(*keys, "violation_type", "file").distinct()
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("violation_type")).alias("violations"), F.sort_array(F.collect_set("file")).alias("files"))


def merged(record: DataFrame, more: DataFrame) -> DataFrame:
    """Union of two records; types and files of a group are united separately."""
    keys = ["referencing_package", "defining_package", "constant_name"]
    rows = record.select(*keys, "violations", "files").unionByName(more.select(*keys, "violations", "files"))
    return rows.groupBy(*keys).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("violations")))).alias("violations"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files")
    )


def size(record: DataFrame) -> DataFrame:
    """Entries of a record by referencing package: files of every group, whatever their types."""
    return record.groupBy("referencing_package").agg(F.sum(F.size("files")).cast("long").alias("n"))


def update_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: violations added and removed, record files added, changed and deleted. Records are compared group by group
    (of each key one row a record), so no package's whole record is ever in one place."""
    keys = ["referencing_package", "defining_package", "constant_name"]
    sided = lambda r, side: r.select(*keys, F.struct("violations", "files").alias(side))
    rows = sided(old, "w").join(sided(new, "x"), keys, "full_outer")
    entries = lambda side: F.coalesce(F.sum(F.size(f"{side}.files")), F.lit(0)).cast("long")
    here = lambda side: F.max(F.col(side).isNotNull())
    both = rows.groupBy("referencing_package").agg(entries("w").alias("was"), entries("x").alias("now"), here("w").alias("old"), here("x").alias("new"), F.max(~F.col("w").eqNullSafe(F.col("x"))).alias("differs"))
    more = F.col("now") - F.col("was")
    return both.agg(
        F.coalesce(F.sum(F.greatest(more, F.lit(0))), F.lit(0)).alias("violations_added"), F.coalesce(F.sum(F.greatest(-more, F.lit(0))), F.lit(0)).alias("violations_removed"),
        F.count_if(~F.col("old")).alias("files_added"), F.count_if(F.col("old") & F.col("new") & F.col("differs")).alias("files_changed"), F.count_if(~F.col("new")).alias("files_deleted"),
    )
