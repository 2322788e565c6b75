"""Questions about use: edges by count, edges nobody uses, dependents, users of a constant, maps, redefinitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge_counts(refs: DataFrame) -> DataFrame:
    """References by (referencing, defining) package, inside ones included, unresolved ones not."""
    return refs.where("defining_package is not null").groupBy("referencing_package", "defining_package").agg(F.count(F.lit(1)).alias("n_references"))


def unnecessary_dependencies(edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Declared edges that no reference uses."""
    used = refs.where("defining_package is not null").select(F.col("referencing_package").alias("from_package"), F.col("defining_package").alias("to_package")).distinct()
    return edges.join(used, ["from_package", "to_package"], "left_anti")


def dependents(edges: DataFrame, package: str) -> DataFrame:
    """Packages that declare a dependency on ``package``."""
    return edges.where((F.col("to_package") == package) & (F.col("from_package") != package)).select(F.col("from_package").alias("package")).distinct()


def implicit_dependents(recorded: DataFrame, package: str) -> DataFrame:
    """Recorded use of ``package`` that no edge declares: constants by referencing package and rule."""
    rows = recorded.where((F.col("defining_package") == package) & (F.col("referencing_package") != package))
    return rows.groupBy("referencing_package", "violation_type").agg(F.countDistinct("constant_name").alias("n_constants"))


def suggested_dependencies(refs: DataFrame, package: str) -> DataFrame:
    """What ``package`` would have to declare: the distinct packages that it refers to."""
    rows = refs.where((F.col("referencing_package") == package) & F.col("defining_package").isNotNull() & (F.col("defining_package") != package))
    return rows.select(F.col("defining_package").alias("package")).distinct()


def constant_users(refs: DataFrame, constant: str) -> DataFrame:
    """(defining_package, referencing_package) of a constant used from elsewhere; of several definers the least by name."""
    rows = refs.where((F.col("constant_name") == constant) & F.col("defining_package").isNotNull() & (F.col("defining_package") != F.col("referencing_package")))
    definer = rows.agg(F.min("defining_package").alias("defining_package"))
    return rows.select("referencing_package").distinct().join(definer, how="cross").where("defining_package <> referencing_package")


def missing_edges_for_constant(refs: DataFrame, edges: DataFrame, packages: DataFrame, constant: str) -> DataFrame:
    """Edges to add so that every known package that uses ``constant`` declares its definer."""
    want = constant_users(refs, constant).select(F.col("referencing_package").alias("from_package"), F.col("defining_package").alias("to_package"))
    known = packages.select(F.col("name").alias("from_package"))
    return want.join(known, "from_package", "left_semi").join(edges, ["from_package", "to_package"], "left_anti")


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone, ["from_package", "to_package"], "left_anti")


def expand_to_packages(owners: DataFrame, files: DataFrame) -> DataFrame:
    """All files of the packages that own ``files(path)``; files without an owner bring none."""
    touched = owners.join(files.select("path").distinct(), "path", "left_semi").where("package is not null").select("package").distinct()
    return owners.join(touched, "package", "left_semi").select("path", "package")


def intersect_files(included: DataFrame, asked: DataFrame | None) -> DataFrame:
    """Files asked for that are included; nothing asked means all."""
    return included.distinct() if asked is None else included.select("path").intersect(asked.select("path"))


def reference_map(refs: DataFrame) -> DataFrame:
    """(referencing_file, constants): resolved constants and their files, sorted, of every file that has any; of several
    definitions of a constant the greatest file."""
    one = refs.where("defining_file is not null").groupBy("referencing_file", "constant_name").agg(F.max("defining_file").alias("defining_file"))
    return one.groupBy("referencing_file").agg(F.sort_array(F.collect_list(F.struct("constant_name", "defining_file"))).alias("constants"))


def redefinitions(definitions: DataFrame, stdlib_dir: str, gem_dir: str) -> DataFrame:
    """(fq_name, path, kind, gem) of the application's definitions that reopen the standard library's (kind ruby), a gem's
    (gem; the greatest of several gems) or each other (application)."""
    path = F.col("path")
    where = F.when(path.startswith(stdlib_dir), F.lit("stdlib")).when(path.startswith(gem_dir), F.lit("gem")).otherwise(F.lit("app"))
    rows = definitions.select("fq_name", "path").distinct().withColumn("place", where)
    gem = F.split(F.substring(path, len(gem_dir.rstrip("/")) + 2, 1 << 30), "/")[0]
    n = rows.groupBy("fq_name").agg(*[F.count_if(F.col("place") == p).alias(f"n_{p}") for p in ("stdlib", "gem", "app")], F.max(F.when(F.col("place") == "gem", gem)).alias("gem"))
    kind = F.when(F.col("n_stdlib") > 0, F.lit("ruby")).when(F.col("n_gem") > 0, F.lit("gem")).when(F.col("n_app") > 1, F.lit("application"))
    joined = rows.where("place = 'app'").join(n, "fq_name").withColumn("kind", kind).where("kind is not null")
    return joined.select("fq_name", "path", "kind", F.when(F.col("kind") == "gem", F.col("gem")).alias("gem"))
