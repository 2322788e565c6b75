"""From names to definitions: the resolution ladder, owners of files, autoload roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names


def _ladder(name: Column, namespace: Column, truncate: bool) -> Column:
    """Names to try in order, as (fq, out): the constant's own path shortened from the end (if ``truncate``) outermost, the
    namespace from the deepest to the top level within. ``out`` is what the reference then means."""
    absolute = name.startswith("::")
    plain = F.regexp_replace(name, "^::", "")
    path = F.when(absolute, F.array().cast("array<string>")).otherwise(F.coalesce(namespace, F.array().cast("array<string>")))
    parts = F.split(plain, "::")
    lengths = F.sequence(F.size(parts), F.lit(1), F.lit(-1)) if truncate else F.array(F.size(parts))
    depths = F.sequence(F.size(path), F.lit(0), F.lit(-1))
    inner = lambda i, j: F.concat(F.slice(path, F.lit(1), j), F.slice(parts, F.lit(1), i))
    step = lambda i: F.transform(depths, lambda j: F.struct(F.concat(F.lit("::"), F.array_join(inner(i, j), "::")).alias("fq"), F.concat(F.lit("::"), F.array_join(F.concat(F.slice(path, F.lit(1), j), F.array(plain)), "::")).alias("out")))
    return F.flatten(F.transform(lengths, step))


def _winners(refs: DataFrame, constants: DataFrame, truncate: bool) -> DataFrame:
    """(ref_id, fq, constant_name) of the first candidate that is defined. Only ids and names go through the join."""
    tries = refs.select("ref_id", F.posexplode(_ladder(F.col("name"), F.col("namespace"), truncate)).alias("priority", "c"))
    defined = constants.select(F.col("fq_name").alias("fq")).distinct()
    hits = tries.select("ref_id", "priority", F.col("c.fq").alias("fq"), F.col("c.out").alias("out")).join(defined, "fq")
    return hits.groupBy("ref_id").agg(F.min_by(F.struct("fq", "out"), "priority").alias("w")).select("ref_id", F.col("w.fq").alias("fq"), F.col("w.out").alias("constant_name"))


def resolve_first(refs: DataFrame, constants: DataFrame) -> DataFrame:
    """Path-convention mode, for ``refs(ref_id, name, namespace)`` and ``constants(fq_name, defining_file)``: every reference once, with
    its meaning and defining file, or its own name and null. A name that two files define fails the job, as the
    convention gives each one file."""
    constants = unique(constants)
    found = _winners(refs, constants, True).join(constants.select(F.col("fq_name").alias("fq"), "defining_file"), "fq")
    return refs.select("ref_id", "name").join(found, "ref_id", "left").select("ref_id", F.coalesce("constant_name", "name").alias("constant_name"), "defining_file")


def resolve_all(refs: DataFrame, constants: DataFrame) -> DataFrame:
    """Definition mode: the constant's path is not shortened, a reference becomes one row a definition, a miss none."""
    found = _winners(refs, constants, False).join(constants.select(F.col("fq_name").alias("fq"), "defining_file"), "fq")
    return found.select("ref_id", "constant_name", "defining_file").distinct()


def ambiguous(constants: DataFrame) -> DataFrame:
    """Definitions of names that several files define."""
    many = constants.groupBy("fq_name").agg(F.countDistinct("defining_file").alias("n_files")).where("n_files > 1")
    return constants.distinct().join(many, "fq_name")


def duplicates(constants: DataFrame) -> DataFrame:
    """(said) of names that several files define, each with its files; path-convention mode asks for none."""
    files = F.array_sort(F.collect_set("defining_file"))
    many = constants.groupBy("fq_name").agg(files.alias("files")).where(F.size("files") > 1)
    return many.select(F.concat("fq_name", F.lit(" ("), F.array_join("files", ", "), F.lit(")")).alias("said"))


def unique(constants: DataFrame) -> DataFrame:
    """``constants`` with a row a name; a name of several files is an error that says two of them (``duplicates`` has all)."""
    one = constants.groupBy("fq_name").agg(F.min("defining_file").alias("a"), F.max("defining_file").alias("b"))
    said = F.concat(F.lit("two files define "), F.col("fq_name"), F.lit(": "), F.col("a"), F.lit(", "), F.col("b"))
    return one.select("fq_name", F.when(F.col("a") != F.col("b"), F.raise_error(said).cast("string")).otherwise(F.col("a")).alias("defining_file"))


def nearest(files: DataFrame, directories: DataFrame, path: str = "path", directory: str = "directory") -> DataFrame:
    """``files`` with the deepest of ``directories`` that holds them (null if none): an equality join on exploded ancestors
    in place of a prefix join."""
    up = files.select(path).distinct().select(path, F.explode(names.ancestors(F.col(path))).alias("a"))
    hits = up.select(path, F.col("a.dir").alias(directory), F.col("a.depth").alias("depth")).join(directories.select(directory).distinct(), directory)
    best = hits.groupBy(path).agg(F.max_by(directory, "depth").alias(directory))
    return files.join(best, path, "left")


def file_owner(files: DataFrame, package_dirs: DataFrame, admitted: DataFrame | None = None) -> DataFrame:
    """(path, package): the nearest directory with a package file owns a file; if that package is not admitted, none does."""
    out = nearest(files.select("path"), package_dirs).withColumnRenamed("directory", "package")
    if admitted is None:
        return out
    ok = admitted.select(F.col("name").alias("package")).distinct().withColumn("ok", F.lit(True))
    return out.join(ok, "package", "left").select("path", F.when(F.col("ok"), F.col("package")).alias("package"))


def inferred_constants(files: DataFrame, roots: DataFrame, acronyms: list[str] | None = None) -> DataFrame:
    """constants(fq_name, defining_file) by path convention: ``roots(directory, namespace)``, the longest root of a file wins."""
    ruby = files.where(F.col("path").endswith(".rb")).select("path")
    rooted = nearest(ruby, roots).where("directory is not null").join(roots, "directory")
    return rooted.select(names.constant_of_path(F.col("path"), F.col("directory"), F.col("namespace"), acronyms).alias("fq_name"), F.col("path").alias("defining_file"))


def default_roots(files: DataFrame, package_dirs: DataFrame) -> DataFrame:
    """roots(directory, namespace): app/* and app/*/concerns of every package, read off the paths of the files. ``package_dirs`` may
    say with a column ``namespace`` that a package's roots stand for one, and with ``bare`` (paths below the package) which
    do not."""
    up = nearest(files.select("path"), package_dirs).where("directory is not null")
    base = F.when(F.col("directory") == ".", F.lit("")).otherwise(F.concat(F.col("directory"), F.lit("/")))
    inner = F.expr("substring(path, length(b) + 1)")
    rows = up.withColumn("b", base).withColumn("inner", inner)
    first = F.regexp_extract("inner", r"^(app/[^/]+)/", 1)
    concern = F.regexp_extract("inner", r"^(app/[^/]+/concerns)/", 1)
    found = rows.select("b", F.explode(F.array(first, concern)).alias("r")).where("r <> ''")
    if "namespace" not in package_dirs.columns:
        return found.select(F.concat("b", "r").alias("directory"), F.lit("").alias("namespace")).distinct()
    own = package_dirs.select(F.when(F.col("directory") == ".", F.lit("")).otherwise(F.concat(F.col("directory"), F.lit("/"))).alias("b"), "namespace", "bare")
    space = F.when(F.array_contains("bare", F.col("r")), F.lit("")).otherwise(F.coalesce("namespace", F.lit("")))
    return found.distinct().join(own, "b").select(F.concat("b", "r").alias("directory"), space.alias("namespace")).distinct()


def automatic_namespaces(packages: DataFrame) -> DataFrame:
    """(directory, namespace, bare) of every package: where its metadata ask for an automatic namespace, the camel case of the last
    part of its name, but for the roots its metadata exclude."""
    wanted = "metadata struct<automatic_pack_namespace:boolean,automatic_pack_namespace_exclusions:array<string>>"
    meta = F.from_json(F.coalesce("client_keys", F.lit("{}")), wanted)["metadata"]
    own = F.when(meta["automatic_pack_namespace"], F.concat(F.lit("::"), names.camelize(names.last_part(F.col("name"))))).otherwise(F.lit(""))
    bare = F.transform(F.coalesce(meta["automatic_pack_namespace_exclusions"], F.array().cast("array<string>")), lambda p: F.rtrim(p, F.lit("/")))
    return packages.select(F.col("name").alias("directory"), own.alias("namespace"), bare.alias("bare"))


def with_overrides(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """Roots where configuration wins over defaults; the namespace ::Object is the top level."""
    rows = defaults.withColumn("p", F.lit(0)).unionByName(overrides.withColumn("p", F.lit(1)))
    best = rows.groupBy("directory").agg(F.max_by("namespace", "p").alias("namespace"))
    return best.withColumn("namespace", F.when(F.col("namespace") == "::Object", F.lit("")).otherwise(F.col("namespace")))


def references(unresolved: DataFrame, constants: DataFrame, owners: DataFrame, definition_mode: bool = False) -> DataFrame:
    """REFERENCES of ``unresolved(ref_id, path, name, namespace, line, col)``. A referencing file without an owner has a null package;
    ``unowned`` gives those, which no rule can judge."""
    meaning = (resolve_all if definition_mode else resolve_first)(unresolved, constants)
    rows = unresolved.select("ref_id", "path", "line", "col").join(meaning, "ref_id")
    rows = rows.join(owners.select("path", F.col("package").alias("referencing_package")), "path", "left")
    rows = rows.join(owners.select(F.col("path").alias("defining_file"), F.col("package").alias("defining_package")), "defining_file", "left")
    return rows.select("constant_name", "defining_package", "defining_file", "referencing_package", F.col("path").alias("referencing_file"), "line", "col")


def unowned(refs: DataFrame) -> DataFrame:
    """(file) of referencing files that no package owns."""
    return refs.where("referencing_package is null").select(F.col("referencing_file").alias("file"))
