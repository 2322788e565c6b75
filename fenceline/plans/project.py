"""A source tree as the tables that the commands work on."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import baseline, resolve
from ..operators.gate import gate
from ..operators.lineage import settled
from ..operators.rules import World
from ..sources import cache as parses
from ..sources import files as trees
from ..sources import packages as package_files
from ..sources import ruby, stores

#: File names that may hold the configuration, the first that exists wins.
CONFIG_FILES = ("boundaries.yml", "packages.yml")


@dataclass(frozen=True)
class Project:
    """Tables of a tree: files as listed, paths of sources, their texts (read where they are asked for), packages, owners of files, constants, resolved references, the record. What several others are
    made of is settled when it is first asked for, so that no file is parsed twice and no command does what it need not."""

    root: str
    listed: DataFrame
    world: World
    settings: package_files.Settings
    paths: DataFrame
    sources: DataFrame
    all_packages: DataFrame
    packages: DataFrame
    record: DataFrame
    acronyms: list[str]
    cache: str | None = None
    faults: str | None = None

    @property
    def recorded(self) -> DataFrame:
        return baseline.unnest(self.record)

    @property
    def edges(self) -> DataFrame:
        return package_files.edges(self.packages)

    @property
    def public_files(self) -> DataFrame:
        return trees.public_files(self.sources, self.settings.definition_mode)

    @cached_property
    def parsed(self) -> DataFrame:
        s = self.settings
        parse = lambda rows: ruby.parse(rows, s.custom_associations)
        return settled(parses.parsed_with_cache(self.sources, parse, parses.table(self.cache, s.custom_associations)) if self.cache else parse(self.sources))

    @cached_property
    def owners(self) -> DataFrame:
        return settled(resolve.file_owner(self.paths, self.all_packages.select(F.col("name").alias("directory")), self.packages))

    @cached_property
    def constants(self) -> DataFrame:
        s, spark = self.settings, self.sources.sparkSession
        if s.definition_mode:
            found = ruby.definitions(self.parsed)
            ignored = [(n, p) for n, ps in s.ignored_definitions.items() for p in ps]
            return settled(found.join(spark.createDataFrame(ignored, "fq_name string, defining_file string"), ["fq_name", "defining_file"], "left_anti") if ignored else found)
        paths = self.paths
        roots = resolve.default_roots(paths, resolve.automatic_namespaces(self.all_packages))
        if s.autoload_roots:
            roots = resolve.with_overrides(roots, spark.createDataFrame(list(s.autoload_roots.items()), "directory string, namespace string"))
        found = settled(resolve.inferred_constants(paths, roots, self.acronyms))
        gate(resolve.duplicates(found), "constants that two files define", self.faults and f"{self.faults}/duplicates")
        return found

    @cached_property
    def refs(self) -> DataFrame:
        unresolved = settled(ruby.unresolved(self.parsed, self.acronyms, self.settings.definition_mode))
        found = settled(resolve.references(unresolved, self.constants, self.owners, self.settings.definition_mode))
        gate(resolve.unowned(found), "referencing files without a package", self.faults and f"{self.faults}/unowned")
        return found


def open_project(spark: SparkSession, root: str, config_files: tuple[str, ...] = CONFIG_FILES, replaced: tuple[str, str] | None = None, cache: str | None = None, faults: str | None = None) -> Project:
    """Read a tree. ``replaced`` (path, text) stands in for a file on disk. The configuration (the first of ``config_files`` that is
    there) and inflections are the only contents that reach the driver; what configuration excludes and what is pruned is
    not listed, be it sources, package files or records. ``cache`` names a folder of earlier parses (``sources.cache``), ``faults``
    one for tables of all that is wrong with the tree."""
    text = lambda path: content.decode() if (content := stores.read(root, path)) is not None else None
    s = package_files.settings(next((t for c in config_files if (t := text(c)) is not None), None))
    listed = trees.tree(spark, root, (*trees.PRUNED, *s.exclude))
    mine = trees.parsable(trees.included(listed, s.include, s.exclude))
    sources, paths = trees.sources(trees.contents(mine, root)), mine.select("path")
    if replaced:
        sources = trees.override(sources, *replaced)
        paths = paths.union(spark.createDataFrame([replaced[:1]], "path string")).distinct()
    named = lambda name: trees.contents(listed.where((F.col("path") == name) | F.col("path").endswith("/" + name)), root)
    all_packages = settled(package_files.packages(named(package_files.PACKAGE_FILE)))
    packages = package_files.admitted(all_packages, s.package_paths)
    record = package_files.record(named(package_files.RECORD_FILE))
    return Project(root, listed, World(s.layers), s, paths, sources, all_packages, packages, record, trees.acronyms(text(s.inflections_path)), cache, faults)
