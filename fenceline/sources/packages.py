"""Package files and records: YAML read in tasks, a row a package or recorded group, and written back in tasks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.globs import split_rules
from ..schema import PACKAGES, SETTINGS
from . import stores

# Names in the files.
PACKAGE_FILE, RECORD_FILE = "package.yml", "package_todo.yml"
SETTING_KEYS = {"dependency": ("enforce_dependencies",), "privacy": ("enforce_privacy",), "visibility": ("enforce_visibility",), "layer": ("enforce_layers", "enforce_architecture"), "folder_privacy": ("enforce_folder_privacy", "enforce_folder_visibility")}
LIST_KEYS = ("dependencies", "ignored_dependencies", "visible_to", "private_constants", "ignored_private_constants")
KEY_ORDER = (
    "enforce_dependencies", "enforce_privacy", "enforce_layers", "enforce_visibility", "enforce_folder_privacy", "enforce_folder_visibility", "enforce_architecture", "layer", "public_path", "dependencies", "owner",
    "private_constants", "visible_to", "enforcement_globs_ignore", "metadata",
)
RECORD_HEADER = """# This file contains a list of dependencies that are not part of the long term plan for the
# '{}' package.
# We should generally work to reduce this list over time.
#
# You can regenerate this file using the following command:
#
# {}
---
"""
RECORD_SCHEMA = "referencing_package string, defining_package string, constant_name string, violations array<string>, files array<string>"


def load_yaml(text: str) -> dict:
    """A YAML mapping; an empty text is an empty one, a key that comes twice is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k) for k, _ in node.value]
        if len({str(k) for k in keys}) < len(keys):
            raise ValueError(f"duplicate key in {sorted(map(str, keys))}")
        return loader.construct_mapping(node, deep=True)

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    out = yaml.load(text, Loader) or {}
    if not isinstance(out, dict):
        raise ValueError("a mapping is expected")
    return out


def package_name(path: str) -> str:
    return path.rpartition("/")[0] or "."


def _setting(value) -> str:
    text = str(value).lower()
    if text not in ("false", "true", "strict"):
        raise ValueError(f"a setting is false, true or strict, not {value!r}")
    return text


def package_row(path: str, text: str) -> dict:
    """One row of PACKAGES. Keys without a column are kept as JSON for writing back."""
    raw, name = load_yaml(text), package_name(path)
    row: dict = {c: None for c in PACKAGES.names} | {"name": name, "parent": name.rpartition("/")[0] or "."}
    for s in SETTINGS:
        given = [raw[k] for k in SETTING_KEYS[s] if k in raw]
        row[f"enforce_{s}"] = _setting(given[0]) if given else None
    for k in ("owner", "layer", "public_folder"):
        row[k] = raw.get(k)
    for k in LIST_KEYS:
        row[k] = sorted(set(raw[k] or [])) if k in raw else None
    row["ignore_rules"] = []
    for rule in raw.get("enforcement_globs_ignore") or []:
        deny, allow = split_rules(rule.get("ignores") or [])
        names = {k: s for s, keys in SETTING_KEYS.items() for k in keys} | {s: s for s in SETTINGS}
        row["ignore_rules"].append({"enforcements": [names.get(e, e) for e in rule.get("enforcements") or []], "deny": deny, "allow": allow, "reason": rule.get("reason")})
    row["client_keys"] = json.dumps(raw, default=str)
    return row


def packages(files: DataFrame) -> DataFrame:
    """PACKAGES of ``files(path, content)``; a file that is no valid YAML fails the job with its path."""
    mine = files.where((F.col("path") == PACKAGE_FILE) | F.col("path").endswith("/" + PACKAGE_FILE)).select("path", F.decode("content", "UTF-8").alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    out.append(package_row(path, text))
                except Exception as e:
                    raise ValueError(f"{path}: {e}") from e
            yield pd.DataFrame(out, columns=PACKAGES.names)

    return mine.mapInPandas(rows, PACKAGES)


def edges(packages_: DataFrame) -> DataFrame:
    return packages_.select(F.col("name").alias("from_package"), F.explode("dependencies").alias("to_package"))


def record(files: DataFrame) -> DataFrame:
    """Recorded groups of ``files(path, content)``; a corrupt file fails the job and says what to do."""
    mine = files.where((F.col("path") == RECORD_FILE) | F.col("path").endswith("/" + RECORD_FILE)).select("path", F.decode("content", "UTF-8").alias("text"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["text"]):
                try:
                    for definer, constants in load_yaml(text).items():
                        out += [(package_name(path), definer, c, sorted(set(g["violations"])), sorted(set(g["files"]))) for c, g in constants.items()]
                except Exception as e:
                    raise ValueError(f"{path} cannot be read ({e}); delete it and run update") from e
            yield pd.DataFrame(out, columns=["referencing_package", "defining_package", "constant_name", "violations", "files"])

    return mine.mapInPandas(rows, RECORD_SCHEMA)


def record_pieces(rows: Iterator[tuple[str, tuple]], command: str = "fenceline update") -> Iterator[str]:
    """The canonical text of a package's record, a piece a group: constants quoted, types and files sorted. ``rows``: the package and
    (defining_package, constant_name, violations, files), sorted by these."""
    now = None
    for package, (definer, constant, kinds, files) in rows:
        if now is None:
            yield RECORD_HEADER.format(package, command)
        if definer != now:
            yield f"{_plain(definer)}:\n"
            now = definer
        yield f'  "{constant}":\n    violations:\n' + "".join(f"    - {_plain(k)}\n" for k in sorted(kinds)) + "    files:\n" + "".join(f"    - {_plain(f)}\n" for f in sorted(files))


def record_text(package: str, groups: list, command: str = "fenceline update") -> str:
    """The whole text of a record of few ``groups``, in any order."""
    return "".join(record_pieces(((package, tuple(g)) for g in sorted(tuple(g) for g in groups)), command))


def _plain(text: str) -> str:
    import yaml

    return yaml.safe_dump(text, default_flow_style=True, width=1 << 30).split("\n")[0]


def package_text(raw: dict) -> str:
    """The canonical text of a package file: keys in their order, others after them, lists sorted and distinct."""
    import yaml

    known = [k for k in KEY_ORDER if k in raw] + sorted(k for k in raw if k not in KEY_ORDER)
    clean = {k: sorted(set(raw[k])) if k in LIST_KEYS and raw[k] else raw[k] for k in known}
    return yaml.safe_dump(clean, sort_keys=False, default_flow_style=False, width=1 << 30) if clean else ""


def with_edges(packages_: DataFrame, edges_: DataFrame) -> DataFrame:
    """``packages_`` whose dependencies are those of ``edges_`` (from_package, to_package)."""
    new = edges_.groupBy(F.col("from_package").alias("name")).agg(F.sort_array(F.collect_set("to_package")).alias("_new"))
    return packages_.join(new, "name", "left").withColumn("dependencies", F.col("_new")).select(*packages_.columns)


ROOT_TEXT = """# The root package of the application. `validate` looks at the configuration, `check` at the code.

# Change to `true` to turn on dependency checks for this package
enforce_dependencies: false

# Packages that this one depends on; each needs a package file of its own
# dependencies:
# - "packages/billing"
"""
CONFIG_TEXT = """# Patterns of the paths to include
# include:
# - "**/*.{rb,rake,erb}"

# Patterns of the paths to exclude
# exclude:
# - "{bin,node_modules,script,tmp,vendor}/**/*"

# Patterns of directories whose package files count
# package_paths: "**/"

# Further calls that name an association
# custom_associations:
# - "cache_belongs_to"
"""


def scaffold(root: str, name: str, text: str = "enforce_dependencies: true\n") -> str:
    """Begin a package: its directory and file. One that exists is left alone, which is an error."""
    return _begin(root, PACKAGE_FILE if name == "." else f"{name}/{PACKAGE_FILE}", text)


def init(root: str, config_file: str) -> list[str]:
    """Begin a project: its root package and configuration. If one of them is there, both are left alone, which is an error."""
    for path in (PACKAGE_FILE, config_file):
        if stores.exists(root, path):
            raise FileExistsError(f"{stores.join(root, path)} already exists")
    return [_begin(root, config_file, CONFIG_TEXT), _begin(root, PACKAGE_FILE, ROOT_TEXT)]


def _begin(root: str, path: str, text: str) -> str:
    if stores.exists(root, path):
        raise FileExistsError(f"{stores.join(root, path)} already exists")
    stores.write(root, path, iter([text.encode()]))
    return stores.join(root, path)


@dataclass(frozen=True)
class Settings:
    """What the configuration file of a tree says; all of it small."""

    include: tuple[str, ...]
    exclude: tuple[str, ...]
    package_paths: tuple[str, ...] = ("**/",)
    layers: tuple[str, ...] = ()
    custom_associations: tuple[str, ...] = ()
    ignored_definitions: dict = field(default_factory=dict)
    autoload_roots: dict = field(default_factory=dict)
    inflections_path: str = "config/initializers/inflections.rb"
    definition_mode: bool = False


def settings(text: str | None) -> Settings:
    """Settings of a configuration file's text; null or empty text: the defaults. A single string stands for a list of one."""
    from .files import EXCLUDE, INCLUDE

    raw = load_yaml(text or "")
    many = lambda k, default: tuple([raw[k]] if isinstance(raw.get(k), str) else raw.get(k) or default)
    return Settings(
        many("include", INCLUDE), many("exclude", EXCLUDE), many("package_paths", ("**/",)), many("layers", ()), tuple(str(a).lstrip(":") for a in many("custom_associations", ())),
        raw.get("ignored_definitions") or {}, raw.get("autoload_roots") or {}, raw.get("inflections_path") or "config/initializers/inflections.rb", bool(raw.get("experimental_parser")),
    )


def admitted(packages_: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Packages whose directory matches one of ``patterns``, and the root."""
    from ..functions.globs import path_glob

    hit = F.col("name") == "."
    for p in patterns:
        hit = hit | F.concat("name", F.lit("/")).rlike(path_glob(p if p.endswith("/") else p + "/"))
    return packages_.where(hit)
