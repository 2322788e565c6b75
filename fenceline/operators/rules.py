"""Boundary rules over resolved references.

A rule is a predicate on one reference with its two packages; all rules are evaluated in one pass over the references
(two joins with the packages, one number that says which rules are broken), not one scan a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..schema import VIOLATION
from .lineage import settled

# The texts of reports, read by other tools.
TEXT = {
    "dependency": "Dependency violation: `%s` belongs to `%s`, but `%s` does not specify a dependency on `%s`.",
    "privacy": "Privacy violation: `%s` is private to `%s`, but referenced from `%s`",
    "visibility": "Visibility violation: `%s` belongs to `%s`, which is not visible to `%s`",
    "layer": "%s violation: `%s` belongs to `%s` (whose layer is `%s`) cannot be accessed from `%s` (whose layer is `%s`)",
    "folder_privacy": "Folder Privacy violation: `%s` belongs to `%s`, which is private to `%s` as it is not a sibling pack or parent pack.",
    "strict": "%s cannot have %s violations on %s because strict mode is enabled for %s violations in the enforcing pack's package.yml file",
}
OUTGOING, INCOMING = "outgoing", "incoming"


@dataclass(frozen=True)
class Rule:
    """``broken(r, d)`` on the referencing and the defining package; outgoing rules follow the referencing package's settings
    and ignore globs on the defining file, incoming ones the other way round."""

    name: str
    direction: str
    broken: Callable[[Callable, Callable, "World"], Column]
    message: Callable[[Callable, Callable, "World"], Column]


@dataclass(frozen=True)
class World:
    """What rules look at besides the packages. ``layers`` is the order of layers, lowest last; ``layer_word`` begins the
    layer rule's message."""

    layers: tuple[str, ...] = ()
    layer_word: str = "Layer"


def _say(text: str, *values: Column) -> Column:
    """``text`` with its %s filled in; joined, not formatted, as a formatter reads the text again for every row."""
    pieces = [F.lit(x) for x in text.split("%s")]
    return F.concat(pieces[0], *[x for v, piece in zip(values, pieces[1:], strict=True) for x in (F.coalesce(v, F.lit("null")), piece)])


def _has(array: Column, value: Column) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def _layer(name: Column, w: World) -> Column:
    """Place of a layer in the order, 0 for one that the order does not have."""
    return F.array_position(F.array(*[F.lit(x) for x in w.layers]), name) if w.layers else F.lit(0).cast("long")


def _above(r: Column, d: Column, w: World) -> Column:
    """Whether layer ``d`` stands above ``r``; a layer that the order does not have is an error, not the top."""
    said = F.format_string("Could not find one of layer `%s` or layer `%s` in the configuration", r, d)
    known = (_layer(r, w) > 0) & (_layer(d, w) > 0)
    return F.when(r.isNull() | d.isNull(), F.lit(False)).when(known, _layer(r, w) > _layer(d, w)).otherwise(F.raise_error(said).cast("boolean"))


def _private(r, d, w) -> Column:
    constant = F.col("constant_name")
    folder = F.coalesce(d("public_folder"), F.concat(d("name"), F.lit("/app/public")))
    public = F.coalesce(F.col("defining_file").startswith(folder), F.lit(False))
    listed = F.coalesce(d("private_constants"), F.array().cast("array<string>"))
    private = F.when(F.size(listed) == 0, F.lit(True)).otherwise(F.exists(listed, lambda p: (constant == p) | constant.startswith(F.concat(p, F.lit("::")))))
    return ~public & ~_has(r("ignored_private_constants"), constant) & private


def _folder_hidden(r, d, w) -> Column:
    visible = (r("name") == ".") | r("parent").eqNullSafe(d("parent")) | d("name").startswith(r("name"))
    return ~visible


RULES = (
    Rule("dependency", OUTGOING, lambda r, d, w: ~_has(r("dependencies"), d("name")) & ~_has(r("ignored_dependencies"), d("name")),
         lambda r, d, w: _say(TEXT["dependency"], F.col("constant_name"), d("name"), names.package_file(r("name")), d("name"))),
    Rule("privacy", INCOMING, _private, lambda r, d, w: _say(TEXT["privacy"], F.col("constant_name"), d("name"), r("name"))),
    Rule("visibility", INCOMING, lambda r, d, w: ~_has(d("visible_to"), r("name")), lambda r, d, w: _say(TEXT["visibility"], F.col("constant_name"), d("name"), r("name"))),
    Rule("layer", OUTGOING, lambda r, d, w: _above(r("layer"), d("layer"), w),
         lambda r, d, w: _say(TEXT["layer"], F.lit(w.layer_word), F.col("constant_name"), d("name"), d("layer"), r("name"), r("layer"))),
    Rule("folder_privacy", INCOMING, _folder_hidden, lambda r, d, w: _say(TEXT["folder_privacy"], F.col("constant_name"), d("name"), r("name"))),
)


#: What a reference breaks is one whole number: of rule number i bit 2i if it is broken, bit 2i + 1 if its breach is strict.
PLAIN, STRICT = sum(1 << 2 * i for i in range(len(RULES))), sum(2 << 2 * i for i in range(len(RULES)))
#: What tells references apart, and what identifiers of violations hold of one.
REFERENCE = ("constant_name", "defining_package", "referencing_package", "referencing_file", "line", "col")
PLACE = ("constant_name", "defining_package", "referencing_package", "referencing_file")


def bits(violation_type: Column, strict: Column) -> Column:
    """The bit of an identifier in ``broken``; 0 for a type that no rule has."""
    out = F.when(F.lit(False), F.lit(0))
    for i, rule in enumerate(RULES):
        out = out.when(violation_type == rule.name, F.when(strict, F.lit(2 << 2 * i)).otherwise(F.lit(1 << 2 * i)))
    return out.otherwise(F.lit(0))


def breaking(broken: DataFrame, mask: int) -> DataFrame:
    """``broken`` with the bits of ``mask`` alone; references without any leave."""
    return broken.withColumn("broken", F.col("broken").bitwiseAND(F.lit(mask))).where("broken <> 0")


def _first_ignore(rules: Column, enforcement: str) -> Column:
    return F.get(F.filter(rules, lambda x: F.array_contains(x["enforcements"], enforcement)), F.lit(0))


def _ignored(first: Column, path: Column) -> Column:
    """The first ignore rule that names the enforcement decides: some deny matches and no allow does."""
    hit = F.exists(first["deny"], lambda g: F.rlike(path, g)) & ~F.exists(first["allow"], lambda g: F.rlike(path, g))
    return F.when(first.isNull(), F.lit(False)).otherwise(F.coalesce(hit, F.lit(False)))


#: Packages up to which they are broadcast: with their sets, some tens of MB. Beyond, the joins shuffle.
BROADCAST_PACKAGES = 100_000
_OF_BOTH = ("name", "parent", "layer", *[f"enforce_{r.name}" for r in RULES], *[f"ignored_{r.name}" for r in RULES])
_OF_USERS, _OF_DEFINERS = ("dependencies", "ignored_dependencies", "ignored_private_constants"), ("public_folder", "visible_to", "private_constants")


def with_packages(refs: DataFrame, packages: DataFrame) -> DataFrame:
    """References with ``r_*`` and ``d_*`` columns of their packages, those that rules look at; ``ignored_*`` is a rule's first ignore rule.

    Packages are computed and counted once and broadcast up to BROADCAST_PACKAGES, so that references, of which a few
    packages may hold most, are not shuffled by package. Unresolved references and references inside one package cannot
    break a rule and leave first. A reference to or from a package that ``packages`` does not have is an error.
    """
    packages = settled(packages.withColumns({f"ignored_{r.name}": _first_ignore(F.col("ignore_rules"), r.name) for r in RULES}))
    hint = F.broadcast if packages.count() <= BROADCAST_PACKAGES else (lambda df: df)
    side = lambda p, own: hint(packages.select(*[F.col(c).alias(p + c) for c in (*_OF_BOTH, *own)]))
    out = refs.where(F.col("defining_package").isNotNull() & (F.col("defining_package") != F.col("referencing_package")))
    out = out.join(side("r_", _OF_USERS), F.col("referencing_package") == F.col("r_name"), "left").join(side("d_", _OF_DEFINERS), F.col("defining_package") == F.col("d_name"), "left")
    none = F.when(F.col("r_name").isNull(), F.col("referencing_package")).when(F.col("d_name").isNull(), F.col("defining_package"))
    return out.where(F.when(none.isNull(), F.lit(True)).otherwise(F.raise_error(F.format_string("No package found '%s'", none)).cast("boolean")))


def broken(refs: DataFrame, packages: DataFrame, world: World = World(), only: Iterable[str] | None = None, disabled: Iterable[str] = (), public_files: DataFrame | None = None) -> DataFrame:
    """References that break a rule (of all, or of ``only`` some), each as often as it is given: REFERENCE columns, the layers of its
    packages and ``broken``. A null setting enforces nothing. A rule of another name is a ValueError.

    Everything else that is said of violations is made of these slim rows: ``once`` joins equal ones, ``told`` makes rows
    and texts of them, last of all.
    """
    r, d = (lambda c: F.col("r_" + c)), (lambda c: F.col("d_" + c))
    only, disabled = None if only is None else list(only), list(disabled)
    if unknown := {*(only or ()), *disabled} - {x.name for x in RULES}:
        raise ValueError(f"No rule is called {sorted(unknown)}")
    code, privacy = F.lit(0), 0
    for i, rule in enumerate(RULES):
        if rule.name in disabled or (only is not None and rule.name not in only):
            continue
        own, path = (r, F.col("defining_file")) if rule.direction == OUTGOING else (d, F.col("referencing_file"))
        setting = F.coalesce(own(f"enforce_{rule.name}"), F.lit("false"))
        # only where the rule is enforced is its condition looked at, as it may be an error
        hit = F.when(setting != "false", rule.broken(r, d, world)).otherwise(F.lit(False)) & ~_ignored(own(f"ignored_{rule.name}"), path)
        code = code + F.when(hit, F.when(setting == "strict", F.lit(2 << 2 * i)).otherwise(F.lit(1 << 2 * i))).otherwise(F.lit(0))
        privacy |= (3 << 2 * i) * (rule.name == "privacy")
    rows = with_packages(refs, packages).select(*REFERENCE, "r_layer", "d_layer", "defining_file", code.alias("broken")).where("broken <> 0")
    return rows.drop("defining_file") if public_files is None or not privacy else _unmarked(rows, public_files, privacy)


def _unmarked(rows: DataFrame, public_files: DataFrame, privacy: int) -> DataFrame:
    """Constants of public files are not private. A reference that does not break that rule has no file to look for: it goes by its own
    file, so that such ones do not gather at one key."""
    asks = F.col("broken").bitwiseAND(F.lit(privacy)) != 0
    rows = rows.select(*[c for c in rows.columns if c != "defining_file"], asks.alias("asks"), F.when(asks, F.col("defining_file")).otherwise(F.col("referencing_file")).alias("looked_for"))
    marked = public_files.select(F.lit(True).alias("asks"), F.col("path").alias("looked_for")).distinct().withColumn("marked", F.lit(True))
    left = F.when(F.col("marked"), F.col("broken").bitwiseAND(F.lit(~privacy))).otherwise(F.col("broken"))
    return rows.join(marked, ["asks", "looked_for"], "left").withColumn("broken", left).where("broken <> 0").drop("asks", "looked_for", "marked")


def once(found: DataFrame, key: Iterable[str] = (*REFERENCE, "r_layer", "d_layer")) -> DataFrame:
    """``broken`` with a row a reference, or a row a ``key``, pre-aggregated where they are read. What is strict is not plain too."""
    out = found.groupBy(*key).agg(F.bit_or("broken").alias("broken"))
    return out.withColumn("broken", F.expr(f"broken & ~((broken & {STRICT}) >> 1)"))


def _each(found: DataFrame) -> DataFrame:
    """A row for every bit of ``broken``: the rule's number, ``strict``."""
    numbers = found.withColumn("rule", F.explode(F.array(*[F.lit(i) for i in range(len(RULES))])))
    return numbers.withColumn("code", F.expr("(broken >> (2 * rule)) & 3")).where("code <> 0").withColumn("strict", F.col("code") > 1)


def _by_rule(values: Iterable[Column]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, v in enumerate(values):
        out = out.when(F.col("rule") == i, v)
    return out


def told(found: DataFrame, world: World = World()) -> DataFrame:
    """VIOLATION rows of ``once(broken)``. Names of packages are in it, so texts need the packages no more."""
    sides = [lambda c: F.col("referencing_package") if c == "name" else F.col("r_" + c), lambda c: F.col("defining_package") if c == "name" else F.col("d_" + c)]
    place = names.location(F.col("referencing_file"), F.col("line"), F.col("col"))
    text = F.concat(place, _by_rule([rule.message(*sides, world) for rule in RULES]))
    return _each(found).select(text.alias("message"), _by_rule([F.lit(x.name) for x in RULES]).alias("violation_type"), "strict", F.col("referencing_file").alias("file"), "constant_name", "referencing_package", "defining_package", "line", "col").select(*VIOLATION)


def identified(found: DataFrame) -> DataFrame:
    """IDENTIFIER rows of ``broken``, as often as it holds them."""
    return _each(found).select(_by_rule([F.lit(x.name) for x in RULES]).alias("violation_type"), "strict", F.col("referencing_file").alias("file"), "constant_name", "referencing_package", "defining_package")


def violations(refs: DataFrame, packages: DataFrame, world: World = World(), only: Iterable[str] | None = None, disabled: Iterable[str] = (), public_files: DataFrame | None = None) -> DataFrame:
    """Distinct violations of all rules (or ``only`` some), VIOLATION columns; see ``broken``."""
    return told(once(broken(refs, packages, world, only, disabled, public_files)), world)


def unknown_layers(packages: DataFrame, world: World) -> DataFrame:
    """Packages whose layer the order does not have; the layer rule means nothing for them, so check this first."""
    return packages.where(F.col("layer").isNotNull() & (_layer(F.col("layer"), world) == 0)).select("name", "layer")


def strict_messages(found: DataFrame) -> DataFrame:
    """One message for each strict violation; equal ones are not joined."""
    v = F.col("violation_type")
    return found.where("strict").select(_say(TEXT["strict"], F.col("referencing_package"), v, F.col("defining_package"), v).alias("message"))
