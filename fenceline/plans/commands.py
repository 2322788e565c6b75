"""The commands as plans over tables: check, update, and their reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import baseline, rules, usage
from ..operators.lineage import settled
from ..operators.rules import World


@dataclass(frozen=True)
class Check:
    """Violations to report, recorded ones that are gone, strict ones."""

    reportable: DataFrame
    stale: DataFrame
    strict: DataFrame


def check(refs: DataFrame, packages: DataFrame, recorded: DataFrame, world: World = World(), files: DataFrame | None = None, ignore_recorded: bool = False, public_files: DataFrame | None = None, disabled: tuple[str, ...] = ()) -> Check:
    """Evaluate all rules once, on the references of ``files(path)`` only where given. What they find, which all three parts are
    made of, is kept."""
    if files is not None:
        refs = refs.join(files.select(F.col("path").alias("referencing_file")).distinct(), "referencing_file", "left_semi")
    return judged(rules.once(rules.broken(refs, packages, world, disabled=disabled, public_files=public_files)), recorded, world, ignore_recorded)


def judged(found: DataFrame, recorded: DataFrame, world: World = World(), ignore_recorded: bool = False) -> Check:
    """What a check says of ``rules.once(broken)``, which is compared with the record once and looked at three times."""
    both = baseline.compared(found, recorded)
    new = both.where("broken is not null") if ignore_recorded else baseline.fresh(both)
    return Check(rules.told(new, world), baseline.gone(both, recorded), rules.told(baseline.bare(both), world))


def report_lines(result: Check, command: str = "update") -> DataFrame:
    """The text report, (part, line): the count, messages by text, one notice of stale records, strict messages."""
    n = result.reportable.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(0).alias("part"), F.concat(F.col("n").cast("string"), F.lit(" violation(s) detected:")).alias("line"))
    messages = result.reportable.select(F.lit(1).alias("part"), F.col("message").alias("line"))
    old = result.stale.limit(1).select(F.lit(2).alias("part"), F.lit(f"There were stale violations found, please run `{command}`").alias("line"))
    strict = rules.strict_messages(result.strict).select(F.lit(3).alias("part"), F.col("message").alias("line"))
    lines = n.unionByName(messages).unionByName(old).unionByName(strict)
    any_row = [df.select(F.lit(1).alias("x")).limit(1) for df in (result.reportable, result.stale, result.strict)]
    clean = any_row[0].unionAll(any_row[1]).unionAll(any_row[2]).agg(F.count("x").alias("n")).where("n = 0").select(F.lit(0).alias("part"), F.lit("No violations detected!").alias("line"))
    return lines.unionByName(clean).orderBy("part", "line")


def _found_fields() -> list:
    """Fields of a violation in a document, as other tools read them."""
    text = [names.strip_ansi(F.col("message")).alias("message"), F.col("file"), F.col("line"), F.col("col").alias("column")]
    return [*text, *[F.col(c).alias(k) for c, k in KEYS if c != "file"]]


#: Columns of an identifier and what they are called in a document, in its order. Fixed values.
KEYS = (
    ("violation_type", "violation_type"), ("strict", "strict"), ("file", "file"), ("constant_name", "constant_name"), ("referencing_package", "referencing_pack_name"), ("defining_package", "defining_pack_name"),
)
#: Parts of a document: the kind of its rows, and the key it stands under.
PARTS = (("violation", "violations"), ("stale", "stale_violations"), ("strict", "strict_mode_violations"))


def report_json(result: Check) -> DataFrame:
    """One JSON object a violation, stale record and strict violation, (kind, at, json), ``at`` to be sorted by; without terminal colours."""
    identifier = [F.col(c).alias(k) for c, k in KEYS]

    def rows(df: DataFrame, kind: str, fields: list, at) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), at.alias("at"), F.to_json(F.struct(*fields)).alias("json"))

    key = F.concat_ws("\0", "file", "constant_name", "violation_type", "referencing_package", "defining_package")
    return rows(result.reportable, "violation", _found_fields(), F.col("message")).unionByName(rows(result.stale, "stale", identifier, key)).unionByName(rows(result.strict, "strict", identifier, key))


def document(result: Check) -> tuple[list, bool]:
    """The pieces of one JSON document of a check (for ``sinks.write_document``: texts, and sorted tables with a separator), and whether
    all is well."""
    rows = settled(report_json(result))
    bad = not rows.isEmpty()
    pieces: list = [f'{{"status":"{"failure" if bad else "success"}"']
    for kind, key in PARTS:
        pieces += [f',"{key}":[', (rows.where(F.col("kind") == kind).orderBy("at", "json").select("json"), ","), "]"]
    return [*pieces, "}"], not bad


def references_document(refs: DataFrame) -> list:
    """The pieces of one JSON document {file: {constant: its file}} of all files with resolved references."""
    constants = F.map_from_entries(F.transform("constants", lambda c: F.struct(c["constant_name"], c["defining_file"])))
    name = F.substring(F.to_json(F.array("referencing_file")), 2, 1 << 30)
    entry = F.concat(F.substring(name, 1, F.length(name) - 1), F.lit(":"), F.to_json(constants))
    return ["{", (usage.reference_map(refs).orderBy("referencing_file").select(entry.alias("json")), ","), "}"]


def references_lines(refs: DataFrame) -> DataFrame:
    """The same map as text, (line): each file and, below it, what its constants mean."""
    below = F.transform("constants", lambda c: F.concat(F.lit("  "), c["constant_name"], F.lit(" => "), c["defining_file"]))
    return usage.reference_map(refs).orderBy("referencing_file").select(F.array_join(F.concat(F.array(F.concat("referencing_file", F.lit(":"))), below), "\n").alias("line"))


def redefinitions_document(found: DataFrame, stdlib: str, gems: str) -> list:
    """The pieces of the report of what the application defines again, in three parts: the standard library's, gems', its own."""
    link = F.concat(F.lit("["), F.col("path"), F.lit("]("), F.col("path"), F.lit(")"))
    name = F.concat(F.lit("- `"), F.col("fq_name"), F.lit("`"))
    line = F.concat(name, F.when(F.col("kind") == "gem", F.concat(F.lit(" (from gem `"), F.col("gem"), F.lit("`)"))).otherwise(F.lit("")), F.lit(" is redefined at "), link, F.lit("\n"))
    rows = settled(found.select("kind", "fq_name", "path", line.alias("line")))
    part = lambda kind: (rows.where(F.col("kind") == kind).orderBy("fq_name", "path").select("line"), "")
    begin, end = "<details>\n<summary>Click here</summary>\n\n", "</details>"
    return [
        "The following is a list of constants that are redefined by your app.\n\n# Ruby Standard Library\n"
        f"These monkey patches redefine behavior in the Ruby standard library (as determined by parsing the contents of `{stdlib}`):\n\n{begin}",
        part("ruby"), f"{end}\n\n# Gems\nThese monkey patches redefine behavior in gems your app depends on (as determined by parsing the contents of `{gems}`):\n{begin}",
        part("gem"), f"{end}\n\n# Application\nThese monkey patches redefine behavior in a pack within your app (as determined by parsing your app's packs):\n{begin}", part("application"), end,
    ]


@dataclass(frozen=True)
class Scope:
    """What an update is narrowed to: the files looked at, and of their violations a constant, a type, a defining package."""

    files: DataFrame | None = None
    constant: str | None = None
    violation_type: str | None = None
    defining_package: str | None = None

    def narrow(self) -> bool:
        return any(x is not None for x in (self.files, self.constant, self.violation_type, self.defining_package))


@dataclass(frozen=True)
class Update:
    """The record after an update, and the strict violations that it cannot hold."""

    record: DataFrame
    strict: DataFrame


def update(refs: DataFrame, packages: DataFrame, record: DataFrame, world: World = World(), scope: Scope = Scope(), public_files: DataFrame | None = None, disabled: tuple[str, ...] = ()) -> Update:
    """What is found, by the same rules as ``check`` finds it, as a record: in place of ``record``, or, where the update is narrowed,
    merged with it. A type of violation that no rule has is an error."""
    if scope.violation_type is not None and scope.violation_type not in {r.name for r in rules.RULES}:
        raise ValueError(f"No rule is called {scope.violation_type}")
    if scope.files is not None:
        refs = refs.join(scope.files.select(F.col("path").alias("referencing_file")).distinct(), "referencing_file", "left_semi")
    found = rules.broken(refs, packages, world, disabled=disabled, public_files=public_files)
    found = baseline.narrowed(found, scope.constant, scope.violation_type, scope.defining_package)
    new = baseline.gathered(found)
    return Update(baseline.merged(record, new) if scope.narrow() else new, rules.told(rules.once(rules.breaking(found, rules.STRICT)), world))
