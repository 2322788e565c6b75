"""Checks and updates on a number a reference, held against the same steps on rows of violations; what they write and deal."""

import random
import re

import pytest

from fenceline import queries
from fenceline.operators import baseline, rules
from fenceline.plans import commands
from fenceline.schema import PACKAGES, REFERENCES, VIOLATION

FOLDER = "/root/testdata/sf0.001"
NAMES = ["packages/a", "packages/b", "packages/b/c", "packages/d"]


def drawn(spark, seed=3):
    """Packages, references (some given twice, some with nulls) and a record with odd types and ids that are gone."""
    rng = random.Random(seed)
    pick = lambda: rng.choice(["true", "strict", "false", None])
    rule = (["privacy"], [r"^.*f1\.rb$"], [], "")
    package_rows = [dict.fromkeys(PACKAGES.names) | {"name": n, "parent": n.rpartition("/")[0], "visible_to": NAMES[:1], "dependencies": NAMES[1:2], "ignore_rules": [rule] if n == NAMES[0] else None, **{f"enforce_{k}": pick() for k in ("dependency", "privacy", "visibility", "folder_privacy")}} for n in NAMES]
    refs = []
    for _ in range(300):
        d, r = rng.sample(NAMES, 2)
        refs.append((rng.choice(["::X", "::Y::Z", "::Q%s"]), rng.choice([d, d, d, None]), rng.choice([f"{d}/app/x.rb", f"{d}/app/public/x.rb", None]), r, f"{r}/app/f{rng.randrange(3)}.rb", rng.choice([1, 2, None]), 0))
    p = spark.createDataFrame([tuple(x[c] for c in PACKAGES.names) for x in package_rows], PACKAGES)
    r = spark.createDataFrame(refs, REFERENCES)
    ids = rules.violations(r, p).select("violation_type", "strict", "file", "constant_name", "referencing_package", "defining_package").collect()
    rows = [tuple(x) for x in rng.sample(ids, len(ids) // 2)] + [("odd", False, "f", "::X", "p", "q"), ("odd", True, *ids[0][2:]), ("layer", False, *ids[0][2:]), ("privacy", False, "f", None, "p", "q"), ("privacy", True, "gone", "::X", "p", "q")]
    return p, r, spark.createDataFrame(rows + rows[:5], "violation_type string, strict boolean, file string, constant_name string, referencing_package string, defining_package string")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("seed", [3, 4])
def test_compared_as_rows_are(spark, seed):
    p, r, record = drawn(spark, seed)
    found, slim = rules.violations(r, p), rules.once(rules.broken(r, p))
    result = commands.judged(slim, record)
    assert rows_of(result.reportable) == rows_of(baseline.reportable(found, record).select(*VIOLATION))
    assert rows_of(result.stale) == rows_of(baseline.stale(found, record))
    assert rows_of(result.strict) == rows_of(baseline.strict(found))
    assert rows_of(commands.judged(slim, record, ignore_recorded=True).reportable) == rows_of(found)
    assert rows_of(baseline.tally(baseline.compared(slim, record), record)) == rows_of(baseline.violation_count(found, record))
    empty = record.limit(0)
    assert rows_of(commands.judged(slim, empty).reportable) == rows_of(found) and commands.judged(slim, empty).stale.isEmpty()


def test_gathered_as_rows_are(spark):
    p, r, _ = drawn(spark)
    found, slim = rules.violations(r, p), rules.broken(r, p)
    assert rows_of(baseline.gathered(slim)) == rows_of(baseline.grouped(found))
    for kw in ({"violation_type": "privacy"}, {"constant": "::X"}, {"defining_package": "packages/b", "violation_type": "dependency"}):
        assert rows_of(baseline.gathered(baseline.narrowed(slim, **kw))) == rows_of(baseline.grouped(baseline.scoped(found, **kw)))
    assert rows_of(rules.told(rules.once(rules.breaking(slim, rules.STRICT)))) == rows_of(baseline.strict(found))


def test_report_of_nothing_says_so(spark):
    p, r, record = drawn(spark)
    lines = commands.report_lines(commands.judged(rules.once(rules.broken(r.limit(0), p)), record.limit(0)))
    assert [x["line"] for x in lines.collect()] == ["No violations detected!"]


@pytest.mark.parametrize("name", ["check_report", "update_record", "update_files", "reportable", "check_json_counts", "violation_count", "todo_merge", "update_stats", "stale"])
def test_no_row_a_violation_is_written(spark, monkeypatch, name):
    """Violations have texts and are more than references; what is written before the result has neither."""
    plain = type(spark.range(1))
    written, real = [], plain.checkpoint

    def checkpoint(self, eager=True):
        written.append(self.columns)
        return real(self, eager)

    monkeypatch.setattr(plain, "checkpoint", checkpoint)
    queries.QUERIES[name](spark, FOLDER)
    assert written and not any({"message", "violation_type"} & set(c) for c in written)


def dealt(df) -> list[str]:
    """Exchanges by hash of columns of references."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan) if "constant_name" in x]


def test_each_reference_is_dealt_once(spark):
    assert len(dealt(queries.QUERIES["todo_grouped"](spark, FOLDER))) == 1
    assert len(dealt(queries.QUERIES["all_violations"](spark, FOLDER))) == 1


@pytest.mark.parametrize("name", ["strict", "strict_messages"])
def test_only_strict_references_are_dealt(spark, name):
    out = queries.QUERIES[name](spark, FOLDER)
    out.collect()
    below = out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [", 1)[1].split("Relation", 1)[0]
    assert f"& {rules.STRICT}) = 0)" in below
