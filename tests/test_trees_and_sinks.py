"""The walk of a tree, sinks that write all or nothing, documents, updates, moves and gates, on small trees."""

import json
import os

import pytest
from pyspark.sql import functions as F

from fenceline import cli
from fenceline.operators import gate as gates
from fenceline.plans import commands, moves
from fenceline.plans.project import open_project
from fenceline.sources import files, packages, ruby, sinks, stores


def plant(root, tree):
    for path, text in tree.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


MARKED = {
    "package.yml": "enforce_dependencies: true\n",
    "packages/a/package.yml": "enforce_dependencies: true\ndependencies: []\n",
    "packages/b/package.yml": "enforce_privacy: true\n",
    "packages/c/package.yml": "enforce_dependencies: true\nenforce_privacy: strict\n",
    "packages/a/app/models/uses.rb": "class Uses\n  def go\n    [Alpha, Beta]\n  end\nend\n",
    "packages/a/app/models/more.rb": "class More\n  Beta\nend\n",
    "packages/b/app/models/alpha.rb": "# pack_public: true\nclass Alpha\nend\n",
    "packages/b/app/models/beta.rb": "class Beta\nend\n",
    "packages/c/app/models/third.rb": "class Third\n  Beta\n  Alpha\nend\n",
}


# the walk


def walked(spark, root, pruned=files.PRUNED):
    return {(r["path"], r["size"]) for r in files.tree(spark, str(root), pruned).collect()}


def test_pruned_directories_are_not_listed(spark, tmp_path):
    kept = ["a.rb", "public/a.rb", "log/a.rb", "sorbet/a.rb", "vendor/a.rb", "node_modules/a.rb", "packages/a/app/tmp/x.rb", "packages/a/log/y.rb", "packages/a/empty.rb", "packages/a/ü x.rb"]
    lost = ["public/x/a.rb", "vendor/g/package.yml", "node_modules/m/a.rb", "tmp/x/deep/er/a.rb", "log/x/a.rb"]
    plant(tmp_path, {p: "" if "empty" in p else "x" for p in kept + lost})
    os.chmod(tmp_path / "tmp/x", 0)  # looking into it would be an error, or is not done
    try:
        got = walked(spark, tmp_path)
    finally:
        os.chmod(tmp_path / "tmp/x", 0o755)
    assert got == {(p, 0 if "empty" in p else 1) for p in kept}
    assert {p for p, _ in walked(spark, tmp_path, ())} == {*kept, *lost}
    # what is included is another question than what is pruned
    listed = files.tree(spark, str(tmp_path), (*files.PRUNED, "packages/*/app/**/*"))
    assert {r["path"] for r in files.included(listed).collect()} == {"a.rb", "public/a.rb", "log/a.rb", "sorbet/a.rb", "packages/a/log/y.rb", "packages/a/empty.rb", "packages/a/ü x.rb"}


def test_links_are_followed_once(spark, tmp_path):
    plant(tmp_path, {"real/a.rb": "A", "real/deep/b.rb": "BB"})
    other = tmp_path / "tree"
    plant(other, {"own.rb": "x"})
    (other / "linked").symlink_to(tmp_path / "real")
    (other / "broken").symlink_to(tmp_path / "nowhere")
    (other / "loop").symlink_to(other)
    (other / "file.rb").symlink_to(tmp_path / "real/a.rb")
    assert walked(spark, other, ()) == {("own.rb", 1), ("linked/a.rb", 1), ("linked/deep/b.rb", 2), ("file.rb", 1)}
    assert walked(spark, tmp_path / "gone", ()) == set()


def test_contents_and_packages_of_a_pruned_tree(spark, tmp_path):
    plant(tmp_path, MARKED | {"vendor/x/package.yml": "", "vendor/x/package_todo.yml": "not: [yaml", "boundaries.yml": "exclude: ['packages/c/**/*', '{bin,node_modules,script,tmp,vendor}/**/*']\n", "é.rb": "É = 1\n", "none.rb": ""})
    p = open_project(spark, str(tmp_path))
    assert {r["name"] for r in p.packages.collect()} == {".", "packages/a", "packages/b", "packages/c"}  # a package file lies directly in what is pruned below
    assert {r["path"]: r["text"] for r in p.sources.collect()}.items() >= {"é.rb": "É = 1\n", "none.rb": ""}.items()
    assert "packages/c/app/models/third.rb" not in {r["path"] for r in p.listed.collect()}
    assert p.record.count() == 0
    texts = files.contents(spark.createDataFrame([("é.rb", 6), ("gone.rb", 1)], "path string, size long"), str(tmp_path)).collect()
    assert [(r["path"], bytes(r["content"]).decode()) for r in texts] == [("é.rb", "É = 1\n")]


# update


def test_update_records_what_check_reports(spark, tmp_path, capsys):
    root = ["--root", str(plant(tmp_path, MARKED))]
    assert cli.main([*root, "check"]) == 1
    out = capsys.readouterr().out
    assert "Privacy violation: `::Alpha`" not in out and out.count("Privacy violation: `::Beta`") == 3
    assert cli.main([*root, "update"]) == 0
    assert capsys.readouterr().out == "Successfully updated package_todo.yml files: 7 violation(s) added, 2 file(s) added\n".replace("7", str(sum(len(v["files"]) for f in ("a", "c") for d in packages.load_yaml((tmp_path / f"packages/{f}/package_todo.yml").read_text()).values() for v in d.values())))
    assert cli.main([*root, "check"]) == 0 and "No violations detected!" in capsys.readouterr().out
    cli.main([*root, "update", "--disable", "privacy"])  # as check would not report them either
    assert "privacy" not in (tmp_path / "packages/a/package_todo.yml").read_text()


def test_update_of_files_merges(spark, tmp_path, capsys):
    root = ["--root", str(plant(tmp_path, MARKED))]
    todo = tmp_path / "packages/a/package_todo.yml"
    todo.write_text('---\npackages/old:\n  "::Old":\n    violations:\n    - privacy\n    files:\n    - packages/a/app/models/old.rb\n')
    cli.main([*root, "update", "packages/a/app/models/uses.rb"])
    held = packages.load_yaml(todo.read_text())
    assert held["packages/old"]["::Old"]["files"] == ["packages/a/app/models/old.rb"]
    assert held["packages/b"] == {"::Alpha": {"violations": ["dependency"], "files": ["packages/a/app/models/uses.rb"]}, "::Beta": {"violations": ["dependency", "privacy"], "files": ["packages/a/app/models/uses.rb"]}}
    assert not (tmp_path / "packages/c/package_todo.yml").exists()
    cli.main([*root, "update", "packages/a/app/models/uses.rb", "--whole-packages", "--constant", "::Beta", "--type", "privacy"])
    assert packages.load_yaml(todo.read_text())["packages/b"]["::Beta"]["files"] == ["packages/a/app/models/more.rb", "packages/a/app/models/uses.rb"]
    with pytest.raises(SystemExit):
        cli.main([*root, "update", "--whole-packages"])
    with pytest.raises(ValueError, match="No rule is called nope"):
        cli.main([*root, "update", "--type", "nope"])


def test_update_says_what_it_cannot_record(spark, tmp_path, capsys):
    plant(tmp_path, MARKED | {"packages/b/package.yml": "enforce_privacy: strict\n"})
    assert cli.main(["--root", str(tmp_path), "update"]) == 0
    out = capsys.readouterr().out
    assert out.count("because strict mode is enabled for privacy violations") == 3 and "3 strict mode violation(s) detected. These violations must be fixed for `check` to succeed." in out


# sinks


def groups(spark, rows):
    return spark.createDataFrame(rows, packages.RECORD_SCHEMA)


def test_records_are_written_sorted_and_deleted(spark, tmp_path):
    plant(tmp_path, {"p/gone/package_todo.yml": "---\n", "p/a/package_todo.yml": "old"})
    new = groups(spark, [("p/a", f"p/{d}", f"::C{k}", ["privacy", "dependency"], ["y.rb", "x.rb"]) for d in "cb" for k in range(9)] + [(".", "p/b", "::R", ["layer"], ["r.rb"])]).repartition(7)
    old = groups(spark, [(p, "p/b", "::O", ["layer"], ["o.rb"]) for p in ("p/gone", "p/a")])
    done = sinks.write_records(new, str(tmp_path), old, "run update")
    assert {tuple(r) for r in done.collect()} == {("p/a", "written"), (".", "written"), ("p/gone", "deleted")}
    text = (tmp_path / "p/a/package_todo.yml").read_text()
    assert text == packages.record_text("p/a", [tuple(r)[1:] for r in new.where("referencing_package = 'p/a'").collect()], "run update")
    assert not (tmp_path / "p/gone/package_todo.yml").exists() and (tmp_path / "package_todo.yml").exists()
    assert not [p for p in tmp_path.rglob("*.part")]


def test_a_failed_task_leaves_old_files_whole(spark, tmp_path):
    plant(tmp_path, {"p/a/package_todo.yml": "old a", "p/b/package_todo.yml": "old b", "p/lost/package_todo.yml": "old"})
    fail = F.when(F.col("constant_name") == "::C5", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("constant_name"))
    new = groups(spark, [(p, "p/x", f"::C{k}", ["privacy"], ["f.rb"]) for p, n in (("p/a", 3), ("p/b", 9)) for k in range(n)])
    broken = new.withColumn("constant_name", fail)
    with pytest.raises(Exception, match="lost"):
        sinks._save(broken.repartition(2, "referencing_package").sortWithinPartitions("referencing_package"), sinks.RecordSink, str(tmp_path))
    assert {p: (tmp_path / p / "package_todo.yml").read_text() for p in ("p/a", "p/b", "p/lost")} == {"p/a": "old a", "p/b": "old b", "p/lost": "old"}
    assert not [p for p in tmp_path.rglob("*.part")]


def test_a_record_of_many_groups_is_a_stream(tmp_path):
    """The writer holds one group at a time, whatever a package has."""
    seen = []

    def rows():
        for k in range(20_000):
            seen.append(k)
            yield ("p", ("q", f"::C{k:06d}", ["privacy"], ["f.rb"]))

    pieces = packages.record_pieces(rows())
    for _ in range(5):
        next(pieces)
    assert len(seen) < 6
    assert sum(len(p) for p in pieces) > 1_000_000


def test_documents_are_put_together_in_order(spark, tmp_path):
    rows = spark.range(1000, numPartitions=7).select(F.concat(F.lit("row "), F.lpad(F.col("id").cast("string"), 4, "0")).alias("t")).orderBy("t")
    sinks.write_document(spark, str(tmp_path), "deep/er/doc.txt", ["[", (rows, ","), "|", (rows.limit(0), ","), "|", (rows.where("t < 'row 0002'"), ";"), "]"])
    assert (tmp_path / "deep/er/doc.txt").read_text() == "[" + ",".join(f"row {k:04d}" for k in range(1000)) + "||row 0000;row 0001]"
    assert os.listdir(tmp_path / "deep/er") == ["doc.txt"]


def test_check_document_on_screen_and_in_a_file(spark, tmp_path, capsys):
    root = ["--root", str(plant(tmp_path, MARKED)), "check", "--json"]
    assert cli.main(root) == 1
    shown = json.loads(capsys.readouterr().out)
    assert cli.main([*root, "--output", "report.json"]) == 1
    assert json.loads((tmp_path / "report.json").read_text()) == shown
    assert list(shown) == ["status", "violations", "stale_violations", "strict_mode_violations"]
    messages = [v["message"] for v in shown["violations"]]
    assert messages == sorted(messages) and "\x1b" not in "".join(messages)


# moves


def test_move_with_specs_and_what_is_in_the_way(spark, tmp_path, capsys):
    tree = MARKED | {
        "packages/a/spec/models/uses_spec.rb": "describe Uses", "packages/b/app/models/more.rb": "taken", "app/models/root.rb": "class Root; end\n",
        ".rubocop_todo.yml": "A:\n  Exclude:\n    - 'packages/a/app/models/uses.rb'\n    - \"packages/a/app/models/uses.rb\"\n    - packages/a/app/models/uses.rb.orig\n    - 'app/models/root.rb'\n",
    }
    root = ["--root", str(plant(tmp_path, tree))]
    cli.main([*root, "move", "packages/a", "app/models/root.rb", "--package", "packages/b"])
    out = capsys.readouterr().out.split("\n")
    assert out[1] == "File Operations" and "[SKIP] Not moving packages/a/app/models/more.rb, packages/b/app/models/more.rb already exists" in out
    assert "Moving file packages/a/spec/models/uses_spec.rb to packages/b/spec/models/uses_spec.rb" in out and "Replaced 2 occurrence(s) of packages/a/app/models/uses.rb in .rubocop_todo.yml" in out
    assert (tmp_path / "packages/b/app/models/uses.rb").read_text() == MARKED["packages/a/app/models/uses.rb"] and not (tmp_path / "packages/a/app/models/uses.rb").exists()
    assert (tmp_path / "packages/b/app/models/root.rb").exists() and (tmp_path / "packages/b/app/models/more.rb").read_text() == "taken"
    assert (tmp_path / "packages/a/package.yml").exists() and (tmp_path / "packages/a/app/models/more.rb").exists()
    assert (tmp_path / ".rubocop_todo.yml").read_text().count("packages/b/app/models/uses.rb") == 2 and "uses.rb.orig" in (tmp_path / ".rubocop_todo.yml").read_text()
    with pytest.raises(ValueError, match="package not found"):
        cli.main([*root, "move", "packages/a", "--package", "packages/none"])


def test_a_move_that_was_cut_off_is_finished(spark, tmp_path, capsys):
    root = str(plant(tmp_path, MARKED))
    p = open_project(spark, root)
    listed = p.listed.select("path")
    steps = moves.steps(moves.plan(listed, files.expand(listed, ["packages/a"]), p.packages, "packages/c"), listed)
    journal = moves.begin(steps, root)
    # one rename done, then the crash
    stores.move(root, "packages/a/app/models/uses.rb", "packages/c/app/models/uses.rb")
    stores.write(root, f"{moves.JOURNALS}/open/plan.jsonl", iter([b'{"source":"packages/b/app/models/beta.rb","destination":"x.rb","action":"move"}']))
    assert moves.journals(root) == [journal] and not (tmp_path / moves.JOURNALS / "open").exists()
    cli.main(["--root", root, "list-packages"])
    assert "Moving file packages/a/app/models/more.rb to packages/c/app/models/more.rb" in capsys.readouterr().out
    assert {x.name for x in (tmp_path / "packages/c/app/models").iterdir()} == {"third.rb", "uses.rb", "more.rb"} and (tmp_path / "packages/b/app/models/beta.rb").exists()
    assert moves.journals(root) == []


def test_two_files_for_one_place(spark):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    planned = spark.createDataFrame([("a/x.rb", "c/x.rb"), ("b/x.rb", "c/x.rb"), ("a/gone.rb", "c/gone.rb"), ("a/here.rb", "c/here.rb"), ("a/late.rb", "c/late.rb")], "source string, destination string")
    got = {(r["source"], r["action"]) for r in moves.steps(planned, paths("a/x.rb", "b/x.rb", "a/here.rb", "c/here.rb", "c/late.rb")).collect()}
    assert got == {("a/x.rb", "move"), ("b/x.rb", "skip"), ("a/here.rb", "skip"), ("a/late.rb", "skip")}


# gates, beginnings and reports


def test_gates_name_all_that_is_wrong(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{k % 9}.rb",) for k in range(40)], "file string")
    gates.gate(rows.limit(0), "files")
    with pytest.raises(gates.GateError, match=r"9 files without a package: f0.rb, f1.rb, f2.rb, f3.rb, f4.rb and 4 more \(all in ") as e:
        gates.gate(rows, "files without a package", str(tmp_path / "t"))
    assert e.value.count == spark.read.parquet(e.value.table).count() == 9


def test_files_without_a_package_and_names_of_two_files(spark, tmp_path):
    plant(tmp_path, {k: v for k, v in MARKED.items() if k != "package.yml"} | {"lib/one.rb": "Beta\n", "lib/two.rb": "Alpha\n"})
    with pytest.raises(gates.GateError, match="2 referencing files without a package: lib/one.rb, lib/two.rb"):
        open_project(spark, str(tmp_path)).refs
    plant(tmp_path, MARKED | {"packages/a/app/services/beta.rb": "", "packages/c/app/services/alpha.rb": ""})
    with pytest.raises(gates.GateError, match=r"2 constants that two files define: ::Alpha \(packages/b/app/models/alpha.rb, packages/c/app/services/alpha.rb\)"):
        open_project(spark, str(tmp_path), faults=str(tmp_path / "faults")).constants


def test_paths_are_taken_from_the_top_or_from_the_root(tmp_path):
    assert [cli._below(p, str(tmp_path)) for p in (f"{tmp_path}/a/b.rb", "./a/b.rb", "a/b.rb", "/elsewhere/b.rb")] == ["a/b.rb", "a/b.rb", "a/b.rb", "/elsewhere/b.rb"]
    assert cli._below("hdfs://h/root/a.rb", "hdfs://h/root/") == "a.rb"


def test_init_begins_a_project_once(tmp_path, capsys):
    root = ["--root", str(tmp_path)]
    assert cli.main([*root, "init", "--config", "first.yml"]) == 0 and "first.yml" in capsys.readouterr().out
    assert packages.package_row("package.yml", (tmp_path / "package.yml").read_text())["enforce_dependency"] == "false" and packages.settings((tmp_path / "first.yml").read_text()) == packages.settings(None)
    with pytest.raises(FileExistsError):
        cli.main([*root, "init", "--config", "second.yml"])
    assert not (tmp_path / "second.yml").exists()


def test_the_first_configuration_that_is_there_counts(spark, tmp_path):
    plant(tmp_path, {"package.yml": "", "one.yml": "layers: [a]\n", "two.yml": "layers: [b]\n"})
    assert open_project(spark, str(tmp_path), ("none.yml", "two.yml", "one.yml")).world.layers == ("b",)


def test_report_of_redefinitions(spark, tmp_path, capsys):
    plant(tmp_path / "own", {
        "package.yml": "", "boundaries.yml": "experimental_parser: true\nignored_definitions: {'::Date': [lib/ignored.rb]}\n", "lib/dates.rb": "class Date\n def x; end\nend\nclass String\nend\n", "lib/ignored.rb": "class Date\n def y; end\nend\n",
        "lib/rails.rb": "module Rails\n go\nend\n", "app/a.rb": "class Own\n def a; end\nend\n", "app/b.rb": "class Own\n def b; end\nend\n", "app/c.rb": "class Own\nend\n",
    })
    std, gems = plant(tmp_path / "std", {"date.rb": "class Date\n def z; end\nend\nclass String\n def z; end\nend\n"}), plant(tmp_path / "gems", {"rails/lib/r.rb": "module Rails\n VERSION = 1\n go\nend\n"})
    assert cli.main(["--root", str(tmp_path / "own"), "list-redefinitions", "--stdlib", str(std), "--gems", str(gems)]) == 0
    out = capsys.readouterr().out
    assert f"(as determined by parsing the contents of `{std}`):\n\n<details>\n<summary>Click here</summary>\n\n- `::Date` is redefined at [lib/dates.rb](lib/dates.rb)\n</details>\n\n# Gems\n" in out
    assert "\n- `::Rails` (from gem `rails`) is redefined at [lib/rails.rb](lib/rails.rb)\n</details>\n\n# Application\n" in out
    assert out.endswith("- `::Own` is redefined at [app/a.rb](app/a.rb)\n- `::Own` is redefined at [app/b.rb](app/b.rb)\n</details>\n")


def test_marks_of_templates(spark):
    rows = spark.createDataFrame([("a.rb", "ruby", "# pack_public: true"), ("b.erb", "erb", "x\n" * 9 + "<%# pack_public: true %>"), ("c.erb", "erb", "pack_public: true")], "path string, kind string, text string")
    assert {r["path"] for r in files.public_files(rows).collect()} == {"a.rb", "b.erb"}
    assert {r["path"] for r in files.public_files(rows, definition_mode=True).collect()} == {"a.rb"}
    assert ruby.definitions(ruby.parse(spark.createDataFrame([("t.erb", "erb", "<% class A; go; end %>")], "path string, kind string, text string"))).collect() == []


def test_references_document_is_json(spark):
    refs = spark.createDataFrame([('we"ird.rb', "::A", "a.rb"), ('we"ird.rb', "::B", "b.rb"), ("x.rb", "::A", "a.rb"), ("y.rb", "::A", None)], "referencing_file string, constant_name string, defining_file string")
    text = "".join(p if isinstance(p, str) else p[1].join(r[0] for r in p[0].collect()) for p in commands.references_document(refs))
    assert json.loads(text) == {'we"ird.rb': {"::A": "a.rb", "::B": "b.rb"}, "x.rb": {"::A": "a.rb"}}
