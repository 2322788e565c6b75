"""Trees, package files, the Ruby scanner, the cache, commands and the stream, on small trees."""

import json
import pathlib

import pytest
from pyspark.sql import functions as F

from fenceline import cli
from fenceline.plans.project import open_project
from fenceline.schema import PACKAGES, REFERENCES
from fenceline.sources import cache, files, packages, ruby
from fenceline.streaming import incremental

TREE = {
    "package.yml": "",
    "boundaries.yml": "layers: [tooling, product]\ncustom_associations: belongs_to_big\n",
    "packages/foo/package.yml": "enforce_dependencies: true\nenforce_privacy: true\ndependencies: [packages/baz]\nowner: team\nextra: 1\n",
    "packages/bar/package.yml": "enforce_privacy: true\n",
    "packages/baz/package.yml": "",
    "packages/foo/app/services/foo.rb": "module Foo\n  def x\n    ::Bar\n    ::Baz # ::Comment\n    'Nope::Str'\n  end\nend\n",
    "packages/bar/app/services/bar.rb": "class Bar\nend\n",
    "packages/baz/app/services/baz.rb": "# pack_public: true\nclass Baz; end\n",
    "packages/foo/app/views/v.html.erb": "<p><%= Bar.new %></p><% Missing %>",
    "tmp/x.rb": "Bar\n",
    "config/initializers/inflections.rb": "inflect.acronym 'API'\n",
}


@pytest.fixture()
def tree(tmp_path):
    for path, text in TREE.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def found(text, kind=None):
    return [(e.kind, e.name, e.namespace) for e in ruby.scan(text) if e.kind != "behaviour" and kind in (None, e.kind)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Foo", [("reference", "Foo", [])]),
        ("Foo::Bar", [("reference", "Foo::Bar", [])]),
        ("class Foo < Base\n  Inner\nend\nOuter", [("definition", "::Foo", []), ("reference", "Base", []), ("reference", "Inner", ["Foo"]), ("reference", "Outer", [])]),
        ("module A\n class B::C\n  X\n end\nend", [("definition", "::A", []), ("definition", "::A::B::C", ["A"]), ("reference", "X", ["A", "B::C"])]),
        ("class Foo\n class << self\n  def x; Bar if y; end\n end\n Q\nend", [("definition", "::Foo", []), ("reference", "Bar", ["Foo"]), ("reference", "Q", ["Foo"])]),
        ("A = 1\nb = A", [("definition", "::A", []), ("reference", "A", [])]),
        ("x = <<~SQL\n  Foo\nSQL\nBar", [("reference", "Bar", [])]),
        ("# Foo\n'Foo'\n:Foo\n%w[Foo Bar]\n\"a #{Baz} Foo\"\n/Foo/", [("reference", "Baz", [])]),
        ("while x do\n Foo\nend\nBar", [("reference", "Foo", []), ("reference", "Bar", [])]),
        ("class A\n has_many :users\n belongs_to :x, class_name: 'Big::X'\nend", [("definition", "::A", []), ("association", "users", ["A"]), ("reference", "Big::X", ["A"])]),
        ("module M\n def a = 1\n N\nend\nO", [("definition", "::M", []), ("reference", "N", ["M"]), ("reference", "O", [])]),
        ("x.Foo; y::Bar", []),
        ("Foo['bar']::Baz\ndescribed_class::Foo", [("reference", "Foo", [])]),
        ("x = <<~A + <<-'B'\n Foo #{Bar.call(\"#{Deep::Er} Nope #{[{a: In}]}\")}\n A\n #{Raw}\n B\nLast", [("reference", "Bar", []), ("reference", "Deep::Er", []), ("reference", "In", []), ("reference", "Last", [])]),
        ("\"a #{x ? \"b #{Q} }\" : 'c'} \\#{No} #{R}\"; S", [("reference", "Q", []), ("reference", "R", []), ("reference", "S", [])]),
        ("%Q(a (b) #{Foo} c) + %w(No (No) No)\nx %w\ny % B\n%r{#{C}}i", [("reference", "Foo", []), ("reference", "B", []), ("reference", "C", [])]),
        ("a = b / C / D\nfoo /No/, E\nf <<No\n", [("reference", "C", []), ("reference", "D", []), ("reference", "E", [])]),
        ("{a: Foo, 'b': Bar, Baz: 1, \"c#{Q}\": 2}\nx ? A : B", [("reference", n, []) for n in ("Foo", "Bar", "Q", "A", "B")]),
        ("Integer('1'); Foo::Bar('x')\ndef Foo.x(a = 1) = B\nC", [("reference", n, []) for n in ("Foo", "Foo", "B", "C")]),
        ("=begin\nNo\n=end\nA\n__END__\nNo", [("reference", "A", [])]),
        ("class A < Struct.new(:b)\n def self.x=(v)\n  return if B\n end\nend\nC", [("definition", "::A", []), ("reference", "Struct", []), ("reference", "B", ["A"]), ("reference", "C", [])]),
        ("class A\n has_one(:b, -> { x(class_name: 'No') }, as: :c,\n  class_name: 'Far::Off')\n has_many :ds, :class_name => Near.name\nend", [("definition", "::A", []), ("reference", "Far::Off", ["A"]), ("reference", "Near", ["A"]), ("reference", "Near", ["A"])]),
        ("", []),
        ("\"never closed #{ [ 'x", []),
    ],
)
def test_scanner(text, want):
    assert found(text) == want


BODIES = {
    "": False, "def x\nend": True, "def self.x\nend": True, "call_me": True, "private_constant :X": False, "attr_reader :x": True, "class Inner\n def x; end\nend": False, "class << self\n def x; end\nend": True,
    "X = 1": False, "X = Y.new": True, "x = 1": False, "x = 1 + 2": True, "'text'": False, "\"a #{b}\"": True, "F = ->(a) { a }": False, "alias a b": False, "super_thing!": True, "[1, :b, nil]": False, "Other": False, "class Inner < Struct.new(:a)\nend": True,
}


@pytest.mark.parametrize("body", BODIES)
def test_behaviour_makes_a_definition(spark, body):
    text = f"module Foo::Bar\n{body}\nend"
    df = spark.createDataFrame([("a.rb", "ruby", text), ("spec/a.rb", "ruby", text), ("x/spec/b.rb", "ruby", text), ("c_spec.rb", "ruby", text)], "path string, kind string, text string")
    got = {(r["fq_name"], r["defining_file"]) for r in ruby.definitions(ruby.parse(df)).collect()}
    assert (("::Foo::Bar", "a.rb") in got) == BODIES[body]
    assert not {f for n, f in got if n == "::Foo::Bar"} & {"x/spec/b.rb", "c_spec.rb"}
    assert (("::Foo::Bar::Inner", "a.rb") in got) == (body.startswith("class Inner\n def"))
    assert (("::Foo::Bar::X", "a.rb") in got) == body.startswith("X =")


def test_scopes_have_flags_of_their_own():
    text = "class Bar\n  class Baz\n  end\n\n  def hello\n    1\n  end\n  class Boo\n   go\n  end\nend"
    events = ruby.scan(text)
    own = {e.name: e.own for e in events if e.kind == "definition"}
    assert {e.scope for e in events if e.kind == "behaviour"} == {own["::Bar"], own["::Bar::Boo"]}


def test_places_are_ranges_in_bytes():
    (a, b, c) = [e for e in ruby.scan("Foo\n é = Foo::Bar\nclass Über::X\nend\nclass self::Y\nend\nZ") if e.kind != "behaviour"][:3]
    assert tuple(a[3:7]) == (1, 0, 1, 4) and tuple(b[3:7]) == (2, 6, 2, 15)
    assert (c.name, c.line, c.col, c.end_col) == ("::Über::X", 3, 6, 15)
    (d,) = [e for e in ruby.scan("class A\n  has_many :bs, -> { x },\n    as: :c\nend") if e.kind == "association"]
    assert tuple(d[3:7]) == (2, 2, 3, 11)


def test_a_superclass_is_meant_as_outside(spark):
    df = spark.createDataFrame([("a.rb", "ruby", "module M\n class Foo < Bar\n  Bar\n  class In\n   Bar\n   Baz\n  end\n end\n Bar\nend")], "path string, kind string, text string")
    parsed = ruby.parse(df)
    rows = lambda mode: {(r["name"], tuple(r["namespace"]), r["line"]) for r in ruby.unresolved(parsed, definition_mode=mode).collect() if not r["name"].startswith("::")}
    assert rows(False) == {("Bar", ("M",), 2), ("Bar", ("M",), 3), ("Bar", ("M",), 5), ("Baz", ("M", "Foo", "In"), 6), ("Bar", ("M",), 9)}
    assert rows(True) == {("Bar", ("M",), 2), ("Bar", ("M", "Foo"), 3), ("Bar", ("M", "Foo", "In"), 5), ("Baz", ("M", "Foo", "In"), 6), ("Bar", ("M",), 9)}


def test_modes_differ_in_references(spark):
    df = spark.createDataFrame([("a.rb", "ruby", "class Foo < Bar\n Foo\n B = 1\n B\nend")], "path string, kind string, text string")
    path = {(r["name"], tuple(r["namespace"]), r["line"], r["end_col"]) for r in ruby.unresolved(ruby.parse(df)).collect()}
    assert path == {("::Foo", (), 1, 10), ("Bar", (), 1, 16)}
    every = {(r["name"], tuple(r["namespace"]), r["line"]) for r in ruby.unresolved(ruby.parse(df), definition_mode=True).collect()}
    assert every == {("Bar", (), 1), ("Foo", (), 2), ("B", ("Foo",), 4)}


def test_places_and_templates(spark):
    assert [(e.line, e.col) for e in ruby.scan("a\n  Foo\n\n Bar") if e.kind == "reference"] == [(2, 2), (4, 1)]
    df = spark.createDataFrame([("a.html.erb", "erb", "<p>Foo</p>\n<%= Bar %> <%- Baz -%>"), ("x_spec.rb", "ruby", "go"), ("n.rb", "ruby", None)], "path string, kind string, text string")
    out = {(r["path"], r["kind"], r["name"], r["line"], r["col"]) for r in ruby.parse(df).where("kind <> 'behaviour'").collect()}
    assert out == {("a.html.erb", "reference", "Bar", 0, 0), ("a.html.erb", "reference", "Baz", 0, 0)}


def test_local_references_leave(spark):
    df = spark.createDataFrame([("a.rb", "ruby", "class A\n B = 1\n B\n C\n has_many :my_users\nend")], "path string, kind string, text string")
    rows = {(r["name"], r["line"]) for r in ruby.unresolved(ruby.parse(df)).collect()}
    assert rows == {("::A", 1), ("C", 4), ("MyUser", 5)}
    assert {r["fq_name"] for r in ruby.definitions(ruby.parse(df)).collect()} == {"::A", "::A::B"}


def test_first_place_of_a_name_counts(spark):
    text = "class A::B\n A\n ::A::B\nend\nmodule A\n class B\n end\n X\nend\nclass C\n A = 1\n A\nend"
    df = spark.createDataFrame([("a.rb", "ruby", text), ("b.rb", "ruby", "A\nB")], "path string, kind string, text string")
    rows = {(r["path"], r["name"], r["line"]) for r in ruby.unresolved(ruby.parse(df)).collect()}
    # A of lines 5 and 12, A::B of line 6 stand elsewhere first
    assert rows == {("a.rb", "::A::B", 1), ("a.rb", "X", 8), ("a.rb", "::C", 10), ("b.rb", "A", 1), ("b.rb", "B", 2)}


def test_listing_and_packages(spark, tree):
    listed = files.tree(spark, str(tree))
    t = files.contents(listed, str(tree))
    assert {r["path"] for r in files.included(listed).select("path").collect()} == {p for p in TREE if p.endswith((".rb", ".erb")) and not p.startswith("tmp/")}
    p = {r["name"]: r for r in packages.packages(t).collect()}
    assert set(p) == {".", "packages/foo", "packages/bar", "packages/baz"} and p["packages/foo"]["dependencies"] == ["packages/baz"] and p["packages/foo"]["enforce_privacy"] == "true" and p["packages/bar"]["enforce_dependency"] is None
    assert {r["path"] for r in files.public_files(files.sources(files.included(t))).collect()} == {"packages/baz/app/services/baz.rb"}
    assert files.acronyms(TREE["config/initializers/inflections.rb"]) == ["API"] and files.acronyms(None) == []
    replaced = files.override(files.sources(t), "packages/bar/app/services/bar.rb", "Zed")
    assert [r["text"] for r in replaced.where("path like '%bar.rb'").collect()] == ["Zed"]


def test_check_update_and_check_again(spark, tree, capsys):
    root = ["--root", str(tree)]
    assert cli.main([*root, "check"]) == 1
    out = capsys.readouterr().out
    assert out.startswith("4 violation(s) detected:") and out.count("Dependency violation: `::Bar`") == 2 and "Baz" not in out
    assert cli.main([*root, "update"]) == 0
    todo = (tree / "packages/foo/package_todo.yml").read_text()
    assert todo.endswith('---\npackages/bar:\n  "::Bar":\n    violations:\n    - dependency\n    - privacy\n    files:\n    - packages/foo/app/services/foo.rb\n    - packages/foo/app/views/v.html.erb\n')
    assert cli.main([*root, "check"]) == 0 and "No violations detected!" in capsys.readouterr().out
    (tree / "packages/foo/app/services/foo.rb").write_text("")
    assert cli.main([*root, "check"]) == 1 and "stale violations" in capsys.readouterr().out
    (tree / "packages/foo/app/views/v.html.erb").write_text("")
    cli.main([*root, "update"])
    assert not (tree / "packages/foo/package_todo.yml").exists()


def test_other_commands(spark, tree, capsys):
    root = ["--root", str(tree)]
    (tree / "packages/bar/package.yml").write_text("dependencies: [packages/foo, packages/bar]\nlayer: odd\n")
    assert cli.main([*root, "validate"]) == 1
    out = capsys.readouterr().out
    assert "cannot list itself" in out and "Invalid 'layer'" in out
    for args, want in {("list-packages",): "packages/baz", ("list-definitions",): "::Baz packages/baz/app/services/baz.rb", ("for-file", "packages/bar/app/services/bar.rb"): "packages/bar/app/services/bar.rb packages/bar", ("check-unnecessary-dependencies",): "packages/bar -> packages/foo",
                       ("list-dependents", "--package", "packages/baz"): "packages/foo", ("suggest-dependencies", "--package", "packages/foo"): "packages/bar\npackages/baz", ("missing-dependencies-for-constant", "--constant", "::Bar"): "packages/foo packages/bar",
                       ("list-references",): "packages/foo/app/services/foo.rb:\n  ::Bar => packages/bar/app/services/bar.rb"}.items():
        cli.main([*root, *args])
        assert want in capsys.readouterr().out, args


def test_commands_that_write_package_files(spark, tree, capsys):
    root = ["--root", str(tree)]
    cli.main([*root, "add-dependency", "packages/foo", "packages/bar"])
    assert (tree / "packages/foo/package.yml").read_text() == "enforce_dependencies: true\nenforce_privacy: true\ndependencies:\n- packages/bar\n- packages/baz\nowner: team\nextra: 1\n"
    cli.main([*root, "remove-dependency", "packages/foo", "packages/baz"])
    assert "packages/baz" not in (tree / "packages/foo/package.yml").read_text() and (tree / "packages/bar/package.yml").read_text() == "enforce_privacy: true\n"
    cli.main([*root, "create", "packages/new"])
    assert (tree / "packages/new/package.yml").exists()
    with pytest.raises(FileExistsError):
        cli.main([*root, "create", "packages/new"])
    capsys.readouterr()
    cli.main([*root, "plan-move", "packages/bar/app/services/bar.rb", "--package", "packages/new"])
    assert capsys.readouterr().out.strip() == "packages/bar/app/services/bar.rb packages/new/app/services/bar.rb move"


def test_definition_mode(spark, tree):
    (tree / "boundaries.yml").write_text("experimental_parser: true\nignored_definitions: {'::Bar': [packages/foo/app/services/again.rb]}\n")
    (tree / "packages/foo/app/services/again.rb").write_text("class Bar\n def y; end\nend\n")
    (tree / "packages/bar/app/services/bar.rb").write_text("class Bar\n def x; end\nend\n")
    (tree / "packages/baz/app/services/name_only.rb").write_text("class Bar\nend\n")
    p = open_project(spark, str(tree))
    assert {r["defining_file"] for r in p.constants.where("fq_name = '::Bar'").collect()} == {"packages/bar/app/services/bar.rb"}
    assert p.refs.where("defining_file is null").count() == 0


def test_packages_are_listed_longest_first(spark, tree, capsys):
    cli.main(["--root", str(tree), "list-packages"])
    assert capsys.readouterr().out.split() == ["packages/bar", "packages/baz", "packages/foo", "."]


def test_bad_yaml(spark, tmp_path):
    for text in ("a: 1\na: 2\n", "- x\n", "enforce_privacy: maybe\n"):
        with pytest.raises(ValueError):
            packages.package_row("packages/x/package.yml", text)
    with pytest.raises(ValueError):
        packages.load_yaml("a: {b: 1, b: 2}")
    df = spark.createDataFrame([("packages/x/package_todo.yml", bytearray(b"a: [1"))], "path string, content binary")
    with pytest.raises(Exception, match="delete it and run update"):
        packages.record(df).collect()
    assert packages.package_text({"zeta": 1, "dependencies": ["b", "a", "a"], "enforce_privacy": True}) == "enforce_privacy: true\ndependencies:\n- a\n- b\nzeta: 1\n"
    assert packages.settings("include: a/*\n").include == ("a/*",)


def test_cache_parses_only_what_is_new(spark, tmp_path):
    table, seen = str(tmp_path / "cache"), []

    def parse(df):
        seen.append(sorted(r["path"] for r in df.select("path").collect()))
        return ruby.parse(df)

    def frame(rows):
        return spark.createDataFrame(rows, "path string, kind string, text string").withColumn("digest", F.md5("text"))

    first = cache.parsed_with_cache(frame([("a.rb", "ruby", "Foo"), ("b.rb", "ruby", "")]), parse, table).collect()
    second = cache.parsed_with_cache(frame([("a.rb", "ruby", "Foo"), ("b.rb", "ruby", "Bar")]), parse, table).collect()
    assert seen == [["a.rb", "b.rb"], ["b.rb"]] and [r["name"] for r in first] == ["Foo"] and sorted(r["name"] for r in second) == ["Bar", "Foo"]


def test_stream_counts_each_file_once(spark, tmp_path):
    row = ("::Bar", "packages/bar", "packages/bar/app/bar.rb", "packages/foo", "packages/foo/app/foo.rb", 1, 1)
    p = spark.createDataFrame([tuple({"name": n, "enforce_dependency": "true", "parent": "packages"}.get(c) for c in PACKAGES.names) for n in ("packages/foo", "packages/bar")], PACKAGES)
    refs, out, mark = (str(tmp_path / x) for x in ("refs", "out", "mark"))
    for _ in range(2):
        spark.createDataFrame([row], REFERENCES).write.mode("append").parquet(refs)
        incremental.watch(spark, refs, p, out, mark).awaitTermination()
    incremental.watch(spark, refs, p, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_automatic_namespaces(spark, tree):
    """A package may ask that its roots stand for its name; roots that it excludes do not."""
    (tree / "packages/baz/package.yml").write_text("metadata:\n  automatic_pack_namespace: true\n  automatic_pack_namespace_exclusions: [app/models]\n")
    (tree / "packages/baz/app/models").mkdir(parents=True)
    (tree / "packages/baz/app/models/plain.rb").write_text("class Plain; end\n")
    (tree / "packages/bar/app/services/uses.rb").write_text("Baz::Baz\nPlain\n")
    p = open_project(spark, str(tree))
    names = {r["fq_name"]: r["defining_file"] for r in p.constants.collect()}
    assert names["::Baz::Baz"] == "packages/baz/app/services/baz.rb" and names["::Plain"] == "packages/baz/app/models/plain.rb" and names["::Bar"] == "packages/bar/app/services/bar.rb"
    used = {(r["constant_name"], r["defining_package"]) for r in p.refs.where("referencing_file like '%uses.rb'").collect()}
    assert used == {("::Baz::Baz", "packages/baz"), ("::Plain", "packages/baz")}


def test_cache_json_and_directories(spark, tree, tmp_path_factory, capsys):
    folder = str(tmp_path_factory.mktemp("parses"))
    root = ["--root", str(tree), "--cache", folder]
    assert cli.main([*root, "check", "--json", "packages/foo/app"]) == 1
    first = json.loads(capsys.readouterr().out)
    assert first["status"] == "failure" and len(first["violations"]) == 4 and first["stale_violations"] == first["strict_mode_violations"] == []
    assert list(first["violations"][0]) == ["message", "file", "line", "column", "violation_type", "strict", "constant_name", "referencing_pack_name", "defining_pack_name"]
    assert len(list(pathlib.Path(folder).glob("parses-*"))) == 1
    assert cli.main([*root, "check", "--json", "packages/foo/app"]) == 1 and json.loads(capsys.readouterr().out) == first
    assert cli.main([*root, "check", "--json", "packages/bar"]) == 0 and json.loads(capsys.readouterr().out)["status"] == "success"
    cli.main([*root, "list-references", "--json", "--output", "out/references.json"])
    written = json.loads((tree / "out/references.json").read_text())
    assert written["packages/foo/app/services/foo.rb"]["::Bar"] == "packages/bar/app/services/bar.rb" and list(written) == sorted(written)
    capsys.readouterr()
    cli.main([*root, "list-references", "--json"])
    assert json.loads(capsys.readouterr().out) == written
    assert [p.name for p in (tree / "out").iterdir()] == ["references.json"]
    assert cli.main([*root, "delete-cache"]) == 0
    assert not pathlib.Path(folder).exists()


def test_sources_of_one_split_are_parsed_by_all_cores(spark):
    df = spark.range(400, numPartitions=1).selectExpr("concat('p', id, '.rb') as path", "'ruby' as kind", "concat('class A', id, '\\nX = 1\\nend') as text")
    parsed = ruby.parse(df)
    sizes = [n for n in parsed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 3
