"""Rules, baseline, graph and resolution on small worlds and against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fenceline import queries
from fenceline.functions import globs, names
from fenceline.operators import baseline, graph, resolve, rules, usage
from fenceline.operators.rules import World
from fenceline.plans import commands
from fenceline.schema import PACKAGES, REFERENCES

EMPTY = dict.fromkeys(PACKAGES.names)


def package(name, **kw):
    return EMPTY | {"name": name, "parent": name.rpartition("/")[0] or "."} | kw


def world(spark, package_rows, refs):
    p = spark.createDataFrame([tuple(x[c] for c in PACKAGES.names) for x in package_rows], PACKAGES)
    return p, spark.createDataFrame(refs, REFERENCES)


def ref(constant="::Bar", definer="packages/bar", user="packages/foo", file=None, line=3, col=4):
    return (constant, definer, file or (definer and f"{definer}/app/services/bar.rb"), user, f"{user}/app/services/foo.rb", line, col)


def kinds(spark, package_rows, refs, w=World(), **kw):
    p, r = world(spark, package_rows, refs)
    return sorted((x["violation_type"], x["strict"]) for x in rules.violations(r, p, w, **kw).collect())


def test_flagship_world(spark):
    package_rows = [package("."), package("packages/foo", enforce_dependency="true", enforce_privacy="true", dependencies=["packages/baz"]), package("packages/bar", enforce_privacy="true"), package("packages/baz")]
    p, r = world(spark, package_rows, [ref(), ref("::Baz", "packages/baz"), ref("::Nowhere", None)])
    found = rules.violations(r, p)
    out = commands.report_lines(commands.Check(found, found.limit(0), found.where("strict"))).collect()
    place = "\x1b[36mpackages/foo/app/services/foo.rb\x1b[0m:3:4\n"
    assert [x["line"] for x in out] == [
        "2 violation(s) detected:",
        place + "Dependency violation: `::Bar` belongs to `packages/bar`, but `packages/foo/package.yml` does not specify a dependency on `packages/bar`.",
        place + "Privacy violation: `::Bar` is private to `packages/bar`, but referenced from `packages/foo`",
    ]


@pytest.mark.parametrize(
    "definer, user, want",
    [
        ({"enforce_privacy": "true"}, {}, ["privacy"]),
        ({"enforce_privacy": "false"}, {}, []),
        ({"enforce_privacy": None}, {}, []),
        ({"enforce_privacy": "true", "public_folder": "packages/bar/app/serv"}, {}, []),  # a prefix of text, not of parts
        ({"enforce_privacy": "true", "private_constants": ["::Bar"]}, {}, ["privacy"]),
        ({"enforce_privacy": "true", "private_constants": ["::Ba"]}, {}, []),
        ({"enforce_privacy": "true", "private_constants": ["::Other"]}, {}, []),
        ({"enforce_privacy": "true"}, {"ignored_private_constants": ["::Bar"]}, []),
        ({"enforce_visibility": "true"}, {}, ["visibility"]),
        ({"enforce_visibility": "true", "visible_to": ["packages/foo"]}, {}, []),
        ({"enforce_visibility": "true", "visible_to": ["packages/x"]}, {}, ["visibility"]),
        ({"enforce_folder_privacy": "true"}, {}, []),  # siblings
        ({}, {"enforce_dependency": "true", "dependencies": ["packages/bar"]}, []),
        ({}, {"enforce_dependency": "true", "ignored_dependencies": ["packages/bar"]}, []),
        ({"layer": "product"}, {"layer": "tooling", "enforce_layer": "true"}, []),
        ({"layer": "tooling"}, {"layer": "product", "enforce_layer": "true"}, ["layer"]),
        ({"layer": None}, {"layer": "product", "enforce_layer": "true"}, []),
        ({"enforce_privacy": "true", "ignore_rules": [(["privacy"], ["^.*foo\\.rb$"], [], "")]}, {}, []),
        ({"enforce_privacy": "true", "ignore_rules": [(["privacy"], ["^.*foo\\.rb$"], ["^.*services.*$"], "")]}, {}, ["privacy"]),
        ({"enforce_privacy": "true", "ignore_rules": [(["privacy"], ["^nothing$"], [], ""), (["privacy"], ["^.*$"], [], "")]}, {}, ["privacy"]),  # only the first rule counts
    ],
)
def test_rule_matrix(spark, definer, user, want):
    package_rows = [package("packages/bar", **definer), package("packages/foo", **user)]
    assert [k for k, _ in kinds(spark, package_rows, [ref()], World(("tooling", "product")))] == want


def test_folder_privacy_table(spark):
    cases = [("packages/a", "packages/a/b", True), ("packages/a/b", "packages/a", False), ("packages/a/b", "packages/a/c", True), (".", "packages/x/y", True), ("packages/foo", "packages/foobar/x", True), ("packages/q/r", "packages/z", False)]
    for user, definer, visible in cases:
        package_rows = [package(user), package(definer, enforce_folder_privacy="strict")]
        assert kinds(spark, package_rows, [ref("::X", definer, user)]) == ([] if visible else [("folder_privacy", True)]), (user, definer)


def test_public_marks_and_switches(spark):
    package_rows = [package("packages/bar", enforce_privacy="true"), package("packages/foo", enforce_dependency="strict")]
    marked = spark.createDataFrame([("packages/bar/app/services/bar.rb",)] * 2, "path string")
    assert kinds(spark, package_rows, [ref(), ref()], public_files=marked) == [("dependency", True)]
    assert kinds(spark, package_rows, [ref()], disabled=["dependency"]) == [("privacy", False)]
    assert kinds(spark, package_rows, []) == [] and kinds(spark, package_rows, [ref()], only=[]) == []


def test_unknown_rules_are_errors():
    for kw in ({"only": ["odd"]}, {"disabled": ["odd"]}):
        with pytest.raises(ValueError, match="odd"):
            rules.violations(None, None, **kw)


def test_strict_is_reportable_strict_and_stale(spark):
    package_rows = [package("packages/bar"), package("packages/foo", enforce_dependency="strict")]
    p, r = world(spark, package_rows, [ref()])
    found = rules.violations(r, p)
    recorded = baseline.unnest(spark.createDataFrame([("packages/foo", "packages/bar", "::Bar", ["dependency"], ["packages/foo/app/services/foo.rb"])], "referencing_package string, defining_package string, constant_name string, violations array<string>, files array<string>"))
    assert baseline.reportable(found, recorded).count() == baseline.stale(found, recorded).count() == 1
    assert baseline.violation_count(found, recorded).first()[0] == 3 and baseline.grouped(found).count() == 0


def record(spark, rows):
    return spark.createDataFrame(rows, "referencing_package string, defining_package string, constant_name string, violations array<string>, files array<string>")


def test_merge_and_stats(spark):
    a = record(spark, [("p", "q", "::A", ["privacy"], ["f1"]), ("r", "q", "::A", ["privacy"], ["f1", "f2"])])
    b = record(spark, [("p", "q", "::A", ["dependency"], ["f2"]), ("s", "q", "::B", ["dependency"], ["f3"])])
    m = {r["referencing_package"]: (r["violations"], r["files"]) for r in baseline.merged(a, b).collect()}
    assert m == {"p": (["dependency", "privacy"], ["f1", "f2"]), "r": (["privacy"], ["f1", "f2"]), "s": (["dependency"], ["f3"])}
    assert baseline.update_stats(a, b).first().asDict() == {"violations_added": 1, "violations_removed": 2, "files_added": 1, "files_changed": 1, "files_deleted": 1}


# resolution


def test_stats_brute_force_without_gathering_packages(spark):
    rng = random.Random(5)
    draw = lambda: [(f"p{p}", f"d{d}", f"::C{c}", sorted(rng.sample("ab", rng.randrange(1, 3))), sorted(rng.sample("xyz", rng.randrange(1, 4)))) for p in rng.sample(range(30), 22) for d in range(2) for c in range(2) if rng.random() < 0.6]
    old, new = draw(), draw()
    new = [r for r in new if r[0] not in ("p1", "p2", "p3")] + [r for r in old if r[0] in ("p1", "p2", "p3")]
    by = lambda rows: {p: [r for r in rows if r[0] == p] for p in {r[0] for r in rows}}
    a, b = by(old), by(new)
    n = lambda side, p: sum(len(r[4]) for r in side.get(p, []))
    out = baseline.update_stats(record(spark, old), record(spark, new))
    want = {
        "violations_added": sum(max(n(b, p) - n(a, p), 0) for p in a | b), "violations_removed": sum(max(n(a, p) - n(b, p), 0) for p in a | b), "files_added": len(b.keys() - a.keys()),
        "files_changed": sum(sorted(a[p]) != sorted(b[p]) for p in a.keys() & b.keys()), "files_deleted": len(a.keys() - b.keys()),
    }
    assert out.first().asDict() == want
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["unnecessary_dependencies", "intersect_files", "unnecessary_dependencies_all", "intersect_files_all", "update_stats"])
def test_queries_of_whole_tables_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("nation", "region", "lineitem", "orders", "customer", "supplier", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchall()
    assert want and sorted(tuple(r) for r in queries.queries()[name](spark, folder).collect()) == sorted(want)


def ladder(name, space, defined, truncate):
    plain, path = (name[2:], []) if name.startswith("::") else (name, space)
    parts = plain.split("::")
    for i in range(len(parts), 0, -1) if truncate else [len(parts)]:
        for j in range(len(path), -1, -1):
            if "::" + "::".join(path[:j] + parts[:i]) in defined:
                return "::" + "::".join([*path[:j], plain]), "::" + "::".join(path[:j] + parts[:i])
    return None


def test_ladders_brute_force(spark):
    rng = random.Random(1)
    letters = "ABCD"
    some = lambda n: "::".join(rng.choice(letters) for _ in range(rng.randrange(1, n)))
    defined = {"::" + some(4): f"f{k}.rb" for k in range(20)}
    rows = [(i, ("::" if rng.random() < 0.2 else "") + some(4), [rng.choice(letters) for _ in range(rng.randrange(3))]) for i in range(300)]
    refs = spark.createDataFrame(rows, "ref_id long, name string, namespace array<string>")
    constants = spark.createDataFrame([*defined.items(), *((n, "more/" + f) for n, f in defined.items())], "fq_name string, defining_file string")
    one = {r["ref_id"]: (r["constant_name"], r["defining_file"]) for r in resolve.resolve_first(refs, constants.where("not startswith(defining_file, 'more')")).collect()}
    many = {}
    for r in resolve.resolve_all(refs, constants).collect():
        many.setdefault(r["ref_id"], set()).add((r["constant_name"], r["defining_file"]))
    for i, name, space in rows:
        hit = ladder(name, space, defined, True)
        assert one[i] == ((hit[0], defined[hit[1]]) if hit else (name, None))
        hit = ladder(name, space, defined, False)
        assert many.get(i, set()) == ({(hit[0], defined[hit[1]]), (hit[0], "more/" + defined[hit[1]])} if hit else set())


def test_owners_and_roots(spark):
    files = spark.createDataFrame([(x,) for x in ("a.rb", "packages/foo/x/y.rb", "packages/foobar/z.rb", "packages/foo/in/ner/q.rb", "packages/foo/app/models/concerns/deep_one/two.rb", "packages/foo/app/models/api_key.rb")], "path string")
    dirs = spark.createDataFrame([(x,) for x in (".", "packages/foo", "packages/foo/in")], "directory string")
    owner = lambda *a: {r["path"]: r["package"] for r in resolve.file_owner(files, dirs, *a).collect()}
    got = owner()
    assert (got["a.rb"], got["packages/foobar/z.rb"], got["packages/foo/in/ner/q.rb"]) == (".", ".", "packages/foo/in")
    admitted = spark.createDataFrame([(".",), ("packages/foo",)], "name string")
    assert owner(admitted)["packages/foo/in/ner/q.rb"] is None
    roots = resolve.default_roots(files, dirs)
    assert {r["directory"] for r in roots.collect()} == {"packages/foo/app/models", "packages/foo/app/models/concerns"}
    got = {r["fq_name"] for r in resolve.inferred_constants(files, roots, ["API"]).collect()}
    assert got == {"::DeepOne::Two", "::APIKey"}
    over = spark.createDataFrame([("packages/foo/app/models", "::Shop"), ("packages/foo/app/models/concerns", "::Object")], "directory string, namespace string")
    assert {r["fq_name"] for r in resolve.inferred_constants(files, resolve.with_overrides(roots, over)).collect()} == {"::DeepOne::Two", "::Shop::ApiKey"}


# graph


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "from_package string, to_package string")


def test_closure_and_components_brute_force(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(14)]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(22)]
    reach = {(a, b) for a, b in pairs if a != b}
    for k, i, j in itertools.product(nodes, nodes, nodes):
        if (i, k) in reach and (k, j) in reach:
            reach.add((i, j))
    e = edges_of(spark, pairs)
    assert {tuple(r) for r in graph.closure(e).collect()} == reach
    want = {a: min(x for x in nodes if x == a or ((a, x) in reach and (x, a) in reach)) for a in nodes if any((a, x) in reach and (x, a) in reach for x in nodes if x != a)}
    assert {r["package"]: r["component"] for r in graph.strong_components(e).collect()} == want


def test_validators(spark):
    package_rows = [package("a", enforce_dependency="strict"), package("b", enforce_dependency="strict"), package("c"), package("d", enforce_layer="true"), package("e", layer="odd")]
    p, _ = world(spark, package_rows, [])
    e = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"), ("e", "e")])
    out = sorted((r["error_type"], r["message"]) for r in graph.validate(p, e, World(("low",))).collect())
    assert out == [
        ("cycle", "Dependency cycle detected: c -> d, d -> c"),
        ("layer", "'layer' must be specified in 'd/package.yml' because `enforce_layers` is true or strict."),
        ("layer", "Invalid 'layer' option in 'e/package.yml'. `layer` must be one of the layers defined in the configuration"),
        ("self_dependency", "Package cannot list itself as a dependency: e/package.yml"),
        ("strict_transitive", "a has `enforce_dependencies: strict` but has a non-strict transitive dependency: a -> b -> c"),
        ("strict_transitive", "b has `enforce_dependencies: strict` but has a non-strict transitive dependency: b -> c"),
    ]
    wrong = graph.validate(p, edges_of(spark, [("a", "zz"), ("a", "a")]), World()).where("error_type <> 'layer'").collect()
    assert [r["error_type"] for r in wrong] == ["configuration"]
    assert graph.validate(p.where("name in ('a', 'c')"), edges_of(spark, []), World()).count() == 0


# use, names, globs


def test_redefinitions_and_users(spark):
    d = spark.createDataFrame([("::A", "/ruby/a.rb"), ("::A", "/app/a.rb"), ("::B", "/gems/g1/b.rb"), ("::B", "/app/b.rb"), ("::C", "/app/c1.rb"), ("::C", "/app/c2.rb"), ("::D", "/app/d.rb")], "fq_name string, path string")
    assert sorted((r["fq_name"], r["kind"], r["gem"] or "") for r in usage.redefinitions(d, "/ruby", "/gems").collect()) == [("::A", "ruby", ""), ("::B", "gem", "g1"), ("::C", "application", ""), ("::C", "application", "")]
    _, r = world(spark, [], [ref(), ref(user="packages/bar"), ref(user="packages/x")])
    assert {tuple(x) for x in usage.constant_users(r, "::Bar").select("defining_package", "referencing_package").collect()} == {("packages/bar", "packages/foo"), ("packages/bar", "packages/x")}


def test_names(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    for raw, want in {"ab_cd/ef": "AbCd::Ef", "api/csv_row": "API::CSVRow"}.items():
        assert one(names.camelize(F.lit(raw), ["API", "CSV"])) == want
    for raw, want in {"users": "User", "statuses": "Status", "census": "Census", "leaves": "Leave", "data": "Datum", "categories": "Category", "boxes": "Box", "status": "Status", "my_companies": "MyCompany"}.items():
        assert one(names.class_case(F.lit(raw))) == want, raw
    assert one(names.strip_ansi(names.location(F.lit("f.rb"), F.lit(1), F.lit(2)))) == "f.rb:1:2\n"
    assert one(names.spec_path(F.lit("packages/a/app/x/y.rb"))) == "packages/a/spec/x/y_spec.rb"
    assert one(names.absolute_path(F.lit("a"), "/r/")) == "/r/a" and one(names.absolute_path(F.lit("/a"), "/r")) == "/a"
    assert one(names.nesting(F.array().cast("array<string>"))) == []


@pytest.mark.parametrize("glob, path, want", [("**/*.rb", "a.rb", True), ("**/*.rb", "a/b/c.rb", True), ("*.rb", "a/b.rb", False), ("{a,b}/**/*", "b/c/d", True), ("{a,b}/**/*", "c/d", False), ("a/?.rb", "a/x.rb", True), ("a/[!x].rb", "a/x.rb", False), ("a.b", "axb", False)])
def test_path_globs(spark, glob, path, want):
    assert spark.range(1).select(F.lit(path).rlike(globs.path_glob(glob)).alias("x")).first()["x"] is want


def test_name_globs():
    deny, allow = globs.split_rules(["**", "!a/*", "x/*.rb"])
    assert len(deny) == 2 and len(allow) == 1
    import re

    assert re.match(globs.name_glob("a/*"), "a/b/c") and not re.match(globs.name_glob("a/*"), "b/a/c")


@pytest.mark.parametrize("many, one_", [("movies", "Movie"), ("series", "Series"), ("news", "News"), ("wolves", "Wolf"), ("people", "Person"), ("my_users", "MyUser"), ("companies", "Company"), ("addresses", "Address"), ("boxes", "Box"), ("statuses", "Status"), ("heroes", "Hero"), ("invoices", "Invoice"), ("children", "Child"), ("analyses", "Analysis"), ("caches", "Cache"), ("bus_stops", "BusStop")])
def test_singulars(spark, many, one_):
    assert spark.range(1).select(names.class_case(F.lit(many))).first()[0] == one_


def test_unknown_layers_and_packages_are_errors(spark):
    layered = [package("packages/foo", layer="odd", enforce_layer="true"), package("packages/bar", layer="product")]
    with pytest.raises(Exception, match="Could not find one of layer `odd` or layer `product`"):
        kinds(spark, layered, [ref()], World(("product", "tooling")))
    quiet = [package("packages/foo", layer="odd"), package("packages/bar", layer="product")]
    assert kinds(spark, quiet, [ref()], World(("product", "tooling"))) == []
    with pytest.raises(Exception, match="No package found 'packages/bar'"):
        kinds(spark, [package("packages/foo")], [ref()])


def test_a_name_of_two_files_is_an_error(spark):
    refs = spark.createDataFrame([(1, "A", None)], "ref_id int, name string, namespace array<string>")
    one = spark.createDataFrame([("::A", "a.rb"), ("::A", "a.rb"), ("::B", "b.rb")], "fq_name string, defining_file string")
    assert [tuple(r) for r in resolve.resolve_first(refs, one).collect()] == [(1, "::A", "a.rb")]
    with pytest.raises(Exception, match="two files define ::A: a.rb, c.rb"):
        resolve.resolve_first(refs, one.unionByName(spark.createDataFrame([("::A", "c.rb")], one.schema))).collect()


def test_shown_values_may_hold_any_text(spark):
    """Texts are filled, not parsed again: percent signs and backticks in names stay."""
    package_rows = [package("packages/foo", enforce_dependency="strict"), package("packages/b%s")]
    p, r = world(spark, package_rows, [ref("::B%d`", "packages/b%s")])
    found = rules.violations(r, p)
    assert "`::B%d`` belongs to `packages/b%s`, but `packages/foo/package.yml` does" in found.first()["message"]
    assert rules.strict_messages(found).first()[0] == "packages/foo cannot have dependency violations on packages/b%s because strict mode is enabled for dependency violations in the enforcing pack's package.yml file"


# strong components without reachable sets


def components_brute(edges):
    """{node: least member} of nodes on a cycle with another, by two searches a node."""
    out, back = {}, {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            back.setdefault(b, set()).add(a)

    def reach(start, ways):
        seen, todo = set(), [start]
        while todo:
            for y in ways.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    both = {v: reach(v, out) & reach(v, back) | {v} for v in {*out, *back}}
    return {v: min(c) for v, c in both.items() if len(c) > 1}


def components(spark, edges):
    return {r["package"]: r["component"] for r in graph.strong_components(spark.createDataFrame(edges, "from_package string, to_package string")).collect()}


def test_strong_components_brute_force(spark):
    rng = random.Random(11)
    edges = [("a", "a"), ("b", None), (None, "b"), ("x", "y"), ("x", "y")]
    for g, (n, m) in enumerate([(8, 6), (8, 9), (12, 14), (12, 20), (20, 24), (20, 45), (30, 33), (6, 25)]):  # many graphs at once
        edges += [(f"g{g:02d}n{rng.randrange(n):02d}", f"g{g:02d}n{rng.randrange(n):02d}") for _ in range(m)]
    rng.shuffle(edges)
    clean = [(a, b) for a, b in edges if a and b]
    assert components(spark, edges) == components_brute(clean)
    assert components(spark, [("a", "b")]) == {} and components(spark, [("b", "a"), ("a", "b")]) == {"a": "a", "b": "a"}


def test_strong_components_of_a_long_chain(spark):
    """A chain, rings on and off it, and a way back over a part of it: pointers double along, no reachable sets."""
    n = 3000
    name = lambda k: f"n{k:05d}"
    edges = [(name(k), name(k + 1)) for k in range(n)] + [(name(900), name(100)), (name(n), "ring0"), ("ring0", "ring1"), ("ring1", "ring2"), ("ring2", "ring0")]
    edges += [("side0", "side1"), ("side1", "side0"), ("side1", name(5)), (name(2500), "spur0"), ("spur0", "spur1"), ("spur1", name(2400))]
    want = {name(k): name(100) for k in range(100, 901)} | {name(k): name(2400) for k in range(2400, 2501)} | {"spur0": name(2400), "spur1": name(2400)}
    want |= {f"ring{k}": "ring0" for k in range(3)} | {"side0": "side0", "side1": "side0"}
    assert components(spark, edges) == want


@pytest.mark.parametrize("name", ["cycles", "validate", "validate_unknown", "behaviour_definitions", "duplicates", "root_overrides"])
def test_queries_against_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.queries()[name](spark, folder)
    want = c.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [tuple(r[x] for x in columns) for r in got.collect()]
    text = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(text, rows)) == sorted(map(text, want.select(*map(duckdb.ColumnExpression, columns)).fetchall())) and rows
