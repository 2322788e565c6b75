"""The graph of declared dependencies: closure, cycles, strict paths, and the validators built on them.

Edges are (from_package, to_package). Loops are semi-naive: each round joins only what the last one found, and lineage is
cut between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from .lineage import settled
from .rules import World, unknown_layers


def _edges(edges: DataFrame) -> DataFrame:
    return settled(edges.where("from_package <> to_package").select(F.col("from_package").alias("x"), F.col("to_package").alias("y")).distinct())


def closure(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, target): every package that is reachable by one edge or more. Self edges count for nothing."""
    e = _edges(edges)
    known = frontier = settled(e.select(F.col("x").alias("source"), F.col("y").alias("target")))
    for _ in range(max_rounds):
        step = frontier.join(e, F.col("target") == F.col("x")).select("source", F.col("y").alias("target")).distinct()
        frontier = settled(step.join(known, ["source", "target"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = settled(known.unionByName(frontier))
    raise RuntimeError("the closure did not settle")


def strong_components(edges: DataFrame) -> DataFrame:
    """(package, component) of packages that lie on a cycle with another; a component is named by its least member.

    No set of reachable packages is ever made. Packages that cannot lie on a cycle, for want of an edge in or out, are
    trimmed; chains of packages with one way out are followed to their end by doubling pointers, and stand for it from then
    on; what is left is coloured: the least package that reaches each one, and, backwards inside a colour from it, its
    component. Rows stay in proportion to edges, but for the doubled pointers of a chain (times the logarithm of its
    length); rounds are that logarithm, and the longest path of packages that all have several ways out.
    """
    e = edges.where("from_package is not null and to_package is not null and from_package <> to_package").select(F.col("from_package").alias("x"), F.col("to_package").alias("y"))
    found = _solve(settled(e.distinct()))
    named = found.groupBy("component").agg(F.min("package").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(named, "component").select("package", F.col("least").alias("component"))


def _solve(e: DataFrame) -> DataFrame:
    """(package, component) of distinct edges (x, y); an edge from a package to itself says that it is in a component."""
    loops = e.where("x = y").select(F.col("x").alias("package"), F.col("x").alias("component"))
    g = _trimmed(e.where("x <> y"))
    if g.isEmpty():
        return loops
    ways = g.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("to"))
    single = settled(ways.where("n = 1").select(F.col("x").alias("v"), "to"))
    inner = _coloured(g) if single.isEmpty() else _contracted(g, loops, single)
    return settled(inner.unionByName(loops.join(inner, "package", "left_anti")))


def _trimmed(g: DataFrame) -> DataFrame:
    """Edges without those that lead to a package without a way out or come from one without a way in, as long as there are any."""
    g, n = settled(g), None
    while n != (n := g.count()):
        g = settled(g.join(g.select(F.col("x").alias("y")).distinct(), "y", "left_semi").join(g.select(F.col("y").alias("x")).distinct(), "x", "left_semi").select("x", "y"))
    return g


def _contracted(g: DataFrame, loops: DataFrame, single: DataFrame) -> DataFrame:
    """Components where ``single(v, to)`` have one way out. A cycle through one of them goes on to the end of its chain, so it is left out
    and its edges in lead there; it is in the end's component if a member of that has an edge to it or to one that
    leads to it. Chains that end in a ring of their own make that ring a component."""
    step = single.withColumn("low", F.col("v"))
    steps, rest = [step], 2 * single.count()
    while rest > 1:  # after each round pointers go twice as far, at most to the end of the chain
        on = step.select(F.col("v").alias("to"), F.col("to").alias("on"), F.col("low").alias("low2"))
        step = settled(step.join(on, "to", "left").select("v", F.coalesce("on", "to").alias("to"), F.least("low", "low2").alias("low")))
        steps.append(step)
        rest = 0 if step.join(single.select(F.col("v").alias("to")), "to", "left_semi").isEmpty() else rest // 2
    ring = step.join(step.select(F.col("to").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("package"), F.col("low").alias("component"))
    ends = settled(step.join(single.select(F.col("v").alias("to")), "to", "left_anti").select("v", F.col("to").alias("end")))
    others = g.join(single.select(F.col("v").alias("x")), "x", "left_anti")
    into = settled(others.join(ends.select(F.col("v").alias("y"), "end"), "y"))  # edges to chains from what is none: x, y, end
    plain = others.join(single.select(F.col("v").alias("y")), "y", "left_anti").select("x", "y")
    own = loops.join(single.select(F.col("v").alias("package")), "package", "left_anti").select(F.col("package").alias("x"), F.col("package").alias("y"))
    sub = _solve(settled(plain.unionByName(into.select("x", F.col("end").alias("y"))).unionByName(own).distinct()))
    known = lambda c, name: sub.select(F.col("package").alias(c), F.col("component").alias(name))
    marks = settled(into.join(known("x", "a"), "x").join(known("end", "b"), "end").where("a = b").select(F.col("y").alias("v")).distinct())
    for s in steps if not marks.isEmpty() else []:
        marks = settled(marks.unionByName(marks.join(s, "v").select(F.col("to").alias("v"))).distinct())
    inside = ends.join(marks, "v", "left_semi").join(known("end", "component"), "end").select(F.col("v").alias("package"), "component")
    return sub.unionByName(inside).unionByName(ring)


def _coloured(g: DataFrame) -> DataFrame:
    """Components by colours: each package takes the least one that reaches it; what reaches that one inside the colour is its
    component. The rest, without edges between colours, is solved anew."""
    colours = settled(g.select(F.col("x").alias("package")).union(g.select("y")).distinct().withColumn("colour", F.col("package")))
    frontier = colours
    while not frontier.isEmpty():
        step = frontier.join(g, F.col("package") == F.col("x")).groupBy(F.col("y").alias("package")).agg(F.min("colour").alias("new"))
        frontier = settled(step.join(colours, "package").where("new < colour").select("package", F.col("new").alias("colour")))
        colours = settled(colours.join(frontier, "package", "left_anti").unionByName(frontier))
    side = lambda c, name: colours.select(F.col("package").alias(c), F.col("colour").alias(name))
    same = settled(g.join(side("x", "a"), "x").join(side("y", "b"), "y").where("a = b").select("x", "y"))
    found = frontier = settled(colours.where("package = colour").select("package", F.col("colour").alias("component")))
    while not frontier.isEmpty():
        step = frontier.join(same, F.col("package") == F.col("y")).select(F.col("x").alias("package"), "component").distinct()
        frontier = settled(step.join(found, "package", "left_anti"))
        found = settled(found.unionByName(frontier))
    rest = same.join(found.select(F.col("package").alias("x")), "x", "left_anti").join(found.select(F.col("package").alias("y")), "y", "left_anti")
    return found.unionByName(_solve(settled(rest)))


def self_dependencies(edges: DataFrame) -> DataFrame:
    return edges.where("from_package = to_package").select(F.col("from_package").alias("package")).distinct()


def unknown_targets(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Edges to what is no package; the other validators take it that there are none."""
    return edges.join(packages.select(F.col("name").alias("to_package")), "to_package", "left_anti").select("from_package", "to_package")


def _paths(edges: DataFrame, start: DataFrame, stop_after: DataFrame | None) -> DataFrame:
    """Shortest (source, target, path) from ``start(source)``, the least by text of equals; ``stop_after(target)`` are not left
    again. Level by level, a target is settled the first time it is reached."""
    e = _edges(edges)
    known = frontier = settled(start.select("source", F.col("source").alias("target"), F.array("source").alias("path")))
    while True:
        go = frontier if stop_after is None else frontier.join(stop_after, "target", "left_anti")
        step = go.join(e, F.col("target") == F.col("x")).select("source", F.col("y").alias("target"), F.concat("path", F.array("y")).alias("path"))
        step = step.groupBy("source", "target").agg(F.min("path").alias("path"))
        frontier = settled(step.join(known.select("source", "target"), ["source", "target"], "left_anti"))
        if frontier.isEmpty():
            return known
        known = settled(known.unionByName(frontier))


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(source, target, length) from the packages ``start(source)``, unreachable ones left out, a package itself at 0."""
    return _paths(edges, start, None).select("source", "target", (F.size("path") - 1).cast("long").alias("length"))


def strict_violations(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """(package, path): strict packages that reach one that is not strict (a null setting is not), by the shortest path through
    strict ones; of equally short ones the least."""
    strict = packages.where("enforce_dependency = 'strict'").select(F.col("name").alias("source"))
    loose = packages.where("coalesce(enforce_dependency, 'false') <> 'strict'").select(F.col("name").alias("target"))
    ends = _paths(edges, strict, loose).join(loose, "target", "left_semi").where("source <> target")
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.size("path"), "path"))
    return ends.withColumn("r", first).where("r = 1").select(F.col("source").alias("package"), "path")


def cycles(edges: DataFrame) -> DataFrame:
    """(component, path): for every strong component the shortest cycle from its least member, written without its end."""
    members = settled(strong_components(edges))
    inside = edges.join(members.select(F.col("package").alias("from_package"), "component"), "from_package").join(
        members.select(F.col("package").alias("to_package"), F.col("component").alias("c2")), "to_package"
    ).where("component = c2")
    start = members.select(F.col("component").alias("source")).distinct()
    out = _paths(inside, start, None).alias("p")
    back = inside.select(F.col("from_package").alias("target"), F.col("to_package").alias("source")).where("source <> target").distinct()
    first = F.row_number().over(Window.partitionBy("source").orderBy(F.size("path"), "path"))
    return out.join(back, ["source", "target"], "left_semi").withColumn("r", first).where("r = 1").select(F.col("source").alias("component"), "path")


def validate(packages: DataFrame, edges: DataFrame, world: World = World()) -> DataFrame:
    """(error_type, message, cycle, file) of all validators. An edge to no package is a configuration error, and then the only
    one of the dependency validator."""
    none = F.lit(None).cast("string")
    row = lambda df, kind, message, cycle=None, file=none: df.select(F.lit(kind).alias("error_type"), message.alias("message"), (F.lit(None).cast("array<string>") if cycle is None else cycle).alias("cycle"), file.alias("file"))
    wrong = settled(unknown_targets(edges, packages))
    if not wrong.isEmpty():
        text = F.concat(names.package_file(F.col("from_package")), F.lit(" has a dependency on an unknown package: "), F.col("to_package"))
        return row(wrong, "configuration", text).unionByName(layer_errors(packages, world)).distinct()
    file = names.package_file(F.col("package"))
    ends = F.concat(F.slice("path", F.lit(2), F.size("path")), F.slice("path", F.lit(1), F.lit(1)))
    steps = F.array_join(F.zip_with("path", ends, lambda a, b: F.concat(a, F.lit(" -> "), b)), ", ")
    strict = F.concat("package", F.lit(" has `enforce_dependencies: strict` but has a non-strict transitive dependency: "), F.array_join("path", " -> "))
    out = row(self_dependencies(edges), "self_dependency", F.concat(F.lit("Package cannot list itself as a dependency: "), file), file=file)
    out = out.unionByName(row(cycles(edges), "cycle", F.concat(F.lit("Dependency cycle detected: "), steps), F.col("path")))
    out = out.unionByName(row(strict_violations(edges, packages), "strict_transitive", strict))
    return out.unionByName(layer_errors(packages, world)).distinct()


def layer_errors(packages: DataFrame, world: World, config_file: str = "the configuration") -> DataFrame:
    """Layers that the order does not have, and packages that enforce layers without having one."""
    file = names.package_file(F.col("name"))
    unknown = unknown_layers(packages, world).select(F.concat(F.lit("Invalid 'layer' option in '"), file, F.lit(f"'. `layer` must be one of the layers defined in {config_file}")).alias("message"), file.alias("file"))
    lacking = packages.where("layer is null and coalesce(enforce_layer, 'false') <> 'false'")
    lacking = lacking.select(F.concat(F.lit("'layer' must be specified in '"), file, F.lit("' because `enforce_layers` is true or strict.")).alias("message"), file.alias("file"))
    return unknown.unionByName(lacking).select(F.lit("layer").alias("error_type"), "message", F.lit(None).cast("array<string>").alias("cycle"), "file")
