"""Registered queries of the boundary operators, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import globs, names
from .operators import baseline, graph, resolve, rules, usage
from .operators.lineage import kept
from .plans import commands, moves
from .plans.projection import SQL, WORLD, Tables, recorded
from .sources import ruby

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
IDS = "violation_type, strict, file, constant_name, referencing_package, defining_package"
ALL = f"message, {IDS}, line, col"
ONE = "packages/asia/nation_2"


def query(sql: str | None = None, prefix: bool = True):
    """Register a function of the tables of a folder, and its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            ORACLE[f.__name__] = (SQL if prefix else "") + sql
        return f

    return put


def _broken(t: Tables, **kw) -> DataFrame:
    return rules.broken(t.refs(), t.packages(), WORLD, **kw)


def _found(t: Tables, **kw) -> DataFrame:
    return rules.told(rules.once(_broken(t, **kw)), WORLD)


def _recorded(t: Tables, found: DataFrame | None = None) -> DataFrame:
    """What was recorded, of ``found`` (broken) where it is at hand."""
    return recorded(t, rules.identified(_broken(t) if found is None else found))


# rules


@query(f"SELECT {ALL} FROM violations")
def all_violations(t: Tables) -> DataFrame:
    return _found(t)


def _rule_query(name: str) -> None:
    def f(t: Tables) -> DataFrame:
        return _found(t, only=[name])

    f.__name__ = f"rule_{name}"
    query(f"SELECT {ALL} FROM violations WHERE violation_type = '{name}'")(f)


for _name in ("dependency", "privacy", "visibility", "layer", "folder_privacy"):
    _rule_query(_name)


# baseline


@query(f"SELECT {ALL} FROM violations ANTI JOIN recorded USING ({IDS})")
def reportable(t: Tables) -> DataFrame:
    found = kept(rules.once(_broken(t)))
    return rules.told(baseline.fresh(baseline.compared(found, _recorded(t, found))), WORLD)


@query(f"SELECT {IDS} FROM recorded ANTI JOIN violations USING ({IDS})")
def stale(t: Tables) -> DataFrame:
    found = kept(rules.once(_broken(t), rules.PLACE))  # neither lines nor messages are asked for
    old = _recorded(t, found)
    return baseline.gone(baseline.compared(found, old), old)


@query(f"SELECT {ALL} FROM violations WHERE strict")
def strict(t: Tables) -> DataFrame:
    return rules.told(rules.once(rules.breaking(_broken(t), rules.STRICT)), WORLD)


@query("SELECT referencing_package || ' cannot have ' || violation_type || ' violations on ' || defining_package || ' because strict mode is enabled for ' || violation_type || ' violations in the enforcing pack''s package.yml file' AS message FROM violations WHERE strict")
def strict_messages(t: Tables) -> DataFrame:
    return rules.strict_messages(rules.told(rules.once(rules.breaking(_broken(t), rules.STRICT)), WORLD))


@query(f"SELECT CAST((SELECT count(*) FROM violations ANTI JOIN recorded USING ({IDS})) + (SELECT count(*) FROM recorded ANTI JOIN violations USING ({IDS})) + (SELECT count(*) FROM violations WHERE strict) AS BIGINT) AS n_violations")
def violation_count(t: Tables) -> DataFrame:
    found = kept(rules.once(_broken(t)))
    old = _recorded(t, found)
    return baseline.tally(baseline.compared(found, old), old)


_TEXTS = "referencing_package, defining_package, constant_name, array_to_string(list_sort(violations), ',') AS violations, array_to_string(list_sort(files), ',') AS files"
_GROUPED = "SELECT referencing_package, defining_package, constant_name, list(DISTINCT violation_type) AS violations, list(DISTINCT file) AS files FROM {} WHERE NOT strict GROUP BY ALL"


def _flat(record: DataFrame) -> DataFrame:
    return record.withColumn("violations", F.array_join("violations", ",")).withColumn("files", F.array_join("files", ","))


@query(f"SELECT {_TEXTS} FROM ({_GROUPED.format('violations')})")
def todo_grouped(t: Tables) -> DataFrame:
    return _flat(baseline.gathered(_broken(t)))


_MERGED = f"""SELECT referencing_package, defining_package, constant_name, list_distinct(flatten(list(violations))) AS violations, list_distinct(flatten(list(files))) AS files
FROM ({_GROUPED.format('recorded')} UNION ALL {_GROUPED.format("(SELECT * FROM violations WHERE violation_type = 'layer')")}) GROUP BY ALL"""


@query(f"SELECT {_TEXTS} FROM ({_MERGED})")
def todo_merge(t: Tables) -> DataFrame:
    old = baseline.grouped(_recorded(t))
    return _flat(baseline.merged(old, baseline.gathered(baseline.narrowed(_broken(t), violation_type="layer"))))


@query(f"""SELECT r.violation_type, false AS strict, r.file, r.constant_name, r.referencing_package, r.defining_package FROM recorded r""")
def recorded_unnest(t: Tables) -> DataFrame:
    return baseline.unnest(baseline.grouped(_recorded(t)))


@query(f""", old AS (SELECT {_TEXTS}, len(files) AS n FROM ({_GROUPED.format('recorded')})), new AS (SELECT {_TEXTS}, len(files) AS n FROM ({_GROUPED.format('violations')})),
a AS (SELECT referencing_package, sum(n) AS was, list((defining_package, constant_name, violations, files) ORDER BY defining_package, constant_name) AS w FROM old GROUP BY 1),
b AS (SELECT referencing_package, sum(n) AS now, list((defining_package, constant_name, violations, files) ORDER BY defining_package, constant_name) AS w FROM new GROUP BY 1)
SELECT CAST(sum(greatest(coalesce(now, 0) - coalesce(was, 0), 0)) AS BIGINT) AS violations_added, CAST(sum(greatest(coalesce(was, 0) - coalesce(now, 0), 0)) AS BIGINT) AS violations_removed,
  count(*) FILTER (was IS NULL) AS files_added, count(*) FILTER (was IS NOT NULL AND now IS NOT NULL AND a.w <> b.w) AS files_changed, count(*) FILTER (now IS NULL) AS files_deleted
FROM a FULL JOIN b USING (referencing_package)""")
def update_stats(t: Tables) -> DataFrame:
    return baseline.update_stats(baseline.grouped(_recorded(t)), baseline.gathered(_broken(t)))


# files whose part is a promotion carry the public mark
_MARKED = ", marked AS (SELECT '::Brand' || (p_partkey % 25) || '::Part' || p_partkey AS constant_name FROM part WHERE p_type LIKE 'PROMO%'),\nvisible AS (SELECT * FROM violations v WHERE violation_type <> 'privacy' OR constant_name NOT IN (SELECT constant_name FROM marked))\n"


def _marked(t: Tables) -> DataFrame:
    promoted = t.read("part").where("p_type like 'PROMO%'").select(F.col("p_partkey").alias("n"))
    number = F.regexp_extract("path", "part_([0-9]+)", 1).cast("long")
    return _files(t, "defining_file").withColumn("n", number).join(promoted, "n", "left_semi").select("path")


@query(_MARKED + f"SELECT {ALL} FROM visible")
def public_marks(t: Tables) -> DataFrame:
    """All rules where some defining files carry the public mark."""
    return _found(t, public_files=_marked(t))


@query(_MARKED + f"SELECT {_TEXTS} FROM ({_GROUPED.format('visible')})")
def update_record(t: Tables) -> DataFrame:
    """The record after an update, which sees public marks as a check does."""
    old = baseline.grouped(_recorded(t))
    return _flat(commands.update(t.refs(), t.packages(), old, WORLD, public_files=_marked(t)).record)


_URGENT = "(SELECT * FROM visible WHERE violation_type = 'visibility' AND regexp_extract(file, 'order_([0-9]+)', 1) IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority = '1-URGENT'))"


@query(_MARKED + f"""SELECT {_TEXTS} FROM (SELECT referencing_package, defining_package, constant_name, list_distinct(flatten(list(violations))) AS violations, list_distinct(flatten(list(files))) AS files
FROM ({_GROUPED.format('recorded')} UNION ALL {_GROUPED.format(_URGENT)}) GROUP BY ALL)""")
def update_files(t: Tables) -> DataFrame:
    """The record after an update of one type in the files of urgent orders: merged into what was there."""
    urgent = t.read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("n"))
    files = _files(t).withColumn("n", F.regexp_extract("path", "order_([0-9]+)", 1)).join(urgent, "n", "left_semi").select("path")
    old = baseline.grouped(_recorded(t))
    return _flat(commands.update(t.refs(), t.packages(), old, WORLD, commands.Scope(files, violation_type="visibility"), _marked(t)).record)


@query(f"SELECT {ALL} FROM violations WHERE violation_type = 'dependency' AND CAST(regexp_extract(constant_name, 'Part([0-9]+)', 1) AS BIGINT) % 10 < 2")
def first_ignore_rule(t: Tables) -> DataFrame:
    """An outgoing rule's ignore globs look at the defining file, and of two ignore rules the first that names the rule decides."""
    rule = lambda words, deny, allow: F.struct(F.array(*map(F.lit, words)).alias("enforcements"), F.array(F.lit(deny)).alias("deny"), F.array(F.lit(allow)).alias("allow"), F.lit("").alias("reason"))
    services, ones = globs.path_glob("packages/**/app/services/*"), globs.path_glob("packages/**/*1.rb")
    ignored = F.array(rule(["privacy"], "^.*$", "^$"), rule(["layer", "dependency"], services, ones), rule(["dependency"], "^.*$", "^$"))
    return rules.violations(t.refs(), t.packages().withColumn("ignore_rules", ignored), WORLD, only=["dependency"])


@query(f"SELECT {ALL} FROM violations WHERE violation_type = 'privacy' AND defining_package = '{ONE}'")
def scoped_filter(t: Tables) -> DataFrame:
    return baseline.scoped(_found(t), violation_type="privacy", defining_package=ONE)


@query(f"""SELECT 'violation' AS kind, count(*) AS n FROM violations ANTI JOIN recorded USING ({IDS}) UNION ALL SELECT 'stale', count(*) FROM recorded ANTI JOIN violations USING ({IDS})
UNION ALL SELECT 'strict', count(*) FROM violations WHERE strict""")
def check_json_counts(t: Tables) -> DataFrame:
    found = kept(rules.once(_broken(t)))
    report = commands.report_json(commands.judged(found, _recorded(t, found), WORLD))
    return report.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 1 AS part, message AS line FROM violations ANTI JOIN recorded USING ({IDS}) UNION ALL SELECT 0, count(*) || ' violation(s) detected:' FROM violations ANTI JOIN recorded USING ({IDS}) HAVING count(*) > 0
UNION ALL SELECT 2, 'There were stale violations found, please run `update`' WHERE EXISTS (SELECT 1 FROM recorded ANTI JOIN violations USING ({IDS}))
UNION ALL SELECT 3, referencing_package || ' cannot have ' || violation_type || ' violations on ' || defining_package || ' because strict mode is enabled for ' || violation_type || ' violations in the enforcing pack''s package.yml file' FROM violations WHERE strict""")
def check_report(t: Tables) -> DataFrame:
    found = kept(rules.once(_broken(t)))
    return commands.report_lines(commands.judged(found, _recorded(t, found), WORLD))


# use


@query("SELECT referencing_package, defining_package, count(*) AS n_references FROM refs WHERE defining_package IS NOT NULL GROUP BY ALL")
def edge_counts(t: Tables) -> DataFrame:
    return usage.edge_counts(t.refs())


_DECLARED = ", declared AS (SELECT * FROM edges UNION ALL SELECT name, 'packages/none' FROM nations)\n"


@query(_DECLARED + "SELECT from_package, to_package FROM declared WHERE NOT EXISTS (SELECT 1 FROM refs WHERE referencing_package = from_package AND defining_package = to_package)")
def unnecessary_dependencies(t: Tables) -> DataFrame:
    """Of all references; every package also declares one that defines nothing, so that some edges are unused."""
    none = t.nations().select(F.col("name").alias("from_package"), F.lit("packages/none").alias("to_package"))
    return usage.unnecessary_dependencies(t.edges().unionByName(none), t.refs())


@query(f"SELECT DISTINCT from_package AS package FROM edges WHERE to_package = '{ONE}' AND from_package <> '{ONE}'")
def dependents(t: Tables) -> DataFrame:
    return usage.dependents(t.edges(), ONE)


@query(f"SELECT referencing_package, violation_type, count(DISTINCT constant_name) AS n_constants FROM recorded WHERE defining_package = '{ONE}' AND referencing_package <> '{ONE}' GROUP BY ALL")
def implicit_counts(t: Tables) -> DataFrame:
    return usage.implicit_dependents(_recorded(t), ONE)


@query(f"SELECT DISTINCT defining_package AS package FROM refs WHERE referencing_package = '{ONE}' AND defining_package IS NOT NULL AND defining_package <> '{ONE}'")
def suggested_dependencies(t: Tables) -> DataFrame:
    return usage.suggested_dependencies(t.refs(), ONE)


_CONST = "::Brand5::Part5"
_USERS = f""", users AS (SELECT DISTINCT referencing_package, (SELECT min(defining_package) FROM refs WHERE constant_name = '{_CONST}' AND defining_package <> referencing_package) AS defining_package
FROM refs WHERE constant_name = '{_CONST}' AND defining_package IS NOT NULL AND defining_package <> referencing_package)
"""


@query(_USERS + "SELECT * FROM users WHERE defining_package <> referencing_package")
def constant_users(t: Tables) -> DataFrame:
    return usage.constant_users(t.refs(), _CONST)


@query(_USERS + "SELECT referencing_package AS from_package, defining_package AS to_package FROM users WHERE defining_package <> referencing_package AND (referencing_package, defining_package) NOT IN (SELECT (from_package, to_package) FROM edges)")
def missing_edges(t: Tables) -> DataFrame:
    return usage.missing_edges_for_constant(t.refs(), t.edges(), t.packages(), _CONST)


@query("SELECT DISTINCT from_package, to_package FROM (SELECT * FROM edges UNION ALL SELECT * FROM chain)")
def add_edges(t: Tables) -> DataFrame:
    return usage.add_edges(t.edges(), t.chain())


@query("SELECT from_package, to_package FROM edges ANTI JOIN acyclic USING (from_package, to_package)")
def remove_edges(t: Tables) -> DataFrame:
    return usage.remove_edges(t.edges(), t.edges(acyclic=True))


def _files(t: Tables, column: str = "referencing_file") -> DataFrame:
    return t.refs().select(F.col(column).alias("path")).where("path is not null").distinct()


_PATHS = ", paths AS (SELECT DISTINCT referencing_file AS path, regexp_extract(referencing_file, '^[^/]+/[^/]+/[^/]+') AS package, CAST(regexp_extract(referencing_file, 'order_([0-9]+)', 1) AS BIGINT) AS n FROM refs)\n"


@query(_PATHS + "SELECT path, package FROM paths WHERE package IN (SELECT package FROM paths WHERE n < 8)")
def expand_to_package(t: Tables) -> DataFrame:
    files = _files(t)
    owners = resolve.file_owner(files, t.nations().select(F.col("name").alias("directory")))
    return usage.expand_to_packages(owners, files.where(F.regexp_extract("path", "order_([0-9]+)", 1).cast("long") < 8))


@query("SELECT file AS path FROM violations WHERE violation_type = 'dependency' INTERSECT SELECT file FROM violations WHERE violation_type = 'privacy'")
def intersect_files(t: Tables) -> DataFrame:
    """All files that break both of two rules."""
    files = lambda rule: _found(t, only=[rule]).select(F.col("file").alias("path"))
    return usage.intersect_files(files("dependency"), files("privacy"))


for _name in ("unnecessary_dependencies", "intersect_files"):  # the names these two had beside queries of parts
    QUERIES[f"{_name}_all"], ORACLE[f"{_name}_all"] = QUERIES[_name], ORACLE[_name]


@query("""SELECT referencing_file, string_agg(constant_name || '=' || defining_file, ',' ORDER BY constant_name) AS constants
FROM (SELECT referencing_file, constant_name, max(defining_file) AS defining_file FROM refs WHERE defining_file IS NOT NULL GROUP BY ALL) GROUP BY 1""")
def reference_map(t: Tables) -> DataFrame:
    out = usage.reference_map(t.refs())
    return out.select("referencing_file", F.array_join(F.transform("constants", lambda c: F.concat(c["constant_name"], F.lit("="), c["defining_file"])), ",").alias("constants"))


_DEFS = """, defs AS (SELECT '::' || upper(substr(p_type, 1, 1)) || (p_partkey % 37) AS fq_name,
  CASE p_partkey % 5 WHEN 0 THEN '/ruby/lib/x' || p_partkey || '.rb' WHEN 1 THEN '/gems/gem_' || (p_partkey % 11) || '/lib/x' || p_partkey || '.rb' ELSE '/app/models/x' || p_partkey || '.rb' END AS path
  FROM part WHERE p_partkey % 7 <> p_partkey % 37),
places AS (SELECT *, CASE WHEN path LIKE '/ruby/%' THEN 's' WHEN path LIKE '/gems/%' THEN 'g' ELSE 'a' END AS place FROM defs),
n AS (SELECT fq_name, count(*) FILTER (place = 's') AS s, count(*) FILTER (place = 'g') AS g, count(*) FILTER (place = 'a') AS a, max(CASE WHEN place = 'g' THEN split_part(path, '/', 3) END) AS gem FROM places GROUP BY 1)
"""


def _definitions(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    s = p.cast("string")
    path = F.when(p % 5 == 0, F.concat(F.lit("/ruby/lib/x"), s, F.lit(".rb"))).when(p % 5 == 1, F.concat(F.lit("/gems/gem_"), (p % 11).cast("string"), F.lit("/lib/x"), s, F.lit(".rb"))).otherwise(F.concat(F.lit("/app/models/x"), s, F.lit(".rb")))
    return t.read("part").where(p % 7 != p % 37).select(F.concat(F.lit("::"), F.upper(F.substring("p_type", 1, 1)), (p % 37).cast("string")).alias("fq_name"), path.alias("path"))


@query(_DEFS + """SELECT fq_name, path, CASE WHEN s > 0 THEN 'ruby' WHEN g > 0 THEN 'gem' ELSE 'application' END AS kind, CASE WHEN s = 0 AND g > 0 THEN gem END AS gem
FROM places JOIN n USING (fq_name) WHERE place = 'a' AND (s > 0 OR g > 0 OR a > 1)""")
def redefinition_classes(t: Tables) -> DataFrame:
    return usage.redefinitions(_definitions(t), "/ruby", "/gems")


# resolution

_RESOLVE = r""", constants AS (SELECT '::Brand' || b || CASE WHEN i = 0 THEN '' ELSE '::Part' || (b * i) END AS fq_name, 'lib/brand_' || b || '_' || i || '.rb' AS defining_file
  FROM (SELECT unnest(range(25)) AS b), (SELECT unnest([0, 1, 2, 3]) AS i) WHERE i = 0 OR b > 0),
asked AS (SELECT p_partkey AS ref_id, CASE p_partkey % 3 WHEN 0 THEN 'Part' || (p_partkey % 60) WHEN 1 THEN '::Brand' || (p_partkey % 30) || '::Part' || (p_partkey % 30 * 2) || '::Deep' ELSE 'Brand' || (p_partkey % 30) END AS name,
  ['Brand' || (p_partkey % 20), 'Inner'][1:p_partkey % 4] AS namespace FROM part),
norm AS (SELECT ref_id, name, regexp_replace(name, '^::', '') AS plain, CASE WHEN name LIKE '::%' THEN [] ELSE namespace END AS ns FROM asked),
tries AS (SELECT ref_id, name, plain, ns, i, j, array_to_string(ns[1:j] || string_split(plain, '::')[1:i], '::') AS tail FROM norm, LATERAL (SELECT unnest(range(1, len(string_split(plain, '::')) + 1)) AS i), LATERAL (SELECT unnest(range(0, len(ns) + 1)) AS j)),
hits AS (SELECT tries.*, fq_name, defining_file, row_number() OVER (PARTITION BY ref_id ORDER BY i DESC, j DESC) AS r, row_number() OVER (PARTITION BY ref_id, i ORDER BY j DESC) AS ri FROM tries JOIN constants ON fq_name = '::' || tail)
"""


def _constants(t: Tables) -> DataFrame:
    b, i = F.col("b"), F.col("i")
    rows = t.spark.range(25).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).where("i = 0 or b > 0")
    name = F.concat(F.lit("::Brand"), b.cast("string"), F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit("::Part"), (b * i).cast("string"))))
    return rows.select(name.alias("fq_name"), F.concat(F.lit("lib/brand_"), b.cast("string"), F.lit("_"), i.cast("string"), F.lit(".rb")).alias("defining_file"))


def _asked(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    text = lambda c: c.cast("string")
    name = F.when(p % 3 == 0, F.concat(F.lit("Part"), text(p % 60))).when(p % 3 == 1, F.concat(F.lit("::Brand"), text(p % 30), F.lit("::Part"), text(p % 30 * 2), F.lit("::Deep"))).otherwise(F.concat(F.lit("Brand"), text(p % 30)))
    space = F.slice(F.array(F.concat(F.lit("Brand"), text(p % 20)), F.lit("Inner")), F.lit(1), (p % 4).cast("int"))
    return t.read("part").select(p.alias("ref_id"), name.alias("name"), space.alias("namespace"))


@query(_RESOLVE + "SELECT norm.ref_id, coalesce('::' || array_to_string(h.ns[1:h.j] || [h.plain], '::'), norm.name) AS constant_name, h.defining_file FROM norm LEFT JOIN (SELECT * FROM hits WHERE r = 1) h ON h.ref_id = norm.ref_id")
def resolve_ladder(t: Tables) -> DataFrame:
    return resolve.resolve_first(_asked(t), _constants(t))


@query("""SELECT name AS directory, CASE WHEN k % 2 = 0 THEN '::' || array_to_string(list_transform(string_split(split_part(name, '/', 3), '_'), lambda w: upper(w[1]) || w[2:]), '') ELSE '' END AS namespace,
  CASE WHEN k % 3 = 0 THEN 'app/models' ELSE '' END AS bare FROM nations""")
def automatic_namespaces(t: Tables) -> DataFrame:
    k = F.col("k")
    own = F.format_string('{"metadata": {"automatic_pack_namespace": %s, "automatic_pack_namespace_exclusions": [%s]}}', F.when(k % 2 == 0, F.lit("true")).otherwise(F.lit("false")), F.when(k % 3 == 0, F.lit('"app/models/"')).otherwise(F.lit("")))
    out = resolve.automatic_namespaces(t.nations().select("name", own.alias("client_keys")))
    return out.withColumn("bare", F.array_join("bare", ","))


@query(_RESOLVE + "SELECT DISTINCT ref_id, '::' || array_to_string(ns[1:j] || [plain], '::') AS constant_name, d.path AS defining_file FROM hits, (SELECT unnest(['', 'more/']) AS pre), LATERAL (SELECT pre || defining_file AS path) d WHERE ri = 1 AND i = len(string_split(plain, '::'))")
def resolve_all(t: Tables) -> DataFrame:
    c = _constants(t)
    return resolve.resolve_all(_asked(t), c.unionByName(c.withColumn("defining_file", F.concat(F.lit("more/"), "defining_file"))))


@query(_DEFS + "SELECT DISTINCT fq_name, path AS defining_file, k AS n_files FROM defs JOIN (SELECT fq_name, count(DISTINCT path) AS k FROM defs GROUP BY 1 HAVING count(DISTINCT path) > 1) USING (fq_name)")
def ambiguous(t: Tables) -> DataFrame:
    return resolve.ambiguous(_definitions(t).withColumnRenamed("path", "defining_file"))


@query(", paths AS (SELECT DISTINCT defining_file AS path FROM refs WHERE defining_file IS NOT NULL) SELECT path, regexp_extract(path, '^[^/]+/[^/]+/[^/]+') AS package FROM paths")
def file_owner(t: Tables) -> DataFrame:
    dirs = t.nations().select(F.explode(F.array("name", "parent", F.lit("."))).alias("directory")).distinct()
    return resolve.file_owner(_files(t, "defining_file"), dirs)


@query(""", paths AS (SELECT DISTINCT defining_file AS path FROM refs WHERE defining_file IS NOT NULL),
words AS (SELECT path, regexp_extract(path, '([^/]+)\\.rb$', 1) AS leaf, path LIKE '%/app/public/%' AS pub FROM paths)
SELECT CASE WHEN pub THEN '::Public' ELSE '' END || '::' || array_to_string(list_transform(string_split(leaf, '_'), lambda w: upper(w[1]) || w[2:]), '') AS fq_name, path AS defining_file FROM words""".replace("\\\\", "\\"))
def longest_root(t: Tables) -> DataFrame:
    n = t.nations()
    roots = n.select(F.concat("name", F.lit("/app")).alias("directory"), F.lit("").alias("namespace")).unionByName(n.select(F.concat("name", F.lit("/app/services")).alias("directory"), F.lit("").alias("namespace")))
    roots = roots.unionByName(n.select(F.concat("name", F.lit("/app/public")).alias("directory"), F.lit("::Public").alias("namespace")))
    return resolve.inferred_constants(_files(t, "defining_file"), roots)


@query(_DEFS + "SELECT fq_name || ' (' || array_to_string(list_sort(list(DISTINCT path)), ', ') || ')' AS said FROM defs GROUP BY fq_name HAVING count(DISTINCT path) > 1")
def duplicates(t: Tables) -> DataFrame:
    return resolve.duplicates(_definitions(t).withColumnRenamed("path", "defining_file"))


@query("""SELECT directory, CASE WHEN o = '::Object' THEN '' ELSE coalesce(o, d) END AS namespace FROM (SELECT name || '/app' AS directory, '' AS d, CASE k % 3 WHEN 0 THEN '::Object' WHEN 1 THEN '::N' || k END AS o FROM nations)
UNION ALL SELECT DISTINCT parent || '/lib', '::Region' FROM nations""")
def root_overrides(t: Tables) -> DataFrame:
    n = t.nations()
    own = F.when(F.col("k") % 3 == 0, F.lit("::Object")).otherwise(F.concat(F.lit("::N"), F.col("k").cast("string")))
    given = n.where("k % 3 < 2").select(F.concat("name", F.lit("/app")).alias("directory"), own.alias("namespace"))
    given = given.unionByName(n.select(F.concat("parent", F.lit("/lib")).alias("directory"), F.lit("::Region").alias("namespace")).distinct())
    return resolve.with_overrides(n.select(F.concat("name", F.lit("/app")).alias("directory"), F.lit("").alias("namespace")), given)


# classes of parts with one of these texts in them, and whether that defines the class, Inner or Y
_BODIES = (
    ("", "none"), ("def x\nend", "class"), ("private_constant :Y", "none"), ("call_me if ready", "class"), ("class Inner\ndef x; end\nend", "inner"), ("Y = %w[a b]", "y"), ("# def x\n'call_me'", "none"),
    ("class << self\ndef x(a = {}) = a\nend", "class"), ('NOTE = <<~TEXT\n  def x\n  end\nTEXT', "note"), ("class Inner < Struct.new(:a)\nend", "class"),
)
_DEFINED = f"""SELECT name AS fq_name, file AS defining_file FROM (SELECT '::Brand' || (p_partkey % 25) || '::Part' || p_partkey AS part, CASE WHEN p_brand LIKE '%1' THEN 'lib/spec/' ELSE 'lib/' END || 'part_' || p_partkey || '.rb' AS file,
  [{', '.join(f"'{k}'" for _, k in _BODIES)}][1 + p_size % {len(_BODIES)}] AS body FROM part),
LATERAL (SELECT CASE body WHEN 'class' THEN part WHEN 'inner' THEN part || '::Inner' WHEN 'y' THEN part || '::Y' WHEN 'note' THEN part || '::NOTE' END AS name) n WHERE name IS NOT NULL AND (body IN ('y', 'note') OR NOT contains(file, '/spec/'))"""


@query(_DEFINED, prefix=False)
def behaviour_definitions(t: Tables) -> DataFrame:
    """A file a part: a class in a module, with a text of its own in it; what defines the class is what does something."""
    k = F.col("p_partkey")
    folder = F.when(F.col("p_brand").endswith("1"), F.lit("lib/spec/")).otherwise(F.lit("lib/"))
    body = F.element_at(F.array(*[F.lit(b) for b, _ in _BODIES]), (F.col("p_size") % len(_BODIES) + 1).cast("int"))
    text = F.concat(F.lit("module Brand"), (k % 25).cast("string"), F.lit("\nclass Part"), k.cast("string"), F.lit("\n"), body, F.lit("\nend\nend\n"))
    sources = t.read("part").select(F.concat(folder, F.lit("part_"), k.cast("string"), F.lit(".rb")).alias("path"), F.lit("ruby").alias("kind"), text.alias("text"))
    return ruby.definitions(ruby.parse(sources))


# graph

_REACH = "reach AS (SELECT from_package AS source, to_package AS target FROM {0} WHERE from_package <> to_package UNION SELECT source, to_package FROM reach JOIN {0} ON target = from_package WHERE from_package <> to_package)"


@query(", all_edges AS (SELECT * FROM acyclic UNION SELECT * FROM chain), " + _REACH.format("all_edges") + " SELECT source, target FROM reach")
def closure(t: Tables) -> DataFrame:
    return graph.closure(t.edges(acyclic=True).union(t.chain()))


@query(", " + _REACH.format("edges") + " SELECT a.source AS package, min(least(a.source, a.target)) AS component FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY 1")
def scc(t: Tables) -> DataFrame:
    return graph.strong_components(t.edges())


@query("SELECT DISTINCT name AS package FROM nations WHERE k % 6 = 0")
def self_dependency(t: Tables) -> DataFrame:
    own = t.nations().where("k % 6 = 0").select(F.col("name").alias("from_package"), F.col("name").alias("to_package"))
    return graph.self_dependencies(t.edges().union(own))


_WALK = """, strict AS (SELECT name FROM settings WHERE i = 0 AND setting = 'strict'),
walk AS (SELECT name AS source, name AS target, [name] AS path, 0 AS depth FROM strict
  UNION ALL SELECT source, to_package, list_append(path, to_package), depth + 1 FROM walk JOIN {0} ON target = from_package WHERE target IN (SELECT name FROM strict) AND NOT list_contains(path, to_package))
"""


@query(_WALK.format("edges") + "SELECT source AS package, array_to_string(path, ' -> ') AS path FROM walk WHERE target NOT IN (SELECT name FROM strict) QUALIFY row_number() OVER (PARTITION BY source ORDER BY depth, path) = 1")
def strict_transitive(t: Tables) -> DataFrame:
    return graph.strict_violations(t.edges(), t.packages()).withColumn("path", F.array_join("path", " -> "))


@query(", steps AS (SELECT name AS source, name AS target, 0 AS length FROM nations UNION SELECT source, to_package, length + 1 FROM steps JOIN (SELECT * FROM chain UNION SELECT * FROM acyclic) ON target = from_package WHERE length < 25) SELECT source, target, CAST(min(length) AS BIGINT) AS length FROM steps GROUP BY ALL")
def shortest_path_len(t: Tables) -> DataFrame:
    return graph.shortest_paths(t.edges(acyclic=True).union(t.chain()), t.nations().select(F.col("name").alias("source")))


_RING = "ring AS (SELECT * FROM chain UNION ALL SELECT a.name, b.name FROM nations a, nations b WHERE a.k = (SELECT max(k) FROM nations) AND b.k = (SELECT min(k) FROM nations))"


@query(", " + _RING + """, walk AS (SELECT min(name) AS component, min(name) AS here, [min(name)] AS path FROM nations UNION ALL SELECT component, to_package, list_append(path, to_package) FROM walk JOIN ring ON here = from_package WHERE to_package <> component)
SELECT component, array_to_string(path, ' -> ') AS path FROM walk ORDER BY len(path) DESC LIMIT 1""")
def cycles(t: Tables) -> DataFrame:
    """A ring of all packages, and branches that lead off it: one component, and its cycle from the least member."""
    n = t.nations()
    last = n.agg(F.max_by("name", "k").alias("from_package"), F.min_by("name", "k").alias("to_package"))
    off = n.select(F.col("name").alias("from_package"), F.concat("name", F.lit("/leaf")).alias("to_package"))
    return graph.cycles(t.chain().unionByName(last).unionByName(off)).withColumn("path", F.array_join("path", " -> "))


@query(_WALK.format("acyclic") + """SELECT 'self_dependency' AS error_type, 'Package cannot list itself as a dependency: ' || name || '/package.yml' AS message, name || '/package.yml' AS file FROM nations WHERE k % 6 = 0
UNION ALL SELECT 'strict_transitive', source || ' has `enforce_dependencies: strict` but has a non-strict transitive dependency: ' || array_to_string(path, ' -> '), NULL FROM (SELECT * FROM walk WHERE target NOT IN (SELECT name FROM strict) QUALIFY row_number() OVER (PARTITION BY source ORDER BY depth, path) = 1)""")
def validate(t: Tables) -> DataFrame:
    own = t.nations().where("k % 6 = 0").select(F.col("name").alias("from_package"), F.col("name").alias("to_package"))
    return graph.validate(t.packages(), t.edges(acyclic=True).union(own), WORLD).drop("cycle")


@query("SELECT 'configuration' AS error_type, name || '/package.yml has a dependency on an unknown package: packages/none' AS message, CAST(NULL AS VARCHAR) AS file FROM nations")
def validate_unknown(t: Tables) -> DataFrame:
    none = t.nations().select(F.col("name").alias("from_package"), F.lit("packages/none").alias("to_package"))
    return graph.validate(t.packages(), t.edges().unionByName(none), WORLD).drop("cycle")


@query("""SELECT 'layer' AS error_type, 'Invalid ''layer'' option in ''' || name || '/package.yml''. `layer` must be one of the layers defined in the configuration' AS message, name || '/package.yml' AS file FROM nations WHERE layer = 'layer4' AND k % 3 <> 0
UNION ALL SELECT 'layer', '''layer'' must be specified in ''' || n.name || '/package.yml'' because `enforce_layers` is true or strict.', n.name || '/package.yml' FROM nations n JOIN settings s ON s.k = n.k AND s.i = 3 WHERE n.k % 3 = 0 AND setting <> 'false'""")
def layer_validate(t: Tables) -> DataFrame:
    k = t.nations().where("k % 3 = 0").select("name", F.lit(True).alias("bare"))
    p = t.packages().join(k, "name", "left").withColumn("layer", F.when(F.col("bare").isNull(), F.col("layer"))).drop("bare")
    return graph.layer_errors(p, rules.World(WORLD.layers[:4])).drop("cycle")


@query(", paths AS (SELECT DISTINCT defining_file AS path, defining_package AS package FROM refs WHERE defining_file IS NOT NULL) SELECT path AS source, 'packages/new' || substr(path, len(package) + 1) AS destination FROM paths WHERE contains(package, 'asia')")
def move_plan(t: Tables) -> DataFrame:
    files = _files(t, "defining_file")
    return moves.plan(files, files.where("path like 'packages/asia/%'"), t.packages(), "packages/new")


# names and texts

_WORDS = "SELECT p_partkey, lower(replace(p_type, ' ', '_')) || '/' || lower(replace(p_name, ' ', '_')) AS path FROM part"


def _paths(t: Tables) -> DataFrame:
    low = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
    return t.read("part").select("p_partkey", F.concat(low("p_type"), F.lit("/"), low("p_name")).alias("path"))


@query(f"SELECT p_partkey, array_to_string(list_transform(string_split(path, '/'), lambda s: array_to_string(list_transform(string_split(s, '_'), lambda w: upper(w[1]) || w[2:]), '')), '::') AS name FROM ({_WORDS})", prefix=False)
def camelize(t: Tables) -> DataFrame:
    return _paths(t).select("p_partkey", names.camelize(F.col("path")).alias("name"))


@query("SELECT p_partkey, array_to_string(list_transform(range(3, 0, -1), lambda n: array_to_string(['A' || p_partkey % 7, 'B' || p_partkey % 5, 'C'][1:n], '::')), ',') AS nesting FROM part", prefix=False)
def nesting(t: Tables) -> DataFrame:
    return t.read("part").select("p_partkey", F.array_join(names.nesting(_space()), ",").alias("nesting"))


def _space() -> Column:
    p = F.col("p_partkey")
    return F.array(F.concat(F.lit("A"), (p % 7).cast("string")), F.concat(F.lit("B"), (p % 5).cast("string")), F.lit("C"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '::X' ELSE '::X,' || array_to_string(list_transform(range(3, 0, -1), lambda n: '::' || array_to_string(['A' || p_partkey % 7, 'B' || p_partkey % 5, 'C'][1:n], '::') || '::X'), ',') END AS candidates FROM part""", prefix=False)
def candidates(t: Tables) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.lit("::X")).otherwise(F.lit("X"))
    return t.read("part").select("p_partkey", F.array_join(names.candidates(name, _space()), ",").alias("candidates"))


@query(f"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'packages/a/spec/' || path || '_spec.rb' WHEN 1 THEN 'packages/a/spec/lib/' || path || '_spec.rb' ELSE 'packages/a/' || path || '.rb' END AS spec FROM ({_WORDS})""", prefix=False)
def spec_path(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    top = F.when(p % 3 == 0, F.lit("app/")).when(p % 3 == 1, F.lit("lib/")).otherwise(F.lit(""))
    return _paths(t).select("p_partkey", names.spec_path(F.concat(F.lit("packages/a/"), top, "path", F.lit(".rb"))).alias("spec"))


@query("SELECT doc_id, md5(text) AS digest FROM documents", prefix=False)
def digest(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", names.digest(F.col("text")).alias("digest"))


@query("SELECT page_id, array_to_string(regexp_extract_all(replace(replace(html, '<b>', '<%= '), '<br>', ' %>'), '(?s)<%=?-?[ \\t\\n\\r\\f\\v]*(.*?)[ \\t\\n\\r\\f\\v]*-?%>', 1), chr(10)) AS code FROM pages".replace("\\\\", "\\"), prefix=False)
def template_extract(t: Tables) -> DataFrame:
    text = F.replace(F.replace(F.col("html"), F.lit("<b>"), F.lit("<%= ")), F.lit("<br>"), F.lit(" %>"))
    return t.read("pages").select("page_id", names.template_code(text).alias("code"))


@query("SELECT doc_id, CAST(len(list_filter(string_split(replace(text, ' the ', ' # pack_public: true '), chr(10))[1:5], lambda x: contains(x, 'pack_public: true'))) AS INTEGER) AS marks FROM documents", prefix=False)
def first_lines(t: Tables) -> DataFrame:
    marked = F.replace(F.col("text"), F.lit(" the "), F.lit(" # pack_public: true "))
    return t.read("documents").select("doc_id", names.public_marks(marked).alias("marks"))


@query("SELECT DISTINCT referencing_file AS path FROM refs WHERE regexp_matches(referencing_file, '^packages/(asia|europe)/[^/]*/app/.*[02468]\\.rb$') AND NOT regexp_matches(referencing_file, '^packages/[^/]*/f[^/]*/.*$')".replace("\\\\", "\\"))
def glob_filter(t: Tables) -> DataFrame:
    include, exclude = globs.path_glob("packages/{asia,europe}/*/app/**/*[02468].rb"), globs.path_glob("packages/*/f*/**")
    return _files(t).where(F.col("path").rlike(include) & ~F.col("path").rlike(exclude))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ruby' WHEN 1 THEN 'ruby' WHEN 2 THEN 'erb' WHEN 3 THEN 'ruby' END AS kind FROM part""", prefix=False)
def file_type(t: Tables) -> DataFrame:
    names_ = F.element_at(F.array(*[F.lit(x) for x in ("a/b.rb", "lib/Rakefile", "x/y.html.erb", "t.rake", "z.md")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.read("part").select("p_partkey", names.file_type(names_).alias("kind"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["rule_dependency"](spark, folder).orderBy("message")
