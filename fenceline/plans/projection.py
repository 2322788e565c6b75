"""The domain's tables out of star-schema tables, so that every operator can run, and be held against SQL, at any size.

Packages are nations, layers regions; a line item is a reference from the package of its customer's nation to that of
its supplier's, unresolved for one part in seventeen. Each table has the DuckDB text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import World
from ..schema import SETTINGS

WORLD = World(tuple(f"layer{i}" for i in range(5)))
#: An ignore rule that every seventh package has: the privacy rule, all files but those allowed.
IGNORE = ("privacy", r"^.*/order_1.*\.rb$", r"^.*/order_12.*\.rb$")


class Tables:
    """DataFrames of a folder; each is only planned when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def nations(self) -> DataFrame:
        low = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("_")))
        n = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        parent = F.concat(F.lit("packages/"), low("r_name"))
        return n.select(F.col("n_nationkey").alias("k"), F.concat(parent, F.lit("/"), low("n_name")).alias("name"), parent.alias("parent"), F.concat(F.lit("layer"), F.col("n_regionkey").cast("string")).alias("layer"))

    def edges(self, acyclic: bool = False) -> DataFrame:
        a, b = self.nations().select(F.col("k").alias("a"), F.col("name").alias("from_package")), self.nations().select(F.col("k").alias("b"), F.col("name").alias("to_package"))
        rule = (F.col("a") < F.col("b")) & ((7 * F.col("a") + 3 * F.col("b")) % 8 == 0) if acyclic else (F.col("a") != F.col("b")) & ((7 * F.col("a") + 3 * F.col("b")) % 4 == 0)
        return a.join(b, rule).select("from_package", "to_package")

    def chain(self) -> DataFrame:
        """k -> k + 1, so that loops over edges are many rounds deep."""
        a, b = self.nations().select(F.col("k").alias("a"), F.col("name").alias("from_package")), self.nations().select(F.col("k").alias("b"), F.col("name").alias("to_package"))
        return a.join(b, F.col("a") + 1 == F.col("b")).select("from_package", "to_package")

    def packages(self) -> DataFrame:
        n = self.nations()
        deps = self.edges().groupBy(F.col("from_package").alias("name")).agg(F.collect_list("to_package").alias("dependencies"))
        other = n.select(F.col("k").alias("v"), F.col("name").alias("viewer"))
        seen = n.join(other, (F.col("k") + F.col("v")) % 3 == 0).groupBy("name").agg(F.collect_list("viewer").alias("visible_to"))
        setting = lambda i: F.when((F.col("k") + i) % 5 == 0, F.lit("false")).when((F.col("k") + i) % 5 == 4, F.lit("strict")).otherwise(F.lit("true"))
        none = F.array().cast("array<string>")
        word, deny, allow = IGNORE
        rule = F.struct(F.array(F.lit(word)).alias("enforcements"), F.array(F.lit(deny)).alias("deny"), F.array(F.lit(allow)).alias("allow"), F.lit("").alias("reason"))
        out = n.join(deps, "name", "left").join(seen, "name", "left")
        return out.select(
            "name", "parent", F.lit(None).cast("string").alias("owner"), "layer", F.lit(None).cast("string").alias("public_folder"),
            *[setting(i).alias(f"enforce_{s}") for i, s in enumerate(SETTINGS)],
            F.coalesce("dependencies", none).alias("dependencies"), none.alias("ignored_dependencies"), "visible_to",
            F.when(F.col("k") % 2 == 0, F.array(F.concat(F.lit("::Brand"), (F.col("k") % 25).cast("string")))).otherwise(none).alias("private_constants"),
            none.alias("ignored_private_constants"), F.when(F.col("k") % 7 == 0, F.array(rule)).otherwise(F.filter(F.array(rule), lambda x: F.lit(False))).alias("ignore_rules"), F.lit(None).cast("string").alias("client_keys"),
        )

    def refs(self) -> DataFrame:
        line = self.read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        orders = self.read("orders").select("o_orderkey", "o_custkey")
        customers, suppliers = self.read("customer").select("c_custkey", "c_nationkey"), self.read("supplier").select("s_suppkey", "s_nationkey")
        r, d = self.nations().select(F.col("k").alias("rk"), F.col("name").alias("referencing_package")), self.nations().select(F.col("k").alias("dk"), F.col("name").alias("d_name"))
        out = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(r, F.col("c_nationkey") == F.col("rk"))
        out = out.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(d, F.col("s_nationkey") == F.col("dk"), "left")
        part = F.col("l_partkey")
        definer = F.when(part % 17 != 0, F.col("d_name"))
        place = F.when(part % 10 == 0, F.lit("/app/public/")).otherwise(F.lit("/app/services/"))
        return out.select(
            F.concat(F.lit("::Brand"), (part % 25).cast("string"), F.lit("::Part"), part.cast("string")).alias("constant_name"), definer.alias("defining_package"),
            F.concat(definer, place, F.lit("part_"), part.cast("string"), F.lit(".rb")).alias("defining_file"), "referencing_package",
            F.concat("referencing_package", F.lit("/app/models/order_"), F.col("o_orderkey").cast("string"), F.lit(".rb")).alias("referencing_file"),
            F.col("l_linenumber").cast("long").alias("line"), (part % 80).alias("col"),
        )


#: The same tables in DuckDB's SQL, as common table expressions.
SQL = r"""WITH RECURSIVE nations AS (
  SELECT n_nationkey AS k, 'packages/' || lower(replace(r_name, ' ', '_')) || '/' || lower(replace(n_name, ' ', '_')) AS name,
    'packages/' || lower(replace(r_name, ' ', '_')) AS parent, n_regionkey AS layer_no, 'layer' || n_regionkey AS layer
  FROM nation JOIN region ON n_regionkey = r_regionkey),
settings AS (
  SELECT k, name, i, CASE (k + i) % 5 WHEN 0 THEN 'false' WHEN 4 THEN 'strict' ELSE 'true' END AS setting FROM nations, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
edges AS (SELECT a.name AS from_package, b.name AS to_package FROM nations a, nations b WHERE a.k <> b.k AND (7 * a.k + 3 * b.k) % 4 = 0),
acyclic AS (SELECT a.name AS from_package, b.name AS to_package FROM nations a, nations b WHERE a.k < b.k AND (7 * a.k + 3 * b.k) % 8 = 0),
chain AS (SELECT a.name AS from_package, b.name AS to_package FROM nations a, nations b WHERE a.k + 1 = b.k),
refs AS (
  SELECT '::Brand' || (l_partkey % 25) || '::Part' || l_partkey AS constant_name, CASE WHEN l_partkey % 17 <> 0 THEN d.name END AS defining_package,
    CASE WHEN l_partkey % 17 <> 0 THEN d.name END || CASE WHEN l_partkey % 10 = 0 THEN '/app/public/' ELSE '/app/services/' END || 'part_' || l_partkey || '.rb' AS defining_file,
    r.name AS referencing_package, r.name || '/app/models/order_' || o_orderkey || '.rb' AS referencing_file, l_linenumber::BIGINT AS line, l_partkey % 80 AS col,
    r.k AS rk, d.k AS dk, l_partkey, o_orderkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nations r ON c_nationkey = r.k
    LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nations d ON s_nationkey = d.k),
known AS (SELECT refs.*, r.parent AS rp, d.parent AS dp, r.layer AS rl, d.layer AS dl, r.layer_no AS rn, d.layer_no AS dn,
    chr(27) || '[36m' || referencing_file || chr(27) || '[0m:' || line || ':' || col || chr(10) AS place
  FROM refs JOIN nations r ON r.k = rk JOIN nations d ON d.k = dk WHERE defining_package IS NOT NULL AND rk <> dk),
broken AS (
  SELECT 'dependency' AS violation_type, rk AS owner, 0 AS i, place || 'Dependency violation: `' || constant_name || '` belongs to `' || defining_package || '`, but `' || referencing_package || '/package.yml` does not specify a dependency on `' || defining_package || '`.' AS message, known.*
  FROM known WHERE (7 * rk + 3 * dk) % 4 <> 0
  UNION ALL SELECT 'privacy', dk, 1, place || 'Privacy violation: `' || constant_name || '` is private to `' || defining_package || '`, but referenced from `' || referencing_package || '`', known.*
  FROM known WHERE l_partkey % 10 <> 0 AND (dk % 2 = 1 OR l_partkey % 25 = dk % 25)
    AND NOT (dk % 7 = 0 AND regexp_matches(referencing_file, '^.*/order_1.*\.rb$') AND NOT regexp_matches(referencing_file, '^.*/order_12.*\.rb$'))
  UNION ALL SELECT 'visibility', dk, 2, place || 'Visibility violation: `' || constant_name || '` belongs to `' || defining_package || '`, which is not visible to `' || referencing_package || '`', known.*
  FROM known WHERE (rk + dk) % 3 <> 0
  UNION ALL SELECT 'layer', rk, 3, place || 'Layer violation: `' || constant_name || '` belongs to `' || defining_package || '` (whose layer is `' || dl || '`) cannot be accessed from `' || referencing_package || '` (whose layer is `' || rl || '`)', known.*
  FROM known WHERE rn > dn
  UNION ALL SELECT 'folder_privacy', dk, 4, place || 'Folder Privacy violation: `' || constant_name || '` belongs to `' || defining_package || '`, which is private to `' || referencing_package || '` as it is not a sibling pack or parent pack.', known.*
  FROM known WHERE rp <> dp),
violations AS (
  SELECT DISTINCT message, violation_type, setting = 'strict' AS strict, referencing_file AS file, constant_name, referencing_package, defining_package, line, col
  FROM broken b JOIN settings s ON s.k = b.owner AND s.i = b.i WHERE setting <> 'false'),
recorded AS (
  SELECT DISTINCT violation_type, strict, file, constant_name, referencing_package, defining_package FROM violations
  WHERE violation_type = 'dependency' AND NOT strict AND CAST(regexp_extract(file, 'order_([0-9]+)', 1) AS BIGINT) % 3 = 0
  UNION SELECT 'privacy', false, name || '/app/models/gone_' || k || '.rb', '::Gone' || k, name, 'packages/none' FROM nations)
"""


def recorded(tables: Tables, found: DataFrame) -> DataFrame:
    """Identifiers recorded earlier: a third of the dependency violations, and files that are gone."""
    order = F.regexp_extract("file", "order_([0-9]+)", 1).cast("long")
    ids = ["violation_type", "strict", "file", "constant_name", "referencing_package", "defining_package"]
    real = found.where((F.col("violation_type") == "dependency") & ~F.col("strict") & (order % 3 == 0)).select(*ids).distinct()
    k = F.col("k").cast("string")
    gone = tables.nations().select(
        F.lit("privacy").alias("violation_type"), F.lit(False).alias("strict"), F.concat("name", F.lit("/app/models/gone_"), k, F.lit(".rb")).alias("file"),
        F.concat(F.lit("::Gone"), k).alias("constant_name"), F.col("name").alias("referencing_package"), F.lit("packages/none").alias("defining_package"),
    )
    return real.unionByName(gone)
