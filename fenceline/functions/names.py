"""Names, paths and texts as column expressions; no Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that other tools read.
ANSI_ON, ANSI_OFF = "\x1b[36m", "\x1b[0m"
PUBLIC_MARK = "pack_public: true"
PUBLIC_MARK_LINES = 5
TEMPLATE_TAG = r"(?s)<%=?-?\s*(.*?)\s*-?%>"
RUBY_FILE = r"(\.(rb|rake|builder|gemspec|ru)$)|((^|/)(Gemfile|Rakefile)$)"
TEMPLATE_FILE = r"\.erb$"
#: Words whose last s is not a plural's, and irregular plurals.
SINGULAR_AS_THEY_ARE = ("Status", "Census", "Series", "Species", "News", "Equipment", "Information", "Money", "Rice", "Fish", "Sheep", "Police", "Jeans")
IRREGULAR = (
    ("Statuses", "Status"), ("Censuses", "Census"), ("Leaves", "Leave"), ("Data", "Datum"), ("People", "Person"), ("Women", "Woman"), ("Men", "Man"), ("Children", "Child"), ("Mice", "Mouse"), ("Movies", "Movie"), ("Cookies", "Cookie"), ("Zombies", "Zombie"),
    ("Shoes", "Shoe"), ("Moves", "Move"), ("Quizzes", "Quiz"), ("Indices", "Index"), ("Vertices", "Vertex"), ("Matrices", "Matrix"), ("Analyses", "Analysis"), ("Crises", "Crisis"), ("Wolves", "Wolf"), ("Halves", "Half"), ("Shelves", "Shelf"), ("Selves", "Self"), ("Knives", "Knife"),
    ("Wives", "Wife"), ("Lives", "Life"), ("Media", "Medium"), ("Caches", "Cache"),
)


def _acronym_map(acronyms: list[str] | None) -> Column | None:
    pairs = [F.lit(x) for a in sorted(set(acronyms or ())) for x in (a.lower(), a)]
    return F.create_map(*pairs) if pairs else None


def camelize(path: Column, acronyms: list[str] | None = None) -> Column:
    """a_b/c_d -> AB::CD; a part that is an acronym, whatever its case, takes the acronym's spelling."""
    table = _acronym_map(acronyms)

    def word(w: Column) -> Column:
        plain = F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
        return plain if table is None else F.coalesce(F.element_at(table, F.lower(w)), plain)

    part = lambda s: F.array_join(F.transform(F.split(s, "_"), word), "")
    return F.array_join(F.transform(F.split(path, "/"), part), "::")


def singular(name: Column) -> Column:
    """The singular of a camel-case English plural, by suffix."""
    out = F.when(F.lit(False), name)
    for word in SINGULAR_AS_THEY_ARE:
        out = out.when(name.endswith(word), name)
    for many, one in IRREGULAR:
        out = out.when(name.endswith(many), F.regexp_replace(name, many + "$", one))
    for suffix, by in ((r"([^aeiou])ies$", "$1y"), (r"(ss|sh|ch|x|z|[^aeiou]o)es$", "$1"), (r"(ss|us|is)$", "$1"), (r"s$", "")):
        out = out.when(name.rlike(suffix), F.regexp_replace(name, suffix, by))
    return out.otherwise(name)


def class_case(path: Column, acronyms: list[str] | None = None, singularise: bool = True) -> Column:
    """The class that a table or association name stands for."""
    name = camelize(path, acronyms)
    return singular(name) if singularise else name


def constant_of_path(path: Column, root: Column, namespace: Column, acronyms: list[str] | None = None) -> Column:
    """The constant that a file under an autoload root defines by convention; namespace is empty at the top level."""
    inner = F.regexp_replace(F.substring(path, F.length(root) + 2, 1 << 30), r"\.[^./]*$", "")
    return F.concat(F.when(F.coalesce(namespace, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("::"), F.regexp_replace(namespace, "^::", ""))), F.lit("::"), camelize(inner, acronyms))


def nesting(namespace: Column) -> Column:
    """[A, B, C] -> [A::B::C, A::B, A]."""
    steps = F.when(F.size(namespace) > 0, F.sequence(F.size(namespace), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda n: F.array_join(F.slice(namespace, F.lit(1), n), "::"))


def candidates(name: Column, namespace: Column) -> Column:
    """Fully qualified names that a reference may mean: itself if absolute, else the top level, then deepest to outermost."""
    inner = F.transform(nesting(namespace), lambda n: F.concat(F.lit("::"), n, F.lit("::"), name))
    return F.when(name.startswith("::"), F.array(name)).otherwise(F.concat(F.array(F.concat(F.lit("::"), name)), inner))


def spec_path(path: Column) -> Column:
    """app/x.rb -> spec/x_spec.rb and lib/x.rb -> spec/lib/x_spec.rb, under any package."""
    app = F.regexp_replace(path, r"(^|/)app/(.*)\.rb$", "$1spec/$2_spec.rb")
    lib = F.regexp_replace(path, r"(^|/)lib/(.*)\.rb$", "$1spec/lib/$2_spec.rb")
    return F.when(path.rlike(r"(^|/)app/.*\.rb$"), app).when(path.rlike(r"(^|/)lib/.*\.rb$"), lib).otherwise(path)


def file_type(path: Column) -> Column:
    return F.when(path.rlike(RUBY_FILE), F.lit("ruby")).when(path.rlike(TEMPLATE_FILE), F.lit("erb"))


def template_code(text: Column) -> Column:
    """The code of a template's tags, a line each."""
    return F.array_join(F.regexp_extract_all(text, F.lit(TEMPLATE_TAG), F.lit(1)), "\n")


def public_marks(text: Column) -> Column:
    """How many of the first lines carry the mark that makes a file's constants public."""
    return F.size(F.filter(F.slice(F.split(text, "\n"), 1, PUBLIC_MARK_LINES), lambda line: line.contains(PUBLIC_MARK)))


def digest(text: Column) -> Column:
    return F.md5(text)


def location(file: Column, line: Column, column: Column) -> Column:
    return F.concat(F.lit(ANSI_ON), file, F.lit(ANSI_OFF + ":"), line.cast("string"), F.lit(":"), column.cast("string"), F.lit("\n"))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def absolute_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def package_file(package: Column) -> Column:
    return F.when(package == ".", F.lit("package.yml")).otherwise(F.concat(package, F.lit("/package.yml")))


def last_part(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ancestors(path: Column) -> Column:
    """Directories above a path, the root "." first, as (directory, depth)."""
    parts = F.split(path, "/")
    inner = F.transform(F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>")), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir"), n.alias("depth")))
    return F.concat(F.array(F.struct(F.lit(".").alias("dir"), F.lit(0).alias("depth"))), inner)
