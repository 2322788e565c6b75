"""Tables of the domain. Packages carry their small sets as arrays, so a rule is a column expression on two joins."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_s, _a = StringType(), ArrayType(StringType())

#: enforcement, deny and allow expressions of an ignore rule, in the order of the package's file.
IGNORE_RULE = StructType([StructField("enforcements", _a), StructField("deny", _a), StructField("allow", _a), StructField("reason", _s)])

SETTINGS = ("dependency", "privacy", "visibility", "layer", "folder_privacy")

PACKAGES = StructType(
    [StructField("name", _s, False), StructField("parent", _s), StructField("owner", _s), StructField("layer", _s), StructField("public_folder", _s)]
    + [StructField(f"enforce_{s}", _s) for s in SETTINGS]
    + [StructField(c, _a) for c in ("dependencies", "ignored_dependencies", "visible_to", "private_constants", "ignored_private_constants")]
    + [StructField("ignore_rules", ArrayType(IGNORE_RULE)), StructField("client_keys", _s)]
)

REFERENCES = StructType(
    [StructField(c, _s) for c in ("constant_name", "defining_package", "defining_file", "referencing_package", "referencing_file")]
    + [StructField("line", LongType()), StructField("col", LongType())]
)

#: What makes two violations the same.
IDENTIFIER = ("violation_type", "strict", "file", "constant_name", "referencing_package", "defining_package")
VIOLATION = ("message", *IDENTIFIER, "line", "col")
