"""Identifiers and keys of code elements as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generated_name(kind: Column, name: Column, path: Column, line: Column, column: Column) -> Column:
    """The name, or one made of kind and place for elements without one."""
    unnamed = name.isNull() | (name == "") | name.startswith("(unnamed struct") | name.startswith("(anonymous union")
    return F.when(unnamed, F.concat_ws("-", F.substring(kind, 1, 5), path, line, column)).otherwise(name)


def element_id(kind: Column, name: Column, path: Column, line: Column, column: Column) -> Column:
    """P5: five characters of the kind and twelve digits of a hash of what identifies the element."""
    made = generated_name(kind, name, path, line, column)
    place = F.when(path.isNull(), F.concat_ws(":", kind, made)).otherwise(F.concat_ws("-", kind, F.replace(path, F.lit(":"), F.lit("_")), line, column, made))
    unique = F.when(name.isNull() | (name == ""), made).otherwise(place)
    return F.concat_ws("_", F.substring(kind, 1, 5), F.substring(F.sha2(unique, 256), 1, 12))


def overload_id(base: Column, types: Column) -> Column:
    """P7."""
    return F.concat_ws(":", base, F.array_join(types, ":"))


def _owner(parent_type: Column, parent_name: Column) -> Column:
    return F.when(F.coalesce(parent_type, F.lit("translation_unit")) == "translation_unit", "").otherwise(F.concat(parent_type, F.lit("_"), parent_name, F.lit("_")))


def function_key(parent_type: Column, parent_name: Column, name: Column, is_const: Column, types: Column) -> Column:
    """P8."""
    args = F.when(F.size(types) > 0, F.concat(F.lit("_"), F.array_join(types, "_"))).otherwise("")
    return F.concat(_owner(parent_type, parent_name), name, F.when(is_const, "_const_").otherwise(""), args)


def verbose_key(kind: Column, returns: Column, name: Column, parameters: Column) -> Column:
    """Kind, return type, name and each parameter's type, name and default."""
    one = F.transform(parameters, lambda p: F.concat_ws(" ", p["type"], p["name"], p["default_value"]))
    return F.concat(kind, F.lit(" "), F.coalesce(returns, F.lit("")), F.lit(" "), name, F.lit("("), F.array_join(one, ", "), F.lit(")"))


def class_key(parent_type: Column, parent_name: Column, kind: Column, name: Column) -> Column:
    """P9."""
    return F.concat(_owner(parent_type, parent_name), kind, F.lit("_"), name)


def relative_path(path: Column, root: str) -> Column:
    """P10."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def stopped(path: Column, parts: list[str]) -> Column:
    """Whether path contains one of parts."""
    return F.coalesce(*[F.when(F.contains(path, F.lit(p)), True) for p in parts], F.lit(False))


def stopped_by_suffix(path: Column, patterns: list[str]) -> Column:
    """``*suffix`` or an exact name."""
    tests = [path.endswith(p[1:]) if p.startswith("*") else path == p for p in patterns]
    return F.coalesce(*[F.when(t, True) for t in tests], F.lit(False))


#: Type families (P36) and the kinds whose parents own methods.
CLASS_LIKE = ("class_decl", "struct_decl", "class_template", "class_template_partial_specialization")
FUNCTION_LIKE = ("function_decl", "cxx_method", "constructor", "destructor", "function_template")


def family(kind: Column) -> Column:
    """Functions, classes, declarations, or null for what is dropped."""
    return F.when(kind.isin(*FUNCTION_LIKE), "functions").when(kind.isin(*CLASS_LIKE), "classes").when(kind.isin("enum_decl", "var_decl"), "declarations")


def is_method(kind: Column) -> Column:
    """P37."""
    return kind.isin("cxx_method", "constructor", "destructor")


def layer_number(parameter: Column) -> Column:
    """The layer number in a parameter's name; countDistinct of it counts layers."""
    return F.nullif(F.regexp_extract(parameter, r"layers\.(\d+)\.", 1), F.lit("")).cast("int")
