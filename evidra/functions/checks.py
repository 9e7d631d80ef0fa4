"""Scalar checks: IRIs, ISO dates, constraint specifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of constraints.
CONSTRAINT_TYPES = ["unique", "cardinality", "value_range", "enumeration", "date_order", "disjoint", "reference", "custom"]


def is_iri(value: Column) -> Column:
    """An absolute identifier: a scheme, and none of white space, angle brackets, double quote, braces, bar, backslash, caret, backtick."""
    return F.coalesce(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & ~value.rlike(r'[\s<>"{}|\\^`]'), F.lit(False))


def iso_date(value: Column) -> Column:
    """The date of text YYYY-MM-DD, else null."""
    return F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def specification_error(kind: Column, spec: Column) -> Column:
    """Why a constraint's specification (a variant) is wrong, as a code; null if nothing is.

    Only the specification is judged, never data.
    """
    get = lambda path, t="variant": F.try_variant_get(spec, f"$.{path}", t)
    shape = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    here = lambda k: get(k).isNotNull()
    number = lambda k: shape(get(k)).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    low, high = get("min", "double"), get("max", "double")
    bad_number = (here("min") & ~number("min")) | (here("max") & ~number("max"))
    whole = lambda k: ~here(k) | ((shape(get(k)) == "BIGINT") & (get(k, "bigint") >= 0))
    flag = lambda k: ~here(k) | (shape(get(k)) == "BOOLEAN")
    closed = F.coalesce(get("min_inclusive", "boolean"), F.lit(True)) & F.coalesce(get("max_inclusive", "boolean"), F.lit(True))
    bounds = (
        F.when(~here("min") & ~here("max"), "bounds_missing").when(bad_number, "bound_not_finite")
        .when((kind == "cardinality") & ~(whole("min") & whole("max")), "cardinality_not_natural").when(low > high, "bounds_reversed")
        .when(~flag("min_inclusive") | ~flag("max_inclusive"), "inclusive_not_boolean").when((low == high) & ~closed, "range_empty")
    )
    values = get("values", "array<variant>")
    scalar = lambda v: shape(v).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "BOOLEAN")
    text = lambda k: F.coalesce(~shape(get(k)).isin("VOID") & ~F.to_json(get(k)).isin('""', "[]", "{}", "0", "false", "null"), F.lit(False))
    return (
        F.when(~F.coalesce(kind.isin(CONSTRAINT_TYPES), F.lit(False)), "type_unknown")
        .when(F.coalesce(shape(spec) != "OBJECT", F.lit(True)) | (F.to_json(spec) == "{}"), "specification_empty")
        .when(kind.isin("value_range", "cardinality"), bounds)
        .when(kind == "enumeration", F.when(values.isNull() | (F.size(values) == 0), "values_missing").when(~F.forall(values, scalar), "value_not_scalar"))
        .when(kind == "date_order", F.when(~F.coalesce(get("operator", "string").isin("lt", "le"), F.lit(False)), "operator_unknown"))
        .when(kind == "unique", F.when(~text("scope"), "scope_missing"))
        .when(kind == "reference", F.when(~F.coalesce(get("policy", "string").isin("must_exist", "allow_external", "requires_resolution"), F.lit(False)), "policy_unknown"))
        .when(kind == "custom", F.when(~text("expression") | ~text("language"), "expression_missing"))
    )
