"""The validation rules, each a DataFrame of issues: code, location, severity, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import checks
from evidra.functions import jsonvalues as J
from evidra.operators import graph, integrity
from evidra.plans import contract as C
from evidra.plans.frames import Model

_SCHEMA = "code string, location string, severity string, detail string"


def _issue(when: Column, code: str, detail: str | Column = "", severity: str = "error") -> Column:
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")))


def _local(df: DataFrame, *found: Column) -> DataFrame:
    """Issues that a row shows by itself."""
    return df.select(F.col("id").alias("location"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.code", "location", "x.severity", "x.detail")


def _named(df: DataFrame, code: str, location: Column | str, detail: Column | str = "", severity: str = "error") -> DataFrame:
    location = F.col(location) if isinstance(location, str) else location
    detail = F.lit(detail) if isinstance(detail, str) else detail
    return df.select(F.lit(code).alias("code"), location.alias("location"), F.lit(severity).alias("severity"), detail.alias("detail"))


def reference_edges(records: DataFrame) -> DataFrame:
    """Distinct (src, dst, field): links, single and listed references of every record, strings only; a single empty string is none."""
    fields = [("links", J.at("v", "links"))] + [(f, J.at("v", f"details.{f}")) for f in C.REFERENCE_FIELDS + C.REFERENCE_LISTS]
    found = records.select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), J.is_text(v).alias("single"), J.texts_in(v).alias("to")) for n, v in fields])).alias("x"))
    found = found.select(F.col("id").alias("src"), F.col("x.field"), F.col("x.single"), F.explode("x.to").alias("dst"))
    return found.where("not single or dst <> ''").select("src", "dst", "field").distinct()


def _head(spark: SparkSession, m: Model, soft: str) -> DataFrame:
    h, rows = m.head, []
    if h["version"] not in C.VERSIONS:
        rows.append(("schema", "schema_version", "error", ""))
    if h["status"] not in C.PROJECT_STATES:
        rows.append(("schema", "project.status", "error", ""))
    rows += [("project_missing", f"project.{k}", "error", k) for k in h["missing"]]
    rows += [("schema", x["c"], "error", "") for x in h["lists"] if not x["ok"]]
    counts = {r["collection"]: r["n"] for r in m.every.where("id is not null").groupBy("collection").agg(F.count("*").alias("n")).collect()}
    if m.baseline and not counts.get("records"):
        rows.append(("empty_baseline", "records", "error", ""))
    if not counts.get("tests"):
        rows.append(("missing_tests", "tests", soft, ""))
    return spark.createDataFrame(rows, _SCHEMA)


def _record_shape(records: DataFrame) -> DataFrame:
    """``records`` with what many rules ask: kind, status, level, and whether details, links and evidence have their form."""
    here = lambda path, form: (J.shape(J.at("v", path)) == "") | (J.shape(J.at("v", path)) == form)
    return records.select(
        "*", J.text(J.at("v", "kind")).alias("kind"), J.text(J.at("v", "status")).alias("status"), J.text(J.at("v", "details.model_level")).alias("level"),
        here("details", "OBJECT").alias("details_ok"), (here("details", "OBJECT") & here("links", "ARRAY") & here("evidence", "ARRAY")).alias("shape_ok"),
    )


def _record_rules(r: DataFrame, soft: str, baseline: bool) -> DataFrame:
    v = lambda p: J.at("v", p)
    ok, alive = F.col("shape_ok"), F.coalesce(F.col("status") != "deprecated", F.lit(True))
    listed = lambda c, names: F.coalesce(c.isin(names), F.lit(False))
    found = [
        _issue(~listed(F.col("kind"), list(C.KINDS)), "kind"), _issue(~listed(F.col("status"), list(C.STATES)), "status"),
        *[_issue(~J.truthy(v(k)), "record_missing", k) for k in ("name", "definition")], _issue(~ok, "schema", "details, links, evidence"),
        *[_issue(ok & alive & (F.col("kind") == kind) & ~J.truthy(v(f"details.{k}")), "detail_missing", k, soft) for kind, keys in C.REQUIRED.items() for k in keys],
    ]
    if baseline:
        found.append(_issue(ok & alive & ~listed(F.col("status"), ["approved"]), "unapproved"))
    return _local(r, *found)


def _semantic_rules(r: DataFrame, version: str | None, soft: str) -> DataFrame:
    """Rules on semantic metadata; details that are no object count as empty."""
    v = lambda k: F.when(F.col("details_ok"), J.at("v", f"details.{k}"))
    kind, level, alive = F.col("kind"), F.col("level"), F.coalesce(F.col("status") != "deprecated", F.lit(True))
    listed = lambda c, names: F.coalesce(c.isin(names), F.lit(False))
    labels = F.try_variant_get(v("labels"), "$", "map<string,variant>")
    no_text = lambda x: ~J.is_text(x) | ~F.coalesce(F.try_variant_get(x, "$", "string").rlike(r"\S"), F.lit(False))
    dates = {k: checks.iso_date(J.text(v(k))) for k in ("effective_from", "effective_to")}
    expected = F.when(kind == "attribute", "data").when(kind == "relation", "object")
    property_type, given = J.text(v("property_type")), ~J.shape(v("property_type")).isin("", "VOID")
    targets = v("target_ids")
    two = (F.size(J.items(targets)) == 2) & (F.size(F.array_distinct(J.texts_in(targets))) == 2) & (J.shape(targets) == "ARRAY")
    error = checks.specification_error(J.text(v("constraint_type")), v("specification"))
    found = [
        *[_issue((J.shape(v(k)) != "") & ~J.is_id_list(v(k)), "reference_shape", k) for k in C.REFERENCE_LISTS],
        _issue(F.lit(version == "1.0") & kind.isin(C.NEW_KINDS), "schema", "kind needs version 1.1"),
        _issue(~J.shape(v("model_level")).isin("", "VOID") & ~listed(J.text(v("model_level")), C.LEVELS), "model_level"),
        _issue((J.shape(v("labels")) != "") & ((J.shape(v("labels")) != "OBJECT") | (F.size(labels) == 0) | F.exists(F.map_values(labels), no_text)), "metadata", "labels"),
        _issue((J.shape(v("synonyms")) != "") & ((J.shape(v("synonyms")) != "ARRAY") | F.exists(J.items(v("synonyms")), lambda x: ~J.is_text(x))), "metadata", "synonyms"),
        _issue(J.truthy(v("iri")) & ~checks.is_iri(J.text(v("iri"))), "invalid_iri"),
        *[_issue(F.lit(version == "1.1") & kind.isin(C.SEMANTIC_KINDS) & alive & J.blank(v(k)), "detail_missing", k, soft) for k in ("model_level", "term_name", "labels")],
        _issue((level == "class") & J.truthy(v("instance_of_ids")), "model_level", "class and instance"),
        _issue((level == "individual") & ~J.truthy(v("instance_of_ids")), "detail_missing", "instance_of_ids", soft),
        _issue(given & (~listed(property_type, ["data", "object"]) | F.coalesce(property_type != expected, F.lit(False))), "property_type"),
        *[_issue((level == "property") & alive & J.blank(v(k)), "detail_missing", k, soft) for k in ("property_type", "domain_ids")],
        _issue((level == "property") & alive & (property_type == "object") & ~J.truthy(v("range_ids")), "detail_missing", "range_ids", soft),
        _issue((level == "property") & alive & (property_type == "data") & J.truthy(v("range_ids")), "property_type", "range_ids"),
        *[_issue(J.truthy(v(k)) & d.isNull(), "date_format", k) for k, d in dates.items()],
        _issue(dates["effective_from"] > dates["effective_to"], "date_order"),
        _issue((kind == "information_unit") & ~listed(J.text(v("unit_type")), C.UNIT_TYPES), "unit_type"),
        _issue((kind == "information_unit") & ~listed(J.text(v("statement_nature")), C.NATURES), "statement_nature"),
        _issue((kind == "information_unit") & ((J.shape(v("representation")) != "ARRAY") | (F.size(J.items(v("representation"))) == 0) | F.exists(J.items(v("representation")), lambda x: ~J.is_text(x) | (F.try_variant_get(x, "$", "string") == ""))), "representation"),
        _issue((kind == "constraint") & error.isNotNull(), "constraint_spec", error),
        _issue((kind == "constraint") & J.text(v("constraint_type")).isin("date_order", "disjoint") & ~F.coalesce(two, F.lit(False)), "constraint_spec", "two targets"),
    ]
    return _local(r, *found)


def _evidence(r: DataFrame, sources: DataFrame, blocks: DataFrame | None) -> list[DataFrame]:
    """Each item of evidence by itself; one that is no object is only reported as such."""
    keys = F.map_keys(F.try_variant_get("v", "$.details", "map<string,variant>"))
    e = r.where("shape_ok").select("id", "v", keys.alias("keys"), F.explode(J.items(J.at("v", "evidence"))).alias("e"))
    wrong = e.where(J.shape(F.col("e")) != "OBJECT")
    e = e.where(J.shape(F.col("e")) == "OBJECT").withColumn("source_id", J.text(J.at("e", "source_id"))).withColumn("anchor", J.text(J.at("e", "anchor")))
    field = J.text(J.at("e", "field"))
    own = (field.isin("name", "definition") & F.when(field == "name", J.shape(J.at("v", "name")) != "").otherwise(J.shape(J.at("v", "definition")) != "")) | (field.startswith("details.") & F.array_contains("keys", F.substring(field, 9, 2**31 - 1)))
    out = [
        _named(wrong, "schema", "id", "evidence"),
        _named(e.where(~J.truthy(J.at("e", "anchor"))), "missing_anchor", "id"),
        _named(e.where((J.shape(J.at("e", "field")) != "") & ~F.coalesce(own, F.lit(False))), "invalid_evidence_field", "id", F.coalesce(field, F.lit(""))),
        _named(e.join(sources.select(F.col("id").alias("s")), F.col("source_id") == F.col("s"), "left_anti"), "missing_source", "id", F.coalesce("source_id", F.lit(""))),
    ]
    if blocks is not None:
        out.append(_named(integrity.invalid_anchors(e, blocks), "invalid_anchor", "id", F.coalesce("anchor", F.lit(""))))
    return out


def validate(spark: SparkSession, m: Model, blocks: DataFrame | None = None, read_failures: DataFrame | None = None) -> DataFrame:
    """All issues of a model.

    ``blocks`` has (source_id, anchor) of every source whose parsed file could be read, ``read_failures`` the
    issues found in reading them. In a baseline what is missing is an error, in a draft a warning.
    """
    if m.head["shape"] != "OBJECT":
        return spark.createDataFrame([("schema", "model", "error", "")], _SCHEMA)
    soft = "error" if m.baseline else "warning"
    every, records, sources = m.every, _record_shape(m.items("records")), m.items("sources")
    questions, tests, decisions = m.items("questions"), m.items("tests"), m.items("decisions")
    edges = reference_edges(records.where("shape_ok"))
    approved = decisions.where((J.text(J.at("v", "status")) == "approved") & J.truthy(J.at("v", "approved_by")) & J.truthy(J.at("v", "approved_at")))
    approved = approved.select(F.explode(J.texts_in(J.at("v", "affects"))).alias("rid"))
    judged = integrity.flag_exists(records.where("shape_ok").where(F.coalesce(F.col("status") != "deprecated", F.lit(True))), "id", approved, "rid", "is_approved")
    known = records.select(F.col("id").alias("known"))
    unknown = lambda df, column: df.join(known, F.col(column) == F.col("known"), "left_anti")
    has = lambda path: J.truthy(J.at("v", path))
    parts = [
        _head(spark, m, soft),
        _named(every.where("id is null"), "missing_id", F.format_string("%s[%d]", "collection", "pos")),
        _named(integrity.repeats(every.where("id is not null"), ["collection", "id"]), "duplicate_id", F.concat_ws(".", "collection", "id")),
        _record_rules(records, soft, m.baseline), _semantic_rules(records, m.head["version"], soft), *_evidence(records, sources, blocks),
        _named(unknown(edges.select("src", "dst").distinct(), "dst"), "missing_reference", "src", F.col("dst")),
        _named(judged.where(~F.col("is_approved") & (F.coalesce(F.size(J.items(J.at("v", "evidence"))), F.lit(0)) <= 0)), "no_evidence", "id", severity=soft),
    ]
    if m.baseline:
        parts.append(_named(judged.where(~F.col("is_approved")), "approval_missing", "id"))
    affects = questions.select("id", F.explode(J.texts_in(J.at("v", "affects"))).alias("to"))
    parts.append(_named(unknown(affects, "to"), "missing_reference", "id", F.col("to")))
    resolved = F.coalesce(J.text(J.at("v", "status")) == "resolved", F.lit(False))
    parts.append(_local(questions, _issue(F.lit(m.baseline) & has("blocking") & ~resolved, "open_blocker"), _issue(resolved & ~has("resolution"), "resolution_missing")))
    refs = J.at("v", "record_ids")
    listed = (J.shape(refs) == "") | J.is_id_list(refs)
    result, proven = J.text(J.at("v", "result")), J.has_text(J.at("v", "evidence"))
    passed = F.coalesce(result == "pass", F.lit(False))
    parts.append(_local(
        tests, _issue(~listed, "test_references"), _issue(listed & (F.coalesce(F.size(J.items(refs)), F.lit(0)) <= 0), "test_unlinked", severity="warning"),
        _issue(~has("question") | ~has("expected"), "test_incomplete"), _issue(~F.coalesce(result.isin(C.RESULTS), F.lit(False)), "test_result"),
        _issue(F.lit(m.baseline) & ~(passed & proven), "test_not_passed"), _issue(F.lit(not m.baseline) & passed & ~proven, "test_evidence_missing", severity="warning"),
    ))
    linked = tests.where(listed).select("id", F.explode(J.texts_in(refs)).alias("to"))
    parts.append(_named(unknown(linked, "to"), "missing_reference", "id", F.col("to")))
    parts += _typed_references(records)
    if read_failures is not None:
        parts.append(read_failures.select("code", "location", "severity", "detail"))
    return reduce(DataFrame.unionByName, parts)


def _typed_references(records: DataFrame) -> list[DataFrame]:
    """References by the kind and level of their targets, repeated IRIs, inheritance cycles, disjoint ancestors."""
    r = records.where("details_ok")
    lists = F.array(*[F.struct(F.lit(k).alias("field"), F.filter(F.coalesce(J.items(J.at("v", f"details.{k}")), F.array().cast("array<variant>")), J.is_text).alias("to")) for k in C.REFERENCE_LISTS])
    each = r.select("id", F.explode(lists).alias("x")).select("id", F.col("x.field").alias("field"), F.explode("x.to").alias("to")).withColumn("to", F.try_variant_get("to", "$", "string"))
    level = F.when(F.col("details_ok"), J.at("v", "details.model_level"))
    target = records.select(F.col("id").alias("target"), F.col("kind").alias("target_kind"), (J.shape(level).isin("", "VOID") | (J.text(level) == "class")).alias("class_or_none"))
    each = each.join(target, F.col("to") == F.col("target"))
    iris = r.where(J.truthy(J.at("v", "details.iri")) & checks.is_iri(J.text(J.at("v", "details.iri")))).select("pos", "id", J.text(J.at("v", "details.iri")).alias("iri"))
    parents, disjoint = (each.where(F.col("field") == f).select(F.col("id").alias("src"), F.col("to").alias("dst")).distinct() for f in ("parent_ids", "disjoint_ids"))
    return [
        _named(each.where(F.col("field").isin(C.UNIT_LISTS) & ~F.coalesce(F.col("target_kind") == "information_unit", F.lit(False))), "reference_kind", "id", F.col("field")),
        _named(each.where(F.col("field").isin(C.CLASS_LISTS) & ~F.coalesce(F.col("class_or_none"), F.lit(False))), "reference_kind", "id", F.col("field")),
        _named(each.where(F.col("field").isin(C.IRREFLEXIVE_LISTS) & (F.col("to") == F.col("id"))), "self_reference", "id", F.col("field")),
        _named(integrity.first_holders(iris, "iri", "pos"), "duplicate_iri", "id", F.col("iri")),
        _named(graph.on_cycles(parents), "inheritance_cycle", "node"),
        _named(graph.disjoint_with_ancestor(parents, disjoint), "disjoint_ancestor", "node"),
    ]


def has_errors(issues: DataFrame) -> bool:
    return not issues.where("severity = 'error'").isEmpty()
