"""Rules, revisions and deliveries on small models."""

import copy
import json
import zipfile

import pytest

from evidra.functions import jsonvalues as J
from evidra.operators import graph, revisions
from evidra.sinks import bundle, document, workbook


def record(rid, kind="object", **details):
    base = {"identity": "key", "model_level": "class", "term_name": rid, "labels": {"en": rid}} if kind == "object" else {}
    return {"id": rid, "kind": kind, "name": rid, "definition": "d", "status": "approved", "evidence": [{"source_id": "S1", "anchor": "L1"}], "links": [], "details": base | details}


@pytest.fixture
def model():
    return {
        "schema_version": "1.1",
        "project": {"id": "P", "title": "t", "version": "1", "status": "draft", "purpose": "p", "domains": ["d"], "application": "a", "owner": "o"},
        "sources": [{"id": "S1", "path": "x", "kind": "k", "version": "1"}],
        "records": [record("A"), record("B", parent_ids=["A"]), record("C", parent_ids=["B"]), record("R", "relation", subject="A", object="B", cardinality="1", model_level="property", term_name="r", labels={"en": "r"}, property_type="object", domain_ids=["A"], range_ids=["B"])],
        "questions": [{"id": "Q1", "question": "?", "blocking": True, "status": "open", "affects": ["A"]}],
        "tests": [{"id": "T1", "question": "?", "expected": "!", "record_ids": ["C"], "result": "pass", "evidence": {"note": "seen"}}],
        "decisions": [{"id": "D1", "status": "approved", "affects": ["A", "Z"], "approved_by": "x", "approved_at": "y"}],
    }


def codes(spark, m, folder=None):
    return sorted((x["code"], x["location"], x["severity"]) for x in bundle.issues_of(spark, m, folder))


def test_clean_model(spark, model):
    assert codes(spark, model) == []


def test_not_an_object(spark):
    assert codes(spark, [1]) == [("schema", "model", "error")]


def test_record_rules(spark, model):
    model["records"] += [
        {"id": "A", "kind": "object"}, {"id": " "}, 5,
        record("X1", "nonsense", iri="no iri", labels={}, effective_from="2024-02-30", effective_to="2024-01-01"),
        record("X2", parent_ids=["X3", "R"], disjoint_ids=["X3"], iri="urn:a"), record("X3", parent_ids=["X2"], iri="urn:a"),
        record("X4", instance_of_ids=["A"], synonyms=[1]), record("X5", "information_unit", content="c", unit_type="odd", statement_nature="fact", representation=[]),
        record("X6", "constraint", constraint_type="value_range", specification={"min": 3, "max": 2}, target_ids=["A"], condition="c", exceptions="e", unknown_handling="u", positive_case="p", negative_case="n"),
        record("X7", source_unit_ids=["A"], parent_ids="A"), record("X8", links=None) | {"links": "A"}, record("X9") | {"evidence": [{"source_id": "S9", "anchor": "", "field": "details.none"}, 3, {}]},
        record("X10") | {"evidence": [], "links": ["NONE"]},
    ]
    got = codes(spark, model)
    want = [
        ("constraint_spec", "X6", "error"), ("date_format", "X1", "error"), ("detail_missing", "X5", "warning"), ("disjoint_ancestor", "X2", "error"), ("duplicate_id", "records.A", "error"),
        ("duplicate_iri", "X3", "error"), ("inheritance_cycle", "X2", "error"), ("inheritance_cycle", "X3", "error"), ("invalid_evidence_field", "X9", "error"), ("invalid_iri", "X1", "error"),
        ("kind", "X1", "error"), ("metadata", "X1", "error"), ("metadata", "X4", "error"), ("missing_anchor", "X9", "error"), ("missing_anchor", "X9", "error"), ("missing_id", "records[5]", "error"), ("missing_id", "records[6]", "error"),
        ("missing_reference", "X10", "error"), ("missing_source", "X9", "error"), ("missing_source", "X9", "error"), ("model_level", "X4", "error"), ("no_evidence", "X10", "warning"), ("reference_kind", "X2", "error"),
        ("reference_kind", "X7", "error"), ("reference_shape", "X7", "error"), ("representation", "X5", "error"), ("schema", "X8", "error"), ("schema", "X9", "error"), ("unit_type", "X5", "error"),
    ]
    assert got == want


def test_baseline_questions_tests(spark, model):
    model["project"]["status"] = "baseline"
    model["records"][1]["status"] = "reviewed"
    model["tests"] += [{"id": "T2", "question": "q", "record_ids": [], "result": "later"}, {"id": "T3", "question": "q", "expected": "e", "record_ids": [1], "result": "pass", "evidence": [" ", {"n": 3}]}]
    model["questions"].append({"id": "Q2", "status": "resolved", "affects": ["NO"]})
    got = codes(spark, model)
    assert got == sorted([
        *[("approval_missing", r, "error") for r in ("B", "C", "R")], ("missing_reference", "Q2", "error"), ("open_blocker", "Q1", "error"), ("resolution_missing", "Q2", "error"),
        ("test_incomplete", "T2", "error"), ("test_not_passed", "T2", "error"), ("test_not_passed", "T3", "error"), ("test_references", "T3", "error"), ("test_result", "T2", "error"), ("test_unlinked", "T2", "warning"), ("unapproved", "B", "error"),
    ])


def test_evidence_of_sources(spark, model, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"source": {"sha256": "h"}, "blocks": [{"anchor": "L2"}]}))
    model["sources"][0] |= {"blocks_path": "s.json", "sha256": "other"}
    model["sources"].append({"id": "S2", "blocks_path": "none.json"})
    got = codes(spark, model, tmp_path)
    assert [x for x in got if x[0] != "invalid_anchor"] == [("source_unavailable", "S2", "error"), ("source_version", "S1", "error")]
    assert [x[1] for x in got if x[0] == "invalid_anchor"] == ["A", "B", "C", "R"]


def test_each_item_of_evidence_is_judged(spark, model):
    model["records"][1]["evidence"] = [5, {"source_id": "S9", "anchor": ""}, 6]
    model["records"][2]["details"]["parent_ids"] = [""]
    got = [x for x in codes(spark, model) if x[1] in ("B", "C")]
    assert got == [("missing_anchor", "B", "error"), ("missing_reference", "C", "error"), ("missing_source", "B", "error"), ("reference_shape", "C", "error"), ("schema", "B", "error"), ("schema", "B", "error")]


def edits(model):
    e = copy.deepcopy(model)
    e["records"][0]["definition"] = "new"
    e["records"][1]["details"]["labels"]["de"] = "b"
    del e["records"][3]
    e["records"].append(record("N"))
    e["project"]["purpose"] = "other"
    return e


def test_propose_and_merge(spark, model):
    current = copy.deepcopy(model)
    current["records"][0]["definition"] = "theirs"
    p = revisions.propose(spark, model, edits(model), current)
    assert [c["path"] for c in p["changes"]] == [["records", "A", "definition"], ["records", "B", "details", "labels", "de"], ["records", "N"], ["records", "R"], ["project", "purpose"]]
    assert [c["conflict"] for c in p["changes"]] == [True, False, False, False, False]
    assert p["changes"][0]["impact"] == ["A", "B", "C", "R"] and p["changes"][4]["impact"] == ["A", "B", "C", "R"]
    assert p["changes"][0]["id"] == "CH-" + J.digest([["records", "A", "definition"], "d", "new"])[:16]
    with pytest.raises(revisions.RevisionError):
        revisions.merge(spark, current, p, {}, "2")
    kept = revisions.merge(spark, current, p, {c["id"]: "current" for c in p["changes"]}, "2")
    assert {k: v for k, v in kept.items() if k not in ("project", "revision_history")} == {k: v for k, v in current.items() if k != "project"}
    done = revisions.merge(spark, current, p, {c["id"]: "edited" for c in p["changes"]}, "2")
    want = {r["id"]: r for r in edits(model)["records"]}
    assert {r["id"]: r | {"status": "approved"} for r in done["records"]} == want
    assert {r["status"] for r in done["records"]} == {"candidate"} and done["tests"][0]["result"] == "not_run" and "evidence" not in done["tests"][0]
    assert done["decisions"][0]["affects"] == ["Z"] and done["decisions"][0]["invalidated_affects"] == ["A"] and done["decisions"][0]["status"] == "approved"
    with pytest.raises(revisions.RevisionError):
        revisions.merge(spark, done, p, {}, "3")


def test_closure_is_idempotent(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "x")], "src string, dst string")
    once = graph.impact(spark.createDataFrame([("a",), ("q",)], "node string"), edges)
    assert sorted(r[0] for r in once.collect()) == ["a", "b", "c", "q"] == sorted(r[0] for r in graph.impact(once, edges).collect())
    assert sorted(r[0] for r in graph.on_cycles(edges).collect()) == ["a", "b", "c"]


def test_differences():
    assert J.differences({"a": 1, "b": [1], "c": {"d": 1}}, {"a": 1.0, "b": [1, 2], "c": {"e": None}}) == [("b",), ("c", "d"), ("c", "e")]
    assert J.canonical({"b": 1.0, "a": "é"}) == '{"a":"é","b":1.0}'


def test_workbook_round_trip(spark, model, tmp_path):
    model["records"][0]["details"]["own"] = {"kept": [1]}
    workbook.write(model, tmp_path / "w.xlsx")
    base, edited = workbook.read_back(tmp_path / "w.xlsx")
    assert base == model == edited
    model["records"][0]["definition"] = "x" * 32768
    with pytest.raises(workbook.WorkbookError):
        workbook.write(model, tmp_path / "v.xlsx")


def changed_sheet(path, sheet, old, new):
    """The workbook with one part's text replaced."""
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    hit = next(n for n in parts if n.startswith("xl/worksheets/") and sheet in parts[n] and old in parts[n])
    parts[hit] = parts[hit].replace(old, new, 1)
    with zipfile.ZipFile(path, "w") as z:
        for n, text in parts.items():
            z.writestr(n, text)


def test_workbook_edits(model, tmp_path):
    path = tmp_path / "w.xlsx"
    workbook.write(model, path)
    changed_sheet(path, "T1", ">?<", ">why?<")
    base, edited = workbook.read_back(path)
    assert base == model and edited["tests"][0]["question"] == "why?" and {k: v for k, v in edited.items() if k != "tests"} == {k: v for k, v in model.items() if k != "tests"}
    for old, new, says in [(">A<", "><", "missing"), (">A<", ">B<", "repeated"), ("[&quot;A&quot;]", "{}", "JSON list"), ('["A"]', "{}", "JSON list")]:
        workbook.write(model, path)
        try:
            changed_sheet(path, ">B<", old, new)
        except StopIteration:
            continue
        with pytest.raises(workbook.WorkbookError, match=says):
            workbook.read_back(path)


def test_merge_refuses_edits_of_lost_items(spark, model):
    current = copy.deepcopy(model)
    p = revisions.propose(spark, model, edits(model), current)
    p["changes"][0]["path"] = ["records", "nobody", "definition"]
    with pytest.raises(revisions.RevisionError, match="gone"):
        revisions.merge(spark, current, p, {c["id"]: "edited" for c in p["changes"]}, "2")


def test_export(spark, model, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"source": {"sha256": "h"}, "blocks": [{"anchor": "L1"}]}))
    model["sources"][0]["blocks_path"] = "s.json"
    done = bundle.export(spark, model, tmp_path / "out", tmp_path)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*done["files"], "evidence"])
    assert bundle.read_json(tmp_path / "out/model.json")["sources"][0]["blocks_path"] == "evidence/source-1.json"
    drawn = (tmp_path / "out" / done["files"][3]).read_text(encoding="utf-8")
    assert 'x="340" y="40"' in drawn and 'id="edge-R"' in drawn
    assert ("Heading2", "A A") in document.content(model)
    with pytest.raises(bundle.DeliveryError):
        bundle.export(spark, model, tmp_path / "out", tmp_path)


def test_commands(tmp_path, capsys):
    from evidra.cli import parser

    a = parser().parse_args(["merge", "c.json", "p.json", "--decisions", "d.json", "--version", "2", "--out", "o.json"])
    assert (a.command, a.current, a.version) == ("merge", "c.json", "2")
