"""The term index on disk: Parquet partitioned by maturity, its reports, and their verification."""

from __future__ import annotations

import hashlib
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import graph, integrity, terms
from evidra.sinks.bundle import read_json, write_json
from evidra.sources import files

TABLE = "index.parquet"
# Reports that a manifest lists where they exist.
REPORTS = ["coverage.json", "upstream.json", "dependency-sources.json", "dependency-licenses.json", "import-resolutions.json", "DEPENDENCIES.md"]


class IndexMissing(ValueError):
    """There is no index, or not the term asked for."""


def build(spark: SparkSession, root: str) -> dict[str, Any]:
    """Builds the index below ``root`` from its source and dependencies folders and returns the coverage report."""
    triples, listed = files.scan_triples(spark, root)
    triples, listed = triples.cache(), listed.cache()
    good = triples.where("error is null")
    terms.build(good).repartition("maturity", "iri").sortWithinPartitions("iri").write.mode("overwrite").partitionBy("maturity").parquet(f"{root}/{TABLE}")
    index = spark.read.parquet(f"{root}/{TABLE}")
    failures = [{"file": r["file"], "error": r["error"]} for r in triples.where("error is not null").orderBy("file").collect()]
    paths, aliases = {r["path"] for r in listed.select("path").collect()}, {}
    if (Path(root) / "import-resolutions.json").exists():
        for iri, entry in read_json(Path(root) / "import-resolutions.json").items():
            if entry.get("file") in paths and entry.get("evidence"):
                aliases[iri] = entry["file"]
            else:
                failures.append({"file": "import-resolutions.json", "error": "invalid resolution of " + iri})
    known, imported = terms.identifiers(good).select("iri").distinct(), terms.imports(good)
    resolved = spark.createDataFrame([(i,) for i in aliases], "iri string")
    missing = imported.select(F.col("dst").alias("iri")).distinct().join(known, "iri", "left_anti").join(resolved, "iri", "left_anti")
    roots = terms.file_maturity(good).where("maturity = 'Release' and file like 'source/%'").select("file").join(terms.ontologies(good), "file").select(F.col("ontology").alias("iri"))
    named = lambda df: sorted(r["iri"] for r in df.collect())
    report = {
        "term_rows": index.count(), "ontology_identifiers": known.count(), "imports": imported.select("dst").distinct().count(), "unresolved_imports": named(missing),
        "release_unresolved_imports": named(graph.unresolved(roots, imported.join(terms.ontologies(good).select(F.col("ontology").alias("src")), "src", "left_semi"), known, resolved)),
        "parse_failures": failures, "maturity_counts": {r["maturity"]: r["count"] for r in index.groupBy("maturity").count().collect()}, "resolutions": aliases,
        "lexical_warnings": [r.asDict() for r in terms.lexical_warnings(good).orderBy("file", "value").collect()],
    }
    report["complete"] = not report["unresolved_imports"] and not failures
    write_json(Path(root) / "coverage.json", report)
    write_json(Path(root) / "dependency-licenses.json", [r.asDict() for r in terms.licences(good).orderBy("file").collect()])
    entries = [r.asDict() for r in listed.select("path", "sha256", "bytes").orderBy("path").collect()]
    own = [p for p in sorted((Path(root) / TABLE).rglob("*.parquet"))] + [Path(root) / n for n in REPORTS if (Path(root) / n).exists()]
    entries += [{"path": p.relative_to(root).as_posix(), "sha256": hashlib.sha256(p.read_bytes()).hexdigest(), "bytes": p.stat().st_size} for p in own]
    upstream = Path(root) / "upstream.json"
    write_json(Path(root) / "manifest.json", {"format": "1.0", "files": entries, "coverage": report, "upstream": read_json(upstream) if upstream.exists() else {}})
    return report


def _index(spark: SparkSession, root: str) -> DataFrame:
    if not (Path(root) / TABLE).exists():
        raise IndexMissing("the index is missing; build it first")
    return spark.read.parquet(f"{root}/{TABLE}")


def search(spark: SparkSession, root: str, query: str, limit: int = 20, include_unstable: bool = False) -> list[dict[str, Any]]:
    return [r.asDict() for r in terms.search(_index(spark, root), query, limit, include_unstable).collect()]


def describe(spark: SparkSession, root: str, iri: str) -> dict[str, Any]:
    """All statements on a term and the blank nodes that hang on it, as N3, file by file."""
    if _index(spark, root).where(F.col("iri") == iri).isEmpty():
        raise IndexMissing("no such term: " + iri)
    triples, _ = files.scan_triples(spark, root)
    found: dict[str, list[list[str]]] = {}
    shown = lambda v, kind, lang=None, datatype=None: v if kind == "bnode" else f"<{v}>" if kind == "iri" else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' + (f"@{lang}" if lang else f"^^<{datatype}>" if datatype else "")
    for r in terms.describe(triples.where("error is null"), iri).orderBy("file", "ord").collect():
        found.setdefault(r["file"], []).append([shown(r["s"], r["stype"]), shown(r["p"], "iri"), shown(r["o"], r["otype"], r["lang"], r["datatype"])])
    return {"iri": iri, "assertions": [{"file": f, "triples": t} for f, t in found.items()]}


def verify(spark: SparkSession, root: str) -> dict[str, Any]:
    """Whether the files below ``root`` are those of its manifest, and complete."""
    manifest = read_json(Path(root) / "manifest.json")
    there = [p for sub in ("source", "dependencies") for p in sorted((Path(root) / sub).rglob("*")) if p.is_file()]
    there += [p for e in manifest["files"] if (p := Path(root) / e["path"]).is_file() and not e["path"].startswith(("source/", "dependencies/"))]
    present = spark.createDataFrame([(p.relative_to(root).as_posix(), hashlib.sha256(p.read_bytes()).hexdigest()) for p in there], "path string, sha256 string")
    listed = spark.createDataFrame([(e["path"], e["sha256"]) for e in manifest["files"]], "path string, sha256 string")
    states = {r["path"]: r["state"] for r in integrity.compare_manifest(listed, present).collect()}
    bad, extra = (sorted(p for p, s in states.items() if (s == "extra") == e) for e in (False, True))
    coverage, sound = manifest["coverage"], not states
    missing = coverage.get("release_unresolved_imports", coverage["unresolved_imports"])
    return {
        "ok": sound and coverage["complete"], "integrity_ok": sound, "changed_or_missing": bad, "unmanifested": extra,
        "dependency_complete": coverage["complete"], "release_dependency_complete": not missing and not coverage["parse_failures"],
    }
