"""JSON files, evidence of sources, and the delivery folder that appears whole or not at all."""

from __future__ import annotations

import copy
import json
import shutil
import tempfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from evidra.functions import jsonvalues as J
from evidra.operators import rules
from evidra.plans import frames
from evidra.sinks import diagram, document, workbook

# Files of a delivery.
FILES = ["model.json", "业务建模台账.xlsx", "业务模型说明书.docx", "业务模型.drawio", "validation.json"]


class DeliveryError(ValueError):
    """Nothing was delivered."""


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(path: str | Path, value: Any) -> None:
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")


def evidence_blocks(spark: SparkSession, model: dict[str, Any], folder: str | Path) -> tuple[DataFrame, DataFrame]:
    """((source_id, anchor) of readable parsed files, issues found in reading them)."""
    anchors, issues = [], []
    for s in model.get("sources") or []:
        if isinstance(s, dict) and isinstance(s.get("id"), str) and s.get("blocks_path"):
            try:
                parsed = read_json(Path(folder) / s["blocks_path"])
                anchors += [(s["id"], b["anchor"]) for b in parsed["blocks"]]
                if s.get("sha256") and s["sha256"] != parsed["source"]["sha256"]:
                    issues.append(("source_version", s["id"], "error", ""))
            except (OSError, KeyError, ValueError, TypeError) as e:
                issues.append(("source_unavailable", s["id"], "error", str(e)))
    return spark.createDataFrame(anchors, "source_id string, anchor string"), spark.createDataFrame(issues, "code string, location string, severity string, detail string")


def issues_of(spark: SparkSession, model: Any, folder: str | Path | None = None) -> list[dict[str, str]]:
    """All issues of a model document, by code and place."""
    blocks, failures = evidence_blocks(spark, model, folder) if folder is not None and isinstance(model, dict) else (None, None)
    return [r.asDict() for r in rules.validate(spark, frames.from_value(spark, model), blocks, failures).orderBy("code", "location", "detail").collect()]


def export(spark: SparkSession, model: dict[str, Any], out: str | Path, folder: str | Path | None = None) -> dict[str, Any]:
    """Writes the delivery of a model without errors to ``out``, which must not exist.

    All is made in a folder beside it and checked once more there, parsed evidence included; then it is renamed.
    """
    if any(x["severity"] == "error" for x in issues_of(spark, model, folder)):
        raise DeliveryError("the model has errors")
    out, model = Path(out).absolute(), copy.deepcopy(model)
    if out.exists() or out.is_symlink():
        raise DeliveryError("the output exists")
    out.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix=f".{out.name}-", dir=out.parent) as made:
        stage = Path(made) / "delivery"
        stage.mkdir()
        for i, s in enumerate(model["sources"] if folder is not None else [], 1):
            if s.get("blocks_path"):
                (stage / "evidence").mkdir(exist_ok=True)
                shutil.copyfile(Path(folder) / s["blocks_path"], stage / f"evidence/source-{i}.json")
                s["blocks_path"] = f"evidence/source-{i}.json"
        write_json(stage / FILES[0], model)
        workbook.write(model, stage / FILES[1])
        document.write(model, stage / FILES[2])
        diagram.write(frames.from_value(spark, model).items("records"), stage / FILES[3])
        issues = issues_of(spark, model, stage)
        if any(x["severity"] == "error" for x in issues):
            raise DeliveryError("the staged model has errors")
        claims = {"semantic_review": "not_certified_by_script", "validation_scope": "model_structure_evidence_and_constraint_specifications", "policy_execution": "not_run", "shacl_validation": "not_run", "gbt48000_conformance": "not_assessed"}
        write_json(stage / FILES[4], {"model_hash": J.digest(model), "issues": issues, **claims})
        out.mkdir()  # reserves the name; a folder that someone else made meanwhile raises
        try:
            stage.rename(out)
        except BaseException:
            out.rmdir()
            raise
    return {"directory": str(out), "files": FILES, "version": model["project"]["version"]}
