"""Commands. Exit codes: 0 done, 1 a check failed, 2 an input error."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys
from pathlib import Path
from typing import Any

from evidra.session import local_session


def _ingested(spark, a) -> dict[str, Any]:
    from evidra.sources import files

    rows = files.ingest(spark, str(Path(a.input).absolute()), getattr(a, "dialect", None), getattr(a, "ocr", False), getattr(a, "language", "chi_sim+eng")).orderBy("ord").collect()
    if not rows:
        source = {"path": str(Path(a.input).absolute()), "sha256": hashlib.sha256(Path(a.input).read_bytes()).hexdigest(), "format": Path(a.input).suffix.lower()}
    else:
        source = {k: rows[0][k] for k in ("path", "sha256", "format")}
    blocks = [{k: r[k] for k in files.COLUMNS} | json.loads(r["extra"]) for r in rows if r["row"] == "block"]
    issues = [{"code": r["code"], "anchor": r["anchor"], **({"message": r["text"]} if r["text"] else {})} for r in rows if r["row"] == "issue"]
    out = {"schema_version": "1.0", "source": source, "blocks": blocks, "issues": issues}
    out |= {"schema": json.loads(r["extra"]) for r in rows if r["row"] == "schema"}
    return out | {"coverage": {"blocks": len(blocks), "needs_review": sum(b["disposition"] != "parsed" for b in blocks), "issues": len(issues), "semantic_extraction": "not_performed"}}


def _run(a: argparse.Namespace) -> tuple[Any, int]:
    from evidra.operators import revisions
    from evidra.sinks import bundle, index, workbook

    spark, read = local_session("4"), bundle.read_json
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "ingest":
        return _ingested(spark, a), 0
    if a.command == "word-opinions":
        got = _ingested(spark, a)
        return {"source": got["source"], "opinions": [b for b in got["blocks"] if b["kind"] in ("comment", "insertion", "deletion")], "status": "pending_semantic_review", "issues": got["issues"]}, 0
    if a.command == "validate":
        issues = bundle.issues_of(spark, read(a.model), Path(a.model).resolve().parent)
        return {"issues": issues}, int(any(x["severity"] == "error" for x in issues))
    if a.command == "export":
        return bundle.export(spark, read(a.model), a.out, Path(a.model).resolve().parent), 0
    if a.command == "review-workbook":
        return revisions.propose(spark, *workbook.read_back(a.workbook), read(a.current)), 0
    if a.command == "merge":
        return revisions.merge(spark, read(a.current), read(a.proposal), read(a.decisions), a.version), 0
    if a.command == "fibo-search":
        return index.search(spark, a.root, a.query, a.limit, a.include_unstable), 0
    if a.command == "fibo-describe":
        return index.describe(spark, a.root, a.iri), 0
    if a.command == "fibo-build":
        return index.build(spark, a.root), 0
    out = index.verify(spark, a.root)
    return out, int(not out["ok"])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evidra", description="Evidence intake, model checks, deliveries, revisions and term search.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, out: bool | None = None) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for x in arguments:
            c.add_argument(x, **({"required": True} if x.startswith("--") else {}))
        if out is not None:
            c.add_argument("--out", required=out)
        return c

    c = command("ingest", "input", out=True)
    c.add_argument("--dialect")
    c.add_argument("--ocr", action="store_true")
    c.add_argument("--language", default="chi_sim+eng")
    command("validate", "model", out=False)
    command("export", "model", out=True)
    command("review-workbook", "workbook", "--current", out=True)
    command("word-opinions", "input", out=True)
    command("merge", "current", "proposal", "--decisions", "--version", out=True)
    for name in ("fibo-search", "fibo-describe", "fibo-build", "fibo-verify"):
        c = command(name)
        c.add_argument("--root", default="terms")
        if name == "fibo-search":
            c.add_argument("query")
            c.add_argument("--limit", type=int, default=20)
            c.add_argument("--include-unstable", action="store_true")
        if name == "fibo-describe":
            c.add_argument("iri")
    return p


def main(arguments: list[str] | None = None) -> int:
    from evidra.sinks import bundle

    a = parser().parse_args(arguments)
    try:
        if getattr(a, "out", None) and Path(a.out).exists():
            raise ValueError("the output exists: " + a.out)
        result, status = _run(a)
        if a.command != "export" and getattr(a, "out", None):
            bundle.write_json(a.out, result)
            result = {"output": a.out, "exit_status": status}
        print(json.dumps(result, ensure_ascii=False, indent=2))
        return status
    except (ValueError, OSError, ImportError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
