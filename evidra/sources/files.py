"""Intake of files: one row a block or issue, parsed where the file is read."""

from __future__ import annotations

import csv
import io
import json
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources import ddl, office, rdf

# Suffixes read line by line, and those of images.
LINE_SUFFIXES = [".txt", ".md", ".json", ".yaml", ".yml", ".xml"]
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".tif", ".tiff"]
COLUMNS = ["anchor", "kind", "text", "disposition"]
SCHEMA = "path string, sha256 string, format string, ord long, row string, anchor string, kind string, text string, disposition string, code string, extra string"


def _recognised(content: bytes, suffix: str, language: str) -> str:
    """Text of an image by the external recogniser; at most 120 seconds."""
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(content)
        f.flush()
        return subprocess.run(["tesseract", f.name, "stdout", "-l", language], check=True, capture_output=True, text=True, timeout=120).stdout


def _pdf(content: bytes, found: office.Found, ocr: bool, language: str) -> None:
    try:
        import pdfplumber
    except ImportError:
        found.add("FILE", "unsupported", "", "needs_review")
        found.issue("pdf_reader_missing", "FILE")
        return
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            text, state, anchor = page.extract_text(layout=True) or "", "parsed", f"PAGE{i}"
            if len(text.strip()) < 20:
                state = "needs_review"
                if ocr and shutil.which("tesseract"):
                    image = io.BytesIO()
                    page.to_image(resolution=200).save(image, format="PNG")
                    text = _recognised(image.getvalue(), ".png", language)
                    found.issue("ocr_review", anchor)
                else:
                    found.issue("scan_or_sparse", anchor)
            found.add(anchor, "page", text, state)
            for j, t in enumerate(page.extract_tables(), 1):
                found.add(f"{anchor}/T{j}", "table", json.dumps(t, ensure_ascii=False))
            if page.images:
                found.issue("pdf_visual", anchor)


def _sql(text: str, found: office.Found, dialect: str | None) -> dict[str, Any]:
    tables = []
    try:
        parsed = ddl.statements(text)
    except ddl.DDLError:
        found.add("DDL/RAW", "ddl", text, "needs_review")
        found.issue("ddl_parse", "DDL/RAW")
        parsed = []
    for i, (tokens, comments) in enumerate(parsed, 1):
        anchor = f"DDL/{i}"
        found.add(anchor, "ddl", ddl.spelled(tokens), original_comments=comments)
        if (t := ddl.table_of(tokens)) is None:
            found.issue("ddl_non_table", anchor)
        else:
            tables.append({"name": t.pop("name"), "anchor": anchor, **t})
    found.add("DDL/SOURCE", "original_ddl", text)
    return {"tables": tables, "dialect": dialect or "unspecified"}


def parse(name: str, content: bytes, dialect: str | None = None, ocr: bool = False, language: str = "chi_sim+eng") -> tuple[office.Found, dict[str, Any] | None]:
    """(blocks and issues, schema of tables) of one file, by its suffix. A damaged file raises what its reader raises."""
    suffix, found, schema = PurePosixPath(name).suffix.lower(), office.Found(), None
    if suffix == ".docx":
        found = office.word(content)
    elif suffix in (".xlsx", ".xlsm"):
        found = office.excel(content)
    elif suffix == ".pptx":
        found = office.slides(content)
    elif suffix == ".pdf":
        _pdf(content, found, ocr, language)
    elif suffix == ".sql":
        schema = _sql(content.decode("utf-8-sig"), found, dialect)
    elif suffix in (".csv", ".tsv"):
        rows = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""), delimiter="\t" if suffix == ".tsv" else ",")
        for i, row in enumerate(rows, 1):
            found.add(f"ROW{i}", "row", json.dumps(row, ensure_ascii=False))
    elif suffix in LINE_SUFFIXES:
        for i, line in enumerate(content.decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n").splitlines(), 1):
            found.add(f"L{i}", "text", line)
    elif suffix in IMAGE_SUFFIXES:
        seen = ocr and shutil.which("tesseract") is not None
        found.add("IMAGE1", "image_ocr", _recognised(content, suffix, language) if seen else "", "needs_review")
        found.issue("image_review", "IMAGE1")
    else:
        found.add("FILE", "unsupported", "", "needs_review")
        found.issue("unsupported_format", "FILE")
    return found, schema


def ingest(spark: SparkSession, path: str, dialect: str | None = None, ocr: bool = False, language: str = "chi_sim+eng") -> DataFrame:
    """Every file under ``path`` (a file, folder or pattern) as rows: blocks, issues, and one ``schema`` row for definitions.

    ``ord`` is the place within the file; ``extra`` holds what only some kinds of blocks have, as JSON. A file that
    can't be read gives one issue ``unreadable`` and no blocks. Files are parsed by tasks of their own.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, sha, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = {"path": name, "sha256": sha, "format": PurePosixPath(name).suffix.lower()}
                try:
                    found, schema = parse(name, content, dialect, ocr, language)
                except Exception as e:  # a damaged file must not stop the others
                    found, schema = office.Found(), None
                    found.issues.append({"code": "unreadable", "anchor": "FILE", "message": str(e)})
                out = [head | {"ord": i, "row": "block", **{k: b[k] for k in COLUMNS}, "extra": json.dumps({k: v for k, v in b.items() if k not in COLUMNS}, ensure_ascii=False)} for i, b in enumerate(found.blocks)]
                out += [head | {"ord": i, "row": "issue", "anchor": x["anchor"], "code": x["code"], "text": x.get("message")} for i, x in enumerate(found.issues)]
                if schema is not None:
                    out.append(head | {"ord": 0, "row": "schema", "extra": json.dumps(schema, ensure_ascii=False)})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return files.mapInArrow(rows, SCHEMA)


_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "long" else pa.string()) for c in SCHEMA.split(", ")])
# Folders of a term package that hold no terms.
SKIPPED_FOLDERS = ["etc", ".github", "test", "tests"]
_TRIPLES = "file string, ord long, s string, stype string, p string, o string, otype string, lang string, datatype string, error string"


def scan_triples(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(triples, files): the RDF files below ``root``/source and ``root``/dependencies, and all files there with hash and size.

    Files in folders for tests and the like are listed but not read. A file that can't be read gives one row
    with ``error`` and no triple; Turtle is such a file.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{base}/{sub}" for sub in ("source", "dependencies") if _exists(spark, f"{base}/{sub}")])
    relative = F.regexp_extract("path", r"/((?:source|dependencies)/.*)$", 1)
    files = files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"), "content")
    folders = F.slice(F.split("path", "/"), 2, F.size(F.split("path", "/")))
    wanted = F.lower("path").rlike(r"\.(rdf|ttl|owl)$") & ~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _TRIPLES.split(", ")]
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    if name.endswith(".ttl"):
                        raise ValueError("Turtle is not read")
                    out = [(name, i, *t, None) for i, t in enumerate(rdf.triples(content))]
                except Exception as e:
                    out = [(name, None, None, None, None, None, None, None, None, str(e))]
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ord" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return files.where(wanted).select("path", "content").mapInArrow(read, _TRIPLES), files.drop("content")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)



