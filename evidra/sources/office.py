"""Blocks of Office files, read with zipfile and ElementTree; nothing outside the file is ever fetched."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from typing import Any
from xml.etree import ElementTree as ET

Block = dict[str, Any]
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
REL = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class Found:
    """Collects blocks and issues in order."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.issues: list[dict[str, str]] = []

    def add(self, anchor: str, kind: str, text: str, disposition: str = "parsed", **extra: Any) -> None:
        self.blocks.append({"anchor": anchor, "kind": kind, "text": text, "disposition": disposition, **extra})

    def issue(self, code: str, anchor: str) -> None:
        self.issues.append({"code": code, "anchor": anchor})


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """(type, target part) of a part's relations, by id."""
    folder, name = posixpath.split(part)
    try:
        root = ET.fromstring(z.read(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"))
    except KeyError:
        return {}
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): (r.get("Type").rsplit("/", 1)[-1], place(r.get("Target"))) for r in root.iter(REL + "Relationship") if r.get("TargetMode") != "External"}


def _text(e: ET.Element, tags: tuple[str, ...], outside: str = "") -> str:
    if e.tag == outside:
        return ""
    return (e.text or "") if e.tag in tags else "".join(_text(c, tags, outside) for c in e)


def word(content: bytes) -> Found:
    """Paragraphs, tables with nested ones, tracked changes, comments with the places they belong to, notes, headers, footers."""
    found, targets = Found(), {}

    def paragraph(p: ET.Element, anchor: str) -> None:
        found.add(anchor, "paragraph", _text(p, (W + "t",), W + "del"), style=[s.get(W + "val") for s in p.findall(f"{W}pPr/{W}pStyle")])
        for i, change in enumerate((e for e in p.iter() if e.tag in (W + "ins", W + "del")), 1):
            kind = "insertion" if change.tag == W + "ins" else "deletion"
            found.add(f"{anchor}/{kind}{i}", kind, _text(change, (W + "t", W + "delText")), "needs_review", parent_anchor=anchor)
            found.issue("tracked_change", anchor)
        for mark in (e for e in p.iter() if e.tag in (W + "commentRangeStart", W + "commentReference")):
            targets.setdefault(mark.get(W + "id"), []).append(anchor)
        if any(e.tag in (W + "drawing", W + "pict") for e in p.iter()):
            found.issue("embedded_visual", anchor)

    def grid(t: ET.Element, anchor: str) -> None:
        rows = t.findall(W + "tr")
        found.add(anchor, "table_structure", "表格", rows=len(rows))
        for r, row in enumerate(rows, 1):
            for c, cell in enumerate(row.findall(W + "tc"), 1):
                at = f"{anchor}/R{r}/C{c}"
                for i, p in enumerate(cell.findall(W + "p"), 1):
                    paragraph(p, f"{at}/P{i}")
                for i, nested in enumerate(cell.findall(W + "tbl"), 1):
                    grid(nested, f"{at}/T{i}")
                if cell.find(f"{W}tcPr/{W}gridSpan") is not None or cell.find(f"{W}tcPr/{W}vMerge") is not None:
                    found.issue("merged_cell", at)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        n = {"p": 0, "tbl": 0}
        for e in ET.fromstring(z.read("word/document.xml")).find(W + "body"):
            kind = e.tag.removeprefix(W)
            if kind in n:
                n[kind] += 1
                (paragraph if kind == "p" else grid)(e, ("P" if kind == "p" else "T") + str(n[kind]))
            elif kind != "sectPr":
                anchor = f"BODY/{len(found.blocks) + 1}"
                found.add(anchor, "other_body_content", _text(e, (W + "t",)), "needs_review")
                found.issue("unsupported_body_structure", anchor)
        for name in z.namelist():
            if name == "word/comments.xml":
                for c in ET.fromstring(z.read(name)).findall(W + "comment"):
                    found.add("COMMENT/" + c.get(W + "id"), "comment", _text(c, (W + "t",)), "needs_review", targets=targets.get(c.get(W + "id"), []))
            elif re.fullmatch(r"word/(footnotes|endnotes|header\d+|footer\d+)\.xml", name):
                for i, p in enumerate(ET.fromstring(z.read(name)).iter(W + "p"), 1):
                    paragraph(p, f"{name}/P{i}")
            elif name.startswith(("word/media/", "word/embeddings/", "word/charts/", "word/diagrams/")):
                found.issue("embedded_resource", name)
    return found


def sheets(content: bytes) -> list[dict[str, Any]]:
    """Sheets in order: name, state, merged ranges, cells {place: (kind, value, cached)}, comments {place: text}."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in si.iter(S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(S + "si")] if "xl/sharedStrings.xml" in z.namelist() else []
        parts = _relations(z, "xl/workbook.xml")
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(S + "sheet"):
            part = parts[sheet.get(R + "id")][1]
            root, cells = ET.fromstring(z.read(part)), {}
            for c in root.iter(S + "c"):
                v, f, kind = c.find(S + "v"), c.find(S + "f"), c.get("t", "n")
                raw = None if v is None else v.text or ""
                if kind == "s" and raw is not None:
                    raw = shared[int(raw)]
                elif kind == "inlineStr":
                    raw = "".join(t.text or "" for t in c.iter(S + "t"))
                elif kind == "b" and raw is not None:
                    raw = "True" if raw == "1" else "False"
                if f is not None:
                    cells[c.get("r")] = ("formula", "=" + (f.text or ""), raw)
                elif raw is not None:
                    cells[c.get("r")] = ("cell", raw, None)
            notes = {}
            for kind, target in _relations(z, part).values():
                if kind == "comments" and target in z.namelist():
                    notes |= {c.get("ref"): "".join(t.text or "" for t in c.iter(S + "t")) for c in ET.fromstring(z.read(target)).iter(S + "comment")}
            out.append({"name": sheet.get("name"), "state": sheet.get("state", "visible"), "merged": [m.get("ref") for m in root.iter(S + "mergeCell")], "cells": cells, "comments": notes})
    return out


def excel(content: bytes) -> Found:
    """Cells that hold something, formulas with their cached value, comments, and how each sheet is built."""
    found = Found()
    for s in sheets(content):
        found.add(s["name"] + "!INFO", "sheet_structure", json.dumps({"hidden": s["state"], "merged": s["merged"]}, ensure_ascii=False))
        for place, (kind, value, cached) in s["cells"].items():
            anchor = f"{s['name']}!{place}"
            found.add(anchor, kind, value, cached_value=cached if kind == "formula" else None)
            if place in s["comments"]:
                found.add(anchor + "/COMMENT", "comment", s["comments"][place], "needs_review")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if any(n.startswith(("xl/media/", "xl/charts/", "xl/drawings/")) for n in z.namelist()):
            found.issue("excel_visual", "workbook")
    return found


def _lines(body: ET.Element | None) -> str:
    return "" if body is None else "\n".join(_text(p, (A + "t",)) for p in body.findall(A + "p"))


def slides(content: bytes) -> Found:
    """Texts of shapes with grouped ones, table cells and notes of every slide."""
    found = Found()
    drawn = {P + x for x in ("sp", "grpSp", "graphicFrame", "pic", "cxnSp")}

    def shape(e: ET.Element, anchor: str) -> None:
        if e.tag == P + "grpSp":
            for i, inner in enumerate((c for c in e if c.tag in drawn), 1):
                shape(inner, f"{anchor}/G{i}")
        if e.tag == P + "sp":
            found.add(anchor, "slide_text", _lines(e.find(P + "txBody")))
        for table in e.iter(A + "tbl") if e.tag == P + "graphicFrame" else ():
            for r, row in enumerate(table.findall(A + "tr"), 1):
                for c, cell in enumerate(row.findall(A + "tc"), 1):
                    found.add(f"{anchor}/R{r}/C{c}", "table_cell", _lines(cell.find(A + "txBody")))
        if e.tag == P + "pic" or e.tag == P + "graphicFrame" and e.find(f".//{A}graphicData[@uri='http://schemas.openxmlformats.org/drawingml/2006/chart']") is not None:
            found.issue("slide_visual", anchor)

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = _relations(z, "ppt/presentation.xml")
        for i, s in enumerate(ET.fromstring(z.read("ppt/presentation.xml")).iter(P + "sldId"), 1):
            part = parts[s.get(R + "id")][1]
            tree = ET.fromstring(z.read(part)).find(f"{P}cSld/{P}spTree")
            for j, e in enumerate((c for c in tree if c.tag in drawn), 1):
                shape(e, f"SLIDE{i}/S{j}")
            for kind, target in _relations(z, part).values():
                if kind == "notesSlide":
                    bodies = [sp.find(P + "txBody") for sp in ET.fromstring(z.read(target)).iter(P + "sp") if (ph := sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body"]
                    found.add(f"SLIDE{i}/NOTES", "notes", _lines(bodies[0] if bodies else None))
    return found
