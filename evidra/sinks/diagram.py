"""The diagram: a page for each domain, laid out by the layout operator."""

from __future__ import annotations

from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import jsonvalues as J
from evidra.operators import projections

# Kinds drawn as nodes, the page of records without a domain and that of an empty model, colours.
NODE_KINDS = ["object", "concept", "role", "event", "state", "decision", "action"]
SHARED, EMPTY = "共享概念", "模型说明"
OWN, FOREIGN, LINE = "#edf3f6", "#fff2cc", "#153b50"


def layout(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all pages from records (pos, id, v).

    A node is on its domain's page; what a relation of the page leads to elsewhere is repeated there, after the
    page's own nodes, by id. Edges whose end is no node are left out.
    """
    named = records.select("pos", "id", J.text(J.at("v", "kind")).alias("kind"), J.text(J.at("v", "name")).alias("name"), *[J.text(J.at("v", f"details.{k}")).alias(k) for k in ("domain", "subject", "object", "cardinality")])
    nodes = named.where(F.col("kind").isin(NODE_KINDS)).select("pos", "id", "name", F.coalesce("domain", F.lit(SHARED)).alias("page"))
    relations = projections.touching(named.where("kind = 'relation'").select(F.col("id").alias("rid"), F.col("pos").alias("rpos"), F.col("name").alias("rname"), "subject", "object", "cardinality"), nodes, "page", "id")
    ends = relations.select("page", F.explode(F.array("subject", "object")).alias("n")).distinct()
    others = ends.join(nodes.select(F.col("id").alias("n"), "name", F.col("page").alias("home")), "n").where("page <> home")
    placed = nodes.select("page", "id", "name", F.lit(False).alias("foreign"), "pos").unionByName(others.select("page", F.col("n").alias("id"), "name", F.lit(True).alias("foreign"), F.lit(0).cast("long").alias("pos")))
    known = nodes.select(F.col("id").alias("k"))
    edges = relations.join(known, F.col("subject") == F.col("k"), "left_semi").join(known, F.col("object") == F.col("k"), "left_semi")
    return projections.layout_order(placed, "page", "foreign", "pos", "id"), edges


def write(records: DataFrame, path: str | Path) -> None:
    nodes, edges = layout(records)
    pages: dict[str, tuple[list, list]] = {}
    rows = nodes.collect()
    first = {p: min(r["pos"] for r in rows if r["page"] == p and not r["foreign"]) for p in {r["page"] for r in rows if not r["foreign"]}}
    for p in sorted(first, key=first.get) or [EMPTY]:
        pages[p] = ([], [])
    for r in sorted(rows, key=lambda r: (r["y"], r["x"])):
        pages[r["page"]][0].append(r)
    for r in edges.orderBy("rpos").collect():
        pages[r["page"]][1].append(r)
    top = ET.Element("mxfile", host="evidra")
    for name, (own, links) in pages.items():
        root = ET.SubElement(ET.SubElement(ET.SubElement(top, "diagram", name=name), "mxGraphModel", adaptiveColors="auto"), "root")
        ET.SubElement(root, "mxCell", id="0")
        ET.SubElement(root, "mxCell", id="1", parent="0")
        for r in own:
            style = f"rounded=1;whiteSpace=wrap;html=0;fillColor={FOREIGN if r['foreign'] else OWN};strokeColor={LINE};fontSize=14;"
            cell = ET.SubElement(root, "mxCell", id=r["id"], value=f"{r['id']} {r['name']}", vertex="1", parent="1", style=style)
            ET.SubElement(cell, "mxGeometry", {"x": str(r["x"]), "y": str(r["y"]), "width": "220", "height": "75", "as": "geometry"})
        for r in links:
            style = "edgeStyle=orthogonalEdgeStyle;rounded=0;html=0;endArrow=open;fontSize=11;"
            cell = ET.SubElement(root, "mxCell", id="edge-" + r["rid"], value=f"{r['rname']} {r['cardinality'] or ''}", edge="1", parent="1", source=r["subject"], target=r["object"], style=style)
            ET.SubElement(cell, "mxGeometry", {"relative": "1", "as": "geometry"})
    ET.ElementTree(top).write(path, encoding="utf-8", xml_declaration=True)
