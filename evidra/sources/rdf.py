"""Triples from RDF/XML with the standard library; Turtle is reported, not read."""

from __future__ import annotations

from urllib.parse import urljoin
from xml.etree import ElementTree as ET

_RDF, _XML = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://www.w3.org/XML/1998/namespace}"
_SYNTAX = {_RDF + x for x in ("about", "ID", "nodeID", "resource", "parseType", "datatype", "li")}


def _iri(tag: str) -> str:
    return tag[1:].replace("}", "", 1)


def triples(content: bytes, base: str = "") -> list[tuple[str, str, str, str, str, str | None, str | None]]:
    """(s, stype, p, o, otype, lang, datatype) in document order; raises on text that is no XML.

    Typed nodes, property attributes, resource, nodeID, datatype, xml:lang and the parse types Resource and
    Collection are understood; entities outside the document are never fetched.
    """
    root, out, made = ET.fromstring(content), [], [0]

    def blank() -> tuple[str, str]:
        made[0] += 1
        return f"_:b{made[0]}", "bnode"

    def full(value: str, at: str) -> str:
        return value if ":" in value.split("/", 1)[0] or not at else urljoin(at, value)

    def node(e: ET.Element, at: str, lang: str | None) -> tuple[str, str]:
        at, lang = e.get(_XML + "base", at), e.get(_XML + "lang", lang)
        if (v := e.get(_RDF + "about")) is not None:
            s = full(v, at), "iri"
        elif (v := e.get(_RDF + "ID")) is not None:
            s = at + "#" + v, "iri"
        elif (v := e.get(_RDF + "nodeID")) is not None:
            s = "_:" + v, "bnode"
        else:
            s = blank()
        if e.tag != _RDF + "Description":
            out.append((*s, _iri(_RDF + "type"), _iri(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if k not in _SYNTAX and not k.startswith(_XML) and k.startswith("{"):
                out.append((*s, _iri(k), v, *(("iri", None, None) if k == _RDF + "type" else ("literal", lang, None))))
        for i, p in enumerate(e, 1):
            prop(s, p, at, lang, i)
        return s

    def prop(s: tuple[str, str], p: ET.Element, at: str, lang: str | None, i: int) -> None:
        at, lang = p.get(_XML + "base", at), p.get(_XML + "lang", lang)
        name = _iri(_RDF + f"_{i}") if p.tag == _RDF + "li" else _iri(p.tag)
        kind, place = p.get(_RDF + "parseType"), len(out)
        if (v := p.get(_RDF + "resource")) is not None:
            o = full(v, at), "iri"
        elif (v := p.get(_RDF + "nodeID")) is not None:
            o = "_:" + v, "bnode"
        elif kind == "Collection":
            nil, rest = (_iri(_RDF + "nil"), "iri"), None
            o = rest = nil
            for c in reversed(list(p)):
                cell = blank()
                out.append((*cell, _iri(_RDF + "first"), *node(c, at, lang), None, None))
                out.append((*cell, _iri(_RDF + "rest"), *rest, None, None))
                o = rest = cell
        elif kind == "Resource":
            o = blank()
            for j, c in enumerate(p, 1):
                prop(o, c, at, lang, j)
        elif len(p) and kind != "Literal":
            o = node(p[0], at, lang)
        else:
            text = "".join(p.itertext()) if kind != "Literal" else (p.text or "") + "".join(ET.tostring(c, "unicode") for c in p)
            out.insert(place, (*s, name, text, "literal", None if p.get(_RDF + "datatype") else lang, p.get(_RDF + "datatype")))
            return
        out.insert(place, (*s, name, *o, None, None))

    at, lang = root.get(_XML + "base", base), root.get(_XML + "lang")
    for e in root if root.tag == _RDF + "RDF" else [root]:
        node(e, at, lang)
    return out
