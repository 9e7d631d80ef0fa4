import io
import json
import zipfile

from evidra.sources import ddl, files, rdf, text


def test_lines_end_as_python_ends_them(spark):
    cases = ["a\r\nb\n", "", "\n", "x\x0by\x1cz w", "﻿q\n\nr", None]
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {i: [] for i in range(len(cases))}
    for r in text.line_blocks(df, "id", "text").orderBy("id", "ord").collect():
        got[r["id"]].append((r["anchor"], r["text"]))
    for i, c in enumerate(cases):
        assert got[i] == [(f"L{k}", x) for k, x in enumerate((c or "").removeprefix("﻿").splitlines(), 1)]


def test_sparse_and_coverage(spark):
    df = spark.createDataFrame([(1, " 　short\n"), (2, "x" * 20), (3, None)], "id long, text string")
    assert [r[0] for r in df.where(text.is_sparse(df["text"])).select("id").orderBy("id").collect()] == [1, 3]
    blocks = spark.createDataFrame([("a", "parsed"), ("a", "needs_review")], "s string, disposition string")
    assert tuple(text.coverage(blocks).first()) == (2, 1, 0, "not_performed")


def test_definitions_keep_keys_and_order():
    found, schema = files.parse("a.sql", b"CREATE TABLE t (a int primary key, b varchar(3) not null references u(x), c decimal(10,2) default 0,\n primary key (a,b), constraint k foreign key (a, c) references s.v (p, q)); -- note\nALTER TABLE t ADD d int;")
    t = schema["tables"][0]
    assert [b["text"] for b in found.blocks][:2] == [
        "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(3) NOT NULL REFERENCES u (x), c DECIMAL(10, 2) DEFAULT 0, PRIMARY KEY (a, b), CONSTRAINT k FOREIGN KEY (a, c) REFERENCES s.v (p, q))",
        "ALTER TABLE t ADD d INT",
    ]
    assert t["primary_key"] == ["a", "b"]
    assert t["foreign_keys"] == [{"columns": ["b"], "target_table": "u", "target_columns": ["x"]}, {"columns": ["a", "c"], "target_table": "s.v", "target_columns": ["p", "q"]}]
    assert [i["code"] for i in found.issues] == ["ddl_non_table"]
    assert found.blocks[-1]["anchor"] == "DDL/SOURCE"


def test_types_of_several_words():
    sql = "create table t (a double precision not null, b timestamp(3) with time zone default now(), c character varying(10), d time without time zone, e decimal(10,2), f, g timestamp)"
    columns = ddl.table_of(ddl.statements(sql)[0][0])["columns"]
    assert [c["type"] for c in columns] == ["DOUBLE PRECISION", "TIMESTAMPTZ(3)", "VARCHAR(10)", "TIME", "DECIMAL(10, 2)", "", "TIMESTAMP"]
    assert columns[0]["constraints"] == ["NOT NULL"] and columns[1]["constraints"][0].startswith("DEFAULT now")


def test_broken_definitions_stay_raw():
    found, schema = files.parse("a.sql", b"CREATE TABLE t (a int")
    assert [b["anchor"] for b in found.blocks] == ["DDL/RAW", "DDL/SOURCE"] and schema["tables"] == []
    assert ddl.table_of(ddl.statements("CREATE TABLE a AS SELECT 1")[0][0]) is None


def docx():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda inner: f"<w:p>{inner}</w:p>"
    r = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = p('<w:pPr><w:pStyle w:val="Head"/></w:pPr><w:commentRangeStart w:id="7"/>' + r("one") + '<w:ins w:id="1">' + r("two") + '</w:ins><w:del w:id="2"><w:r><w:delText>gone</w:delText></w:r></w:del>')
    body += f"<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p(r('cell'))}<w:tbl><w:tr><w:tc>{p(r('in'))}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl><w:sdt>{p(r('box'))}</w:sdt><w:sectPr/>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/comments.xml", f'<w:comments xmlns:w="{w}"><w:comment w:id="7">{p(r("why"))}</w:comment></w:comments>')
        z.writestr("word/media/a.png", b"x")
    return out.getvalue()


def test_word_changes_tables_comments():
    found, _ = files.parse("A.DOCX", docx())
    assert [(b["anchor"], b["kind"], b["text"]) for b in found.blocks] == [
        ("P1", "paragraph", "onetwo"), ("P1/insertion1", "insertion", "two"), ("P1/deletion2", "deletion", "gone"), ("T1", "table_structure", "表格"),
        ("T1/R1/C1/P1", "paragraph", "cell"), ("T1/R1/C1/T1", "table_structure", "表格"), ("T1/R1/C1/T1/R1/C1/P1", "paragraph", "in"),
        ("BODY/8", "other_body_content", "box"), ("COMMENT/7", "comment", "why"),
    ]
    assert found.blocks[0]["style"] == ["Head"] and found.blocks[-1]["targets"] == ["P1"]
    assert [i["code"] for i in found.issues] == ["tracked_change", "tracked_change", "merged_cell", "unsupported_body_structure", "embedded_resource"]


def test_intake_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('"1,2",é\n"q\nr",\n', encoding="utf-8-sig")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / "d.docx").write_bytes(b"no zip")
    rows = files.ingest(spark, str(tmp_path)).collect()
    shown = sorted((r["path"].rsplit("/", 1)[1], r["row"], r["anchor"], r["text"] if r["row"] == "block" else r["code"]) for r in rows)
    assert shown == [
        ("a.txt", "block", "L1", "x"), ("a.txt", "block", "L2", "y"), ("b.csv", "block", "ROW1", '["1,2", "é"]'), ("b.csv", "block", "ROW2", '["q\\nr", ""]'),
        ("c.bin", "block", "FILE", ""), ("c.bin", "issue", "FILE", "unsupported_format"), ("d.docx", "issue", "FILE", "unreadable"),
    ]


RDF_XML = b"""<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:x="http://x/" xml:base="http://x/o">
<owl:Ontology rdf:about="http://x/o"><owl:imports rdf:resource="http://x/p"/><owl:imports rdf:resource="http://x/none"/><x:hasMaturityLevel rdf:resource="http://x/Release"/></owl:Ontology>
<owl:Class rdf:about="http://x/A"><rdfs:label xml:lang="en">Loan</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://x/q"/></owl:Restriction></rdfs:subClassOf><x:when rdf:datatype="http://www.w3.org/2001/XMLSchema#dateTime">2020-1-01T00:00:00</x:when></owl:Class>
<owl:Class rdf:about="http://x/B"><rdfs:label>Old loan</rdfs:label><owl:deprecated>true</owl:deprecated><rdfs:subClassOf rdf:resource="http://x/A"/></owl:Class></rdf:RDF>"""


def test_triples():
    t = rdf.triples(RDF_XML)
    assert ("http://x/B", "iri", "http://www.w3.org/2000/01/rdf-schema#subClassOf", "http://x/A", "iri", None, None) in t
    assert sum(x[1] == "bnode" for x in t) == 2


def test_term_index(spark, tmp_path):
    from evidra.sinks import index

    for sub, name, content in (("source", "o.rdf", RDF_XML), ("dependencies", "p.rdf", RDF_XML.replace(b"http://x/o", b"http://x/p").replace(b'<x:hasMaturityLevel rdf:resource="http://x/Release"/>', b"")), ("source/test", "skipped.rdf", b"bad"), ("source", "t.ttl", b"@prefix")):
        (tmp_path / sub).mkdir(parents=True, exist_ok=True)
        (tmp_path / sub / name).write_bytes(content)
    report = index.build(spark, str(tmp_path))
    assert report["term_rows"] == 4 and report["maturity_counts"] == {"Release": 2, "ExternalReference": 2}
    assert report["unresolved_imports"] == ["http://x/none"] == report["release_unresolved_imports"]
    assert len(report["lexical_warnings"]) == 2 and [f["file"] for f in report["parse_failures"]] == ["source/t.ttl"] and not report["complete"]
    assert [r["label"] for r in index.search(spark, str(tmp_path), "LOAN")] == ["Loan", "Loan"]
    assert [r["label"] for r in index.search(spark, str(tmp_path), "lo_n", include_unstable=True)] == ["Loan", "Loan", "Old loan", "Old loan"]
    said = index.describe(spark, str(tmp_path), "http://x/A")
    assert [len(a["triples"]) for a in said["assertions"]] == [6, 6]
    assert index.verify(spark, str(tmp_path))["integrity_ok"]
    (tmp_path / "source/o.rdf").write_bytes(b"other")
    (tmp_path / "source/new.txt").write_text("x")
    v = index.verify(spark, str(tmp_path))
    assert v["changed_or_missing"] == ["source/o.rdf"] and v["unmanifested"] == ["source/new.txt"] and not v["ok"]


def test_quoted_rows():
    assert json.loads('["a"]') == ["a"]
