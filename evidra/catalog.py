"""The queries over the driver's tables and the SQL that must agree with them.

Records are rows of the business tables, references their foreign keys, sources the documents and pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import checks
from evidra.operators import graph, integrity, projections, tables, terms
from evidra.session import table
from evidra.sources import text as texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = r"regexp_split_to_array(regexp_replace(coalesce(text, ''), '^\x{FEFF}', ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_BLANK = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_STRIPPED = f"regexp_replace(coalesce(text, ''), '^{_BLANK}+|{_BLANK}+$', '', 'g')"
_BLOCKS = f"(SELECT doc_id, source, i AS ord, l[i] AS text FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, source, CASE WHEN a[len(a)] = '' THEN a[:len(a) - 1] ELSE a END AS l FROM (SELECT doc_id, source, {_LINES} AS a FROM documents))))"
_EDGES = """(SELECT 'orders:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'o_custkey' AS field FROM orders
    UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'c_nationkey' FROM customer
    UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 's_nationkey' FROM supplier
    UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'n_regionkey' FROM nation)"""


def query(sql: str):
    """Registers a query together with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _key(name: str, column: str):
    return F.concat(F.lit(name + ":"), F.col(column).cast("string"))


def _edges(spark: SparkSession, d: str, with_lines: bool = False) -> DataFrame:
    parts = [
        (table(spark, d, "orders"), _key("orders", "o_orderkey"), _key("customer", "o_custkey"), "o_custkey"),
        (table(spark, d, "customer"), _key("customer", "c_custkey"), _key("nation", "c_nationkey"), "c_nationkey"),
        (table(spark, d, "supplier"), _key("supplier", "s_suppkey"), _key("nation", "s_nationkey"), "s_nationkey"),
        (table(spark, d, "nation"), _key("nation", "n_nationkey"), _key("region", "n_regionkey"), "n_regionkey"),
    ]
    if with_lines:
        line = F.concat_ws(":", F.lit("lineitem"), "l_orderkey", "l_linenumber")
        parts.append((table(spark, d, "lineitem"), line, _key("orders", "l_orderkey"), "l_orderkey"))
    return integrity.edges(*parts)


@query(f"SELECT doc_id, ord, 'L' || ord AS anchor, text, 'parsed' AS disposition FROM {_BLOCKS}")
def blocks_lines(spark, d):
    return texts.line_blocks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", F.col("ord").cast("long").alias("ord"), "anchor", "text", "disposition")


@query(f"""WITH s AS (SELECT doc_id, length({_STRIPPED}) < 20 AS sparse FROM documents)
    SELECT source, count(*) AS blocks, CAST(count(*) FILTER (sparse) AS BIGINT) AS needs_review,
        CAST(coalesce(any_value(n), 0) AS BIGINT) AS issues, 'not_performed' AS semantic_extraction
    FROM {_BLOCKS} b JOIN s USING (doc_id) LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE length({_STRIPPED}) < 20 GROUP BY source) USING (source) GROUP BY source""")  # fmt: skip
def blocks_coverage(spark, d):
    docs = table(spark, d, "documents").withColumn("sparse", texts.is_sparse(F.col("text")))
    blocks = texts.line_blocks(docs, "doc_id", "text", "source", "sparse").withColumn("disposition", F.when(F.col("sparse"), "needs_review").otherwise("parsed"))
    return texts.coverage(blocks, docs.where("sparse"), ["source"])


@query(f"SELECT doc_id, CAST(length({_STRIPPED}) AS BIGINT) AS chars, 'needs_review' AS disposition, 'scan_or_sparse' AS code FROM documents WHERE length({_STRIPPED}) < 20")
def sparse_units(spark, d):
    docs = table(spark, d, "documents").where(texts.is_sparse(F.col("text")))
    return docs.select("doc_id", F.length(texts.stripped(F.coalesce("text", F.lit("")))).cast("long").alias("chars"), F.lit("needs_review").alias("disposition"), F.lit("scan_or_sparse").alias("code"))


@query("SELECT conv_id, turn, role AS kind, text, 'pending_semantic_review' AS status FROM conversations WHERE role IN ('assistant', 'system')")
def opinions_filter(spark, d):
    blocks = table(spark, d, "conversations").withColumnRenamed("role", "kind")
    return texts.opinions(blocks, kinds=("assistant", "system")).select("conv_id", "turn", "kind", "text", "status")


@query("""SELECT 'nation' AS source, '[' || to_json(CAST(n_nationkey AS VARCHAR)) || ', ' || to_json(n_name) || ', ' || to_json(CAST(n_regionkey AS VARCHAR)) || ']' AS text FROM nation
    UNION ALL SELECT 'region', '[' || to_json(CAST(r_regionkey AS VARCHAR)) || ', ' || to_json(r_name) || ']' FROM region""")
def row_json(spark, d):
    nation = table(spark, d, "nation").select(F.lit("nation").alias("source"), texts.row_text("n_nationkey", "n_name", "n_regionkey").alias("text"))
    return nation.unionByName(table(spark, d, "region").select(F.lit("region").alias("source"), texts.row_text("r_regionkey", "r_name").alias("text")))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber) AS occurrence FROM lineitem QUALIFY occurrence > 1")
def duplicate_id(spark, d):
    return integrity.repeats(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, first_holder FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_holder FROM documents WHERE text IS NOT NULL) WHERE doc_id <> first_holder")
def duplicate_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return integrity.first_holders(docs, "sha256", "doc_id").select("doc_id", "first_holder")


@query("""SELECT 'documents:' || doc_id AS location, 'missing_reference' AS code FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'orders:' || o_orderkey, 'missing_reference' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""")
def missing_reference(spark, d):
    docs = integrity.missing(table(spark, d, "documents"), table(spark, d, "labels"), {"doc_id": "doc_id"}).select(_key("documents", "doc_id").alias("location"))
    orders = integrity.missing(table(spark, d, "orders"), table(spark, d, "customer").where("c_custkey % 10 <> 0"), {"o_custkey": "c_custkey"}).select(_key("orders", "o_orderkey").alias("location"))
    return docs.unionByName(orders).withColumn("code", F.lit("missing_reference"))


@query(f"""WITH b AS (SELECT doc_id, 'L' || ord AS anchor FROM {_BLOCKS} WHERE doc_id % 7 <> 0),
    e AS (SELECT doc_id, 'L1' AS anchor FROM documents UNION ALL SELECT doc_id, 'L' || (n_chars % 40 + 1) FROM documents)
    SELECT e.doc_id, e.anchor, 'invalid_anchor' AS code FROM e WHERE e.doc_id IN (SELECT doc_id FROM b) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = e.doc_id AND b.anchor = e.anchor)""")
def invalid_anchor(spark, d):
    docs = table(spark, d, "documents")
    blocks = texts.line_blocks(docs.where("doc_id % 7 <> 0"), "doc_id", "text").select("doc_id", "anchor")
    cited = docs.select("doc_id", F.explode(F.array(F.lit("L1"), F.concat(F.lit("L"), (F.col("n_chars") % 40 + 1).cast("string")))).alias("anchor"))
    return integrity.invalid_anchors(cited, blocks, "doc_id").withColumn("code", F.lit("invalid_anchor"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority <> '' AND o_totalprice > 400000) AS approved FROM customer")
def approved_exists(spark, d):
    decisions = table(spark, d, "orders").where("o_orderstatus = 'F' and o_orderpriority <> '' and o_totalprice > 400000")
    return integrity.flag_exists(table(spark, d, "customer").select("c_custkey"), "c_custkey", decisions, "o_custkey", "approved")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0")
def unreferenced(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").where("o_orderkey % 20 = 0").select("o_custkey"))


@query("""SELECT s_suppkey AS source, n_nationkey AS target, 'reference_kind' AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> s_suppkey % 5
    UNION ALL SELECT c_custkey, n_nationkey, 'reference_kind' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = c_custkey % 5""")
def reference_kind(spark, d):
    nation = F.broadcast(table(spark, d, "nation"))  # a dimension of fixed size
    supplier = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).where("n_regionkey <> s_suppkey % 5").select(F.col("s_suppkey").alias("source"), F.col("n_nationkey").alias("target"))
    customer = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = c_custkey % 5").select(F.col("c_custkey").alias("source"), F.col("n_nationkey").alias("target"))
    return supplier.unionByName(customer).withColumn("code", F.lit("reference_kind"))


@query(f"SELECT * FROM {_EDGES} UNION SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber, 'orders:' || l_orderkey, 'l_orderkey' FROM lineitem")
def edge_extract(spark, d):
    return _edges(spark, d, with_lines=True)


@query(f"WITH RECURSIVE e AS (SELECT src, dst FROM {_EDGES} UNION SELECT 'lineitem:' || l_orderkey || ':' || l_linenumber, 'orders:' || l_orderkey FROM lineitem), r(node) AS (SELECT 'region:2' UNION SELECT e.src FROM e JOIN r ON e.dst = r.node) SELECT node FROM r")
def impact_closure(spark, d):
    return graph.impact(spark.range(1).select(F.lit("region:2").alias("node")), _edges(spark, d, with_lines=True))


_PARENTS = "(SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey > 1 AND p_partkey % 97 = 0)"


@query(f"WITH RECURSIVE e AS {_PARENTS}, r(o, node) AS (SELECT src, dst FROM e UNION SELECT r.o, e.dst FROM r JOIN e ON e.src = r.node) SELECT o AS node, 'inheritance_cycle' AS code FROM r WHERE o = node")
def hierarchy_cycle(spark, d):
    part = table(spark, d, "part").where("p_partkey > 1").select("p_partkey", F.floor(F.col("p_partkey") / 2).cast("long").alias("parent"))
    up = part.select(F.col("p_partkey").alias("src"), F.col("parent").alias("dst"))
    down = part.where("p_partkey % 97 = 0").select(F.col("parent").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.on_cycles(up.unionByName(down)).withColumn("code", F.lit("inheritance_cycle"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1),
    r(o, node) AS (SELECT src, dst FROM e UNION SELECT r.o, e.dst FROM r JOIN e ON e.src = r.node),
    j AS (SELECT p_partkey AS src, p_partkey // 8 AS dst FROM part WHERE p_partkey % 10 = 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey % 15 = 0)
    SELECT DISTINCT o AS node, 'disjoint_ancestor' AS code FROM r JOIN j ON r.o = j.src AND r.node = j.dst""")
def disjoint_ancestor(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    over = lambda k: F.floor(F.col("p_partkey") / k).cast("long").alias("dst")
    parents = part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), over(2))
    declared = part.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("src"), over(8)).unionByName(part.where("p_partkey % 15 = 0").select(F.col("p_partkey").alias("src"), over(3)))
    return graph.disjoint_with_ancestor(parents, declared).withColumn("code", F.lit("disjoint_ancestor"))


@query("""WITH RECURSIVE e AS (SELECT 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM supplier UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation WHERE n_nationkey % 2 = 0),
    r(iri) AS (SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 UNION SELECT e.dst FROM e JOIN r ON e.src = r.iri)
    SELECT iri FROM r WHERE iri NOT IN (SELECT 'supplier:' || s_suppkey FROM supplier UNION SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey % 3 <> 0) AND iri NOT IN ('region:0', 'nation:6')""")
def import_reach(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    own = supplier.select(_key("supplier", "s_suppkey").alias("src"), _key("nation", "s_nationkey").alias("dst"))
    more = nation.where("n_nationkey % 2 = 0").select(_key("nation", "n_nationkey").alias("src"), _key("region", "n_regionkey").alias("dst"))
    known = supplier.select(_key("supplier", "s_suppkey").alias("iri")).unionByName(nation.where("n_nationkey % 3 <> 0").select(_key("nation", "n_nationkey").alias("iri")))
    aliases = spark.range(1).select(F.explode(F.array(F.lit("region:0"), F.lit("nation:6"))).alias("iri"))
    roots = supplier.where("s_suppkey % 10 = 0").select(_key("supplier", "s_suppkey").alias("iri"))
    return graph.unresolved(roots, own.unionByName(more), known, aliases)


_TERMS = """(SELECT 'urn:part:' || p_partkey AS iri, p_name AS label, p_brand || ' ' || p_type AS definition,
    ['Class', 'ObjectProperty', 'NamedIndividual'][CAST(p_partkey % 3 + 1 AS INT)] AS type, ['Release', 'Provisional', 'ExternalReference', 'Informative'][CAST(p_size % 4 + 1 AS INT)] AS maturity,
    CAST(p_partkey % 11 = 0 AS INT) AS deprecated, CAST(p_partkey % 13 = 0 AS INT) AS example, 'source/' || p_brand AS file FROM part)"""


def _terms(spark, d):
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.concat(F.lit("urn:part:"), key.cast("string")).alias("iri"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_brand", "p_type").alias("definition"),
        pick(["Class", "ObjectProperty", "NamedIndividual"], key % 3).alias("type"), pick(["Release", "Provisional", "ExternalReference", "Informative"], F.col("p_size") % 4).alias("maturity"),
        (key % 11 == 0).cast("int").alias("deprecated"), (key % 13 == 0).cast("int").alias("example"), F.concat(F.lit("source/"), "p_brand").alias("file"),
    )


_FOUND = "(lower(label) LIKE '%{0}%' OR lower(iri) LIKE '%{0}%' OR lower(definition) LIKE '%{0}%')"


@query(f"""SELECT iri, label, definition, type, maturity, file FROM {_TERMS} WHERE {_FOUND.format("red")} AND {_FOUND.format("w_dget")}
    AND maturity IN ('Release', 'ExternalReference') AND deprecated = 0 AND example = 0 AND type IN ('Class', 'ObjectProperty', 'DatatypeProperty', 'AnnotationProperty')
    ORDER BY CASE WHEN lower(label) = 'red w_dget' THEN 0 ELSE 1 END, label, iri, file LIMIT 200""")
def term_search(spark, d):
    return terms.search(_terms(spark, d), "Red  w_dget", limit=500).select("iri", "label", "definition", "type", "maturity", "file")


@query("SELECT 'lang' AS field, lang AS maturity, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY event_type")
def maturity_counts(spark, d):
    langs = table(spark, d, "documents").groupBy(F.col("lang").alias("maturity")).agg(F.count("*").alias("n")).select(F.lit("lang").alias("field"), "maturity", "n")
    return langs.unionByName(table(spark, d, "events").groupBy(F.col("event_type").alias("maturity")).agg(F.count("*").alias("n")).select(F.lit("event_type").alias("field"), "maturity", "n"))


@query("""WITH m AS (SELECT doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN sha256(text || '!') ELSE sha256(text) END AS v FROM documents WHERE doc_id % 23 <> 0),
    p AS (SELECT doc_id AS path, sha256(text) AS v FROM documents WHERE doc_id % 19 <> 0)
    SELECT coalesce(m.path, p.path) AS path, CASE WHEN p.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' ELSE 'changed' END AS state
    FROM m FULL JOIN p ON m.path = p.path WHERE p.path IS NULL OR m.path IS NULL OR m.v <> p.v""")
def verify_manifest(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    listed = docs.where("path % 23 <> 0").select("path", F.sha2(F.when(F.col("path") % 17 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return integrity.compare_manifest(listed, docs.where("path % 19 <> 0").select("path", F.sha2("text", 256).alias("sha256")))


_FIELDS = ["c_name", "c_nationkey", "c_mktsegment"]
_THREE = """b AS (SELECT c_custkey AS k, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 31 <> 0),
    e AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' (edited)' ELSE c_name END AS c_name, CAST(CASE WHEN c_custkey % 11 = 0 THEN 24 - c_nationkey ELSE c_nationkey END AS VARCHAR) AS c_nationkey,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 37 <> 0),
    c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 14 = 0 THEN c_name || ' (edited)' WHEN c_custkey % 21 = 0 THEN upper(c_name) ELSE c_name END AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 31 <> 0),
    j AS (SELECT coalesce(b.k, e.k) AS k, b.k AS bk, e.k AS ek, c.k AS ck, b.c_name AS b1, e.c_name AS e1, c.c_name AS c1, b.c_nationkey AS b2, e.c_nationkey AS e2, c.c_nationkey AS c2, b.c_mktsegment AS b3, e.c_mktsegment AS e3, c.c_mktsegment AS c3
        FROM b FULL JOIN e ON b.k = e.k LEFT JOIN c ON coalesce(b.k, e.k) = c.k),
    x AS (SELECT k, '*' AS field, CAST(bk IS NOT NULL AS VARCHAR) AS base, CAST(ek IS NOT NULL AS VARCHAR) AS edited, CAST(ck IS NOT NULL AS VARCHAR) AS "current" FROM j WHERE bk IS NULL OR ek IS NULL
        UNION ALL SELECT k, 'c_name', b1, e1, c1 FROM j WHERE bk IS NOT NULL AND ek IS NOT NULL UNION ALL SELECT k, 'c_nationkey', b2, e2, c2 FROM j WHERE bk IS NOT NULL AND ek IS NOT NULL UNION ALL SELECT k, 'c_mktsegment', b3, e3, c3 FROM j WHERE bk IS NOT NULL AND ek IS NOT NULL),
    ch AS (SELECT *, base IS DISTINCT FROM "current" AS conflict FROM x WHERE base IS DISTINCT FROM edited AND edited IS DISTINCT FROM "current")"""


def _three(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", *_FIELDS)
    name, key = F.col("c_name"), F.col("c_custkey")
    marked = F.concat(name, F.lit(" (edited)"))
    base = rows.where("c_custkey % 31 <> 0")
    edited = rows.where("c_custkey % 37 <> 0").select(
        "c_custkey", F.when(key % 7 == 0, marked).otherwise(name).alias("c_name"), F.when(key % 11 == 0, 24 - F.col("c_nationkey")).otherwise(F.col("c_nationkey")).alias("c_nationkey"),
        F.when(key % 13 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )
    current = base.withColumn("c_name", F.when(key % 14 == 0, marked).when(key % 21 == 0, F.upper(name)).otherwise(name))
    return base, edited, current


@query(f'WITH {_THREE} SELECT k AS key, field, base, edited, "current", conflict FROM ch')
def diff_changes(spark, d):
    return tables.changes(*_three(spark, d), "c_custkey", _FIELDS)


@query(f"""WITH {_THREE}, t AS (SELECT * FROM ch WHERE k % 2 = 0)
    SELECT c.k AS c_custkey, coalesce((SELECT any_value(t.edited) FROM t WHERE t.k = c.k AND field = 'c_name'), c.c_name) AS c_name,
        CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.k = c.k AND field = 'c_mktsegment') THEN NULL ELSE c.c_mktsegment END AS c_mktsegment,
        CAST(coalesce((SELECT any_value(t.edited) FROM t WHERE t.k = c.k AND field = 'c_nationkey'), c.c_nationkey) AS INT) AS c_nationkey,
        CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.k = c.k) AND c.k % 5 <> 0 THEN 'candidate' WHEN c.k % 5 = 0 THEN 'deprecated' ELSE 'approved' END AS status
    FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = c.k AND field = '*' AND edited = 'false')
    UNION ALL SELECT e.k, e.c_name, e.c_mktsegment, CAST(e.c_nationkey AS INT), CASE WHEN e.k % 5 = 0 THEN 'deprecated' ELSE 'candidate' END FROM e JOIN t ON e.k = t.k AND t.field = '*' AND t.edited = 'true'""")
def merge_apply(spark, d):
    base, edited, current = _three(spark, d)
    decided = tables.changes(base, edited, current, "c_custkey", _FIELDS).withColumn("decision", F.when(F.col("key") % 2 == 0, "edited").otherwise("current"))
    merged = tables.merge(current, decided, "c_custkey", _FIELDS, edited)
    status = F.when(F.col("c_custkey") % 5 == 0, "deprecated").otherwise("approved")
    return merged.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", tables.candidate_again(status, F.col("touched")).alias("status"))


@query("""WITH t AS (SELECT o_custkey, list_sort(list_distinct(list(CAST(o_orderkey AS VARCHAR)))) AS ids, CASE WHEN o_custkey % 3 = 0 THEN 'pass' ELSE 'fail' END AS result FROM orders GROUP BY o_custkey),
    x AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 9 = 0)
    SELECT t.o_custkey AS id, CASE WHEN x.o_custkey IS NULL AND t.o_custkey % 41 <> 0 THEN result ELSE 'not_run' END AS result,
        CASE WHEN x.o_custkey IS NULL AND t.o_custkey % 41 <> 0 THEN 'seen' END AS evidence, CAST(len(ids) AS BIGINT) AS n_records FROM t LEFT JOIN x ON t.o_custkey = x.o_custkey""")
def test_reset(spark, d):
    orders = table(spark, d, "orders")
    tests = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("record_ids"))
    tests = tests.withColumn("result", F.when(F.col("id") % 3 == 0, "pass").otherwise("fail")).withColumn("evidence", F.lit("seen"))
    touched = orders.where("o_orderkey % 9 = 0").select(F.col("o_orderkey").cast("string").alias("node"))
    return tables.reset_tests(tests, touched, tests.where("id % 41 = 0").select("id")).select("id", "result", "evidence", F.size("record_ids").cast("long").alias("n_records"))


@query("""WITH a AS (SELECT DISTINCT o_custkey, o_orderkey, o_orderkey % 3 <> 0 AS kept FROM orders)
    SELECT o_custkey AS id, CASE WHEN bool_or(NOT kept) AND NOT bool_or(kept) THEN 'superseded' ELSE 'approved' END AS status, CAST(count(*) FILTER (kept) AS BIGINT) AS n_affects,
        coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (NOT kept), '') AS invalidated FROM a GROUP BY o_custkey""")
def decisions_invalidate(spark, d):
    orders = table(spark, d, "orders")
    decisions = orders.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("affects")).withColumn("status", F.lit("approved"))
    touched = orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("node"))
    return tables.invalidate(decisions, touched).select("id", "status", F.size("affects").cast("long").alias("n_affects"), F.array_join("invalidated_affects", ",").alias("invalidated"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN CASE WHEN toxic = 0 THEN 'passed_with_evidence' ELSE 'passed_without_evidence' END
    WHEN doc_id % 3 = 0 THEN 'not_run' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'invalid' END AS status FROM labels) GROUP BY status""")
def status_summary(spark, d):
    result = F.when(F.col("quality") == 1, "pass").when(F.col("doc_id") % 3 == 0, "not_run").when(F.col("doc_id") % 3 == 1, "fail")
    return table(spark, d, "labels").select(projections.test_status(result, F.col("toxic") == 0).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 10 = 1 THEN '2024-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS f, strftime(l_shipdate, '%Y-%m-%d') AS t
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey), p AS (SELECT *, CASE WHEN regexp_full_match(f, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_strptime(f, '%Y-%m-%d') END AS fd, try_strptime(t, '%Y-%m-%d') AS td FROM s)
    SELECT o_orderkey, f AS effective_from, t AS effective_to, CASE WHEN fd IS NULL OR td IS NULL THEN 'date_format' ELSE 'date_order' END AS code FROM p WHERE fd IS NULL OR td IS NULL OR fd > td""")
def date_rules(spark, d):
    day = lambda c, f="yyyy-MM-dd": F.date_format(c, f)
    key = F.col("o_orderkey")
    start = F.when(key % 10 == 0, day("o_orderdate", "yyyy/MM/dd")).when(key % 10 == 1, "2024-13-01").otherwise(day("o_orderdate"))
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem").select("l_orderkey", "l_shipdate"), key == F.col("l_orderkey")).select("o_orderkey", start.alias("effective_from"), day("l_shipdate").alias("effective_to"))
    a, b = checks.iso_date(F.col("effective_from")), checks.iso_date(F.col("effective_to"))
    return rows.withColumn("code", F.when(a.isNull() | b.isNull(), "date_format").when(a > b, "date_order")).where("code is not null")


@query("""SELECT p_partkey, CASE p_size % 6
    WHEN 0 THEN CASE WHEN p_size > 25 THEN 'bounds_reversed' WHEN p_size = 24 THEN 'range_empty' END
    WHEN 1 THEN CASE WHEN p_size % 4 = 1 THEN 'cardinality_not_natural' END
    WHEN 2 THEN CASE WHEN p_size > 20 THEN 'values_missing' WHEN p_size > 10 THEN 'value_not_scalar' END
    WHEN 3 THEN CASE WHEN p_size % 2 = 1 THEN 'operator_unknown' END WHEN 4 THEN 'scope_missing' ELSE 'type_unknown' END AS error FROM part""")
def constraint_spec(spark, d):
    size = F.col("p_size")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    spec = (
        F.when(size % 6 == 0, F.when(size == 24, '{"min": 24, "max": 24, "max_inclusive": false}').otherwise(text('{"min": ', size.cast("string"), ', "max": 25}')))
        .when(size % 6 == 1, F.when(size % 4 == 1, text('{"max": ', size.cast("string"), ".5}")).otherwise(text('{"max": ', size.cast("string"), "}")))
        .when(size % 6 == 2, F.when(size > 20, '{"values": []}').when(size > 10, '{"values": [1, {"a": 2}]}').otherwise('{"values": [1, "b", true]}'))
        .when(size % 6 == 3, F.when(size % 2 == 1, '{"operator": "gt"}').otherwise('{"operator": "le"}')).when(size % 6 == 4, '{"scope": ""}').otherwise('{"a": 1}')
    )
    kind = F.element_at(F.array(*map(F.lit, ["value_range", "cardinality", "enumeration", "date_order", "unique", "fuzzy"])), size % 6 + 1)
    return table(spark, d, "part").select("p_partkey", checks.specification_error(kind, F.parse_json(spec)).alias("error"))


@query("""WITH v AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN replace(url, '://', ' ') ELSE url END AS iri FROM pages),
    k AS (SELECT *, regexp_matches(iri, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(iri, '[\\s<>"{}|\\\\^`]') AS ok FROM v)
    SELECT page_id, 'invalid_iri' AS code, NULL::BIGINT AS first_holder FROM k WHERE NOT ok
    UNION ALL SELECT page_id, 'duplicate_iri', f FROM (SELECT page_id, min(page_id) OVER (PARTITION BY iri) AS f FROM k WHERE ok) WHERE page_id <> f""")
def iri_check(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, F.replace("url", F.lit("://"), F.lit(" "))).otherwise(F.col("url")).alias("iri"))
    good = checks.is_iri(F.col("iri"))
    wrong = pages.where(~good).select("page_id", F.lit("invalid_iri").alias("code"), F.lit(None).cast("long").alias("first_holder"))
    return wrong.unionByName(integrity.first_holders(pages.where(good), "iri", "page_id").select("page_id", F.lit("duplicate_iri").alias("code"), "first_holder"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events""")
def json_path(spark, d):
    v = F.parse_json("props")
    here = lambda k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    return table(spark, d, "events").select("event_id", F.try_variant_get(v, "$.k", "long").alias("k"), here("k").alias("has_k"), here("missing").alias("has_missing"))


@query("""SELECT doc_id, CAST(i AS INT) AS piece, sha256(substr(text, i * 20000 + 1, 20000)) AS chunk_sha256, length(text) > 32767 AS over_limit
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 20000.0) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def render_cells(spark, d):
    docs = table(spark, d, "documents").withColumn("over_limit", projections.too_long(F.col("text")))
    return projections.chunks(docs, "text", "doc_id", "over_limit").select("doc_id", "piece", F.sha2("chunk", 256).alias("chunk_sha256"), "over_limit")


@query("""SELECT c_custkey, c_nationkey, CAST(40 + (i % 3) * 300 AS BIGINT) AS x, CAST(40 + (i // 3) * 180 AS BIGINT) AS y
    FROM (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)""")
def layout_grid(spark, d):
    return projections.layout_order(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey")


@query("""SELECT p.p_partkey, p.p_name, coalesce(p.p_type, '') AS kind, CASE WHEN p.p_partkey % 3 = 0 THEN 4611686018427387904 ELSE 1000000 - p.p_partkey END AS position FROM part p""")
def workbook_order(spark, d):
    part = table(spark, d, "part")
    base = part.where("p_partkey % 3 <> 0").withColumn("position", 1_000_000 - F.col("p_partkey"))
    edited = part.select("p_partkey", "p_name", F.coalesce("p_type", F.lit("")).alias("kind"))
    return projections.in_original_order(edited, base, "p_partkey", "position")
