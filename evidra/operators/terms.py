"""The term index: rows from triples, ranked keyword search, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the vocabularies that the index reads.
RDF, RDFS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#"
OWL, SKOS, XSD = "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#", "http://www.w3.org/2001/XMLSchema#"
# Types that make a term, in order of precedence, and the stable part of the index.
TYPES = [(OWL + "Class", "Class"), (RDFS + "Class", "Class"), (OWL + "ObjectProperty", "ObjectProperty"), (OWL + "DatatypeProperty", "DatatypeProperty"), (OWL + "AnnotationProperty", "AnnotationProperty"), (OWL + "NamedIndividual", "NamedIndividual")]
STABLE_MATURITY = ["Release", "ExternalReference"]
STABLE_TYPES = ["Class", "ObjectProperty", "DatatypeProperty", "AnnotationProperty"]
LICENCE_PREDICATES = ["http://purl.org/dc/terms/license", "http://purl.org/dc/elements/1.1/rights"]
# What a literal of each datatype must look like.
LEXICAL = {
    "dateTime": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])T([01]\d|2[0-4]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-]\d\d:\d\d)?",
    "date": r"-?\d{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])(Z|[+-]\d\d:\d\d)?",
    "boolean": r"true|false|0|1",
    "integer": r"[+-]?\d+",
    "nonNegativeInteger": r"\+?\d+|-0+",
    "decimal": r"[+-]?(\d+(\.\d*)?|\.\d+)",
    "double": r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN",
}


def is_stable() -> Column:
    return F.col("maturity").isin(STABLE_MATURITY) & (F.col("deprecated") == 0) & (F.col("example") == 0) & F.col("type").isin(STABLE_TYPES)


def like_pattern(term: str) -> str:
    """A search term as a LIKE pattern: % and _ stay wildcards, backslashes are themselves."""
    return "%" + term.lower().replace("\\", "\\\\") + "%"


def search(terms: DataFrame, query: str, limit: int = 20, include_unstable: bool = False) -> DataFrame:
    """Terms that hold every word of ``query`` in label, IRI or definition; an equal label first, then by label, IRI and file.

    ``limit`` is held within 1 and 200. Case is ignored for all letters.
    """
    words = query.split()
    fields = [F.lower(c) for c in ("label", "iri", "definition")]
    found = reduce(lambda df, w: df.where(reduce(Column.__or__, [f.like(like_pattern(w)) for f in fields])), words, terms)
    if not include_unstable:
        found = found.where(is_stable())
    exact = F.when(F.lower("label") == query.lower(), 0).otherwise(1)
    return found.orderBy(exact, "label", "iri", "file").limit(max(1, min(limit, 200)))


def ontologies(triples: DataFrame) -> DataFrame:
    """(file, ontology) for each ontology node of each file, in the order of names."""
    return triples.where((F.col("p") == RDF + "type") & (F.col("o") == OWL + "Ontology")).select("file", F.col("s").alias("ontology")).distinct()


def file_maturity(triples: DataFrame) -> DataFrame:
    """(file, maturity, ontology): ExternalReference for dependencies, else Unknown, unless an ontology states its level."""
    nodes = ontologies(triples)
    said = triples.where(F.col("p").endswith("hasMaturityLevel")).join(nodes.withColumnRenamed("ontology", "s"), ["file", "s"], "left_semi")
    level = said.groupBy("file").agg(F.max(F.element_at(F.split(F.element_at(F.split("o", "/"), -1), "#"), -1)).alias("level"))
    files = triples.select("file").distinct().join(level, "file", "left").join(nodes.groupBy("file").agg(F.min("ontology").alias("ontology")), "file", "left")
    default = F.when(F.col("file").startswith("dependencies/"), "ExternalReference").otherwise("Unknown")
    return files.select("file", F.coalesce("level", default).alias("maturity"), F.coalesce("ontology", F.lit("")).alias("ontology"))


def build(triples: DataFrame) -> DataFrame:
    """The index from triples (file, ord, s, p, o, otype, lang, datatype); otype is iri, bnode or literal, as are s's kinds by ``stype``.

    A row for each IRI and file with a label or a known type, ontology nodes left out. Of several values the
    first in the file counts; definitions are joined. Lists keep the file's order.
    """
    p, lit = F.col("p"), F.col("otype") == "literal"
    ranked = F.coalesce(*[F.when((p == RDF + "type") & (F.col("o") == iri), F.lit(i)) for i, (iri, _) in enumerate(TYPES)])
    values = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ord", "o")))), lambda x: x["o"])
    labelled = (p == RDFS + "label") & (F.col("lang").isNull() | (F.col("lang") == "en"))
    rows = triples.where("stype = 'iri'").withColumn("__t", ranked).groupBy(F.col("s").alias("iri"), "file").agg(
        F.min_by("o", F.when(labelled, F.col("ord"))).alias("label"), F.min("__t").alias("t"), F.bool_or(p == RDFS + "label").alias("named"),
        F.array_join(values(p == SKOS + "definition"), " | ").alias("definition"), F.bool_or((p == OWL + "deprecated") & lit & F.lower("o").isin("true", "1")).cast("int").alias("deprecated"),
        values((p == RDFS + "subClassOf") & (F.col("otype") == "iri")).alias("parents"), values(p == RDFS + "domain").alias("domain"), values(p == RDFS + "range").alias("range"),
    )
    rows = rows.where("named or t is not null").join(ontologies(triples).withColumnRenamed("ontology", "iri"), ["file", "iri"], "left_anti")
    kinds = F.create_map(*[F.lit(x) for i, (_, name) in enumerate(TYPES) for x in (i, name)])
    stem = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    example = (F.concat(F.lit("/"), "file", F.lit("/")).contains("/EXMP/") | F.lower(stem).contains("example")).cast("int")
    return rows.join(file_maturity(triples), "file").select(
        "iri", F.coalesce("label", F.element_at(F.split("iri", "/"), -1)).alias("label"), "definition", F.coalesce(F.element_at(kinds, F.col("t")), F.lit("Resource")).alias("type"),
        "maturity", "deprecated", example.alias("example"), "file", "ontology", "parents", "domain", "range",
    )


def identifiers(triples: DataFrame) -> DataFrame:
    """(iri, file): ontologies and their version IRIs."""
    nodes = ontologies(triples)
    versions = triples.where(F.col("p") == OWL + "versionIRI").join(nodes.withColumnRenamed("ontology", "s"), ["file", "s"], "left_semi").select(F.col("o").alias("iri"), "file")
    return nodes.select(F.col("ontology").alias("iri"), "file").unionByName(versions).distinct()


def imports(triples: DataFrame) -> DataFrame:
    """(src, dst) of owl:imports."""
    return triples.where(F.col("p") == OWL + "imports").select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()


def lexical_warnings(triples: DataFrame) -> DataFrame:
    """(file, value, datatype) of literals that are none of their datatype."""
    bad = reduce(Column.__or__, [(F.col("datatype") == XSD + t) & ~F.col("o").rlike(f"^(?:{r})$") for t, r in LEXICAL.items()])
    return triples.where((F.col("otype") == "literal") & bad).select("file", F.col("o").alias("value"), "datatype")


def licences(triples: DataFrame) -> DataFrame:
    """(file, declarations) of dependencies."""
    said = triples.where(F.col("file").startswith("dependencies/")).withColumn("d", F.when(F.col("p").isin(LICENCE_PREDICATES), F.struct("ord", "o")))
    return said.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["o"]).alias("declarations"))


def describe(triples: DataFrame, iri: str) -> DataFrame:
    """(file, s, p, o, ...) of all triples of an IRI and of the blank nodes that hang on it, file by file."""
    from evidra.operators.graph import reach

    files = triples.where(F.col("s") == iri).select("file").distinct()
    near = triples.join(files, "file", "left_semi")
    key = lambda c: F.concat_ws("\x1f", "file", c)
    hangs = near.where("otype = 'bnode'").select(key("s").alias("src"), key("o").alias("dst"))
    seen = reach(files.select(F.concat_ws("\x1f", "file", F.lit(iri)).alias("node")), hangs)
    return near.join(seen, key("s") == F.col("node"), "left_semi")
