"""A corpus pipeline of five stages; each takes all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import decontam, jaccard, mixing, pii, toxicity
from evidra.llm.common import fresh
from evidra.session import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold; the classifier learns from the labels of two thirds of all ids."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    (score,) = fresh(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.POSITIVE_AT).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows that share an id count as one document and stay together; documents without an id stay.
    """
    found = jaccard.link_components(docs.select("doc_id", "text"), size=5, num=80)
    gone = found.where("doc_id <> component").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("gone"), F.col("print").alias("of")).distinct()
    key = F.struct(F.xxhash64("text"), F.length("text"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("gone")) & (key == F.col("of")), "left_anti").select(docs.columns)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    (spans,) = fresh(docs, "pii")
    done = pii.redact(pii.find_pii(docs, out=spans), spans=spans)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of the documents that the mix takes."""
    return mixing.mix(docs.select("doc_id", "text", "source")).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", cut_benchmark),
    ("pii", redact_pii),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if i == len(STAGES) - 1 else checkpointed(docs)
    return docs
