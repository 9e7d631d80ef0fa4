"""The queries of this subpackage: each applies one operator to its whole tables and derives the reported columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import chat, decontam, jaccard, licenses, mixing, pii, tokens, toxicity, urls, vectors
from evidra.session import table


def _joined(spans, keep=None):
    names = F.array(*map(F.lit, pii.ALL_KINDS))
    spans = spans if keep is None else F.filter(spans, keep)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{pii.KINDS[k]}")
    secrets = F.size(F.filter("pii", lambda x: x["kind"] == len(pii.KINDS))).cast("long").alias("n_secret")
    return found.select("doc_id", *map(count, range(4)), F.sha2(_joined("pii", lambda x: x["base"]), 256).alias("base_sha256"), _joined("pii").alias("spans"), secrets, F.size("pii").cast("long").alias("n_spans"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("blocks", "wrapped")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.train(docs, labels, usable=remainder != 1)
    scored = toxicity.score(docs, model, out="score")
    return scored.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    done = chat.format_paths(chat.threaded(turns.unionByName(more)))
    read = done.select(F.col("tree").alias("conv_id"), "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("component", "component_id")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("component", "component_id")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all texts before and after three edits: a note put first, a span in the middle replaced, the last words cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, end, said: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(said).alias("replacement"))
    edits = F.array(edit(F.lit(0), F.lit(0), "Note: "), edit(n / 2, n / 2 + 12, "it's replaced 42 times"), edit(n - 5, n + 100, ""))
    done = tokens.recount(tokens.token_trees(docs), edits)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_after").alias("n_tokens_edited"), "n_encoded", F.size("token_tree.ends").cast("long").alias("n_pieces"), F.sha2("text", 256).alias("text_sha256"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).drop("patterns")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_licenses": op2_licenses,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_chat": op5_chat,
    "op6_decontamination": op6_decontamination,
    "op7_vectors": op7_vectors,
    "op8_jaccard": op8_jaccard,
    "op9_tokens": op9_tokens,
    "op10_urls": op10_urls,
}
