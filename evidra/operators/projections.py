"""Delivery projections: rendered cells, chunks, places on a page, status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The most characters of a spreadsheet cell and the length of a baseline piece.
CELL_LIMIT, CHUNK = 32_767, 20_000


def neutralised(text: Column) -> Column:
    """Cell text that no spreadsheet takes for a formula."""
    return F.when(F.startswith(text, F.lit("=")), F.concat(F.lit("'"), text)).otherwise(text)


def too_long(text: Column) -> Column:
    return F.coalesce(F.length(text) > CELL_LIMIT, F.lit(False))


def chunks(df: DataFrame, text: str, *keep: str, size: int = CHUNK) -> DataFrame:
    """A row for each piece of ``size`` characters: ``keep``, piece (from 0) and chunk; an empty text has none."""
    n = F.ceil(F.length(text) / size).cast("int")
    pieces = df.where(F.length(text) > 0).select(*keep, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return pieces.select(*keep, "piece", F.substring("__t", F.col("piece") * size + 1, F.lit(size)).alias("chunk"))


def layout_order(df: DataFrame, page: str, *order: str) -> DataFrame:
    """``df`` with its nodes' places on each page: three in a row, 300 apart and 180 below each other, from (40, 40)."""
    i = F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1
    return df.withColumn("i", i).withColumn("x", (40 + (F.col("i") % 3) * 300).cast("long")).withColumn("y", (40 + F.floor(F.col("i") / 3) * 180).cast("long")).drop("i")


def test_status(result: Column, has_evidence: Column) -> Column:
    """What a test's result says once its evidence is looked at."""
    return F.when(result == "pass", F.when(has_evidence, "passed_with_evidence").otherwise("passed_without_evidence")).when(result == "not_run", "not_run").when(result == "fail", "failed").otherwise("invalid")


def touching(relations: DataFrame, nodes: DataFrame, page: str, node: str, ends: tuple[str, str] = ("subject", "object")) -> DataFrame:
    """(page, *relations) for each page that holds either end: two equi-joins, no pair twice."""
    on_page = nodes.select(F.col(page), F.col(node).alias("__n"))
    parts = [relations.join(on_page, F.col(e) == F.col("__n")).drop("__n") for e in ends]
    return parts[0].unionByName(parts[1]).distinct()


def in_original_order(edited: DataFrame, base: DataFrame, key: str, position: str) -> DataFrame:
    """``edited`` with ``position`` from ``base``; rows that base does not have come last, by key."""
    at = base.select(F.col(key).alias("__k"), F.col(position).alias("__p"))
    return edited.join(at, F.col(key) == F.col("__k"), "left").withColumn(position, F.coalesce("__p", F.lit(2**62))).drop("__k", "__p")
