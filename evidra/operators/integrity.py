"""Referential integrity: missing targets, duplicates, evidence anchors, reference edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def missing(references: DataFrame, targets: DataFrame, on: dict[str, str]) -> DataFrame:
    """References whose target does not exist: columns of ``references`` map to those of ``targets``. Null references are left out."""
    known = targets.select(*[F.col(t).alias(f"__{i}") for i, t in enumerate(on.values())])
    match = reduce(Column.__and__, [F.col(r) == F.col(f"__{i}") for i, r in enumerate(on)])
    return references.dropna(subset=list(on)).join(known, match, "left_anti")


def repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each occurrence of a key after its first: the keys and which occurrence it is.

    Counted with partial sums, so a key with most of the rows costs no more than others.
    """
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys, F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("occurrence"))


def first_holders(df: DataFrame, value: str, position: str) -> DataFrame:
    """Rows whose ``value`` an earlier row holds, with that row's ``position`` as first_holder; null values never repeat."""
    first = df.dropna(subset=[value]).groupBy(F.col(value).alias("__v")).agg(F.min(position).alias("first_holder"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return df.join(first, F.col(value) == F.col("__v")).drop("__v").where(F.col(position) != F.col("first_holder"))


def invalid_anchors(evidence: DataFrame, blocks: DataFrame, source: str = "source_id", anchor: str = "anchor") -> DataFrame:
    """Evidence whose source has readable blocks, none of them at its anchor."""
    readable = blocks.select(F.col(source).alias("__s")).distinct()
    places = blocks.select(F.col(source).alias("__s"), F.col(anchor).alias("__a"))
    cited = evidence.join(readable, F.col(source) == F.col("__s"), "left_semi")
    return cited.join(places, (F.col(source) == F.col("__s")) & F.col(anchor).eqNullSafe(F.col("__a")), "left_anti")


def flag_exists(df: DataFrame, key: str, others: DataFrame, other_key: str, name: str) -> DataFrame:
    """``df`` with ``name``: whether ``others`` holds the key."""
    known = others.select(F.col(other_key).alias("__k")).distinct()
    return df.join(known, F.col(key) == F.col("__k"), "left").withColumn(name, F.col("__k").isNotNull()).drop("__k")


def edges(*parts: tuple[DataFrame, Column, Column, str]) -> DataFrame:
    """Distinct reference edges (src, dst, field) of several tables; null and empty ends are left out."""
    rows = [df.select(src.cast("string").alias("src"), dst.cast("string").alias("dst"), F.lit(field).alias("field")) for df, src, dst, field in parts]
    return reduce(DataFrame.unionByName, rows).where("src <> '' and dst <> ''").distinct()


def compare_manifest(listed: DataFrame, present: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """(key, state) of what differs: changed, missing (listed only) or extra (present only)."""
    a, b = listed.select(F.col(key).alias("a"), F.col(value).alias("va")), present.select(F.col(key).alias("b"), F.col(value).alias("vb"))
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(~F.col("va").eqNullSafe(F.col("vb")), "changed")
    return both.select(F.coalesce("a", "b").alias(key), state.alias("state")).where("state is not null")
