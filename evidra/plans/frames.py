"""A model document as DataFrames: one row an item, its content a variant."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import jsonvalues as J
from evidra.plans import contract as C


@dataclass
class Model:
    """``root`` has one row (v); ``every`` has (collection, pos, id, v) of all items, ``items(c)`` those usable by id.

    An item counts under its id when that is a string with characters and no earlier item has it.
    """

    root: DataFrame
    every: DataFrame
    head: dict[str, Any]

    @property
    def baseline(self) -> bool:
        return self.head["status"] == "baseline"

    def items(self, collection: str) -> DataFrame:
        own = self.every.where((F.col("collection") == collection) & F.col("id").isNotNull())
        first = own.groupBy(F.col("id").alias("__i")).agg(F.min("pos").alias("__p"))
        return own.join(first, (F.col("id") == F.col("__i")) & (F.col("pos") == F.col("__p")), "left_semi").select("pos", "id", "v")


def from_text(document: DataFrame, column: str = "value") -> Model:
    """The model in the single row of ``document``."""
    root = document.select(F.parse_json(column).alias("v"))
    rows = root.select(F.explode(F.array(*[F.struct(F.lit(c).alias("collection"), J.items(J.at("v", c)).alias("x")) for c in C.COLLECTIONS])).alias("c"))
    rows = rows.select("c.collection", F.posexplode("c.x").alias("pos", "v"))
    name = J.text(J.at("v", "id"))
    every = rows.select("collection", F.col("pos").cast("long").alias("pos"), F.when(F.coalesce(name.rlike(r"\S"), F.lit(False)), name).alias("id"), "v")
    head = root.select(
        J.shape(F.col("v")).alias("shape"), J.text(J.at("v", "schema_version")).alias("version"), J.text(J.at("v", "project.status")).alias("status"),
        F.array(*[F.struct(F.lit(c).alias("c"), (J.shape(J.at("v", c)) == "ARRAY").alias("ok")) for c in C.COLLECTIONS]).alias("lists"),
        F.array_compact(F.array(*[F.when(~J.truthy(J.at("v", f"project.{k}")), k) for k in C.PROJECT_FIELDS])).alias("missing"),
    ).first()
    return Model(root, every, head.asDict(recursive=True))


def from_value(spark: SparkSession, value: Any) -> Model:
    """The model in a Python value, which crosses over as one JSON text."""
    return from_text(spark.range(1).select(F.lit(json.dumps(value, ensure_ascii=False)).alias("value")))


def read(spark: SparkSession, path: str) -> Model:
    return from_text(spark.read.text(path, wholetext=True))
