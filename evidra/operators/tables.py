"""Three-way revisions of keyed tables: changes, conflicts, merges, invalidation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "*"


def _side(df: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    return df.select(F.col(key).alias(f"{name}_key"), F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))


def changes(base: DataFrame, edited: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, base, edited, current, conflict): what ``edited`` changes of ``base`` and ``current`` does not have already.

    A row that was added or removed is one change with field ``*`` and whether each side has it. ``conflict``:
    the current value is not the base's. Values are compared as text, nulls being equal.
    """
    every = _side(base, key, fields, "b").join(_side(edited, key, fields, "e"), F.col("b_key") == F.col("e_key"), "full_outer").withColumn("key", F.coalesce("b_key", "e_key"))
    every = every.join(_side(current, key, fields, "c"), F.col("key") == F.col("c_key"), "left")
    here = lambda x: F.col(f"{x}_key").isNotNull()
    row = F.struct(F.lit(RECORD).alias("field"), *[here(x).cast("string").alias(n) for x, n in (("b", "base"), ("e", "edited"), ("c", "current"))])
    cells = [F.struct(F.lit(f).alias("field"), F.col(f"b.{f}").alias("base"), F.col(f"e.{f}").alias("edited"), F.col(f"c.{f}").alias("current")) for f in fields]
    found = every.select("key", F.explode(F.when(here("b") & here("e"), F.array(*cells)).otherwise(F.array(row))).alias("x")).select("key", "x.*")
    found = found.where(~F.col("base").eqNullSafe(F.col("edited")) & ~F.col("edited").eqNullSafe(F.col("current")))
    return found.withColumn("conflict", ~F.col("base").eqNullSafe(F.col("current")))


def merge(current: DataFrame, decided: DataFrame, key: str, fields: list[str], edited: DataFrame) -> DataFrame:
    """``current`` after the changes whose ``decision`` is edited, with ``touched``: whether the row was changed.

    Cells take the change's value; added rows come from ``edited``, removed ones go.
    """
    taken = decided.where("decision = 'edited'")
    cells = taken.where(F.col("field") != RECORD).groupBy(F.col("key").alias("__k")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("edited").alias("v"))))).alias("__c"))
    rows = taken.where(F.col("field") == RECORD)
    gone, added = rows.where("edited = 'false'").select(F.col("key").alias("__g")), rows.where("edited = 'true'").select(F.col("key").alias("__g"))
    kept = current.join(gone, F.col(key) == F.col("__g"), "left_anti").join(cells, F.col(key) == F.col("__k"), "left")
    kinds = dict(current.dtypes)
    value = lambda f: F.when(F.coalesce(F.map_contains_key("__c", F.lit(f)), F.lit(False)), F.element_at("__c", F.lit(f))["v"].cast(kinds[f])).otherwise(F.col(f)).alias(f)
    kept = kept.select(*[value(c) if c in fields else F.col(c) for c in current.columns], F.col("__k").isNotNull().alias("touched"))
    more = edited.join(added, F.col(key) == F.col("__g"), "left_semi").select(*current.columns, F.lit(True).alias("touched"))
    return kept.unionByName(more)


def candidate_again(status: Column, touched: Column) -> Column:
    """The status of a record once it is touched: candidate, unless deprecated."""
    return F.when(touched & (status != "deprecated"), "candidate").otherwise(status)


def invalidate(decisions: DataFrame, touched: DataFrame, node: str = "node") -> DataFrame:
    """``decisions`` (id, status, affects) with touched ids moved to invalidated_affects; without any left, superseded."""
    each = decisions.select("id", F.explode("affects").alias("__a")).join(touched.select(F.col(node).alias("__a")).distinct(), "__a", "left_semi")
    hit = each.groupBy(F.col("id").alias("__i")).agg(F.array_sort(F.collect_set("__a")).alias("hit"))
    out = decisions.join(hit, F.col("id") == F.col("__i"), "left").withColumn("invalidated_affects", F.coalesce("hit", F.array().cast("array<string>")))
    out = out.withColumn("affects", F.filter("affects", lambda x: ~F.array_contains("invalidated_affects", x)))
    return out.withColumn("status", F.when(F.col("hit").isNotNull() & (F.size("affects") == 0), "superseded").otherwise(F.col("status"))).drop("hit", "__i")


def reset_tests(tests: DataFrame, touched: DataFrame, changed: DataFrame | None = None, node: str = "node") -> DataFrame:
    """``tests`` (id, record_ids, result, evidence): not_run and without evidence where a touched record takes part or the test changed."""
    each = tests.select("id", F.explode("record_ids").alias("__r")).join(touched.select(F.col(node).alias("__r")).distinct(), "__r", "left_semi").select("id")
    ids = each if changed is None else each.unionByName(changed.select("id"))
    again = tests.join(ids.distinct().withColumn("__h", F.lit(True)), "id", "left")
    hit = F.col("__h").isNotNull()
    return again.withColumn("result", F.when(hit, "not_run").otherwise(F.col("result"))).withColumn("evidence", F.when(~hit, F.col("evidence"))).drop("__h")


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions)
