"""Mixing sources to target weights: subset-sum budget fitting over exact text lengths.

Every source is reduced to how many texts it has of each length. A proportional share of each length is
taken first; what remains of the budget is filled by bounded-knapsack dynamic programming over lengths, and
texts of each length are then chosen by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, fresh

WIDEST = 1 << 17


def copies_by_length(length: np.ndarray, count: np.ndarray, budget: int, widest: int = WIDEST) -> np.ndarray:
    """How many of ``count[i]`` texts of ``length[i]`` words to take so that the words come as near ``budget`` as can be.

    Proportional shares first, then whole texts from the longest down until at most ``widest`` words
    (or, if less, twice the longest length) remain, which dynamic programming fills: ``first[s]`` is the item
    by which a sum s was first reached, so the walk back never uses an item twice. Lengths of 0 are taken whole.
    """
    taken = np.where(length > 0, 0, count).astype(np.int64)
    total = int((length * count).sum())
    if budget <= 0 or not total:
        return taken
    if budget >= total:
        return count.astype(np.int64)
    taken = np.where(length > 0, (count * (budget / total)).astype(np.int64), count).astype(np.int64)
    rest = budget - int((length * taken).sum())
    while rest < 0:  # rounding of huge budgets
        i = int(np.argmax(taken * (length > 0)))
        taken[i] -= 1
        rest += int(length[i])
    order = np.argsort(-length, kind="stable")
    keep = min(widest, 2 * int(length.max()))
    for i in order:
        if length[i] and rest > keep:
            n = min(int(count[i] - taken[i]), (rest - keep) // int(length[i]))
            taken[i] += n
            rest -= n * int(length[i])
    rest_dp = min(rest, widest + int(length.max()))
    first = np.full(rest_dp + 1, -1, np.int64)
    first[0] = 0
    items: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        left, part = (min(int(count[i] - taken[i]), rest_dp // int(length[i])), 1) if length[i] else (0, 1)
        while left > 0 and first[rest_dp] < 0:
            part = min(part, left)
            step = part * int(length[i])
            if step <= rest_dp:
                new = np.flatnonzero((first[: rest_dp + 1 - step] >= 0) & (first[step:] < 0)) + step
                first[new] = len(items)
                items.append((int(i), part))
            left -= part
            part *= 2
    at = int(np.flatnonzero(first >= 0)[-1])
    while at:
        i, part = items[first[at]]
        taken[i] += part
        at -= part * int(length[i])
    return taken


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size: one row a source) with each source's target.

    Sources by code point, null last, weigh ``weights`` in turn and divide ``share`` times all words; none gets
    more than ``most`` times its own, and the excess is divided again by weight until none is above. Only sums
    reach the driver. The rank of a source is its place in a range-partitioned sort: partition offsets plus the
    place within the partition.
    """
    placed = sizes.select("source", F.col("source_size").cast("double").alias("own")).repartitionByRange(F.col("source").isNull(), F.col("source"))
    placed = checkpointed(placed.sortWithinPartitions(F.col("source").isNull(), F.col("source")).select("*", F.monotonically_increasing_id().alias("place")))
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).count().orderBy("part").collect()
    before, offsets = 0, []
    for r in parts:
        offsets += [F.lit(r["part"]), F.lit(before - (r["part"] << 33))]
        before += r["count"]
    if not parts:
        return sizes.select("source", F.lit(None).cast("double").alias("target")).limit(0)
    rank = F.col("place") + F.element_at(F.create_map(*offsets), F.shiftright("place", 33))
    weighed = checkpointed(placed.select("source", "own", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).alias("weight")))
    budget = share * weighed.agg(F.sum("own")).first()[0]
    level, full = None, -1
    while True:
        capped = F.lit(False) if level is None else most * F.col("own") <= F.col("weight") * level
        r = weighed.agg(F.coalesce(F.sum(F.when(capped, most * F.col("own"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)), F.count_if(capped)).first()
        if r[2] == full or not r[1]:
            break
        full, level = r[2], (budget - r[0]) / r[1]
    return weighed.select("source", F.least(most * F.col("own"), F.col("weight") * (level or 0.0)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17, rows_a_salt: int = 50_000) -> DataFrame:
    """All rows of ``docs``, with all their columns, and what a mix of target weights takes of them.

    Adds size (words ``[^\\x20\\x09-\\x0D]+``; a null text has none), source_size, target and taken: 0, 1 or 2
    times the size. A source whose target exceeds its words is taken once in whole and the rest of the target a
    second time. Texts without words take 0. Choice among texts of one source and length is by a hash of id and
    seed within salts, of which there are more the more rows there are, so that no group of equal lengths meets
    in one task; rows alike in id, source and size are interchangeable. A null source is a source. Existing
    columns of those names, whatever their case, are replaced. An empty table gives no rows.
    """
    added = ("size", "source_size", "target", "taken")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    key, salt, place, source = fresh(docs, "key", "salt", "place", "mixed_source")
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long"))
    slim = checkpointed(sized.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), "size"))
    n_salts = max(1, -(-slim.count() // rows_a_salt))
    hashed = F.xxhash64("id", F.lit(seed))
    slim = slim.select("id", "source", "size", hashed.alias("key"), F.pmod(F.xxhash64(hashed, F.lit(1)), F.lit(n_salts)).cast("int").alias("salt"))
    salted = checkpointed(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    lengths = salted.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = salted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goals = checkpointed(sizes.join(source_targets(sizes).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        own, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        whole = 1 if target >= own else 0
        take = copies_by_length(group["size"].to_numpy(), group["n"].to_numpy(), round(target) - whole * own)
        return group[["source", "size", "source_size", "target"]].assign(whole=whole, more=take)

    fitted = (
        lengths.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .groupBy("source").applyInPandas(fit, "source string, size long, source_size long, target double, whole long, more long")
    )
    before = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    allotted = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    right = [F.col(c).alias("r_" + c) for c in fitted.columns]
    allotted = allotted.join(fitted.select(*right), F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")))
    allotted = checkpointed(allotted.select("source", "size", "salt", F.col("r_source_size").alias("source_size"), F.col("r_target").alias("target"), F.col("r_whole").alias("whole"), (F.col("r_more") - F.col("before")).alias("more")))
    names = dict(zip(allotted.columns, fresh(docs, *("r_" + c for c in allotted.columns)), strict=True))
    right = {c: F.col(n) for c, n in names.items()}
    hashed = F.xxhash64(F.col(id_col), F.lit(seed))
    full = sized.withColumn(source, F.col(source_col).cast("string")).withColumn(key, hashed).withColumn(salt, F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(n_salts)).cast("int"))
    full = full.withColumn(place, F.row_number().over(Window.partitionBy(source, "size", salt).orderBy(key, id_col)))
    picked = full.join(
        allotted.select(*(F.col(c).alias(n) for c, n in names.items())), F.col(source).eqNullSafe(right["source"]) & (F.col("size") == right["size"]) & (F.col(salt) == right["salt"])
    )
    return picked.select(
        *(F.col(f"`{c}`") for c in docs.columns), "size", right["source_size"].alias("source_size"), right["target"].alias("target"),
        (F.col("size") * (right["whole"] + (F.col(place) <= right["more"]).cast("long"))).alias("taken"),
    )
