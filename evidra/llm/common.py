"""What several of the training-data operators need."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.session import checkpointed

BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once; text_blocks cuts them further
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# Functions of this subpackage travel to the executors by value, so that these need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules["evidra.llm"])


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Each name, lengthened until it clashes with no column of ``df`` whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` whose memory does not grow with the length of texts; the rows are the same.

    A batch of Spark's 10,000 rows or 64 MB stands in the executor's native memory and again in the worker's, which
    both keep what they freed. So batches end after BATCH_BYTES, unless the session sets a size of its own (the
    setting stays with the session, as it is read only when the plan runs), and a task's end gives memory back.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) is None:
        conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            _given_back()

    return df.mapInArrow(run, schema)


def _given_back() -> None:
    """Arrow's and the C library's freed memory go back to the system, where the library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components: (node, component) with the smallest node of each as its name.

    ``edges`` holds pairs of longs; loops, repeats and nulls are ignored, and nodes without an edge don't
    come back. Large-star and small-star steps alternate until the edges stay as they are; each step sends
    every edge once and a hub's edges meet only in partial minima and in a join that adaptive execution
    splits. An empty input gives no rows.
    """
    e = (
        edges.where(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`")
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    e, state = checkpointed(e), None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpointed(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, number of each row's group) in pieces of whole groups; rows come sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def numbered(t: pa.Table) -> np.ndarray:
        change = np.zeros(len(t), bool)
        for c in range(keys):
            v = t.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.cumsum(change)

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        group = numbered(t)
        end = int(np.searchsorted(group, group[-1])) if len(t) else 0
        if end:
            yield t.slice(0, end), group[:end]
            held = t.slice(end).combine_chunks().to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield t, numbered(t)
