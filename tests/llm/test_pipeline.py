"""The pipeline's stages and the queries with SQL, over the smallest tables."""

import re
from pathlib import Path

import brute
import corpus_pipeline
import duckdb
import pandas as pd
import pytest

from evidra.llm import queries, sql
from evidra.session import checkpointed, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = checkpointed(stage(spark, docs, sf))
        rows = docs.collect()
        after = {r["doc_id"]: r["text"] for r in rows} if name != "mixing" else {}
        if name == "near_copies":
            found = brute.jaccard_components(list(before.items()), 5, 80)
            assert set(after) == {i for i in before if found[i][1] == i}
        if name == "decontamination":
            items = [tuple(r) for r in table(spark, sf, "benchmark").collect()]
            hits = brute.contaminated(list(before.values()), items)
            assert set(after) == {i for i, h in zip(before, hits, strict=True) if not h[1]}
        if name == "pii":
            assert set(after) == set(before) and all(not sum(brute.pii(t)[0]) for t in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= set(before) and all(0 < r["taken"] <= 2 * r["size"] for r in rows)
        else:
            assert docs.columns == columns and set(after) <= set(before)
        before = after


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf, name):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    a, b = queries.QUERIES[name](spark, sf).toPandas(), c.execute(sql.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    shown = lambda df: sorted(tuple("null" if pd.isna(v) else str(v) for v in r) for r in df[columns].astype(object).values.tolist())
    assert shown(a) == shown(b)


def test_freed_memory_of_the_driver_goes_back(spark):
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    resident = lambda: int(re.search(r"RssAnon:\s+(\d+)", status.read_text())[1]) >> 10
    checkpointed(spark.range(1))
    # Each holds about 130 KB of native memory; the last one stays above the others, so that their end alone returns nothing.
    held = [jvm.java.util.zip.Deflater() for _ in range(2000)]
    for x in held[:-1]:
        x.end()
    freed = resident()
    checkpointed(spark.range(1))
    assert freed - resident() > 100
    held[-1].end()
