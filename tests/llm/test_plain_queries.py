"""Queries without SQL against plain versions, over a whole small table."""

import zlib

import brute
import numpy as np
import pytest

from evidra.llm import queries, tokens, vectors
from evidra.session import table


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}


def test_op1(spark, sf, texts):
    got = queries.op1_pii(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        counts, sha, joined = brute.pii(texts[r["doc_id"]]["text"])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts and r["base_sha256"] == sha
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(",")) and r["n_spans"] == len([x for x in r["spans"].split(",") if x])


def test_op1_secrets(spark, texts, sf):
    import re

    got = {r["doc_id"]: r for r in queries.op1_pii(spark, sf).collect()}
    for i, r in texts.items():
        spans = [tuple(map(int, x.split(":")[1:])) for x in got[i]["spans"].split(",") if x.startswith("secret:")]
        for m in re.finditer(r'\b[0-9a-f]{40}\b|\bAKIA[0-9A-Z]{16}\b', r["text"] or ""):
            assert any(a <= m.start() and m.end() <= b for a, b in spans)


def test_op2(spark, sf, texts):
    got = queries.op2_licenses(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(texts[r["doc_id"]]["text"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_op3(spark, sf, texts):
    got = queries.op3_toxicity(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_op4(spark, sf, texts):
    got = queries.op4_mixing(spark, sf).collect()
    size = {i: len(brute.SPACE.findall(r["text"] or "")) for i, r in texts.items()}
    whole, taken, target = {}, {}, {}
    for r in got:
        s = texts[r["doc_id"]]["source"]
        whole[s], taken[s], target[s] = whole.get(s, 0) + size[r["doc_id"]], taken.get(s, 0) + r["taken"], r["target"]
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
    assert all(r["source_size"] == whole[texts[r["doc_id"]]["source"]] for r in got)
    assert len(got) == len(texts) and all(abs(taken[s] - target[s]) <= 0.05 * target[s] + 1 for s in whole)


def test_op9(spark, sf, texts):
    with open(tokens.VOCABULARY, "rb") as f:
        encoding = tokens.Tokenizer(f.read()).encoding
    got = queries.op9_tokens(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]]["text"] or ""
        assert r["n_tokens"] == len(encoding.encode_ordinary(text))


def test_vectors_in_double_precision(spark):
    r = np.random.RandomState(2)
    centre = r.normal(size=8)
    rows = [(i, (centre + r.normal(scale=0.001, size=8)).tolist(), 1) for i in range(30)] + [(30 + i, r.normal(size=8).tolist(), 1) for i in range(30)]
    got = {x["vec_id"]: x["component"] for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i] == 0 for i in range(30)) and len(got) == 60
