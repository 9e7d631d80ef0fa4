"""Where an operator once did less than its whole job."""

import math
import random

import brute
import numpy as np
import pytest

from evidra.llm import common, hashing, jaccard, licenses, mixing, toxicity, vectors


def links_of(rows, threshold=0.98):
    m = np.array([v for _, v, _ in rows], np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= threshold
    np.fill_diagonal(hit, False)
    return hit


def near_pair(r, noise, size):
    """Two tight groups of which each vector links with all of its own group and some or all of the other."""
    centre, across = r.normal(size=16), r.normal(size=16)
    across -= centre * (across @ centre) / (centre @ centre)
    across *= np.linalg.norm(centre) / np.linalg.norm(across)
    out = []
    for angle in (0, np.arccos(0.985)):
        out += [(np.cos(angle) * centre + np.sin(angle) * across + r.normal(scale=noise, size=16)).astype(np.float32).tolist() for _ in range(size)]
    return out


@pytest.mark.parametrize("noise", [0, 0.001, 0.03])
def test_near_vectors_between_tight_groups(spark, noise):
    r = np.random.RandomState(4)
    far = [r.normal(size=16).tolist() for _ in range(60)]
    rows = [(i, v, 0) for i, v in enumerate(far + near_pair(r, noise, 50))]
    hit = links_of(rows)
    assert hit[60:110, 110:].any()
    root = brute.union_find(range(len(rows)), [(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True) if i < j])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for recall in (0.97, 2):
        got = {x["vec_id"]: (x["n_links"], x["component"]) for x in vectors.near_duplicates(df, k=5, attempts=1, recall=recall).collect()}
        assert got == {i: (int(hit[i].sum()), root[i]) for i in range(len(rows))}


MIT = " * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files (the \"Software\"), to deal"
GPL = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by"
BSD = "Redistribution and use in source and binary forms, with or without\r\nmodification, are permitted provided that"


def test_licenses_that_wrap(spark):
    texts = [MIT, "one\n\n" + GPL + "\nmore", BSD, BSD + "\n" + BSD, "all\nother things, rights too, are reserved", "words of the\nGNU Lesser\nGeneral\nPublic License"]
    r = random.Random(8)
    for _ in range(300):
        words = " ".join(t for _, t in r.sample(licenses.TEMPLATES, 2)).split()
        for _ in range(r.randrange(6)):
            words[r.randrange(len(words))] = r.choice(["other", "the", "gnu", "license"])
        texts.append("".join(w + r.choice([" ", " ", " ", "\n"]) for w in words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in licenses.license_scan(df).collect()}
    assert [[(w["label"], w["line"], w["last_line"], w["containment"]) for w in got[i]["wrapped"]] for i in (0, 2, 4)] == [[("mit", 0, 1, 1.0)], [("bsd", 0, 1, 1.0)], []]
    assert ("gpl", 2, 3, 1.0) in [(w["label"], w["line"], w["last_line"], w["containment"]) for w in got[1]["wrapped"]] and got[0]["wrapped"][0]["text"] == MIT
    assert "gpl" in got[1]["labels"].split(",") and got[2]["labels"] == "bsd" and got[0]["score"] == got[2]["score"] == 1 and "lgpl" in got[5]["labels"].split(",")
    assert [(w["line"], w["last_line"]) for w in got[3]["wrapped"]] == [(0, 1), (2, 3)]
    for i, text in enumerate(texts):
        places = [(w, n) for n, x in enumerate(text.split("\n")) for w in brute.ALNUM.findall(x.lower())]
        want, best = set(filter(None, got[i]["base_labels"].split(","))), 0
        for label, t in licenses.TEMPLATES:
            own = brute.ALNUM.findall(t.lower())
            runs = [places[a : a + math.ceil(len(own) / 0.8)] for a in range(len(places))]
            share = max(len({w for w, _ in run} & set(own)) for run in runs) / len(set(own))
            if share >= 0.8:
                want.add(label)
                best = max(best, share)
        assert set(filter(None, got[i]["labels"].split(","))) == want and (got[i]["n_base"] or got[i]["score"] == pytest.approx(best)), text


def test_toxicity_thresholds_from_all_labels(spark):
    """Few texts are toxic; a word that many of these and a tenth of the others have must not suffice."""
    r = random.Random(9)
    rows = []
    for i in range(4000):
        toxic = i % 20 == 0
        words = ["w%d" % r.randrange(60) for _ in range(8)]
        words += ["scum"] * (r.random() < (0.9 if toxic else 0.1)) + ["vile"] * (toxic and r.random() < 0.6)
        rows.append((i, " ".join(words), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"), most=200)
    got = [(x["toxic"], x["toxicity"] >= toxicity.POSITIVE_AT) for x in toxicity.score(d, model).select("toxic", "toxicity").collect()]
    right, found = sum(y and p for y, p in got), sum(p for _, p in got)
    assert 2 * right / (found + 200) >= 0.65


def test_toxicity_reads_six_thousand_of_a_class(spark, monkeypatch):
    seen, fit = [], toxicity.fit

    def counted(texts, y):
        seen.append((len(texts), int(y.sum())))
        return fit([texts[0], texts[1]], y[:2])

    monkeypatch.setattr(toxicity, "fit", counted)
    d = spark.range(16000).selectExpr("id as doc_id", "concat('word ', id) as text", "cast(id % 2 as int) as toxic")
    toxicity.train(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    assert 8500 < seen[0][0] < 9500 and abs(seen[0][1] - seen[0][0] / 2) < 200


def test_mix_keeps_all_columns(spark):
    rows = [(i % 7, " ".join(["w"] * (i % 5)) + f" t{i}", "ab"[i % 2], i) for i in range(40)] + [(None, None, None, 40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, R_More int")
    got = mixing.mix(d, rows_a_salt=10)
    assert got.columns == [*d.columns, "size", "source_size", "target", "taken"]
    assert sorted(map(tuple, got.select(*d.columns).collect()), key=lambda x: x[3]) == rows
    assert all(x["size"] == len((x["text"] or "").split()) for x in got.collect())


def test_long_texts_reach_a_worker_in_small_batches(spark, monkeypatch):
    """A task's memory must not grow with the bytes of its rows: 300 texts of 100 KB are no single batch."""
    cut, most = hashing.text_blocks, 3 * common.BATCH_BYTES

    def guarded(texts):
        assert texts.get_total_buffer_size() <= most, "a batch holds too many bytes"
        return cut(texts)

    monkeypatch.setattr(hashing, "text_blocks", guarded)
    docs = spark.range(300).coalesce(1).selectExpr("id doc_id", "repeat(concat('word', id, ' '), 100000 div length(concat('word', id, ' '))) text")
    spread = jaccard.link_components(docs)
    assert spread.where("component <> doc_id or n_shingles <> 1").count() == 0 and spread.count() == 300
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic")
    model = toxicity.train(docs, labels, most=4)
    assert toxicity.score(docs, model).where("toxicity between 0 and 1").count() == 300
