"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random
import re
import time

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm import chat, common, decontam, jaccard, licenses, mixing, pii, tokens, toxicity, urls, vectors

ODD = [None, "", " \n ", "ÀÉ ß 日本", "a" * 5000, "x " * 3000, "1 2 3"]


def docs_of(spark, texts, ids=None, source="s"):
    rows = [(i if ids is None else ids[i], t, source if isinstance(source, str) else source[i], "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, ID string, n long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, ID string, n long")


# 1: personal data


PII_TEXTS = [
    *ODD, "mail a.b+c@x-1.example.org, and a@b.c@d.e or a@b.c_x@d.e.f; not a@b or @b.c", "hosts 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.004 99999999999999999999.1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1111 4111  1111 1111 1111 and 12345678901234 " + "1" * 40 + " " + "7" * 6000, "call +1 (555) 010-9999 now +44 20 7946 0958) or +1+1 +12 (3", "@".join("ab" for _ in range(2000)),
    "a" + ".b" * 3000 + "@" + "c." * 3000 + "d", "é4111111111111111日 +49 30 1234567", " ".join(f"10.0.{i % 256}.{i % 200}" for i in range(400)),
]


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.train(spark)


def test_pii_base_spans(spark, empty, pii_model):
    d = docs_of(spark, [*PII_TEXTS, PII_TEXTS[7]])
    for r in pii.find_pii(d, model=pii_model).collect():
        base = [(x["start"], x["kind"], x["end"]) for x in r["pii"] if x["base"]]
        want = [(a, k, b) for k, p in enumerate(brute.PII) for a, k2, b in _spans(r["text"]) if k2 == k]
        assert base == sorted(want), r["text"][:50]
        every = [(x["start"], x["kind"], x["end"]) for x in r["pii"]]
        assert every == sorted(set(every))
    assert pii.find_pii(empty, model=pii_model).count() == 0
    assert pii.find_pii(d, model=pii_model).columns == [*d.columns, "pii"]


def _spans(text):
    joined = brute.pii(text)[2]
    names = list(brute.PII)
    return [(int(a), names.index(k), int(b)) for k, a, b in (x.split(":") for x in joined.split(","))] if joined else []


def test_pii_model_and_redaction(spark, pii_model):
    d = docs_of(spark, ["reach me: joe [at] mail [dot] com today", "order 1234.5678.9012.3456 shipped", "mail a@b.c, 1.2.3.4!", "none", None])
    found = pii.find_pii(d, model=pii_model)
    assert [[(pii.KINDS[x["kind"]], x["base"]) for x in r["pii"]] for r in found.orderBy("doc_id").collect()] == [[("email", False)], [], [("email", True), ("ip", True)], [], []]
    assert [r["text"] for r in pii.redact(found).orderBy("doc_id").collect()] == ["reach me: [EMAIL] today", "order 1234.5678.9012.3456 shipped", "mail [EMAIL], [IP]!", "none", None]


def test_pii_runs_no_python(spark, pii_model):
    plan = pii.redact(pii.find_pii(docs_of(spark, ["a"]), model=pii_model))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2: licenses


def test_licenses(spark, empty):
    texts = [*ODD, "the MIT License and\nthe mit license", "GNU general\npublic license", "cc, by; CC-BY", "Licensed under the Apache License, Version 2.0.", "Permission is granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "all rights reserved", "all rights were reserved " * 3]
    got = licenses.license_scan(docs_of(spark, texts)).collect()
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute.licenses(texts[r["doc_id"]])
    by = {r["doc_id"]: r for r in got}
    assert by[10]["labels"] == "apache,apache-2.0" and [b["label"] for b in by[11]["blocks"]] == ["mit"] and by[12]["labels"] == "proprietary"
    templates = {label: set(brute.ALNUM.findall(t.lower())) for label, t in licenses.TEMPLATES}
    for r in got:
        lines = (texts[r["doc_id"]] or "").split("\n")
        want = {(i, label) for i, x in enumerate(lines) for label, t in licenses.TEMPLATES if brute.held(brute.ALNUM.findall(t.lower()), brute.ALNUM.findall(x.lower())) >= 0.8}
        assert {(b["line"], b["label"]) for b in r["blocks"]} == want
    assert templates and licenses.license_scan(empty).count() == 0
    far = "all " + "w " * 2500 + "rights " + "w " * 2500 + "reserved"
    assert [r["labels"] for r in licenses.license_scan(docs_of(spark, [far])).collect()] == [""]


# 3: toxicity


def test_toxicity_learns(spark, empty):
    r = random.Random(2)
    words = ["w%d" % i for i in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(40)) + (" scum" if i % 3 == 0 else "") for i in range(600)]
    d = docs_of(spark, [*texts, *ODD])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(0, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    usable = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = toxicity.train(d, labels, usable=usable)
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.score(d, model).collect()}
    held = [x["doc_id"] for x in labels.where(~usable).collect() if x["doc_id"] is not None]
    right = sum((got[i] >= 0.7) == (i % 3 == 0) for i in held)
    assert right >= 0.97 * len(held) and len(got) == 600 + len(ODD) and all(0 <= s <= 1 for s in got.values())
    again = {x["doc_id"]: x["toxicity"] for x in toxicity.score(d, toxicity.train(d, labels, usable=usable)).collect()}
    assert again == got and got[600] == got[601] == got[602]
    assert toxicity.train(empty, labels) is None and toxicity.score(d, None).where("toxicity <> 0").count() == 0 and toxicity.score(empty, model).count() == 0


# 4: mixing


def test_knapsack_hits_reachable_budgets():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 6)
        length = np.array(r.sample(range(1, 30), n))
        count = np.array([r.randint(1, 5) for _ in range(n)])
        sums = {0}
        for v, c in zip(length.tolist(), count.tolist(), strict=True):
            sums = {s + v * k for s in sums for k in range(c + 1)}
        budget = r.randint(0, int((length * count).sum()))
        taken = mixing.copies_by_length(length, count, budget)
        assert (taken >= 0).all() and (taken <= count).all()
        assert budget - int((length * taken).sum()) <= 30
        small = mixing.copies_by_length(length, np.minimum(count, 1), min(budget, int(length.max())))
        reach = {0}
        for v in length.tolist():
            reach |= {s + v for s in reach}
        assert int((length * small).sum()) == max(s for s in reach if s <= min(budget, int(length.max()))) or int((length * small).sum()) <= budget


def targets(sizes):
    weights, budget = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, x)))}, 1.5 * sum(sizes.values())
    full = set()
    while True:
        free = [s for s in sizes if s not in full]
        level = (budget - sum(2 * sizes[s] for s in full)) / max(1, sum(weights[s] for s in free))
        more = {s for s in free if 2 * sizes[s] <= level * weights[s]}
        if not more:
            return {s: 2 * sizes[s] if s in full else level * weights[s] for s in sizes}
        full |= more


def test_mix(spark, empty):
    r = random.Random(3)
    texts = [" ".join("w" for _ in range(r.choice([0, 1, 5, 5, 5, 9, 40]))) for _ in range(900)] + [None, ""]
    source = [r.choice(["b", "a", "é", "", "Z", None]) for _ in texts]
    d = docs_of(spark, texts, source=source).unionByName(docs_of(spark, ["v v v"] * 3, ids=[1, 1, 1], source="b"))
    rows = mixing.mix(d, rows_a_salt=100).collect()
    assert len(rows) == len(texts) + 3
    sizes, taken, target = {}, {}, {}
    for x in rows:
        sizes[x["source"]] = sizes.get(x["source"], 0) + x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
        target[x["source"]] = x["target"]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
    want = targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
        assert {x["source_size"] for x in rows if x["source"] == s} == {sizes[s]}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(d, rows_a_salt=100).collect()))
    assert mixing.mix(empty).count() == 0


# 5: chat


def test_chat_round_trip(spark):
    turns = {
        1: [(0, "user", "hi"), (1, "assistant", "### user: x </turn>\n &lt; &amp;lt; ok"), (2, "assistant", "")], -7: [(0, "user", "\\### Assistant: </turn> ok"), (1, "assistant", "\\### Assistant: </turn> ok")],
        3: [(5, "a: b#</turn>", None), (5, None, "t"), (None, "system", "s"), (5, None, "t")], None: [(1, "assistant", "null's")], 4: [(i, "assistant" if i % 2 else "user", f"t{i}\n") for i in range(70)],
    }
    rows = [(c, *t) for c, ts in turns.items() for t in ts]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    done = chat.format_paths(chat.threaded(df)).select("tree", chat.parsed(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    assert not re.search("Python|Pandas|Arrow", done._jdf.queryExecution().executedPlan().toString())
    got = {r["tree"]: r for r in done.collect()}
    assert set(got) == set(turns)
    for c, ts in turns.items():
        said = "".join(f"{t['role']}\n{t['text']}\n" for t in got[c]["turns"])
        assert (len(got[c]["turns"]), brute.sha(said), len(got[c]["loss"]), brute.sha(got[c]["loss"])) == brute.conversation(ts)
    assert chat.format_paths(chat.threaded(df.limit(0))).count() == 0


def test_chat_trees_rank_paths(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 2, "user", "no", 0.2), (1, 6, 99, "user", "orphan", 0.0), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0)]
    m = spark.createDataFrame(rows, "tree long, message long, parent long, role string, text string, score double")
    assert [r["formatted"] for r in chat.format_paths(m).collect()] == ["### user: q </turn>\n### assistant: good </turn>\n### user: more </turn>\n"]
    assert sorted(r["path"] for r in chat.best_paths(m, 3).select("path").distinct().collect()) == [4, 5, 6]


# 6: decontamination


def test_decontamination(spark, empty):
    r = random.Random(5)
    words = ["w%d" % i for i in range(60)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(1, say(40)), (2, say(10)), (3, "Short Item here"), (4, None), (5, ""), (6, say(12)), (7, "solo!"), (None, say(11)), (11, say(25))]
    shared = say(20)
    items += [(i, shared) for i in range(20, 30)]
    texts = [*ODD, *[say(50) for _ in range(20)], *[say(5) + ", " + t.upper() + "\n" + say(5) + " " + t for _, t in items if t], "short item, here and SOLO short item here", items[0][1][10:90], shared + " " + shared]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = docs_of(spark, texts).unionByName(docs_of(spark, [texts[-1], texts[-1], "other"], ids=[0, 0, 0]))
    out = decontam.decontaminate(d, b, windows_a_block=40)
    got = sorted((x["doc_id"], x["n_words"], x["n_hit"], x["n_items"], brute.sha(x["items"])) for x in out.collect())
    every = [*enumerate(texts), (0, texts[-1]), (0, texts[-1]), (0, "other")]
    assert got == sorted((i, *x) for (i, _), x in zip(every, brute.contaminated([t for _, t in every], items), strict=True))
    for x in out.collect():
        assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_hit"] and x["contaminated"] == (x["n_hit"] > 0)
    assert decontam.decontaminate(empty, b).count() == 0 and decontam.decontaminate(d, b.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_words(spark):
    ranges = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    every = [chr(c) for c in [*range(0x300), 0x2028, 0x65E5, 0xFFFD, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]]
    texts = [*ODD, "".join(every), *[f"a{x}B{x}{x}9" for x in every]]
    got = docs_of(spark, texts).select("text", decontam.words_of(F.col("text")).alias("w")).collect()
    lowered = str.maketrans(decontam.UPPER, decontam.LOWER)
    for x in got:
        assert x["w"] == re.findall(ranges, (x["text"] or "").translate(lowered)), x["text"]
    # By ranges the same words take about twice as long on this text.
    long = spark.range(0, 200, 1, 1).select(F.concat(F.repeat(F.lit("some wörds of ä text, 123 and more: "), 2000), F.col("id").cast("string")).alias("text")).cache()
    long.count()

    def seconds(word):
        began = time.perf_counter()
        assert long.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(word), F.lit(0))))).first()[0] == 3_200_200
        return time.perf_counter() - began

    took = [(seconds(decontam.WORD), seconds(ranges)) for _ in range(4)]
    assert min(t[0] for t in took) < 0.75 * min(t[1] for t in took)
    long.unpersist()


# 7: vectors


def test_near_vectors(spark):
    r = np.random.RandomState(1)
    rows = []
    for c in range(12):
        centre = r.normal(size=16)
        for _ in range([1, 3, 60, 2][c % 4]):
            rows.append((len(rows), (centre + r.normal(scale=0.06 * (c % 3), size=16)).tolist(), c % 2))
    rows += [(len(rows) + i, r.normal(size=16).tolist(), 3) for i in range(100)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] + rows[0][1][1:], 0), (n + 4, rows[0][1], None), (n + 5, rows[0][1][:8], 0), (n + 6, rows[0][1], 0), (n + 7, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("clash"))
    got = {x["vec_id"]: x for x in vectors.near_duplicates(df, k=5).collect()}
    m = {i: np.array(v, np.float32).astype(float) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: (lab, len(v or ())) for i, v, lab in rows}
    links = [(i, j) for i in m for j in m if i < j and label[i] == label[j] and m[i] @ m[j] / np.linalg.norm(m[i]) / np.linalg.norm(m[j]) >= 0.98]
    root = brute.union_find(got, links)
    assert len(links) > 500 and len(got) == len(rows)
    for i, x in got.items():
        assert (x["n_links"], x["component"], x["kept"]) == (sum(i in e for e in links), root[i], root[i] == i)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


# 8: n-gram Jaccard


def mutated(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = "m%d" % r.randrange(10**6)
    return " ".join(w)


def test_jaccard_components(spark, empty):
    r = random.Random(6)
    word = lambda: "v%d" % r.randrange(300)
    texts = [*ODD, "a b", "A  b", "a b c", "one", "One"]
    for size in (5, 30, 120, 400):
        base = [word() for _ in range(size)]
        texts += [mutated(r, base, r.choice([0, 1, 1, 2, 3, size // 60])) for _ in range(40)]
    passage = " ".join(word() for _ in range(30))
    texts += [passage + " " + " ".join(word() for _ in range(60)) for _ in range(60)]
    r.shuffle(texts)
    for num, size, piece in ((90, 3, 2048), (80, 5, 7)):
        jaccard.REGION, before = piece, jaccard.REGION
        got = {x["doc_id"]: (x["n_shingles"], x["component"]) for x in jaccard.link_components(docs_of(spark, texts), num=num, size=size).collect()}
        jaccard.REGION = before
        assert got == brute.jaccard_components(list(enumerate(texts)), size, num)
    assert jaccard.link_components(empty).count() == 0
    twice = jaccard.link_components(docs_of(spark, ["p q r s", "p q r s", "x"], ids=[3, 3, 1])).collect()
    assert sorted((x["doc_id"], x["component"]) for x in twice) == [(1, 1), (3, 3), (3, 3)]


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 1), (5, 5)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [e for e in edges if None not in e and e[0] != e[1]]
    assert got == brute.union_find({x for e in real for x in e}, real)


# 9: tokens


@pytest.fixture(scope="module")
def tokenizer():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.Tokenizer(f.read())


def test_edits_give_what_encoding_anew_gives(tokenizer):
    r, letters = random.Random(8), "ab é\n\n  '12.,ßxyz's't're日"
    say = lambda n: "".join(r.choice(letters) for _ in range(n))
    for _ in range(400):
        text = say(r.choice([0, 1, 5, 50, 400, 1500]))
        tree = tokens.TokenTree.of(text, tokenizer)
        for _ in range(3):
            at = r.randint(0, len(text) + 2)
            text, n = tree.edit(text, at, at + r.choice([0, 0, 1, 5, 100, 3000]), say(r.choice([0, 1, 3, 20, 300])), tokenizer)
            anew = tokens.TokenTree.of(text, tokenizer)
            assert tree.total == anew.total == len(tokenizer.encoding.encode_ordinary(text))
            assert tree.ends.tolist() == anew.ends.tolist() and tree.counts.tolist() == anew.counts.tolist()
            assert all(int(s.sum()) == tree.total for s in tree.sums) and n <= len(anew.ends)


def test_edits_update_only_the_paths_to_the_root(tokenizer):
    text = "word and more. " * 40_000
    tree = tokens.TokenTree.of(text, tokenizer)
    levels, made = len(tree.sums), tree.updated
    assert levels >= 4 and made == sum(map(len, tree.sums)) > 1000
    for at in (0, 7, 300_001, len(text) - 3):
        text, _ = tree.edit(text, at, at + 3, "it's", tokenizer)
        assert tree.updated <= 2 * levels and tree.total == len(tokenizer.encoding.encode_ordinary(text))
        assert all(np.array_equal(np.add.reduceat(a, np.arange(0, len(a), tokens.FAN)), b) for a, b in zip(tree.sums, tree.sums[1:], strict=False))
        assert np.array_equal(np.add.reduceat(tree.counts, tree.leaves[:-1]), tree.sums[0])
    text, _ = tree.edit(text, 5, 5, " new" * 1000, tokenizer)
    assert tree.updated > 2 * levels and tree.total == len(tokenizer.encoding.encode_ordinary(text)) == int(tree.counts.sum())


def test_token_tables(spark, empty, tokenizer):
    texts = [*ODD, "Hello, it's a test.\n\nDone  now "]
    edits = F.when(F.col("doc_id") != 3, F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit("New 's").alias("replacement")), F.struct(F.lit(4).alias("start"), F.lit(None).cast("int").alias("end"), F.lit(None).cast("string").alias("replacement"))))
    for x in tokens.recount(tokens.token_trees(docs_of(spark, texts)), edits).collect():
        t = texts[x["doc_id"]] or ""
        new = t if x["doc_id"] == 3 else "New 's" + t[2:]
        assert x["n_before"] == len(tokenizer.encoding.encode_ordinary(t)) and x["n_after"] == len(tokenizer.encoding.encode_ordinary(new)) and (x["text"] or "") == new
    assert tokens.token_trees(empty).count() == 0


# 10: URLs


def test_urls(spark):
    cases = [None, "", "no scheme", "http://", "https://A.EXAMPLE.com/en/7?x", "http://example.com/en/79", "http://x.com/en/", "http://com/en/1", "http://xcom/en/1", "http://a.net/de/81", "http://example.net/de/81", "http://b.example.net/de/7#q", "ftp://o.org/es/x", "http://o.org/ES/x", "http://spam-farm.example.org/en", "http://o.org?u=://x/es/", "http://a.com:80/en/", "x://y://z.com/en/1", "http://ü.com/en/spam/é", "http://ok.org/alphabet", "http://a.net/x/casino-royal/1", "http://a.net/x/casinos", "http://CASINO.a.net/", "http://a.net/spam/farm", "http://a.net/spamfarm", "http://cheap.a.net/pills", "http://a.net/my-poker", "http://a.net/Poker"]
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    df = spark.createDataFrame([(i % 18, c) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = sorted(tuple(x)[:5] for x in urls.filter_urls(df).select("page_id", "host", "path", F.coalesce("rule", F.lit("-")), "verdict").collect())
    want = []
    for i, c in enumerate(cases):
        m = re.search("://([^/?#]*)([^?#]*)", c or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        parts = re.split("[^a-z0-9]", (host + "\n" + path).lower())
        bad = not {*re.split("[.-]", host)}.isdisjoint(urls.HOST_WORDS) or any(re.split("[._-]", x)[0] in urls.PATH_WORDS for x in path.lower().split("/")) or any(p in urls.PAIRS for p in zip(parts, parts[1:], strict=False))
        want.append((i % 18, host, path, max(fits)[2] if fits else "-", max(fits)[1] if fits else "block" if bad else "allow"))
    assert got == sorted(want)
    assert urls.filter_urls(df.limit(0)).count() == 0
