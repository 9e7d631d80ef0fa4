"""Personal data: candidate spans scored by boosted trees, in DataFrame operations only.

Generators with high recall propose overlapping candidates in every whole text; each is described by its format
and its surroundings, scored by trees, and kept from a threshold on that is calibrated for its kind. Candidates
that pass the fixed checks of their format are always kept. The trees learn from examples made from templates
by a seeded generator, as no table marks personal data; their features come from the same expressions.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm import boosting
from evidra.llm.common import fresh

# Kinds with a base format in the order of reports, and then those that only the trees decide on.
KINDS = ["email", "ip", "card", "phone"]
ALL_KINDS = [*KINDS, "secret"]
# The base formats. Possessive groups and starts at the edge of a run match the same spans as the
# plain forms, without recursion or repeated scans of a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The further generators, by kind.
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?|\.)[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{0,4}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+(.])(?:\([0-9]{2,5}\)\x20?|(?:00?[1-9][0-9]{0,4}+|[0-9]{3})[\x20./-]|0[1-9])[0-9]{2,10}(?:[\x20./-][0-9]{2,8}){0,4}+(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\"']?\x20?[:=]\x20?[\"']?[^\s\"',;]{6,256}+|(?<![a-z0-9+/_-])[a-z0-9+/_-]{16,256}+(?![a-z0-9+/_-])",
}
# Words of the surroundings that speak for a kind or against all.
CUES = {
    "email": r"(?i)e-?mail|contact|write|reach",
    "ip": r"(?i)\bip|host|server|login|client|addr",
    "card": r"(?i)card|visa|master|amex|credit|payment|pay ",
    "phone": r"(?i)phone|tel|call|fax|mobile|whatsapp",
    "secret": r"(?i)token|secret|passw|pwd|key|credential|bearer",
    "against": r"(?i)version|order|invoice|isbn|sku|part|model|build|serial|section|chapter|date|figure",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
AROUND = 24
FEATURES = ["kind", "wide", "valid", "digits", "length", "marks", "cue", "against", "left_word", "right_word", "letters", "groups", "changes", "double"]


def _spans(text: Column, kind: int, wide: int, pattern: str) -> Column:
    """All matches as structs; the texts between the matches and running sums over blocks of 64 give places."""
    got = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, F.lit(pattern), F.lit(-1)).alias("p"))
    one = F.transform(F.array(got), lambda x: F.struct(x["m"].alias("m"), x["p"].alias("p"), F.zip_with(x["m"], F.slice(x["p"], 1, F.size(x["m"])), lambda m, p: (F.length(m) + F.length(p))).alias("step")))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, v: a + v)
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["p"].alias("p"), x["step"].alias("step"), F.transform(
        F.sequence(F.lit(0), F.floor((F.size(x["m"]) - 1) / 64).cast("int")), lambda b: add(F.slice(x["step"], b * 64 + 1, 64))).alias("block")))
    one = F.transform(one, lambda x: F.struct(x["m"].alias("m"), x["p"].alias("p"), x["step"].alias("step"), F.transform(
        x["block"], lambda v, b: add(F.slice(x["block"], 1, b))).alias("before")))
    spans = F.transform(one, lambda x: F.transform(x["m"], lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(wide).alias("wide"), m.alias("m"),
        (F.get(x["before"], F.floor(i / 64).cast("int")) + add(F.slice(x["step"], F.floor(i / 64).cast("int") * 64 + 1, i % 64)) + F.length(F.get(x["p"], i))).alias("start"),
        F.right(F.get(x["p"], i), F.lit(AROUND)).alias("left"), F.left(F.get(x["p"], i + 1), F.lit(AROUND)).alias("right"),
    )))
    return F.when(text.rlike(pattern), F.flatten(spans)).otherwise(F.array().cast("array<struct<kind:int,wide:int,m:string,start:int,left:string,right:string>>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _described(x: Column) -> Column:
    """A candidate's struct with its end, the outcome of its format's fixed check, and its features."""
    m, kind = x["m"], x["kind"]
    digits = _digits(m)
    n = F.length(digits)
    valid = (x["wide"] == 0) & (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"))
        .when(kind == 2, n.between(14, 19) & F.call_function("luhn_check", digits))
        .otherwise(n.between(10, 15))
    )
    around = F.concat(x["left"], F.lit(" "), x["right"])
    cue = F.when(kind == 0, around.rlike(CUES["email"])).when(kind == 1, around.rlike(CUES["ip"])).when(kind == 2, around.rlike(CUES["card"])).when(kind == 3, around.rlike(CUES["phone"])).otherwise(F.concat(around, m).rlike(CUES["secret"]))
    feature = {
        "kind": kind, "wide": x["wide"], "valid": valid.cast("int"), "digits": n, "length": F.length(m), "marks": F.length(F.regexp_replace(m, "[^().@:+/_-]", "")),
        "cue": cue.cast("int"), "against": around.rlike(CUES["against"]).cast("int"), "left_word": x["left"].rlike("[A-Za-z0-9]$").cast("int"), "right_word": x["right"].rlike("^[A-Za-z0-9]").cast("int"),
        "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "groups": F.size(F.split(m, "[^A-Za-z0-9]+")),
        "changes": F.size(F.split(m, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])")), "double": m.contains("::").cast("int"),
    }
    return F.struct(kind.alias("kind"), x["start"].alias("start"), (x["start"] + F.length(m)).alias("end"), valid.alias("valid"), F.struct(*[v.cast("double").alias(k) for k, v in feature.items()]).alias("f"))


def candidates(text: Column) -> Column:
    """Described candidates of all generators in ``text``."""
    every = [_spans(text, k, wide, patterns[kind]) for wide, patterns in enumerate((BASE, WIDER)) for k, kind in enumerate(ALL_KINDS) if kind in patterns]
    return F.transform(F.concat(*every), _described)


def examples(n: int, seed: int) -> list[tuple[str, int, int]]:
    """``n`` made-up texts with one span to judge: (text, start of the span, its kind or -1 if it is no personal data).

    A third of the texts have the leading word of another template or none, so that format and context both count.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(2, 9)))
    octets = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
    hexes = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    signs = lambda k, of="ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(r.choice(of) for _ in range(k))
    mixed = lambda k: signs(k, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

    def short_v6() -> str:
        left, right = ([f"{r.randint(1, 65535):x}" for _ in range(r.randint(a, 3))] for a in (1, 0))
        return ":".join(left) + "::" + ":".join(right)

    def card(good: bool, sep: str) -> str:
        body = d(15)
        for last in range(10):
            s = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(body + str(last))))
            if (s % 10 == 0) == good:
                return sep.join((body + str(last))[i : i + 4] for i in range(0, 16, 4))
        return body + "0"

    yes = [
        (0, "email: ", lambda: f"{word()}{d(2)}@{word()}.example.com"), (0, "contact ", lambda: f"{word()} [at] {word()} [dot] com"), (0, "", lambda: f"{word()}.{word()}@{word()}.org"),
        (0, "write to ", lambda: f"{word()}(at){word()}.net"), (1, "login from ", lambda: octets(255)), (1, "", lambda: octets(255)), (1, "client ip ", lambda: ":".join("%x" % r.randint(0, 65535) for _ in range(8))),
        (2, "card ", lambda: card(True, r.choice(["", " ", "-"]))), (2, "", lambda: card(True, "")), (2, "credit card ", lambda: card(True, r.choice("./_"))),
        (3, "phone ", lambda: f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}"), (3, "", lambda: f"+{r.randint(1, 9)} ({d(3)}) {d(3)}-{d(4)}"), (3, "tel. ", lambda: f"({d(3)}) {d(3)}-{d(4)}"), (3, "call ", lambda: f"0{r.randint(1, 9)}{d(2)} {d(3)} {d(4)}"),
        (1, "host ", short_v6), (1, "", short_v6), (3, "mobile ", lambda: f"0{r.randint(1, 9)}{d(2)} {d(8)}"), (3, "phone ", lambda: f"({d(3)}) {d(7)}"), (3, "tel ", lambda: f"00{r.randint(1, 9)}{d(1)} {d(3)} {d(8)}"),
        (3, "phone: ", lambda: f"0{r.randint(1, 9)}{d(r.randint(7, 10))}"), (3, "call ", lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        (4, "", lambda: f'token = "{hexes(r.choice([32, 40, 64]))}'), (4, "", lambda: f"password={mixed(r.randint(8, 24))}"), (4, "", lambda: f"api_key: {mixed(32)}"), (4, "", lambda: "AKIA" + signs(16)), (4, "", lambda: f"{word()[:3]}_{mixed(36)}"),
        (4, "key ", lambda: hexes(40)), (4, "", lambda: hexes(r.choice([32, 40, 64]))), (4, "bearer ", lambda: mixed(r.randint(24, 60))),
    ]
    no = [
        ("order ", lambda: f"{d(4)}.{d(4)}.{d(4)}.{d(4)}"), ("", lambda: f"{d(4)}/{d(4)}/{d(4)}/{d(4)}"), ("version ", lambda: f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(256, 999)}.{r.randint(0, 9999)}"),
        ("", lambda: card(False, "")), ("invoice ", lambda: card(False, "")), ("", lambda: f"{d(3)} {d(2)} {d(3)}"), ("isbn ", lambda: f"{d(3)}-{d(2)}-{d(5)}-{d(3)}"), ("part ", lambda: f"{d(3)}-{d(3)}-{d(4)}"),
        ("", lambda: f"{d(3)} {d(3)} {d(3)}"), ("", lambda: f"+{d(3)} {d(3)}"), ("date ", lambda: f"00{r.randint(1, 9)}{d(2)} {d(2)} {d(4)}"), ("serial ", lambda: ":".join("%x" % r.randint(0, 65535) for _ in range(8))), ("", lambda: octets(900)),
        ("", lambda: f"({d(4)}) {d(3)}/{d(3)}"), ("", lambda: f"{word()} (at) {word()}.{word()}"),
        ("at ", lambda: f"{d(2)}:{d(2)}:{d(2)}"), ("", lambda: f"{d(1)}:{d(2)}:{d(2)}"), ("", lambda: ":".join(hexes(2) for _ in range(6))), ("", lambda: f"{word()[:1]}::{word()[:1]}"), ("", lambda: f"0{r.randint(1, 9)}/{d(2)}"),
        ("order ", lambda: f"0{r.randint(1, 9)}{d(r.randint(4, 9))}"), ("", lambda: f"({d(3)}) {d(3)}"), ("pages ", lambda: f"{d(3)}-{d(3)}"), ("", lambda: f"{d(3)}.{d(2)}"),
        ("", lambda: word() + word() + word() + "lichkeit"), ("", lambda: "-".join(word() for _ in range(5))), ("", lambda: "/".join(word() for _ in range(5))), ("", lambda: "_".join(word() for _ in range(4)) + d(1)),
        ("", lambda: "-" * r.randint(16, 60)), ("", lambda: f"/{word()}/{d(4)}/{d(2)}/{word()}-{word()}"), ("", lambda: "a" * r.randint(16, 60)), ("", lambda: d(r.randint(20, 40))), ("", lambda: f"token: {word()}ing {word()}"),
    ]
    out = []
    for i in range(n):
        kind, before, make = (-1, *r.choice(no)) if i % 2 else r.choice(yes)
        if r.random() < 0.33:
            before = r.choice(["", r.choice(no)[0], r.choice(yes)[1]] if kind < 0 else ["", "", r.choice(yes)[1]])
        lead = " ".join(word() for _ in range(r.randint(1, 5))) + " " + before
        out.append((lead + make() + r.choice([" ", ". ", ", "]) + " ".join(word() for _ in range(3)), len(lead), kind))
    return out


def train(spark: SparkSession, n: int = 3200, seed: int = 5, precision: float = 0.99) -> tuple[list, list[float]]:
    """(trees, a threshold of the log-odds for each kind): fitted on half of ``n`` made-up examples, calibrated on the rest.

    A kind's threshold is the lowest that still reaches ``precision`` on its held-back examples, or if none does the
    one of the best precision.
    """
    made = F.from_json(F.lit(json.dumps([{"t": t, "s": s, "k": k} for t, s, k in examples(n, seed)])), "array<struct<t:string,s:int,k:int>>")
    rows = spark.range(1).select(F.posexplode(made).alias("i", "e")).select("i", "e.*").withColumn("c", F.explode(candidates(F.col("t")))).where("c.start = s").select("i", F.expr("int(c.kind = k)").alias("y"), "c.f").collect()
    x = np.array([[r["f"][k] for k in FEATURES] for r in rows])
    y, half = np.array([r["y"] for r in rows], float), np.array([r["i"] // 2 % 2 == 0 for r in rows])
    trees = boosting.fit(x[half], y[half], rounds=20, depth=4)
    score, kind = sum(boosting.predict(t, x) for t in trees), x[:, 0]
    thresholds = []
    for k in range(len(ALL_KINDS)):
        own = ~half & (kind == k)
        order = np.argsort(-score[own], kind="stable")
        s, right = score[own][order], np.cumsum(y[own][order])
        share = right / np.arange(1, len(s) + 1)
        thresholds.append(float(s[np.flatnonzero(share >= min(precision, share.max()))[-1]]))
    return trees, thresholds


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "pii", model: tuple | None = None) -> DataFrame:
    """``docs`` with ``out``: an array of structs (start, kind, end, base, score) by start, then kind, then end.

    Places are code points, the end exclusive; ``kind`` is a number in ALL_KINDS; ``base`` says that the fixed check
    of the format holds; others are there because their score reaches the threshold of their kind. One span
    comes once. Nulls and empty texts have no spans; other columns stay (an older ``out`` is replaced).
    """
    trees, thresholds = model or train(docs.sparkSession)
    found, judged = fresh(docs, "found", "judged")
    docs = docs.drop(out) if out in docs.columns else docs
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    limit = F.array(*map(F.lit, thresholds))

    def judge(x: Column) -> Column:
        score = boosting.expression(trees, [x["f"][k] for k in FEATURES])
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["valid"].alias("base"), score.alias("score"))

    kept = F.filter(F.transform(F.col(found), judge), lambda x: x["base"] | (x["score"] >= F.get(limit, x["kind"])))
    key = lambda x: F.struct(x["start"], x["kind"], x["end"])
    first = F.filter(F.col(judged), lambda x, i: (i == 0) | (key(x) != key(F.get(F.col(judged), i - 1))))
    ordered = F.array_sort(kept, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).when(a["base"] & ~b["base"], -1).when(b["base"] & ~a["base"], 1).otherwise(0))
    return docs.withColumn(found, candidates(text)).withColumn(judged, ordered).withColumn(out, first).drop(found, judged)


def redact(docs: DataFrame, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by the kind of its first: [EMAIL], [IP], [CARD], [PHONE] or [SECRET].

    ``text_col`` is replaced and ``spans`` dropped. A null text stays null.
    """
    (runs,) = fresh(docs, "runs")
    merged = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int,kind:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (x["start"] < F.element_at(a, -1)["end"]),
            F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"), F.element_at(a, -1)["kind"].alias("kind")))),
        ).otherwise(F.array_append(a, F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))),
    )
    text, r = F.col(text_col), F.col(runs)
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in ALL_KINDS])
    pieces = F.transform(r, lambda x, i: F.concat(F.substring(text, F.coalesce(F.get(r, i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(r, i - 1)["end"], F.lit(0))), F.get(names, x["kind"])))
    rest = F.substring(text, F.element_at(r, -1)["end"] + 1, F.length(text))
    done = F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)
    return docs.withColumn(runs, merged).withColumn(text_col, done).drop(runs, spans)
