"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of ten words is known by the least hash of its runs of five words, its fingerprint: two texts that
share a window share its fingerprint. Windows of documents whose fingerprint is one of a benchmark window's are
extended to their words and compared whole. An item of fewer words is one window of its own length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed

WINDOW, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ with each character by itself: Java then looks a character up in a table instead of trying ranges in turn.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not ("0" <= chr(c) <= "9" or "a" <= chr(c) <= "z")) + "]+"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _from_zero(n: Column, of: Column, made) -> Column:
    """``made(i)`` for i from 0 to n - 1; an empty array of longs without any."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), made)).otherwise(F.array().cast("array<bigint>"))


def with_fingerprints(df: DataFrame, words: str, window: int) -> DataFrame:
    """``df`` with ``prints``: the fingerprint of each window of ``window`` words, by its first word."""
    gram = min(GRAM, window)
    hashed = lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(gram)])
    df = df.withColumn("grams", _from_zero(F.size(words) - (gram - 1), F.col(words), hashed))
    least = (lambda i: F.least(*[F.get("grams", i + d) for d in range(window - gram + 1)])) if window > gram else (lambda i: F.get("grams", i))
    return df.withColumn("prints", _from_zero(F.size(words) - (window - 1), F.col("grams"), least)).drop("grams")


def windows(df: DataFrame, words: str, window: int) -> DataFrame:
    """A row for each window: its start, fingerprint and words."""
    df = with_fingerprints(df, words, window)
    # The outer form: for the inner one the optimizer would make the arrays again to see whether they are empty.
    df = df.select(*[c for c in df.columns if c != "prints"], F.posexplode_outer("prints").alias("start", "print"))
    return df.withColumn("words", F.concat_ws(" ", F.slice(words, F.col("start") + 1, window)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", windows_a_block: int = 400_000,
) -> DataFrame:
    """What each whole text shares with the benchmark: one row for each row of ``docs``.

    Returns the id, ``print`` (a hash that tells texts of one id apart), n_words, n_hit (words inside any
    occurrence of an item's window), spans (first word, end exclusive; merged), n_items, items (ids as
    strings, sorted, comma-joined) and contaminated. Items without words take no part; a null item id counts as
    the empty string; items of one id are one. A null or empty text has no words and no hits. Repeated rows
    each keep their row. Empty tables give no hits.

    The benchmark's windows are broadcast in blocks of at most ``windows_a_block``; more blocks mean more
    passes over the texts. Windows that stand in the same items are told apart by no more than those items: a
    passage in many items and many texts costs a row for each text.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(item_text_col)).alias("w")).where("size(w) > 0")
    items = items.withColumn("length", F.least(F.size("w"), F.lit(WINDOW)))
    items = checkpointed(items)
    lengths = [r[0] for r in items.select("length").distinct().orderBy("length").collect()]
    found = []
    keyed = docs.select(F.col(id_col).alias("id"), F.struct(F.xxhash64(text_col), F.length(text_col)).alias("print"), F.col(text_col).alias("text"))
    texts = keyed.select("id", "print", words_of(F.col("text")).alias("w"))
    members = None
    for length in lengths:
        own = checkpointed(windows(items.where(F.col("length") == length).select("item", "w"), "w", length).select("item", "print", "words").distinct())
        sets = own.groupBy("print", "words").agg(F.struct(F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("item"))).alias("y"), F.count("*").alias("n")).alias("set"))
        sets = checkpointed(sets)
        one = sets.groupBy("set").agg(F.min(F.struct("print", "words")).alias("k")).select("set", "k.print", "k.words")
        mine = own.join(one, ["print", "words"]).select("set", "item")
        members = mine if members is None else members.unionByName(mine)
        blocks = max(1, -(-sets.count() // windows_a_block))
        for block in range(blocks):
            part = sets if blocks == 1 else sets.where(F.pmod("print", F.lit(blocks)) == block)
            prints = part.select("print").distinct()
            at = with_fingerprints(texts, "w", length).select("id", F.col("print").alias("of"), "w", F.posexplode_outer("prints").alias("start", "print"))
            at = at.join(F.broadcast(prints), "print", "left_semi")
            at = at.select("id", "of", "start", F.concat_ws(" ", F.slice("w", F.col("start") + 1, length)).alias("words"))
            found.append(at.join(F.broadcast(part.select("words", "set")), "words").select("id", "of", "start", (F.col("start") + length).alias("end"), "set"))
    counted = keyed.select("id", "print", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    if not found:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return counted.select(F.col("id").alias(id_col), "print", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("spans"), F.lit(0).cast("long").alias("n_items"), F.lit("").alias("items"), F.lit(False).alias("contaminated"))
    hits = reduce(DataFrame.unionByName, found).groupBy("id", "of").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("at"), F.array_sort(F.collect_set("set")).alias("sets"))
    hits = checkpointed(hits)
    distinct = hits.select("sets").distinct().select("sets", F.explode("sets").alias("set"))
    named = distinct.join(members.distinct(), "set").select("sets", "item").distinct().groupBy("sets")
    named = named.agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    merged = F.aggregate(
        "at",
        F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("out"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(
            F.when((x["start"] > a["end"]) & (a["end"] >= 0), F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["out"]).alias("out"),
            F.when(x["start"] > a["end"], x["start"]).otherwise(a["start"]).alias("start"),
            F.greatest(a["end"], x["end"]).alias("end"),
            (a["n"] + x["end"] - F.greatest(x["start"], F.least(a["end"], x["end"]))).alias("n"),
        ),
        lambda a: F.struct(F.array_append(a["out"], F.struct(a["start"].alias("start"), a["end"].alias("end"))).alias("spans"), a["n"].alias("n")),
    )
    hits = hits.select("id", "of", "sets", merged.alias("m")).join(named, "sets").select(F.col("id").alias("i"), "of", F.col("m.n").alias("n_hit"), "m.spans", "n_items", "items")
    joined = counted.join(hits, F.col("id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("of")), "left")
    return joined.select(
        F.col("id").alias(id_col), "print", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.lit("")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
