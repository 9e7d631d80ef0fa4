"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Every word has the sum of three rows of one hashed table: two for the word, one for how it begins. Filters of several widths run over all words of a text,
the largest response of each is kept (max pooling), and a logistic layer reads them. Thresholds are calibrated
for each language, which is told from the text's own function words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm import common as _common
from evidra.llm import hashing as H

WIDTHS, FILTERS, DIMENSIONS, BUCKETS, BEGINNING = (1, 2, 3), 8, 8, 1 << 17, 8
PADDING = max(WIDTHS)
POSITIVE_AT = 0.7
#: Cells of the histogram that calibrates: so many to one of the inverse hyperbolic sine of the log-odds, and their range.
CELLS, LAST_CELL = 256, 5000
# Function words by which a text's language is told.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit von zu den ein eine auf für im sich des dem",
    "en": "the and of to in is that for it was with as on are this be by or from an",
    "es": "el los las del que por con para una un es y en se al lo como más su",
    "fr": "le les des et est une dans que pour qui sur pas au du avec par ce il elle",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


@dataclass
class Model:
    table: np.ndarray  # rows of the three hashes, one after the other
    filters: list[np.ndarray]  # of each width: width x dimensions x filters
    offsets: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: np.ndarray  # of the log-odds, by language


def _packed(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The places of a word's three rows in one number."""
    mask = np.uint64(BUCKETS - 1)
    return ((h & mask) | (((h >> np.uint64(32)) & mask) << np.uint64(17)) | ((begin & mask) << np.uint64(34))).astype(np.int64)


def _unpacked(x: np.ndarray) -> list[np.ndarray]:
    return [((x >> (17 * k)) & (BUCKETS - 1)).astype(np.int32) + np.int32(k * BUCKETS) for k in range(3)]


def _rows(h: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return _unpacked(_packed(h, begin))


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    kind = H.byte_class("alnum")
    pairs = sorted((H.word_hash(w, kind), i) for i, ws in enumerate(FUNCTION_WORDS.values()) for w in set(ws.split()))
    return np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)


def languages(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index in LANGUAGES of the language with most function words in each text; the last one without any."""
    known, which = _language_table()
    n, size = len(at) - 1, len(LANGUAGES)
    place = np.minimum(np.searchsorted(known, h), len(known) - 1)
    found = np.flatnonzero(known[place] == h)
    row = np.searchsorted(at, found, "right") - 1
    counts = np.bincount(row * size + which[place[found]], minlength=n * size).reshape(n, size)
    return np.where(counts.any(axis=1), counts.argmax(axis=1), size - 1)


def log_odds(m: Model, h: np.ndarray, begin: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-odds of each text whose words begin at ``at``; PADDING empty rows stand behind each text."""
    n, words = len(at) - 1, len(h)
    x = np.zeros((words + PADDING * n + PADDING, DIMENSIONS), np.float32)
    row = np.repeat(np.arange(n), np.diff(at))
    x[np.arange(words) + PADDING * row] = sum(m.table[side] for side in _rows(h, begin))
    start, end = at[:-1] + PADDING * np.arange(n), at[1:] + PADDING * np.arange(n)
    total, length = np.full(n, m.bias), words + PADDING * n
    for k, w in enumerate(m.filters):
        z = x[:length] @ w[0]
        for j in range(1, WIDTHS[k]):
            z += x[j : length + j] @ w[j]
        for d in range(1, PADDING):
            z[end + d] = -np.inf
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        total = total + np.maximum(np.maximum.reduceat(z, start, axis=0) + m.offsets[own], 0) @ m.out[own]
    return total


class _Texts(Sequence):
    """The lists of a table's last column, in order; the table's own memory is read, batch by batch."""

    def __init__(self, rows: pa.Table, order: np.ndarray):
        self.flat = [x.values.to_numpy() for x in rows.column(rows.num_columns - 1).chunks]
        self.ends = [x.offsets.to_numpy() for x in rows.column(rows.num_columns - 1).chunks]
        first = np.cumsum([0, *(len(x) - 1 for x in self.ends)])
        self.chunk = np.searchsorted(first, order, "right") - 1
        self.row = order - first[self.chunk]

    def __len__(self) -> int:
        return len(self.row)

    def __getitem__(self, i: int) -> list[np.ndarray]:
        k, ends = self.chunk[i], self.ends[self.chunk[i]]
        return _unpacked(self.flat[k][ends[self.row[i]] : ends[self.row[i] + 1]])


def fit(texts: Sequence[list[np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.15, dropped: float = 0.3, seed: int = 3) -> Model:
    """A model (without thresholds) from the table rows of texts' words (three for a word) and labels 0 or 1, by Adagrad on single texts.

    Each class weighs the same. Only the words under a filter's largest response receive a gradient; each visit
    leaves out the share ``dropped`` of the words, so that a text's other words get their turn.
    """
    r = np.random.RandomState(seed)
    table = r.normal(0, 0.05, (3 * BUCKETS, DIMENSIONS)).astype(np.float32)
    filters = [r.normal(0, 0.4, (k, DIMENSIONS, FILTERS)).astype(np.float32) for k in WIDTHS]
    offsets, out, bias = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.abs(r.normal(0.5, 0.2, len(WIDTHS) * FILTERS)).astype(np.float32), -1.0
    s_table, s_filters, s_offsets, s_out, s_bias = np.full(3 * BUCKETS, 0.1, np.float32), [np.full_like(w, 0.1) for w in filters], np.full_like(offsets, 0.1), np.full_like(out, 0.1), 0.1
    weight = {c: len(y) / (2 * max(1, int((y == c).sum()))) for c in (0, 1)}
    each = np.arange(FILTERS)
    for _ in range(epochs):
        for t in r.permutation(len(y)):
            sides = texts[t]
            kept = r.random_sample(len(sides[0])) >= dropped
            sides, n = [x[kept] for x in sides], int(kept.sum())
            x = np.zeros((n + PADDING, DIMENSIONS), np.float32)
            x[:n] = sum(table[side] for side in sides)
            best, pooled = [], np.empty_like(offsets)
            for k, w in enumerate(filters):
                z = x[: n + 1] @ w[0]
                for j in range(1, WIDTHS[k]):
                    z += x[j : n + 1 + j] @ w[j]
                i = z.argmax(axis=0)
                best.append(i)
                pooled[k * FILTERS : (k + 1) * FILTERS] = z[i, each]
            pooled += offsets
            active = np.maximum(pooled, 0)
            g = float(1 / (1 + np.exp(-np.clip(active @ out + bias, -30, 30))) - y[t]) * weight[int(y[t])]
            if abs(g) < 1e-3:
                continue
            d = g * out * (pooled > 0)
            rows, grads = [], []
            for k, w in enumerate(filters):
                dk = d[k * FILTERS : (k + 1) * FILTERS]
                grad = np.empty_like(w)
                for j in range(WIDTHS[k]):
                    place = best[k] + j
                    grad[j] = (dk[:, None] * x[place]).T
                    real = (place < n) & (dk != 0)
                    rows.append(place[real])
                    grads.append((dk[:, None] * w[j].T)[real])
                s_filters[k] += grad * grad
                filters[k] = w - rate * grad / np.sqrt(s_filters[k])
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            if len(rows):
                for side in (side[rows] for side in sides):
                    np.add.at(s_table, side, (grads * grads).mean(axis=1))
                    np.add.at(table, side, -rate * grads / np.sqrt(s_table[side])[:, None])
            s_offsets += d * d
            offsets -= rate * d / np.sqrt(s_offsets)
            go = g * active
            s_out += go * go
            out -= rate * go / np.sqrt(s_out)
            s_bias += g * g
            bias -= rate * g / np.sqrt(s_bias)
    return Model(table, filters, offsets, out, float(bias), np.zeros(len(LANGUAGES)))


def _threshold(cell: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """The middle of the highest gap between filled cells that gives the best F1; ``n`` texts are in a cell."""
    cells, place = np.unique(-cell, return_inverse=True)
    right = np.cumsum(np.bincount(place, n * (y == 1), len(cells)))
    f1 = 2 * right / (np.cumsum(np.bincount(place, n, len(cells))) + right[-1])
    i = int(np.argmax(f1))
    edge = (1 - cells[i] - cells[i + 1]) / 2 if i + 1 < len(cells) else -cells[i]
    return float(np.sinh(edge / CELLS))


def calibrated(model: Model, docs: DataFrame, known: DataFrame, fitted: DataFrame) -> Model:
    """``model`` with thresholds from all texts of ``docs`` (id, text) that ``known`` (id, y) labels, but those of ``fitted`` (id).

    Each class of a language weighs what it has of all labelled texts. Only a histogram by language and class
    reaches the driver. Languages with at least 20 texts of either class have their own threshold, the others one.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = H.byte_class("alnum")
        for batch in batches:
            for r0, data, offsets in H.text_blocks(batch.column(1)):
                h, at, _ = H.words(data, offsets, kind)
                cell = np.floor(np.arcsinh(log_odds(model, h, H.beginnings(data, offsets, kind, BEGINNING), at)) * CELLS)
                cell = np.clip(cell, -LAST_CELL, LAST_CELL).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, len(cell)), pa.array(languages(h, at).astype(np.int32)), pa.array(cell)], names=["id", "language", "cell"])

    judged = _common.map_batches(docs.select("id", "text").where("id is not null"), judge, f"id {dict(docs.dtypes)['id']}, language int, cell int")
    rows = judged.join(known, "id").join(F.broadcast(fitted.select("id", F.lit(1).alias("used"))), "id", "left")
    got = rows.groupBy("language", "y", "cell", F.coalesce("used", F.lit(0)).alias("used")).agg(F.count("*").alias("n")).collect()
    language, y, cell, used, n = (np.array([r[c] for r in got], np.int64) for c in ("language", "y", "cell", "used", "n"))
    weight, many = np.zeros(len(n)), np.zeros((len(LANGUAGES), 2), np.int64)
    for i in range(len(LANGUAGES)):
        for c in (0, 1):
            own = (language == i) & (y == c)
            many[i, c] = n[own & (used == 0)].sum()
            weight[own] = n[own] * (n[own].sum() / max(1, many[i, c]))
    free = used == 0
    common = _threshold(cell[free], y[free], weight[free]) if len(set(y[free].tolist())) == 2 else 0.0
    for i in range(len(LANGUAGES)):
        own = free & (language == i)
        model.thresholds[i] = _threshold(cell[own], y[own], weight[own]) if many[i].min() >= 20 else common
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, most: int = 6000, seed: int = 11) -> Model | None:
    """A calibrated model from the texts of ``docs`` that ``labels`` marks 0 or 1; None unless both classes occur.

    At most ``most`` rows of each class are chosen by a hash of id and seed, of those for which ``usable`` (over the
    columns of ``labels``) holds; three quarters of them are fitted, for which their whole texts reach the driver
    as numbers of table rows. An id with several labels counts as 1 if one is. All other usable labelled texts calibrate the
    thresholds: one for each language with at least 20 texts of either class, one common to the others.
    """
    known = labels.where(usable) if usable is not None else labels
    known = known.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    key = F.xxhash64(F.col("id").cast("string"), F.lit(seed))
    chosen = known.where("y = 1").orderBy(key, "id").limit(most).unionByName(known.where("y = 0").orderBy(key, "id").limit(most))
    part = F.xxhash64(F.col("id").cast("string"), F.lit(seed + 1))
    chosen = _common.checkpointed(chosen.withColumn("key", part).withColumn("fitted", F.pmod("key", F.lit(4)) != 0))
    # With few labels none of a class may be left to fit: then all are.
    if chosen.where("fitted").agg(F.countDistinct("y")).first()[0] < 2:
        chosen = chosen.withColumn("fitted", F.lit(True))
    fitted = chosen.where("fitted").drop("fitted")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = H.byte_class("alnum")
        for batch in batches:
            for r0, data, offsets in H.text_blocks(batch.column(2)):
                h, at, _ = H.words(data, offsets, kind)
                n = len(at) - 1
                words = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_packed(h, H.beginnings(data, offsets, kind, BEGINNING))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(r0, n), batch.column(1).slice(r0, n), words], names=["key", "y", "words"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = _common.map_batches(texts.join(F.broadcast(fitted), "id").select("key", "y", "text"), hashed, "key long, y int, words array<long>").toArrow()
    key, y = rows.column("key").to_numpy(), rows.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return None
    order = np.argsort(key, kind="stable")
    model = fit(_Texts(rows, order), y[order])
    del rows
    pa.default_memory_pool().release_unused()
    return calibrated(model, texts, known, fitted.select("id"))


def score(docs: DataFrame, model: Model | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with ``out``: 0 to 1, at least 0.7 from the threshold of the text's language on.

    Only the text is an input, and all of it. A null text counts as empty and gets the score of a text without
    words. Without a model every score is 0. Other columns stay (an older ``out`` is replaced).
    """
    docs = docs.drop(out)
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    (raw,) = _common.fresh(docs, "raw_text")
    base = float(np.log(POSITIVE_AT / (1 - POSITIVE_AT)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = H.byte_class("alnum")
        for batch in batches:
            got = np.zeros(batch.num_rows)
            for r0, data, offsets in H.text_blocks(batch.column(batch.num_columns - 1)):
                h, at, _ = H.words(data, offsets, kind)
                odds = log_odds(model, h, H.beginnings(data, offsets, kind, BEGINNING), at) - model.thresholds[languages(h, at)] + base
                got[r0 : r0 + len(at) - 1] = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got)], names=[*batch.schema.names[:-1], out])

    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return _common.map_batches(docs.withColumn(raw, F.col(text_col).cast("string")), judge, schema)
