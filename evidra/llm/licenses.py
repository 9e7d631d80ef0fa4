"""License scans: an exact containment join between the lines of all texts and license templates.

Tokens are ordered by their frequency over all lines. A template of n words is found in a line that holds at
least the share ``threshold`` of them; then one of its n - ceil(threshold * n) + 1 rarest words is in the line
(prefix filter), the line has enough template words (length filter), and what follows the shared word in both
orders suffices (positional filter). In lines that pass, the template's words must stand within a run of at most its length divided
by the threshold, which is compared exactly. Templates that wrap are found likewise
in runs of words over line ends: around each of a template's rarest words there must be enough of its words, and
what passes is compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import common as _common  # noqa: F401
from evidra.llm import hashing as H

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Templates of the containment join and their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2.0"),
    ("cc-by-4.0", "licensed under cc by 4.0"),
    ("cc-by-nc", "licensed under cc by nc 4.0"),
    ("cc-by-sa", "licensed under cc by sa 4.0"),
    ("cc0", "no rights reserved cc0 public domain dedication"),
    ("proprietary", "all rights reserved"),
]
_SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label:string,line:long,containment:double,text:string>>, wrapped array<struct<label:string,line:long,last_line:long,containment:double,text:string>>"


def _template_words(templates) -> list[tuple[str, list[int]]]:
    kind = H.byte_class("alnum")
    out = []
    for label, text in templates:
        data = np.frombuffer(text.encode(), np.uint8)
        out.append((label, sorted(set(H.words(data, np.array([0, len(data)]), kind)[0].tolist()))))
    return [x for x in out if x[1]]


def _lines_of(data: np.ndarray, offsets: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line of each word, first byte of each line, its row): a row's end and \\n end a line."""
    ends = np.flatnonzero(data == 10) + 1
    begin = np.union1d(offsets[:-1], ends[ends < len(data)]) if len(data) else np.zeros(0, np.int64)
    return np.searchsorted(begin, start, "right") - 1, begin, np.searchsorted(offsets, begin, "right") - 1


def line_frequencies(docs: DataFrame, text_col: str, templates) -> dict[int, int]:
    """In how many lines of all texts each template word stands: as many numbers as templates have words."""
    vocabulary = np.array(sorted({w for _, t in _template_words(templates) for w in t}), np.uint64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, total = H.byte_class("alnum"), np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for _, data, offsets in H.text_blocks(batch.column(0)):
                h, _, start = H.words(data, offsets, kind)
                at = np.searchsorted(vocabulary, h)
                found = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h
                line, _, _ = _lines_of(data, offsets, start[found])
                pairs = np.unique(line * len(vocabulary) + at[found])
                total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary.view(np.int64)), pa.array(total)], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"] % 2**64: r["n"] for r in rows}


def most_within(placed: list[tuple[int, int]], width: int) -> int:
    """The most different words of ``placed`` (place, word; in order) that stand within ``width`` words of the text."""
    held, s, best = Counter(), 0, 0
    for place, word in placed:
        held[word] += 1
        while place - placed[s][0] >= width:
            held[placed[s][1]] -= 1
            if not held[placed[s][1]]:
                del held[placed[s][1]]
            s += 1
        best = max(best, len(held))
    return best


def runs_over_lines(place: list[int], word: list[int], line: list[int], need: int, width: int) -> list[tuple[int, int, int]]:
    """(number of different words, first, last) of runs over several lines that don't overlap, the best first.

    ``place`` says where in the text the template's words stand. A run spans at most ``width`` words of the text, has
    ``need`` different ones, and its first and last word stand in it once.
    """
    wide, s, found = Counter(), 0, []
    for e in range(len(place)):
        wide[word[e]] += 1
        while place[e] - place[s] >= width:
            wide[word[s]] -= 1
            if not wide[word[s]]:
                del wide[word[s]]
            s += 1
        if len(wide) >= need:
            begin, left = s, Counter(wide)
            while left[word[begin]] > 1:
                left[word[begin]] -= 1
                begin += 1
            if line[begin] != line[e] and left[word[e]] == 1:
                found.append((-len(wide), place[e] - place[begin], begin, e))
    taken, out = bytearray(len(place)), []
    for n, _, a, b in sorted(found):
        if not any(taken[a : b + 1]):
            taken[a : b + 1] = b"\1" * (b + 1 - a)
            out.append((-n, a, b))
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """What every whole text says about licenses: one row for each row of ``docs``.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lowered. ``n_base`` counts the places
    where a phrase's words stand consecutively, over line ends too; ``first_word`` and ``last_word`` are the
    smallest and largest start of one, or null. ``blocks`` lists the lines in which a run of at most a template's
    number of words divided by ``threshold`` holds its words to at least ``threshold`` (label, line from 0,
    containment, the line itself), by line, label and containment. ``wrapped`` lists likewise (with the last line, and
    all lines as text) such runs over line ends; of overlapping ones the best counts.
    ``labels`` has the labels of phrases, blocks and wrapped ones; ``score`` is 1 with a phrase, else the best
    containment of a block or wrapped one, else 0. A null text counts as empty; an empty one has no words, no labels and score 0. Rows
    with the same id stay apart; other columns are left out; an empty table gives an empty result.
    """
    kind = H.byte_class("alnum")
    frequency = line_frequencies(docs, text_col, templates)
    listed = _template_words(templates)
    order = sorted({w for _, t in listed for w in t}, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    vocabulary = np.array(sorted(order), np.uint64)
    rank_of = np.array([rank[int(w)] for w in vocabulary], np.int64)
    ranked = [(label, sorted(rank[w] for w in t)) for label, t in listed]
    need = [math.ceil(threshold * len(t) - 1e-9) for _, t in ranked]
    index: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, (_, t) in enumerate(ranked):
        for i, w in enumerate(t[: len(t) - need[k] + 1]):
            index[w].append((k, i))
    index = dict(index)
    # A template's words, its rarest ones, and how many words of a text may hold it.
    whole, rare = np.zeros((len(ranked), len(order)), bool), np.zeros((len(ranked), len(order)), bool)
    for k, (_, t) in enumerate(ranked):
        whole[k, t], rare[k, t[: len(t) - need[k] + 1]] = True, True
    lengths = [n for _, text in templates if (n := len(H.words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]), kind)[0]))]
    widths = [math.ceil(n / threshold - 1e-9) for n in lengths]
    members = [frozenset(t) for _, t in ranked]
    first = np.array(sorted(index), np.int64)
    hashes = [([H.word_hash(w, kind) for w in phrase.split()], label) for phrase, label in phrases.items()]

    def lines_found(h, start, data, offsets):
        at = np.searchsorted(vocabulary, h)
        found = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == h)
        ranks = rank_of[at[found]]
        line, begin, row = _lines_of(data, offsets, start[found])
        lines = np.unique(line[np.isin(ranks, first)])
        lo, hi = np.searchsorted(line, lines), np.searchsorted(line, lines, "right")
        for at_line, a, b in zip(lines.tolist(), lo.tolist(), hi.tolist(), strict=True):
            words = np.unique(ranks[a:b]).tolist()
            seen = set()
            for j, w in enumerate(words):
                for k, i in index.get(w, ()):
                    label, t = ranked[k]
                    if k in seen or len(words) < need[k] or min(len(t) - i, len(words) - j) < need[k]:
                        continue
                    seen.add(k)
                    if len(members[k].intersection(words)) < need[k]:
                        continue
                    own = [(int(found[x]), int(ranks[x])) for x in range(a, b) if ranks[x] in members[k]]
                    if (same := most_within(own, widths[k])) >= need[k]:
                        r = int(row[at_line])
                        end = int(begin[at_line + 1]) if at_line + 1 < len(begin) else len(data)
                        yield r, label, at_line - int(np.searchsorted(row, r)), same / len(t), data[begin[at_line] : end].tobytes().decode("utf-8", "replace").rstrip("\n")

    def wrapped_found(h, at, start, data, offsets):
        near = np.searchsorted(vocabulary, h)
        found = np.flatnonzero(vocabulary[np.minimum(near, len(vocabulary) - 1)] == h)
        ranks = rank_of[near[found]]
        seeds = found[np.isin(ranks, first)], ranks[np.isin(ranks, first)]
        line, begin, row = _lines_of(data, offsets, start[found])
        for k, (label, t) in enumerate(ranked):
            seed = seeds[0][rare[k][seeds[1]]]
            if not len(seed):
                continue
            own = np.flatnonzero(whole[k][ranks])
            place = found[own]
            r = np.searchsorted(at, seed, "right") - 1
            lo = np.searchsorted(place, np.maximum(seed - widths[k] + 1, at[r]))
            hi = np.searchsorted(place, np.minimum(seed + widths[k], at[r + 1]))
            kept = hi - lo >= need[k]
            kept[kept] = line[own[lo[kept]]] != line[own[hi[kept] - 1]]
            spans: list[list[int]] = []
            for a, b, x in zip(lo[kept].tolist(), hi[kept].tolist(), r[kept].tolist(), strict=True):
                if spans and spans[-1][2] == x and a < spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b, x])
            for a, b, x in spans:
                mine = own[a:b]
                lines = line[mine]
                for same, s, e in runs_over_lines(place[a:b].tolist(), ranks[mine].tolist(), lines.tolist(), need[k], widths[k]):
                    one, two, top = int(lines[s]), int(lines[e]), int(np.searchsorted(row, x))
                    end = int(begin[two + 1]) if two + 1 < len(begin) else len(data)
                    yield x, label, one - top, two - top, same / len(t), data[begin[one] : end].tobytes().decode("utf-8", "replace").rstrip("\n")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            n_words, n_base = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low, high = np.full(n, 2**62), np.full(n, -1)
            base = [set() for _ in range(n)]
            blocks: list[list] = [[] for _ in range(n)]
            wrapped: list[list] = [[] for _ in range(n)]
            for r0, data, offsets in H.text_blocks(batch.column(1)):
                h, at, start = H.words(data, offsets, kind)
                n_words[r0 : r0 + len(at) - 1] = np.diff(at)
                for want, label in hashes:
                    places = np.flatnonzero(h[: max(0, len(h) - len(want) + 1)] == np.uint64(want[0]))
                    for d, w in enumerate(want[1:], 1):
                        places = places[h[places + d] == np.uint64(w)]
                    row = np.searchsorted(at, places, "right") - 1
                    inside = places + len(want) <= at[row + 1] if len(places) else np.zeros(0, bool)
                    for r, p in zip(row[inside].tolist(), (places - at[row])[inside].tolist(), strict=True):
                        n_base[r0 + r] += 1
                        low[r0 + r], high[r0 + r] = min(low[r0 + r], p), max(high[r0 + r], p)
                        base[r0 + r].add(label)
                if len(vocabulary):
                    for r, label, line, share, text in lines_found(h, start, data, offsets):
                        blocks[r0 + r].append({"label": label, "line": line, "containment": share, "text": text})
                    for r, label, line, last, share, text in wrapped_found(h, at, start, data, offsets):
                        wrapped[r0 + r].append({"label": label, "line": line, "last_line": last, "containment": share, "text": text})
            for x in [*blocks, *wrapped]:
                x.sort(key=lambda y: (y["line"], y["label"], y["containment"]))
            none = n_base == 0
            every = [b + w for b, w in zip(blocks, wrapped, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n_words), pa.array(n_base), pa.array(low, mask=none), pa.array(high, mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | {y["label"] for y in b})) for x, b in zip(base, every, strict=True)], pa.string()),
                    pa.array([1.0 if x else max((y["containment"] for y in b), default=0.0) for x, b in zip(base, every, strict=True)], pa.float64()),
                    pa.array(blocks, pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("containment", pa.float64()), ("text", pa.string())]))),
                    pa.array(wrapped, pa.list_(pa.struct([("label", pa.string()), ("line", pa.int64()), ("last_line", pa.int64()), ("containment", pa.float64()), ("text", pa.string())]))),
                ],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks", "wrapped"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, f"id {dict(rows.dtypes)['id']}, {_SCHEMA}").withColumnRenamed("id", id_col)
