"""Edit-aware token counts: each text keeps a tree of its pre-tokens' counts.

A pre-token is a match of the tokenizer's pattern; tokens never cross one. Leaves of the tree hold runs of
pre-tokens, inner levels the sums of their children. An edit re-encodes from the last pre-token that ends,
with the two characters its pattern looks ahead, before the edit, until an old boundary beyond the edit comes
back; only the leaves in between are made anew, and of the sums only theirs and those on the paths from them to the
root. A leaf holds up to twice LEAF pre-tokens; only where the touched leaves would hold more, or one would be empty,
the number of leaves changes, and the sums behind them are added up again. Places behind the edit are shifted: no
pre-token there is encoded or read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm import common as _common  # noqa: F401

# The vocabulary's file and its public pre-token pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, FAN, REMEMBERED = 64, 16, 300_000
AHEAD = 2  # how far the pattern looks beyond a match it could have made longer
_TREE = "struct<ends:array<int>,counts:array<int>,leaves:array<int>,sums:array<array<int>>>"


class Tokenizer:
    """Counts tokens of pre-tokens; remembers up to REMEMBERED of them."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern, self.seen = regex.compile(pattern), {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            n = self.seen[piece] = len(self.encoding.encode_ordinary(piece))
        return n


class TokenTree:
    """``ends`` and ``counts`` of pre-tokens, first pre-token of each leaf and the end, sums from the leaves up to the root."""

    def __init__(self, ends: np.ndarray, counts: np.ndarray, leaves: np.ndarray, sums: list[np.ndarray]):
        self.ends, self.counts, self.leaves, self.sums = ends, counts, leaves, sums
        self.updated = 0  # how many sums the last edit, or the making of the tree, has written

    @classmethod
    def of(cls, text: str, tokenizer: Tokenizer) -> TokenTree:
        pieces = tokenizer.pattern.findall(text)
        counts = np.fromiter(map(tokenizer.count, pieces), np.int32, len(pieces))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
        tree = cls(ends, counts, np.append(np.arange(0, len(pieces), LEAF), len(pieces)).astype(np.int32), [])
        tree._sum_from(0)
        return tree

    @property
    def total(self) -> int:
        return int(self.sums[-1][0]) if len(self.sums[-1]) else 0

    def _sum_from(self, leaf: int) -> None:
        """Sums of leaves from ``leaf`` on and of what is above them; those before stay."""
        old, sums, at, self.updated = self.sums, [], leaf, 0
        below = self.counts
        starts = self.leaves[:-1]
        while True:
            kept = old[len(sums)][:at] if len(sums) < len(old) else np.zeros(0, np.int32)
            at = len(kept)
            fresh = np.add.reduceat(below[starts[at] :], starts[at:] - starts[at], dtype=np.int32) if at < len(starts) else np.zeros(0, np.int32)
            sums.append(np.concatenate([kept, fresh]).astype(np.int32))
            self.updated += len(fresh)
            if len(sums[-1]) <= 1:
                break
            below, starts, at = sums[-1], np.arange(0, len(sums[-1]), FAN), at // FAN
        self.sums = sums

    def _sum_paths(self, first: int, last: int) -> None:
        """Sums of leaves ``first`` to ``last`` (exclusive) and on their paths to the root; the tree keeps its shape."""
        self.sums = [x if x.flags.writeable else x.copy() for x in self.sums]
        begin, end = int(self.leaves[first]), int(self.leaves[last])
        self.sums[0][first:last] = np.add.reduceat(self.counts[begin:end], self.leaves[first:last] - begin)
        self.updated, lo, hi = last - first, first, last
        for below, level in pairwise(self.sums):
            lo, hi = lo // FAN, (hi - 1) // FAN + 1
            under = below[lo * FAN : hi * FAN]
            level[lo:hi] = np.add.reduceat(under, np.arange(0, len(under), FAN))
            self.updated += hi - lo

    def edit(self, text: str, start: int, end: int, replacement: str, tokenizer: Tokenizer) -> tuple[str, int]:
        """The text after replacing code points ``start`` to ``end`` (cut to the text), and how many pre-tokens were encoded."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        new, shift = text[:start] + replacement + text[end:], len(replacement) - (end - start)
        keep = int(np.searchsorted(self.ends, start - AHEAD, "right"))  # with the characters looked at behind them, these are as they were
        at = int(self.ends[keep - 1]) if keep else 0
        pieces, resume, back = [], len(self.ends), int(np.searchsorted(self.ends, end, "left"))
        for m in tokenizer.pattern.finditer(new, at):
            pieces.append(m[0])
            if m.end() >= start + len(replacement):
                while back < len(self.ends) and self.ends[back] + shift < m.end():
                    back += 1
                if back < len(self.ends) and self.ends[back] + shift == m.end():
                    resume = back + 1
                    break
        counts = np.fromiter(map(tokenizer.count, pieces), np.int32, len(pieces))
        ends = at + np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
        first = max(0, int(np.searchsorted(self.leaves, keep, "right")) - 1)
        first = min(first, max(0, len(self.leaves) - 2))
        last = min(max(int(np.searchsorted(self.leaves, resume, "left")), first + 1), len(self.leaves) - 1)
        begin, old_end = int(self.leaves[first]), int(self.leaves[last])
        size = old_end - begin - (resume - keep) + len(pieces)
        self.ends = np.concatenate([self.ends[:keep], ends, self.ends[resume:] + shift]).astype(np.int32)
        self.counts = np.concatenate([self.counts[:keep], counts, self.counts[resume:]])
        tail, touched = self.leaves[last:] + (size - (old_end - begin)), last - first
        if 0 < touched <= size <= 2 * LEAF * touched:
            self.leaves = np.concatenate([self.leaves[:first], begin + np.arange(touched) * size // touched, tail]).astype(np.int32)
            self._sum_paths(first, last)
            return new, len(pieces)
        self.leaves = np.concatenate([self.leaves[:first], np.arange(begin, begin + size, LEAF), tail if size or len(tail) > 1 or first else tail]).astype(np.int32)
        self._sum_from(first)
        return new, len(pieces)


def token_trees(docs: DataFrame, text_col: str = "text", out: str = "token_tree", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with ``out``: the tree of every whole text (ends of pre-tokens in code points, their token counts, leaves, sums).

    The last level of sums holds the text's number of tokens. A null text counts as empty, whose tree has no
    pre-token. Other columns stay (an older ``out`` is replaced). ``vocabulary`` is a file of ranks the driver can open.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    docs = docs.drop(out)
    (raw,) = _common.fresh(docs, "raw_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T._parse_datatype_string(_TREE))])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks, pattern)
        for batch in batches:
            trees = [TokenTree.of(t or "", tokenizer) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _packed(trees)], names=[*batch.schema.names[:-1], out])

    return docs.withColumn(raw, F.col(text_col).cast("string")).mapInArrow(grow, schema)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)))


def _packed(trees: list[TokenTree]) -> pa.StructArray:
    levels = _lists([s for t in trees for s in t.sums])
    sums = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(t.sums) for t in trees)]), pa.int32()), levels)
    return pa.StructArray.from_arrays([_lists([t.ends for t in trees]), _lists([t.counts for t in trees]), _lists([t.leaves for t in trees]), sums], names=["ends", "counts", "leaves", "sums"])


def recount(trees: DataFrame, edits: Column, text_col: str = "text", tree: str = "token_tree", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``trees`` (of ``token_trees``) after ``edits``: an array of structs (start, end, replacement), applied in turn.

    Each edit's places are code points of the text as the edits before it left it, and are cut to the text; null
    or missing parts mean 0, the start, and the empty string. Text and tree are replaced; n_before, n_after
    (tokens) and n_encoded (pre-tokens encoded anew) are added. Null edits change nothing.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    added = ("n_before", "n_after", "n_encoded")
    trees = trees.drop(*added)
    (todo,) = _common.fresh(trees, "edits_to_do")
    names = trees.columns
    schema = T.StructType([*trees.schema.fields, *[T.StructField(c, T.LongType()) for c in added]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(ranks, pattern)
        for batch in batches:
            texts, packed, every = batch.column(names.index(text_col)).to_pylist(), batch.column(names.index(tree)), batch.column(batch.num_columns - 1).to_pylist()
            arrays = {c: packed.field(c) for c in ("ends", "counts", "leaves")}
            done, counted = [], []
            for i, (text, edits_here) in enumerate(zip(texts, every, strict=True)):
                sums = packed.field("sums")[i].values
                t = TokenTree(*(arrays[c][i].values.to_numpy() for c in arrays), [sums[j].values.to_numpy() for j in range(len(sums))])
                before, encoded, text = t.total, 0, text or ""
                for e in edits_here or ():
                    start = e["start"] or 0
                    text, n = t.edit(text, start, start if e["end"] is None else e["end"], e["replacement"] or "", tokenizer)
                    encoded += n
                done.append((text if edits_here or texts[i] is not None else None, t))
                counted.append((before, t.total, encoded))
            columns = dict(zip(names, batch.columns[:-1], strict=True)) | {text_col: pa.array([x for x, _ in done], pa.string()), tree: _packed([t for _, t in done])}
            yield pa.RecordBatch.from_arrays([*columns.values(), *(pa.array(c, pa.int64()) for c in (zip(*counted, strict=True) if counted else [()] * 3))], names=[*names, *added])

    wanted = "array<struct<start:int,end:int,replacement:string>>"
    return trees.withColumn(todo, edits.cast(wanted)).mapInArrow(apply, schema)
