"""Near-duplicate embeddings by NN-descent.

A neighbour graph starts from cells of random hyperplanes and is refined by neighbours-of-neighbours joins:
around each vector its neighbours are compared with each other, and what is nearer than the worst entry of a
list enters it. Exact copies take part once. Vectors whose whole list reaches the threshold are saturated; their
lists grow to all vectors of their component, compared exactly in pieces, and to all they link with outside it,
found exactly by pivots and the triangle inequality of angles. Recall is audited against brute force on a bounded
sample; with too little of it the lists are doubled, and in the end all vectors are treated as saturated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import checkpointed, components, groups

PIECE = 1024
#: Numbers of pivots' vectors that reach the driver and the executors at once.
BLOCK = 1 << 20


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length, in double precision, from lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, space, v): a row an id, of vectors without null or non-finite components and not zero; a space is a label and a length.

    Of several rows with one id the least by label and vector counts.
    """
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(good).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(label_col).cast("string").alias("l"), v.alias("v"))).alias("r"))
    return rows.select("id", F.concat_ws("/", "r.l", F.size("r.v")).alias("space"), "r.v")


def distinct(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, space, v, w): one of each vector, with the smallest of its ids and their number; (id, rep): that one for every id."""
    reps = checkpointed(rows.groupBy("space", "v").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "space", "v", "w"))
    return reps, checkpointed(rows.join(reps.withColumnRenamed("id", "rep"), ["space", "v"]).select("id", "rep"))


def _sorted_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _coded(keys: list[str]):
    """The group's keys as one number, so that Arrow groups can be told apart whatever the keys' types."""
    return F.xxhash64(*keys)


def first_graph(rows: DataFrame, k: int, trees: int, seed: int, cell: int = 256) -> DataFrame:
    """(id, other, cos): each vector's best ``k`` within its cell of each of ``trees`` random partitions.

    Cells hold about ``cell`` vectors, by as many hyperplanes as the number of vectors asks for; larger ones are
    searched in pieces.
    """
    planes = int(np.clip(np.ceil(np.log2(max(1, rows.count()) / cell)), 0, 40))

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            space, v = batch.column(1).to_pylist(), batch.column(2)
            size = v.value_lengths().to_numpy()
            for tree in range(trees):
                code = np.zeros(len(size), np.int64)
                for d in np.unique(size).tolist():
                    own = np.flatnonzero(size == d)
                    m = _matrix(v.take(pa.array(own)))
                    side = m @ np.random.RandomState(seed + 1000 * tree + d).normal(size=(d, planes)) > 0
                    code[own] = side @ (1 << np.arange(planes, dtype=np.int64)) if planes else 0
                yield pa.RecordBatch.from_arrays([pa.array([f"{tree}/{s}/{c}" for s, c in zip(space, code.tolist(), strict=True)]), batch.column(0), v], names=["cell", "id", "v"])

    dealt = rows.select("id", "space", "v").mapInArrow(celled, f"cell string, id long, v {dict(rows.dtypes)['v']}")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1")
    dealt = dealt.join(sizes, "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / PIECE))).withColumn("g", _coded(["cell", "piece"]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, 1):
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if b - a > 1:
                    ids, m = t.column("id").slice(a, b - a).to_numpy(), _matrix(t.column("v").slice(a, b - a))
                    cos = m @ m.T
                    np.fill_diagonal(cos, -2)
                    top = np.argpartition(-cos, min(k, b - a - 1) - 1, axis=1)[:, : min(k, b - a - 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(cos, top, 1).ravel())], names=["id", "other", "cos"])

    return _sorted_by(dealt.select("g", "id", "v"), "g").mapInArrow(best, "id long, other long, cos double").distinct()


def _lists(edges: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each vector."""
    once = edges.groupBy("id", "other").agg(F.max("cos").alias("cos"))
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cos"), "other"))).where(F.col("rank") <= k)


def refined(rows: DataFrame, edges: DataFrame, k: int, rounds: int, settled: float = 0.002) -> DataFrame:
    """``edges`` after neighbours-of-neighbours joins, until fewer than ``settled`` of the entries change."""
    lists = checkpointed(_lists(edges, k).select("id", "other", "cos", "rank"))
    for _ in range(rounds):
        worst = lists.groupBy("id").agg(F.min("cos").alias("least"), F.count("*").alias("n")).select(F.col("id").alias("member"), F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("least"))
        back = lists.withColumn("place", F.row_number().over(Window.partitionBy("other").orderBy(F.desc("cos"), "id"))).where(F.col("place") <= k)
        around = lists.select("id", F.col("other").alias("member")).unionByName(back.select(F.col("other").alias("id"), F.col("id").alias("member"))).unionByName(lists.select("id", F.col("id").alias("member"))).distinct()
        known = rows.select(F.col("id").alias("member"), "v").join(worst, "member", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
        met = _sorted_by(around.join(known, "member").select("id", "member", "least", "v"), "id")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, group in groups(batches, 1):
                ends = np.flatnonzero(np.diff(group, append=-1)) + 1
                out = []
                for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    ids, least, m = t.column("member").slice(a, b - a).to_numpy(), t.column("least").slice(a, b - a).to_numpy(), _matrix(t.column("v").slice(a, b - a))
                    cos = m @ m.T
                    np.fill_diagonal(cos, -3)
                    i, j = np.nonzero(cos > least[:, None])
                    out.append((ids[i], ids[j], cos[i, j]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "other", "cos"])

        newer = checkpointed(_lists(lists.select("id", "other", "cos").unionByName(met.mapInArrow(compare, "id long, other long, cos double")), k).select("id", "other", "cos", "rank"))
        changed = newer.join(lists.select("id", "other"), ["id", "other"], "left_anti").count()
        lists = newer
        if changed <= settled * lists.count():
            break
    return lists


def outside(rows: DataFrame, saturated: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join the components of the vectors ``saturated`` (id) with all that these link with outside.

    Pivots cover the saturated vectors of a component. What links with one that is at most an angle r from its
    pivot is at most r + arccos(threshold) from the pivot; such vectors of other components are compared exactly
    with the pivot's own. A pivot stands for its own in the result.
    """
    reach = float(np.arccos(threshold))
    placed = checkpointed(rows.join(found.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "space", F.coalesce("component", "id").alias("component"), "v"))
    dealt = placed.join(saturated, "id")
    sizes = dealt.groupBy("component").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = dealt.join(sizes, "component").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))).select("component", "piece", "id", "v")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, 2):
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                ids, m = t.column("id").slice(a, b - a).to_numpy(), _matrix(t.column("v").slice(a, b - a))
                pivot, cos = np.full(b - a, -1), np.ones(b - a)
                while (free := pivot < 0).any():
                    p = int(free.argmax())
                    near = m @ m[p]
                    near[p] = 1
                    own = free & (near >= threshold)
                    pivot[own], cos[own] = p, near[own]
                yield pa.RecordBatch.from_arrays([pa.array(ids[pivot]), pa.array(ids), pa.array(cos)], names=["pivot", "id", "cos"])

    members = checkpointed(_sorted_by(dealt, "component", "piece").mapInArrow(cover, "pivot long, id long, cos double"))
    pivots = members.groupBy("pivot").agg(F.min("cos").alias("cos")).join(placed, F.col("pivot") == F.col("id")).select("pivot", "cos", "space", "component", "v")

    def met(block: list) -> DataFrame:
        spaces = {}
        for space in {r["space"] for r in block}:
            own = [r for r in block if r["space"] == space]
            m = np.array([r["v"] for r in own], np.float64)
            least = np.cos(np.minimum(np.arccos(np.clip([r["cos"] for r in own], -1, 1)) + reach + 1e-6, np.pi))
            spaces[space] = np.array([r["pivot"] for r in own]), np.array([r["component"] for r in own]), least, m / np.linalg.norm(m, axis=1, keepdims=True)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of = np.array(batch.column(1).to_pylist(), object)
                every, component = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for space, (ids, place, least, m) in spaces.items():
                    own = np.flatnonzero(of == space)
                    step = max(1, (1 << 21) // len(ids))
                    for part in (own[i : i + step] for i in range(0, len(own), step)):
                        i, j = np.nonzero((_matrix(batch.column(3).take(pa.array(part))) @ m.T >= least) & (component[part][:, None] != place))
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(every[part[i]])], names=["pivot", "id"])

        return checkpointed(placed.select("id", "space", "component", "v").mapInArrow(search, "pivot long, id long"))

    found_near, block, held = members.select("pivot", "id").limit(0), [], 0
    for r in pivots.toLocalIterator():
        block.append(r)
        held += len(r["v"])
        if held >= BLOCK:
            found_near, block, held = found_near.unionByName(met(block)), [], 0
    if block:
        found_near = found_near.unionByName(met(block))
    pieces = checkpointed(found_near.groupBy("pivot").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")))
    theirs = found_near.join(pieces, "pivot").select("pivot", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int").alias("piece"), F.lit(0).alias("own"), "id")
    ours = members.join(pieces, "pivot").select("pivot", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("own"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, 2):
            pivot, own, every = (t.column(c).to_numpy() for c in ("pivot", "own", "id"))
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                m = _matrix(t.column("v").slice(a, b - a))
                x, y = np.flatnonzero(own[a:b] == 0), np.flatnonzero(own[a:b] == 1)
                linked = every[a:b][x[(m[x] @ m[y].T >= threshold).any(axis=1)]]
                if len(linked):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(linked), pivot[a])), pa.array(linked)], names=["a", "b"])

    pairs = theirs.unionByName(ours).join(placed.select("id", "v"), "id").select("pivot", "piece", "own", "id", "v")
    return _sorted_by(pairs, "pivot", "piece").mapInArrow(compare, "a long, b long")


def _links_within(rows: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """(id, n_links): how many vectors (``w`` for each row) of its component each is linked with, compared in pieces of about PIECE."""
    sizes = found.groupBy("component").agg(F.count("*").alias("m"))
    own = found.join(sizes, "component").join(rows, found["node"] == rows["id"]).withColumn("pieces", F.ceil(F.col("m") / PIECE).cast("int"))
    own = own.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    own = own.select("component", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "id", "v", "w")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in groups(batches, 3):
            low, high, piece, every, weight = (t.column(c).to_numpy() for c in ("low", "high", "piece", "id", "w"))
            ends = np.flatnonzero(np.diff(group, append=-1)) + 1
            ids, ns = [], []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                m, w = _matrix(t.column("v").slice(a, b - a)), weight[a:b]
                if low[a] == high[a]:
                    hit = m @ m.T >= threshold
                    np.fill_diagonal(hit, False)
                    ids.append(every[a:b])
                    ns.append(hit @ w)
                else:
                    x, y = np.flatnonzero(piece[a:b] == low[a]), np.flatnonzero(piece[a:b] == high[a])
                    hit = m[x] @ m[y].T >= threshold
                    ids += [every[a:b][x], every[a:b][y]]
                    ns += [hit @ w[y], w[x] @ hit]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(ns).astype(np.int64))], names=["id", "n"])

    return _sorted_by(own, "component", "low", "high").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))


def audited(rows: DataFrame, links: DataFrame, threshold: float, sample: int, seed: int) -> float:
    """The share of all links of ``sample`` vectors (chosen by hash) that ``links`` counts; 1 if they have none."""
    chosen = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()
    spaces: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for space in {r["space"] for r in chosen}:
        own = [r for r in chosen if r["space"] == space]
        m = np.array([r["v"] for r in own], np.float64)
        spaces[space] = np.array([r["id"] for r in own]), m / np.linalg.norm(m, axis=1, keepdims=True)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {space: np.zeros(len(ids), np.int64) for space, (ids, _) in spaces.items()}
        for batch in batches:
            of = np.array(batch.column(1).to_pylist(), object)
            for space, (ids, m) in spaces.items():
                own = np.flatnonzero(of == space)
                if len(own):
                    hit = m @ _matrix(batch.column(2).take(pa.array(own))).T >= threshold
                    total[space] += hit.sum(axis=1) - (ids[:, None] == batch.column(0).to_numpy()[own]).any(axis=1)
        for space, (ids, _) in spaces.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[space])], names=["id", "n"])

    if not spaces:
        return 1.0
    true = rows.select("id", "space", "v").mapInArrow(search, "id long, n long").groupBy("id").agg(F.sum("n").alias("true"))
    got = true.join(links, "id", "left").agg(F.sum("true"), F.sum(F.coalesce("n_links", F.lit(0)))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
    k: int = 10, trees: int = 4, rounds: int = 3, recall: float = 0.97, sample: int = 500, attempts: int = 3, seed: int = 29,
) -> DataFrame:
    """(id, n_links, component, kept) for every row: vectors of one label link from a cosine of ``threshold`` on.

    Cosines are in double precision. ``component`` is the smallest id that links reach, ``kept`` whether it is
    the row's own; ``n_links`` counts all links within the component. A vector that is null, zero or holds null
    or non-finite components, or has a null label, links with nothing; vectors of different lengths never link.
    Rows that share an id count as one vector and all get its result; a row without an id stays alone. Extra
    columns are left out, and an empty table gives no rows. The audit takes ``sample`` vectors; below
    ``recall`` the search is repeated with lists and trees doubled, ``attempts`` times at most, and then every
    vector is compared by pivots, which loses no link.
    """
    every = checkpointed(usable(vectors, id_col, vector_col, label_col))
    rows, copies = distinct(every)
    edges = None

    def counted(bonds: DataFrame, saturated: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, component) of the representatives, (id, n_links) of all ids."""
        found = checkpointed(components(bonds))
        found = checkpointed(components(bonds.unionByName(outside(rows, saturated, found, threshold))))
        within = rows.select(F.col("id").alias("rep"), "w").join(_links_within(rows, found, threshold).withColumnRenamed("id", "rep"), "rep", "left")
        links = copies.join(within, "rep").select("id", (F.coalesce("n_links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
        return found, checkpointed(links)

    for attempt in range(attempts):
        size = k << attempt
        started = first_graph(rows, size, trees << attempt, seed + attempt)
        edges = started if edges is None else edges.unionByName(started)
        edges = refined(rows, edges, size, rounds).select("id", "other", "cos")
        near = edges.where(F.col("cos") >= threshold)
        bonds = near.select(F.col("id").alias("a"), F.col("other").alias("b"))
        found, links = counted(bonds, near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("id"))
        if audited(every, links, threshold, sample, seed) >= recall:
            break
    else:
        found, links = counted(bonds, rows.select("id"))
    known = copies.join(found, F.col("rep") == F.col("node"), "left").select(F.col("id").alias("node"), F.coalesce("component", "rep").alias("component")).join(links.withColumnRenamed("id", "node"), "node")
    out = vectors.select(F.col(id_col).alias("id")).join(known, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
