"""N-gram Jaccard join: an exact join in the metric space of shingle sets.

Jaccard distance is a metric, but nearly all pairs of texts are at distance 1, so with whole texts as the first
pivots every text would be replicated to every region (README has the figures). The corpus is therefore split by
shingles first: rare ones come first in a common order, and a text that is linked with one of n shingles holds one
of its first n - ceil(t n) + 1, and two of its first n - ceil(t n) + 2. Regions with the same members are one, and
one of two texts counts only if they share a second region. Only texts of a region can be at a distance
below 1, and there the join goes on with texts as pivots: the pivot's cell is what lies within 1 - t of it, what lies
outside gets a pivot of its own, and cells are connected by their pivots. What is still apart is compared exactly,
but only with the boundary: by the triangle inequality a text at distance a from the pivot can't be linked with one
at a distance below a - (1 - t). Parity sketches, whose difference never exceeds that of the sets, go before
every comparison of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import hashing as H
from evidra.llm.common import checkpointed, components, groups, map_batches

ORDERED = 1 << 19  # this many shingles at most have their place in the order by frequency, 4 MB; the rest go by hash
REGION = 512  # texts compared in one piece; larger regions are dealt out in pieces
FLUSH = 1 << 21
SENT_WHOLE = 1_000_000  # a list of at most so many numbers, 8 MB, goes to every executor; a longer one is joined by a shuffle
_WIDEST = 1 << 16


def _sets(batch_texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    kind = H.byte_class("space")
    for r0, data, offsets in H.text_blocks(batch_texts):
        h, at, _ = H.words(data, offsets, kind)
        for r in range(len(at) - 1):
            s = H.shingles(h[at[r] : at[r + 1]], size)
            s.sort()
            yield r0 + r, s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def common_shingles(texts: DataFrame, size: int, most: int = ORDERED, least: int = 10) -> np.ndarray:
    """Shingles of at least ``least`` texts, rarest first; the ``most`` most frequent of them.

    All texts are counted. A task counts in runs of about FLUSH shingles and passes on what stands in three texts
    of a run; the sums place shingles in the order. Which order is used changes the cost of the join, never its
    result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flushed():
            s, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s[n >= 3].view(np.int64)), pa.array(n[n >= 3])], names=["s", "n"])

        for batch in batches:
            for _, s in _sets(batch.column(0), size):
                held.append(s)
                total += len(s)
                if total >= FLUSH:
                    yield flushed()
                    held, total = [], 0
        if held:
            yield flushed()

    counted = map_batches(texts.select("text"), count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    return got.column("s").to_numpy()[::-1].view(np.uint64)


def _described(texts: DataFrame, size: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """For each row: n, two set hashes, rare (how many of the first shingles are uncommon), its first shingles, its parity sketch of at least 2 n bits."""
    by_hash = np.argsort(common)
    known, place = common[by_hash], by_hash

    def first_of(s: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        if not len(known):
            return s[:k], k
        upto = min(len(s), 2 * k + 8)
        while True:
            at = np.minimum(np.searchsorted(known, s[:upto]), len(known) - 1)
            usual = known[at] == s[:upto]
            rare = s[:upto][~usual]
            if len(rare) >= k:
                return rare[:k], k
            if upto == len(s):
                return np.concatenate([rare, s[usual][np.argsort(place[at[usual]])][: k - len(rare)]]), len(rare)
            upto = min(len(s), 2 * upto)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, rare = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            first, sketch = [None] * batch.num_rows, [b""] * batch.num_rows
            for r, s in _sets(batch.column(1), size):
                n[r] = len(s)
                if not len(s):
                    continue
                k1[r] = np.bitwise_xor.reduce(H.mixed(s)).astype(np.int64)
                k2[r] = H.mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)
                first[r], rare[r] = first_of(s, min(len(s), len(s) - -(-num * len(s) // den) + 2))
                width = min(_WIDEST, max(64, 1 << (2 * len(s) - 1).bit_length()))
                sketch[r] = np.packbits((np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in first)])
            flat = np.concatenate([np.zeros(0, np.uint64), *(x for x in first if x is not None)]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n, k1, k2, rare)), lists, pa.array(sketch, pa.binary())], names=["id", "n", "k1", "k2", "rare", "first", "sketch"])

    return map_batches(texts.select("id", "text"), describe, "id long, n long, k1 long, k2 long, rare long, first array<long>, sketch binary")


def _near_pairs(group: np.ndarray, n: np.ndarray, sketch: list[bytes], num: int, den: int, allowed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, least difference) of ``allowed`` pairs in a group whose sizes and sketches are near enough for a link."""
    judge = _sketch_judge(n, sketch, num, den)
    active, d, held, total = np.arange(len(group) - 1), 1, [], 0
    while len(active):
        active = active[active + d < len(group)]
        active = active[group[active + d] == group[active]]
        i, j = active, active + d
        ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & allowed(i, j)
        held.append((i[ok], j[ok]))
        total += int(ok.sum())
        d += 1
        if total > 1 << 20:
            yield from judge(*map(np.concatenate, zip(*held, strict=True)))
            held, total = [], 0
    if held:
        yield from judge(*map(np.concatenate, zip(*held, strict=True)))


def _sketch_judge(n: np.ndarray, sketch: list[bytes], num: int, den: int, every: bool = False):
    """A function of index arrays i, j that yields (i, j, difference of the sketches) where a link is possible, or of ``every`` pair."""
    width = np.array([8 * len(x) for x in sketch])
    folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at_width(w: int) -> tuple[np.ndarray, np.ndarray]:
        if w not in folded:
            rows = np.flatnonzero((width >= w) & (width <= 8 * w))
            m = np.zeros((len(rows), w // 64), np.uint64)
            for k, r in enumerate(rows):
                m[k] = np.bitwise_xor.reduce(np.frombuffer(sketch[r], np.uint64).reshape(-1, w // 64))
            place = np.full(len(sketch), -1)
            place[rows] = np.arange(len(rows))
            folded[w] = m, place
        return folded[w]

    def judge(i: np.ndarray, j: np.ndarray):
        low = np.minimum(width[i], width[j])
        for w in np.unique(low).tolist():
            m, place = at_width(w)
            own = np.flatnonzero(low == w)
            step = max(1, (1 << 23) // w)
            for a in range(0, len(own), step):
                x, y = i[own[a : a + step]], j[own[a : a + step]]
                d = np.bitwise_count(m[place[x]] ^ m[place[y]]).sum(axis=1, dtype=np.int64)
                both = n[x] + n[y]
                good = np.ones(len(d), bool) if every else d <= both - 2 * -(-num * both // (num + den))
                yield x[good], y[good], d[good]

    return judge


def _folded(sketches: DataFrame, num: int, den: int) -> DataFrame:
    """``sketches`` with brief: the sketch folded to at least 4 times the difference at which texts of its size can still be linked, 128 bits at least.

    A folded sketch differs in no more places than the whole one, so it too never excludes a link; half of its
    bits differ for texts that have little in common, twice as many as a link allows.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brief = []
            for n, x in zip(batch.column(1).to_numpy().tolist(), batch.column(2).to_pylist(), strict=True):
                w = max(128, 1 << (-(-8 * n * (den - num) // (den + num)) - 1).bit_length())
                brief.append(np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, w // 64)).tobytes() if w < 8 * len(x) else x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(brief, pa.binary())], names=["r", "rn", "sketch", "brief"])

    return map_batches(sketches.select("r", "rn", "sketch"), fold, "r long, rn long, sketch binary, brief binary")


def _sent(numbers: DataFrame) -> DataFrame:
    """``numbers``, to be joined by broadcast if they are few."""
    return F.broadcast(numbers) if numbers.count() <= SENT_WHOLE else numbers


def members_of(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(s, rep, n, rare, p, pn): the texts of each region that have one of a fitting size there, and the region's pivot; one region of each set of members.

    Counts by size and sums of members' hashes are partial sums; no region is gathered in one place.
    """
    entries = classes.where("rep is not null").select("rep", F.col("n").cast("int").alias("n"), F.col("rare").cast("int").alias("rare"), F.explode("first").alias("s"))
    entries = entries.join(entries.groupBy("s").agg(F.count("*").alias("c")).where("c > 1").select("s"), "s", "left_semi")
    entries = entries.withColumn("b", F.floor(F.log(F.col("n").cast("double")) / (1.0001 * float(np.log(den / num)))).cast("int"))
    sizes = entries.groupBy("s", "b").agg(F.count("*").alias("c")).groupBy("s").agg(F.collect_list(F.struct("b", "c")).alias("sizes"))
    fits = F.exists("sizes", lambda x: (F.abs(x["b"] - F.col("b")) <= 1) & ((x["b"] != F.col("b")) | (x["c"] > 1)))
    members = entries.join(sizes, "s").where(fits).select("s", "rep", F.col("n").cast("long").alias("n"), "rare")
    hashed = F.xxhash64("rep", "n")
    known = members.groupBy("s").agg(F.count("*").alias("m"), F.bit_xor(hashed).alias("x"), F.bit_xor(F.xxhash64(hashed, F.lit(1))).alias("y"), F.min(F.struct("rare", "rep", "n")).alias("pivot"))
    regions = known.groupBy("m", "x", "y").agg(F.min(F.struct("s", "pivot")).alias("r"), F.count("*").alias("same")).where("m > 2 or same > 1").select("r.s", F.col("r.pivot.rep").alias("p"), F.col("r.pivot.n").alias("pn"))
    return checkpointed(members.join(regions, "s"))


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """(id, n_shingles, component) for every row: texts link when ``den`` * common >= ``num`` * all of their shingles.

    Words are runs of all but ``[\\x20\\x09-\\x0D]``, A-Z lowered; a text's set has its runs of ``size`` words, or
    the whole sequence if it has fewer. Shingles are known by 64-bit hashes. A text without words (null, empty,
    blank) has an empty set, links with nothing and is its own component. ``component`` is the smallest id that
    links reach. Ids are longs; rows that share an id count as one document. Texts with equal sets form one
    class, which is joined once. Links inside a component that others connect are not all compared. An empty
    table gives no rows; other columns are left out.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common = common_shingles(texts, size)
    base = checkpointed(_described(texts, size, num, den, common).withColumn("place", F.monotonically_increasing_id()))
    # Of texts with equal sets the first by id stands for all.
    least = F.min(F.struct(F.col("id").isNull(), "id", "place"))
    reps = checkpointed(base.where("n > 0").groupBy("n", "k1", "k2").agg(least.alias("r")).select("n", "k1", "k2", F.col("r.id").alias("rep"), "r.place"))
    classes = base.join(_sent(reps.select("place")), "place", "left_semi").withColumnRenamed("id", "rep")
    members = members_of(classes, num, den)
    wanted = _sent(checkpointed(members.select(F.col("rep").alias("id")).distinct()))
    sketches = checkpointed(_folded(classes.withColumnRenamed("rep", "id").join(wanted, "id", "left_semi").select(F.col("id").alias("r"), F.col("n").alias("rn"), "sketch"), num, den))
    reach = 1 - num / den

    def with_sketch(df: DataFrame, rep: str, n: str, out: str, which: str = "sketch") -> DataFrame:
        return df.join(sketches.select("r", "rn", F.col(which).alias(out)), (F.col(rep) == F.col("r")) & (F.col(n) == F.col("rn"))).drop("r", "rn")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            n = np.concatenate([batch.column(1).to_numpy(), batch.column(3).to_numpy()])
            judge = _sketch_judge(n, batch.column(4).to_pylist() + batch.column(5).to_pylist(), num, den, every=True)
            differ = np.zeros(k, np.int64)
            for i, _, d in judge(np.arange(k), np.arange(k) + k):
                differ[i] = d
            both = n[:k] + n[k:]
            near = differ <= both - 2 * -(-num * both // (num + den))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(2 * differ / (both + differ)), pa.array(near)], names=["a", "b", "far", "near"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, ok = np.ones(batch.num_rows), np.zeros(batch.num_rows, bool)
            for (r, x), (_, y) in zip(_sets(batch.column(2), size), _sets(batch.column(3), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[r] = len(x) > 0 and both * (num + den) >= num * (len(x) + len(y))
                far[r] = 1 - both / max(1, len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far), pa.array(ok)], names=["a", "b", "far", "linked"])

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b, far, linked): exact distances of pairs of texts; only these texts are read on."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        written = texts.join(F.broadcast(ids) if 2 * pairs.count() <= SENT_WHOLE else ids, "id", "left_semi")
        pairs = pairs.join(written.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(written.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        return map_batches(pairs.select("a", "b", "x", "y"), compare, "a long, b long, far double, linked boolean")

    def star(around: DataFrame) -> DataFrame:
        """(a, pivot, far, known, linked) of the texts around the pivots: the distance if ``known``, else a lower bound of it."""
        pairs = around.where("rep <> p and :d * least(n, pn) >= :n * greatest(n, pn)".replace(":d", str(den)).replace(":n", str(num))).select("rep", "n", "p", "pn").distinct()
        if pairs.count() <= SENT_WHOLE // 4:
            # Few pairs go to the sketches, which then need no shuffle.
            x, y = with_sketch(F.broadcast(pairs), "rep", "n", "x"), with_sketch(F.broadcast(pairs), "p", "pn", "y")
            pairs = x.join(y, ["rep", "n", "p", "pn"]).select("rep", "n", "p", "pn", "x", "y")
        else:
            pairs = with_sketch(with_sketch(pairs, "rep", "n", "x"), "p", "pn", "y").select("rep", "n", "p", "pn", "x", "y")
        measured = checkpointed(map_batches(pairs, measure, "a long, b long, far double, near boolean"))
        done = verified(measured.where("near").select("a", "b")).withColumn("known", F.lit(True))
        done = done.unionByName(measured.where("not near").select("a", "b", "far", F.lit(False).alias("linked"), F.lit(False).alias("known")))
        # Rows that share an id can have several distances; then only 0 is known to be a lower bound.
        once = F.count("*") == 1
        done = done.groupBy("a", F.col("b").alias("pivot")).agg(F.when(once, F.min("far")).otherwise(0.0).alias("far"), (once & F.min("known")).alias("known"), F.max("linked").alias("linked"))
        return checkpointed(done)

    def with_star(around: DataFrame, stars: DataFrame) -> DataFrame:
        return around.join(stars, (F.col("rep") == F.col("a")) & (F.col("p") == F.col("pivot")), "left").drop("a", "pivot")

    def links_of(stars: DataFrame) -> DataFrame:
        return stars.where("linked").select("a", F.col("pivot").alias("b"))

    # The first pivots; what lies outside their cells gets a second one. Regions of two or with nothing outside are done.
    first = star(members)
    own = F.col("rep") == F.col("p")
    placed = checkpointed(with_star(members, first).select("s", "rep", "n", "rare", "p", F.when(own, F.lit(0.0)).otherwise(F.col("far")).alias("far"), F.coalesce("known", own).alias("known"), F.coalesce("linked", own).alias("inside")))
    found_outside = F.when(~F.col("inside"), F.struct("rare", "rep", "n"))
    left = checkpointed(placed.groupBy("s").agg(F.count("*").alias("m"), F.count_if(~F.col("inside")).alias("k"), F.min(found_outside).alias("pivot")).where("k > 0 and m > 2"))
    placed = placed.join(left.select("s"), "s", "left_semi")
    outside = placed.where("not inside").select("s", "rep", "n", "rare")
    seconds = left.where("k > 1").select("s", F.col("pivot.rep").alias("p"), F.col("pivot.n").alias("pn"))
    links = links_of(first).unionByName(links_of(star(outside.join(seconds, "s")))).distinct()
    found = components(links)

    def apart(placed: DataFrame, found: DataFrame) -> DataFrame:
        """(s, o, q, role, rep, n, component, far, known): what is outside the pivot's component (role 0) against all of the boundary (role 1), in pieces; both at once (role 2) in a region of one piece."""
        found = _sent(found)
        named = placed.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        named = named.join(found.withColumnsRenamed({"node": "p", "component": "main"}), "p", "left")
        named = checkpointed(named.withColumn("out", F.col("component") != F.coalesce("main", "p")).drop("main"))
        sized = named.groupBy("s").agg(F.count_if("out").alias("k"), F.count("*").alias("all"), F.min(F.when(F.col("out"), F.coalesce("far", F.lit(0.0)))).alias("nearest")).where("k > 0")
        split = lambda c: F.greatest(F.ceil(F.col(c) / REGION), F.lit(1)).cast("int")
        named = named.join(sized.select("s", split("k").alias("outs"), split("all").alias("alls"), "nearest"), "s")
        # The boundary: known distances from the pivot below nearest - (1 - t) exclude a link with anything outside.
        named = named.where(F.col("out") | ~F.col("known") | (F.col("far") >= F.col("nearest") - reach - 1e-9))
        piece = lambda c: F.pmod(F.xxhash64("rep"), F.col(c)).cast("int")
        to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        kept = ["rep", "n", "out", "component", F.coalesce("far", F.lit(float("nan"))).alias("far"), "known"]
        whole = named.where("alls = 1").select("s", F.lit(0).alias("o"), F.lit(0).alias("q"), F.lit(2).alias("role"), *kept)
        named = named.where("alls > 1")
        one = named.where("out").select("s", piece("outs").alias("o"), to("alls").alias("q"), F.lit(0).alias("role"), *kept)
        return whole.unionByName(one).unionByName(named.select("s", to("outs").alias("o"), piece("alls").alias("q"), F.lit(1).alias("role"), *kept))

    def candidates(placed: DataFrame, found: DataFrame, nearest: bool) -> DataFrame:
        """(s, a, b): pairs that are not connected yet and may be linked; for two components in a piece only the nearest, if so asked."""

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, group in groups(batches, 3):
                role, rep, n, own, far = (t.column(c).to_numpy() for c in ("role", "rep", "n", "component", "far"))
                out, known = (t.column(c).to_numpy(zero_copy_only=False) for c in ("out", "known"))

                def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                    x, y = np.where(role[i] == 0, i, j), np.where(role[i] == 0, j, i)
                    ok = (own[i] != own[j]) & np.where(role[i] == 2, out[i] | out[j], (role[i] != role[j]) & (~out[y] | (rep[x] < rep[y])))
                    return ok & ~((far[i] - far[j] > reach + 1e-9) & known[j]) & ~((far[j] - far[i] > reach + 1e-9) & known[i])

                for i, j, d in _near_pairs(group, n, t.column("sketch").to_pylist(), num, den, allowed):
                    if nearest and len(i):
                        u, v = np.minimum(own[i], own[j]), np.maximum(own[i], own[j])
                        order = np.lexsort((d, v, u, group[i]))
                        u, v, g = u[order], v[order], group[i][order]
                        keep = order[np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (g[1:] != g[:-1])])]
                        i, j = i[keep], j[keep]
                    if len(i):
                        yield pa.RecordBatch.from_arrays([t.column("s").take(pa.array(i)).combine_chunks(), pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j]))], names=["s", "a", "b"])

        keys = ["s", "o", "q"]
        dealt = with_sketch(apart(placed, found), "rep", "n", "sketch", "brief").select(*keys, "role", "rep", "n", "out", "component", "far", "known", "sketch")
        return map_batches(dealt.repartition(*keys).sortWithinPartitions(*keys), emit, "s long, a long, b long")

    for nearest in (True, False):
        tried = checkpointed(candidates(placed, found, nearest))
        done = checkpointed(verified(tried.select("a", "b").distinct()).groupBy("a", "b").agg(F.max("linked").alias("linked")))
        if not (more := done.where("linked").select("a", "b")).isEmpty():
            links = links.unionByName(more)
            found = components(links)
        # Only where the nearest two weren't linked can others of their components be.
        placed = placed.join(tried.join(done.where("not linked"), ["a", "b"]).select("s").distinct(), "s", "left_semi")
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("n", "k1", "k2", F.coalesce("component", "rep").alias("component"))
    return base.select("id", "n", "k1", "k2").join(named, ["n", "k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
