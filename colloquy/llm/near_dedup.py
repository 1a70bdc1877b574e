"""Near-duplicates by bottom-k sketches of word shingles.

1. Every text becomes the set of 64-bit hashes of its shingles; its sketch is the k least of them. Texts with equal sets
   are one class from here on, represented by the least id.
2. Inverted lists of the retained values generate overlaps. A list of up to SHORT members gives all its pairs, which are
   counted over lists; a pair whose count, with the values that may be in longer lists, is too small for a link goes. A
   longer list pairs its members with two of them, first and last in a random order: that finds large groups of copies.
3. The union sketch of a pair estimates its similarity; pairs far below the threshold go. Components of what is left
   are clusters.
4. A link between clusters can be hidden only where all values that two texts share are in long lists. Texts with as many
   values in long lists of several clusters as a link takes meet again in bands of minima over their full sets; texts of
   a band that are in different clusters are compared by their union sketches.
5. Inside a cluster exact Jaccard similarities of full sets decide. Clusters are cut into blocks of bounded size; each
   block meets itself and the first block. What is then still in several components of a large cluster meets by the
   rarest shingles of full sets: two texts that are linked share one of the rarest quarter of either.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, in_batches, without, written
from colloquy.llm.graph import components
from colloquy.llm.line_dedup import LAST
from colloquy.llm.token_counts import byte_lengths, portions

WORDS, KEPT = 5, 32
#: Pairs at the threshold that a filter may lose, and bands of minima.
LOST, BANDS = 5e-6, 48
#: Members of a list that gives all its pairs; orders in which longer ones choose pivots.
SHORT, ORDERS = 16, 4
#: Texts of a band that are compared at once; this bounds memory only.
BAND_BLOCK = 500
#: Shingles and texts in a block.
BLOCK_SHINGLES, BLOCK_TEXTS = 100_000, 250
#: Bytes whose shingles are computed at once; this bounds memory only.
AT_ONCE = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def shared_least(percent: int) -> int:
    """Retained values of a union sketch that must be shared, by the binomial: 12 of 32 at 75, fewer are for at most 5 pairs in a million."""
    p, below, s = percent / 100, 0.0, 0
    while s < KEPT and (below := below + comb(KEPT, s) * p**s * (1 - p) ** (KEPT - s)) <= LOST:
        s += 1
    return s


def band_rows(percent: int) -> int:
    """Minima in a band: 5 at 75, where two texts share none of 48 bands in 2 cases in a million."""
    return max([r for r in range(1, 6) if (1 - (percent / 100) ** r) ** BANDS <= LOST], default=1)


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P), np.full(n, _P_INV)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct 64-bit hashes of each text's shingles, computed over the bytes of all texts at once."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    data = (data + np.where((data >= 65) & (data <= 90), 32, 0)).astype(np.uint64) + np.uint64(1)
    up, down = _powers(1 << max(20, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], out=total[1:])
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    last = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    word = _mix((total[last] - total[first]) * down[first])
    bounds = np.searchsorted(first, np.r_[0, ends])
    out = []
    scale = [np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64)) for j in range(words)]
    runs = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        runs += word[j : j + len(runs)] * scale[j]
    runs = _mix(runs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:  # too short for a shingle: the whole sequence, marked by its length
            out.append(_mix(np.array([int(sum(int(w) * int(s) for w, s in zip(word[a:b], scale, strict=False)) + b - a) & (1 << 64) - 1], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray], rows: int) -> list[np.ndarray | None]:
    """For each set that is not empty its BANDS keys: minima of the set's hashes in so many further orders make one."""
    full = [s for s in sets if len(s)]
    if not full:
        return [None] * len(sets)
    scale = np.random.default_rng(0).integers(0, 1 << 63, (BANDS, rows), np.uint64) * np.uint64(2) + np.uint64(1)
    values, starts = np.concatenate(full), np.cumsum([0, *(len(s) for s in full[:-1])])
    keys = np.empty((len(full), BANDS), np.uint64)
    for k in range(BANDS):
        key = np.full(len(full), k, np.uint64)
        for f in scale[k]:
            key = _mix(key * _P + np.minimum.reduceat(values * f, starts))
        keys[:, k] = key
    left = iter(keys.view(np.int64))
    return [next(left) if len(s) else None for s in sets]


def _sketched(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(byte_lengths(b.column(2)), AT_ONCE):
                sets = shingle_sets(b.column(2)[part].to_pylist())
                low = [s[:KEPT] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part], b.column(1)[part], pa.array([len(s) for s in sets], pa.int64()), pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in low], pa.list_(pa.int64())), pa.array(band_keys(sets, rows), pa.list_(pa.int64()))],
                    ["doc", "version", "n", "print", "sketch", "bands"],
                )

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the full set to rows whose last column is the text."""
    for b in batches:
        texts = b.column(b.num_columns - 1)
        for part in portions(byte_lengths(texts), AT_ONCE):
            yield pa.RecordBatch.from_arrays([*(c[part] for c in b.columns[:-1]), pa.array([s.tobytes() for s in shingle_sets(texts[part].to_pylist())], pa.binary())], [*b.schema.names[:-1], "set"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, as products of 0/1 matrices over shingles that several sets have."""
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times >= 2
    column = np.cumsum(shared) - 1
    of, place = of[shared[place]], column[place[shared[place]]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [start, start + width])
        m = np.zeros((len(sets), width), np.float32)
        m[of[a:b], place[a:b] - start] = 1
        out += m @ m.T
    return np.rint(out).astype(np.int64)


def stars(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric 0/1 matrix the least row of its component."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(percent: int):
    """Rows sorted by (cluster, i, j, doc); gives (doc, least doc of its component) within each pair of blocks."""

    def links(rows: list[tuple[int, int, bytes]], i: int, j: int) -> list[tuple[int, int]]:
        docs = [r[0] for r in rows]
        side = np.array([r[1] for r in rows])
        sets = [np.frombuffer(r[2], np.uint64) for r in rows]
        n = np.array([len(s) for s in sets])
        both = intersections(sets)
        ok = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        if i != j:
            ok &= side[:, None] != side[None, :]
        return [(docs[k], docs[r]) for k, r in enumerate(stars(ok)) if docs[k] != docs[r]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []

        def ended() -> None:
            if len(rows) > 1:
                out.extend(links(rows, key[1], key[2]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["doc", "root"])

        for b in batches:
            for c, i, j, doc, block, content in (row for part in portions(byte_lengths(b.column(5)), 8 * AT_ONCE) for row in zip(*(x[part].to_pylist() for x in b.columns), strict=True)):
                if (c, i, j) != key:
                    ended()
                    key, rows = (c, i, j), []
                rows.append((doc, block, content))
            if len(out) > 10_000:
                yield batch()
                out.clear()
        ended()
        yield batch()

    return run


def _compared(rows: DataFrame, percent: int) -> DataFrame:
    """rows: cluster, i, j, doc, block, set; blocks i and j of a cluster are compared."""
    key = ["cluster", "i", "j"]
    return rows.select(*key, "doc", "block", "set").repartition(*key).sortWithinPartitions(*key, "doc").mapInArrow(_verified(percent), "doc long, root long")


def sketches_alike(left: list[np.ndarray], right: list[np.ndarray], shared: int) -> np.ndarray:
    """For each pair of ascending sketches, one of either side, whether so many of the 32 values of their union sketch, or
    that share of a smaller one, are shared."""
    sets, m = [*left, *right], len(left)
    n, both = np.array([len(s) for s in sets]), intersections(sets)[:m, m:]
    ok = both * KEPT >= shared * np.minimum(KEPT, n[:m, None] + n[None, m:] - both)
    # What passes has enough values in common anywhere; those of the union sketch decide.
    a, b = np.nonzero(ok)
    wide = np.full((len(sets), KEPT), np.iinfo(np.uint64).max)
    for row, s in zip(wide, sets, strict=True):
        row[: len(s)] = s
    for at in range(0, len(a), 10_000):
        x, y = a[at : at + 10_000], b[at : at + 10_000]
        union = np.sort(np.concatenate([wide[x], wide[m + y]], 1), 1)
        again = union[:, 1:] == union[:, :-1]
        rank = np.cumsum(np.concatenate([np.ones((len(x), 1), int), ~again], 1), 1)
        real = np.minimum(KEPT, n[x] + n[m + y] - both[x, y])
        hits = (again & (rank[:, 1:] <= real[:, None])).sum(1)
        ok[x, y] = hits * KEPT >= shared * real
    return ok


def _met(shared: int):
    """Rows sorted by (key, i, j, side): gives (a, b), links of sketches of different clusters in a band as stars."""

    def links(rows: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int]]:
        m = sum(1 - r[0] for r in rows)
        if not 0 < m < len(rows):
            return []
        cluster = np.array([r[2] for r in rows])
        sets = [np.array(r[3], np.int64).view(np.uint64) for r in rows]
        ok = np.zeros((len(rows), len(rows)), bool)
        ok[:m, m:] = sketches_alike(sets[:m], sets[m:], shared) & (cluster[:m, None] != cluster[None, m:])
        return [(rows[k][1], rows[r][1]) for k, r in enumerate(stars(ok | ok.T)) if rows[k][1] != rows[r][1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if out := links(rows):
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        for b in batches:
            for key, i, j, *row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (key, i, j) != now:
                    yield from ended()
                    now, rows = (key, i, j), []
                rows.append(tuple(row))
        yield from ended()

    return run


def _hidden(sketched: DataFrame, reps: DataFrame, long: DataFrame, clusters: DataFrame, shared: int) -> DataFrame | None:
    """(a, b): links between clusters that the pivots of long lists may not show; None if no text can have one.

    long has (doc, v) for the values in long lists. Two alike texts of different clusters share no value of a short list,
    whose pairs are all seen, so all their common values are in long lists of more than one cluster."""
    held = written(long.join(clusters.select(F.col("node").alias("doc"), "root"), "doc", "left").select("doc", "v", F.coalesce("root", "doc").alias("cluster")), "held")
    mixed = held.groupBy("v").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low != high").select("v")
    rest = held.join(mixed, "v").groupBy("doc", "cluster").agg(F.count(F.lit(1)).alias("n"))
    rest = written(rest.join(reps, "doc").where(F.col("n") * KEPT >= shared * F.size("sketch")).select("doc", "version", "cluster", "sketch"), "rest")
    discard(held)
    if rest.isEmpty():
        return None
    met = written(rest.join(sketched.select("doc", "version", "bands"), ["doc", "version"]).dropDuplicates(["doc"]).select("doc", "cluster", F.explode("bands").alias("key")), "bands")
    # Texts outside a band's largest cluster meet all of the band, so a large group of near copies is not compared with itself.
    keys = met.groupBy("key", "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("large"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")
    ways = lambda n: F.ceil(n / BAND_BLOCK).cast("int")
    member = written(met.join(keys, "key").select("key", "doc", F.col("cluster") != F.col("large"), ways(F.col("all") - F.col("most")), ways(F.col("all"))).toDF("key", "doc", "few", "lefts", "rights"), "band-members")
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tasks = member.where("few").select("key", block("lefts").alias("i"), each("rights").alias("j"), F.lit(0).alias("side"), "doc").union(member.select("key", each("lefts").alias("i"), block("rights"), F.lit(1), "doc"))
    tasks = tasks.join(rest.select("doc", "cluster", "sketch"), "doc").select("key", "i", "j", "side", "doc", "cluster", "sketch")
    return written(tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "doc").mapInArrow(_met(shared), "a long, b long").distinct(), "hidden")


def _blocks(shingles, texts):
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS), F.lit(1)).cast("int")


def near_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc, version, n, root) for each row of (doc, version, text): n is the size of its set, root the least doc that links
    lead to, itself included."""
    shared = shared_least(percent)
    sketched = written(in_batches(docs.select("doc", "version", "text")).mapInArrow(_sketched(band_rows(percent)), "doc long, version long, n long, print binary, sketch array<long>, bands array<long>"), "sketches")
    classes = sketched.where("n > 0").groupBy("print").agg(F.min(F.struct("doc", "version")).alias("rep"), F.min_by("sketch", F.struct("doc", "version")).alias("sketch"))
    reps = written(classes.select("print", "rep.doc", "rep.version", "sketch"), "classes")
    entries = reps.select("doc", F.explode("sketch").alias("v"), F.size("sketch").cast("short").alias("size"))
    listed = written(entries.join(entries.groupBy("v").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "v"), "lists")
    # A member's place in a long list is its id in one of ORDERS orders; first and last are the pivots. As lists of one
    # order choose alike, members of a large group have a few pivots and not two for each value.
    long, order = listed.where(F.col("members") > SHORT), F.xxhash64(F.pmod("v", F.lit(ORDERS)))
    ends = long.groupBy("v").agg(F.min(F.col("doc").bitwiseXOR(order)).alias("p"), F.max(F.col("doc").bitwiseXOR(order)).alias("q"))
    pivots = long.join(ends, "v").select("doc", F.explode(F.array(F.col("p").bitwiseXOR(order), F.col("q").bitwiseXOR(order))).alias("pivot")).where("doc != pivot")
    pairs = written(pivots.select(F.least("doc", "pivot").alias("a"), F.greatest("doc", "pivot").alias("b")).union(_overlapping(listed, shared)).distinct(), "pairs")
    # Only the upper halves of retained values travel with pairs.
    short = reps.select("doc", F.transform("sketch", lambda v: (F.shiftrightunsigned(v, 32) - F.lit(1 << 31)).cast("int")).alias("s"))
    pairs = pairs.join(short.withColumnsRenamed({"doc": "a", "s": "sa"}), "a").join(short.withColumnsRenamed({"doc": "b", "s": "sb"}), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, KEPT)
    alike = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) * KEPT >= shared * F.size(union)
    clusters = components(written(pairs.where(alike).select("a", "b"), "alike"))
    hidden = _hidden(sketched, reps, long.select("doc", "v"), clusters, shared)
    if hidden is not None:
        clusters = components(clusters.union(hidden))
    members = clusters.union(clusters.select("root", "root").distinct()).toDF("doc", "cluster")
    nodes = members.join(reps.select("print", "doc", "version"), "doc").join(sketched.select("print", "doc", "version", "n"), ["print", "doc", "version"]).distinct()
    sizes = nodes.groupBy("cluster").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("blocks"))
    nodes = written(nodes.join(sizes, "cluster").select("doc", "version", "cluster", "blocks", "n", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int").alias("block")), "members")
    # Sorted on both sides at every size: texts of members are too many to count on their being broadcast.
    text = docs.select("doc", "version", "text")
    sets = nodes.hint("merge").join(text, ["doc", "version"]).select("doc", "cluster", "blocks", "n", "block", "text").mapInArrow(_with_sets, "doc long, cluster long, blocks int, n long, block int, set binary")
    large = not nodes.where("blocks > 1").isEmpty()
    if large:
        sets = written(sets, "sets")
    own = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j")))
    hub = F.when((F.col("block") == 0) & (F.col("blocks") > 1), F.transform(F.sequence(F.lit(1), F.greatest(F.col("blocks") - 1, F.lit(1))), lambda k: F.struct(F.lit(0).alias("i"), k.alias("j")))).when(F.col("block") > 0, F.array(F.struct(F.lit(0).alias("i"), F.col("block").alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    tasks = sets.withColumn("task", F.explode(F.concat(own, hub))).select("cluster", "task.i", "task.j", "doc", "block", "set")
    found = components(written(_compared(tasks, percent), "links"))
    if large:
        rest = _rest(sets.where("blocks > 1"), found, percent)
        found = found if rest is None else components(found.union(rest))
    roots = reps.select("print", F.col("doc").alias("rep")).join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("print", F.coalesce("root", "rep").alias("root"))
    return sketched.join(roots, "print", "left").select("doc", "version", "n", F.coalesce("root", "doc").alias("root"))


def _overlapping(listed: DataFrame, shared: int) -> DataFrame:
    """(a, b): pairs that share enough retained values, those in short lists counted, those in long ones taken as shared."""
    some = listed.where(F.col("members") <= SHORT).groupBy("v").agg(F.collect_list(F.struct("doc", "size")).alias("docs"))
    some = some.select("docs", F.explode("docs").alias("a")).select("a", F.explode(F.filter("docs", lambda x: x["doc"] > F.col("a.doc"))).alias("b"))
    pairs = some.groupBy(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest("a.size", "b.size")).alias("size"))
    more = listed.where(F.col("members") > SHORT).groupBy("doc").agg(F.count(F.lit(1)).alias("more"))
    pairs = pairs.join(more.toDF("a", "more_a"), "a", "left").join(more.toDF("b", "more_b"), "b", "left")
    # The union sketch holds at least as many values as the larger sketch.
    most = F.col("n") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    return pairs.where(most * KEPT >= shared * F.col("size")).select("a", "b")


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose last column is a set, with the set as an array."""
    for b in batches:
        for part in portions(byte_lengths(b.column(b.num_columns - 1)), 4 * AT_ONCE):
            sets = [np.frombuffer(x, np.int64) for x in b.column(b.num_columns - 1)[part].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(c[part] for c in b.columns[:-1]), pa.array(sets, pa.list_(pa.int64()))], [*b.schema.names[:-1], "vs"])


def _linked(percent: int):
    """Rows of (a, b, set of a, set of b): gives (node, root) of those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["node", "root"])

    return run


def _rest(sets: DataFrame, found: DataFrame, percent: int) -> DataFrame | None:
    """(node, root): links between the components that are left in clusters of several blocks; None where one is left.

    Shingles that only one component has can't be shared by two; the others are put in order, rarest first. A link takes
    percent of a set at least, so two linked sets share one of the first ones that go beyond that: these alone are
    listed. Texts outside a cluster's largest component meet what shares such a shingle."""
    s = sets.join(found.withColumnsRenamed({"node": "doc", "root": "part"}), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    large = s.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("large"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    s = written(s.join(large, "cluster").select("doc", "cluster", "part", (F.col("part") != F.col("large")).alias("few"), "n", "set"), "rest-sets")
    if s.isEmpty():
        return None
    each = s.mapInArrow(_shingled, "doc long, cluster long, part long, few boolean, n long, vs array<long>").select("cluster", F.explode("vs").alias("v"), "doc", "part", "few", "n")
    mixed = each.groupBy("cluster", "v").agg(F.count(F.lit(1)).alias("members"), F.min("part").alias("low"), F.max("part").alias("high")).where("low != high").select("cluster", "v", "members")
    order = each.join(mixed, ["cluster", "v"]).groupBy("doc", "cluster", "part", "few", "n").agg(F.array_sort(F.collect_list(F.struct("members", "v"))).alias("vs"))
    own = F.col("n") - F.size("vs")  # places before the first shared shingle
    listed = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = order.select("doc", "cluster", "part", "few", "n", listed.cast("int").alias("listed"), own.cast("int").alias("own"), "vs").where("listed > own")
    first = first.select("doc", "cluster", "part", "few", "n", "own", F.posexplode(F.slice("vs", F.lit(1), F.col("listed") - F.col("own"))).alias("at", "x"))
    first = written(first.select("cluster", "x.v", "doc", "part", "few", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left")), "rest-lists")
    other = first.select("cluster", "v", *[F.col(c).alias(f"{c}_b") for c in ("doc", "part", "n", "left")])
    # A link takes so many common shingles; from the first common one on, each set must have as many left.
    least = F.ceil((F.col("n") + F.col("n_b")) * percent / (100 + percent))
    met = first.where("few").join(other, ["cluster", "v"]).where((F.col("part") != F.col("part_b")) & (F.least("left", "left_b") >= least))
    pairs = written(met.select(F.greatest("doc", "doc_b").alias("a"), F.least("doc", "doc_b").alias("b")).distinct(), "rest-pairs")
    discard(first)
    full = s.select("doc", "set")
    pairs = pairs.join(full.toDF("a", "set_a"), "a").join(full.toDF("b", "set_b"), "b").select("a", "b", "set_a", "set_b")
    return written(pairs.mapInArrow(_linked(percent), "node long, root long"), "links")


def near_dedup(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles, component_id and kept.

    Texts are linked if 100 * intersection >= percent * union of their shingle sets; a document is kept if no smaller id
    is in its component. Null and empty texts and such of white space have no shingles and no links. A null id counts as
    the largest one and comes out as null unless links lead to another. Rows that repeat an id are linked by their texts
    like others and get the smallest id reached. Ties cannot arise; an empty table gives an empty result. Columns of docs
    stay, but those that are added are replaced.
    """
    docs = without(docs, "n_shingles", "component_id", "kept")
    doc, version = F.coalesce(docs[id_col], F.lit(LAST)).cast("long"), F.xxhash64(docs[text_col])
    found = near_components(docs.select(doc.alias("doc"), version.alias("version"), F.col(text_col).alias("text")), percent)
    found = found.groupBy("doc", "version").agg(F.max("n").alias("n_shingles"), F.min("root").alias("root"))
    out = docs.select("*", doc.alias("__doc"), version.alias("__version")).join(found, (F.col("__doc") == F.col("doc")) & (F.col("__version") == F.col("version")))
    root = F.when(F.col("root") != LAST, F.col("root"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "n_shingles", root.alias("component_id"), (F.col("root") == F.col("__doc")).alias("kept"))
