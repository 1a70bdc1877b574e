"""Near-duplicates of embeddings by iterative quantisation and multi-index Hamming tables.

1. Rotations learned on a bounded sample turn each vector into a binary code whose bits keep angles.
2. Vectors so close to a leader that they must be linked among each other (half the angle of a link) form a class with it.
   A class's own links need no enumeration, however many copies it has.
3. Hamming tables: the code is cut into substrings; vectors meet where a substring differs by at most one bit. A table
   holds each class once in a bucket, so a bucket full of copies is one entry.
4. Pairs of classes that meet, and whose leaders' codes are near enough, are reranked: the original vectors of both are
   compared in blocks, and only cosines in double precision make links.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import in_batches, written
from colloquy.llm.graph import components

BLOCK = 1000
log = logging.getLogger(__name__)


def table_recall(cosine: float, bits: int, tables: int) -> float:
    """The share of pairs at that cosine that meet in some table, if bits differ independently."""
    p = np.arccos(cosine) / np.pi
    return 1 - (1 - (1 - p) ** bits - bits * p * (1 - p) ** (bits - 1)) ** tables


def table_sizes(n: int, cosine: float, recall: float = 0.95) -> tuple[int, int]:
    """Bits of a table's substring and number of tables for n vectors: as many buckets as vectors, so that a bucket holds a
    few whatever n is, and as many tables as that share of pairs at the threshold takes. A code is all substrings."""
    bits = min(30, max(8, int(np.ceil(np.log2(max(n, 2))))))
    tables = 1
    while table_recall(cosine, bits, tables) < recall:
        tables += 1
    return bits, tables


@dataclass
class Quantiser:
    """Codes are the signs of the unit vector in learned rotations. Rotations are learned on centred vectors, but what is
    coded is not centred: bits must differ by the angle that the cosine of a link gives, and centring widens it."""

    mean: np.ndarray  # of the sample
    axes: np.ndarray  # dimension x bits of a code
    bits: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """(n, tables) substrings as int32."""
        bits = unit @ self.axes >= 0
        return (bits.reshape(len(unit), -1, self.bits) << np.arange(self.bits)).sum(2).astype(np.int32)


def fit_quantiser(unit: np.ndarray, bits: int, tables: int, rounds: int = 30, seed: int = 0) -> Quantiser:
    """Iterative quantisation: principal axes, then in turn the nearest binary codes and, by a singular value
    decomposition, the rotation that fits them best. Each rotation starts at random; fewer dimensions than bits of a
    rotation are used again by further rotations."""
    dim, rng = unit.shape[1], np.random.default_rng(seed)
    mean = unit.mean(0) if len(unit) else np.zeros(dim)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred) if len(unit) else (None, np.eye(dim))
    axes = axes[:, ::-1]
    parts, have = [], 0
    while have < bits * tables:
        take = min(dim, bits * tables - have)
        base = centred @ axes[:, :take]
        turn = np.linalg.qr(rng.normal(size=(take, take)))[0]
        for _ in range(rounds if len(unit) else 0):
            left, _, right = np.linalg.svd(np.where(base @ turn >= 0, 1.0, -1.0).T @ base)
            turn = (left @ right).T
        parts.append(axes[:, :take] @ turn)
        have += take
    return Quantiser(mean, np.concatenate(parts, 1), bits)


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that can be compared, as unit vectors in double precision, and their places."""
    ok = [i for i, x in enumerate(column) if x.is_valid and len(x.values) == dim and not x.values.null_count] if column.null_count or len(column.flatten()) != dim * len(column) or column.flatten().null_count else range(len(column))
    at = np.fromiter(ok, np.int64)
    flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    with np.errstate(all="ignore"):
        scale = np.abs(flat).max(1, initial=0)
        good = np.isfinite(flat).all(1) & (scale > 0)
        flat = flat[good] / scale[good][:, None]
    return flat / np.sqrt((flat * flat).sum(1))[:, None], at[good]


def _blob(unit: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in unit], pa.binary())


def _vectors(blobs: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), dim)


def _apart(x, y):
    """Bits in which two arrays of substrings differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)


def embedding_dedup(vectors: DataFrame, cosine: float = 0.9, sample: int = 10_000, seed: int = 0, recall: float = 0.95, bits: int | None = None, tables: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) for every id of vectors, all compared by cosine in double precision.

    Vectors that are null, zero, of another length than most of the sample, or hold null or non-finite components
    link with nothing. Rows that repeat an id are one vector: the least of its arrays. Rows without id are left as they
    are, without links. An empty table gives an empty result, other columns are not read. The quantiser alone is fitted
    on at most `sample` vectors, the first in a seeded order of hashes; all vectors are indexed. Bits and tables go with
    the number of vectors and the recall wanted at the threshold, see table_sizes(), unless both are given.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    known = raw.where("id is not null").groupBy("id").agg(F.min("v").alias("v"))
    known = written(known, "vectors")
    if not (bits and tables):
        bits, tables = table_sizes(known.count(), cosine, recall)
        log.info("%d tables of %d bits", tables, bits)
    picked = known.where("v is not null").select("id", "v").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample).toArrow().column("v").combine_chunks()
    lengths = np.array([len(x) for x in picked], int)
    dim = int(np.bincount(lengths[lengths > 0]).argmax()) if (lengths > 0).any() else 1
    model = known.sparkSession.sparkContext.broadcast(fit_quantiser(unit_rows(picked, dim)[0], bits, tables, seed=seed))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, at = unit_rows(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(model.value.codes(unit)), pa.list_(pa.int32())), _blob(unit)], ["id", "code", "unit"])

    codes = written(in_batches(known).mapInArrow(coded, "id long, code array<int>, unit binary"), "codes")
    angle = np.arccos(cosine)
    classes = written(_classes(codes, dim, np.cos(angle / 2) + 1e-9, _near_bits(angle / 2, bits * tables)), "classes")
    size = classes.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    pairs = written(_meeting(codes.select("id", "code"), classes, size, angle, bits, bits * tables), "pairs")
    linked, edges = _rerank(codes.select("id", "unit"), classes, size, pairs, dim, cosine)
    found = components(edges)
    out = classes.join(size, "leader").join(linked, "id", "left").join(found.select(F.col("node").alias("leader"), "root"), "leader", "left")
    out = out.select("id", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "leader").alias("component_id"))
    out = known.select("id").join(out, "id", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    lost = raw.where("id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.union(lost).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def _near_bits(angle: float, n: int, sigmas: float = 4.0) -> int:
    """Of n bits those in which codes at that angle differ at most, but for one in 30,000: a binomial's mean and 4 deviations."""
    p = angle / np.pi
    return int(np.ceil(n * p + sigmas * np.sqrt(n * p * (1 - p))))


def _substrings(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("*", F.posexplode("code").alias("t", "s")).select("t", "s", *more)


def _classes(codes: DataFrame, dim: int, cosine: float, near: int) -> DataFrame:
    """(id, leader): the least id among the leaders of its buckets that is near enough and is led by none itself."""
    first = _substrings(codes, "id", "code").groupBy("t", "s").agg(F.min(F.struct("id", "code")).alias("first"), F.max("id").alias("last")).where("first.id != last")
    met = _substrings(codes, "id", "code").join(first, ["t", "s"]).where(F.col("id") != F.col("first.id"))
    met = met.where(_apart(F.col("code"), F.col("first.code")) <= near).select("id", F.col("first.id").alias("leader")).distinct()
    both = met.join(codes.select("id", "unit"), "id").join(codes.select(F.col("id").alias("leader"), F.col("unit").alias("other")), "leader").select("id", "leader", "unit", "other")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cos = (_vectors(b.column(2).to_pylist(), dim) * _vectors(b.column(3).to_pylist(), dim)).sum(1)
            yield b.select(["id", "leader"]).filter(pa.array(cos >= cosine))

    led = written(both.mapInArrow(close, "id long, leader long"), "led").groupBy("id").agg(F.min("leader").alias("leader"))
    led = written(led, "leaders")
    led = led.join(led.select(F.col("id").alias("leader")), "leader", "left_anti")
    return codes.select("id").join(led, "id", "left").select("id", F.coalesce("leader", "id").alias("leader"))


def _meeting(codes: DataFrame, classes: DataFrame, size: DataFrame, angle: float, bits: int, n: int) -> DataFrame:
    """(a, b) with a < b: classes that meet in a table within one bit, whose leaders' codes allow for a link."""
    lead = classes.select("leader").distinct().join(codes.withColumnsRenamed({"id": "leader", "code": "top"}), "leader").join(size, "leader").select("leader", "top", (F.col("size") > 1).cast("int").alias("many"))
    rows = classes.join(lead, "leader").join(codes, "id")
    entries = written(_substrings(rows, "leader", "top", "many").dropDuplicates(["t", "s", "leader"]), "tables")
    # Of two substrings that differ in one bit, one has a 0 there: setting each 0 bit of one side finds them once.
    flips = F.filter(F.transform(F.array(*[F.lit(0), *(F.lit(1 << k) for k in range(bits))]), lambda m: F.col("s").bitwiseOR(m)), lambda x: x != F.col("s"))
    probes = entries.select("t", "leader", "top", "many", F.explode(F.concat(F.array("s"), flips)).alias("s"))
    there = entries.select("t", "s", F.col("leader").alias("other"), F.col("top").alias("code"), F.col("many").alias("much"))
    met = probes.join(there, ["t", "s"]).where("leader != other")
    limit = F.element_at(F.array(*[F.lit(_near_bits(angle * k, n)) for k in (1, 1.5, 2)]), F.col("many") + F.col("much") + 1)
    return met.where(_apart(F.col("top"), F.col("code")) <= limit).select(F.least("leader", "other").alias("a"), F.greatest("leader", "other").alias("b")).distinct()


def _rerank(units: DataFrame, classes: DataFrame, size: DataFrame, pairs: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, n): links of a vector to other classes; (a, b): classes with a link between them."""
    ways = size.select("leader", F.ceil(F.col("size") / BLOCK).cast("int").alias("ways"))
    member = classes.join(ways, "leader").join(units, "id").select("leader", "id", "unit", F.pmod(F.xxhash64("id"), F.col("ways")).cast("int").alias("block"))
    todo = pairs.join(ways.toDF("a", "na"), "a").join(ways.toDF("b", "nb"), "b")
    todo = todo.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("i"), "nb").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"))
    key = ["a", "b", "i", "j"]
    uses = todo.select(*key, F.col("a").alias("leader"), F.col("i").alias("block"), F.lit(0).alias("side")).union(todo.select(*key, F.col("b"), F.col("j"), F.lit(1)))
    rows = uses.join(member, ["leader", "block"]).select(*key, "side", "id", "unit").repartition(*key).sortWithinPartitions(*key, "side")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, [], []

        def ended() -> Iterator[pa.RecordBatch]:
            if left and right:
                ok = _vectors([u for _, u in left], dim) @ _vectors([u for _, u in right], dim).T >= cosine
                n = [*zip((i for i, _ in left), ok.sum(1).tolist(), strict=True), *zip((i for i, _ in right), ok.sum(0).tolist(), strict=True)]
                n = [x for x in n if x[1]]
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(n), pa.int64()), pa.array([now[1]] * len(n), pa.int64()), pa.array([i for i, _ in n], pa.int64()), pa.array([k for _, k in n], pa.int64())], ["a", "b", "id", "n"])

        for b in batches:
            for a, c, i, j, side, vec, unit in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (a, c, i, j) != now:
                    yield from ended()
                    now, left, right = (a, c, i, j), [], []
                (right if side else left).append((vec, unit))
        yield from ended()

    found = written(rows.mapInArrow(linked, "a long, b long, id long, n long"), "links")
    return found.groupBy("id").agg(F.sum("n").alias("n")), found.select("a", "b").distinct()
