"""The k most similar vectors of every vector.

Method: cross-polytope hashing. A unit vector is turned by fast pseudo-rotations (three rounds of random signs and a
Hadamard transform) and hashed to the signed axis nearest to it; a few such digits make the code of one table. Every
vector also enters, per table, the bucket of its most likely second choice (multiprobe). The vectors that meet in a
bucket are candidates of each other and are ranked by their exact cosine distance.

At scale: rows are range-partitioned by (table, code, finer digits), so that a bucket that holds a third of all rows is cut by its finer digits
into ranges of ordinary size instead of landing in one task; rows that all digits leave together, as a tight cluster's, are ordered by their place on a random line. Within a range all vectors of a bucket are compared block
by block, without a cap on candidates; only the best k of each leave the task, never pairs. Equal vectors are one class
before hashing and are put back from the first k + 1 members of each class.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CODED = "code binary, vec binary"
#: a candidate is packed as its distance (big-endian double, which sorts as bytes since it isn't negative) and its class
_BEST = "cls binary, best binary"
_RECORD = np.dtype([("distance", ">f8"), ("cls", "S16")])


def _class(vec: bytes) -> bytes:
    return hashlib.md5(vec, usedforsecurity=False).digest()


def _unit_rows(dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows = flat.reshape(-1, dim)  # only lists of dim entries come here
            with np.errstate(all="ignore"):
                largest = np.abs(rows).max(axis=1, initial=0)
                good = np.isfinite(rows).all(axis=1) & (largest > 0)
                rows, ids = rows[good] / largest[good, None], batch.column("point_id").filter(pa.array(good))
                unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True) + 0.0).astype(np.float32)  # + 0.0: no -0.0
            packed = [u.tobytes() for u in unit]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.string()), pa.array([_class(p) for p in packed], pa.binary()), pa.array(packed, pa.binary())],
                names=["point_id", "cls", "vec"],
            )

    return run


def unit_points(points: DataFrame, dim: int) -> DataFrame:
    """``(point_id, cls, vec)`` of the usable vectors: ``dim`` entries, all present and finite, not all zero.

    ``vec`` is the unit vector (float32), ``cls`` identifies it, so vectors that differ only in length share a class.
    """
    whole = points.where(F.col("point_id").isNotNull() & (F.size("vector") == dim) & ~F.exists("vector", lambda x: x.isNull()))
    return whole.select("point_id", "vector").mapInArrow(_unit_rows(dim), "point_id string, cls binary, vec binary")


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows, length a power of two, in n log n steps."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x * np.float32(n**-0.5)


class CrossPolytope:
    """A family of cross-polytope tables.

    ``digits`` signed-axis digits identify a bucket, the last one of ``last_dims`` dimensions only, which makes the number of buckets
    ``(2 d) ** (digits - 1) * 2 * last_dims``; ``finer`` further digits order the rows inside it.
    """

    def __init__(self, dim: int, tables: int, buckets: int, probes: int, finer: int = 2, seed: int = 20):
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.tables, self.probes, self.finer, self.dim = tables, probes, finer, dim
        per = 2 * self.width
        self.digits = max(1, math.ceil(math.log(max(2, buckets)) / math.log(per) - 1e-9))
        self.last_dims = min(self.width, max(1, math.ceil(buckets / per ** (self.digits - 1) / 2)))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1, 1], np.float32), (tables, self.digits + finer, 3, self.width))
        self.digit = ">u1" if per <= 256 else ">u2"
        self.lines = rng.normal(size=(tables, dim)).astype(np.float32)

    def place(self, t: int, x: np.ndarray) -> np.ndarray:
        """Where each row lies on the table's random line, as bytes in that order: it orders rows that all digits leave together, however close they are."""
        bits = (x @ self.lines[t]).astype(np.float32).view(np.uint32)
        return np.where(bits >> 31, ~bits, bits | np.uint32(1 << 31)).astype(">u4")

    def codes(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each table and probe, the code bytes of each row: the bucket's digits and then the finer ones."""
        padded = np.zeros((len(x), self.width), np.float32)
        padded[:, : self.dim] = x
        for t in range(self.tables):
            first, second, margin = [], [], []
            for k in range(self.digits + self.finer):
                y = padded
                for s in self.signs[t, k]:
                    y = hadamard(y * s)
                if k == self.digits - 1:
                    y = y[:, : self.last_dims]
                size = np.abs(y)
                best = size.argmax(axis=1)
                rows = np.arange(len(x))
                top = size[rows, best]
                first.append(best * 2 + (y[rows, best] < 0))
                if k < self.digits:
                    size[rows, best] = -1
                    other = size.argmax(axis=1) if size.shape[1] > 1 else best
                    # the opposite sign of the same axis is never second: another axis is always nearer
                    second.append(other * 2 + (y[rows, other] < 0))
                    margin.append(top - size[rows, other])
            code = np.stack(first, axis=1).astype(self.digit)
            yield t, code
            order = np.argsort(np.stack(margin, axis=1), axis=1, kind="stable")
            for p in range(min(self.probes, self.digits)):
                probe, at = code.copy(), order[:, p]
                probe[np.arange(len(x)), at] = np.stack(second, axis=1)[np.arange(len(x)), at]
                yield t, probe


def _hash(family: CrossPolytope):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.float32).reshape(-1, family.dim)
            for t, code in family.codes(x):
                prefix, last = t.to_bytes(2, "big"), family.place(t, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([prefix + c.tobytes() + p.tobytes() for c, p in zip(code, last)], pa.binary()), batch.column("vec")], names=["code", "vec"]
                )

    return run


def _rerank(dim: int, k: int, prefix: int, block: int = 1024):
    """Within one range: the exact best k of every row among the rows of its bucket, in blocks of bounded memory."""

    def bucket(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = min(k, len(x) - 1)
        near, far = [], []
        for lo in range(0, len(x), block):
            q = x[lo : lo + block]
            best = np.full((len(q), 0), 0, np.int64)
            score = np.full((len(q), 0), 0, np.float32)
            for at in range(0, len(x), block * 8):
                s = q @ x[at : at + block * 8].T
                same = np.arange(lo, lo + len(q)) - at
                inside = (same >= 0) & (same < s.shape[1])
                s[np.flatnonzero(inside), same[inside]] = -np.inf
                index = np.broadcast_to(np.arange(at, at + s.shape[1]), s.shape)
                score, best = np.concatenate((score, s), axis=1), np.concatenate((best, index), axis=1)
                # some more than k are kept here, as float32 may order near ties otherwise than float64 below
                if score.shape[1] > k + 4:
                    top = np.argpartition(-score, k + 3, axis=1)[:, : k + 4]
                    score, best = np.take_along_axis(score, top, 1), np.take_along_axis(best, top, 1)
            a = x[lo : lo + block].astype(np.float64)
            dist = 1.0 - np.einsum("ij,ikj->ik", a, x[best].astype(np.float64))
            dist[score == -np.inf] = np.inf
            order = np.lexsort((ids[best], dist), axis=1)[:, :keep]
            near.append(np.take_along_axis(best, order, 1))
            far.append(np.take_along_axis(dist, order, 1))
        return np.concatenate(near), np.concatenate(far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, vec = [], []
        for batch in batches:
            code += batch.column("code").to_pylist()
            vec += batch.column("vec").to_pylist()
        if not code:
            return
        x = np.frombuffer(b"".join(vec), np.float32).reshape(-1, dim)
        full = np.array([_class(v) for v in vec] + [None], dtype=object)[:-1]
        ids = full.astype("S16")
        code = np.array([c[:prefix] for c in code], dtype=f"V{prefix}")
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        rows: list[bytes] = []
        packed: list[bytes] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(packed, pa.binary())], names=["cls", "best"])

        for lo, hi in zip(starts, [*starts[1:], len(x)]):
            _, once = np.unique(ids[lo:hi], return_index=True)  # a class may enter a bucket only once
            at = lo + np.sort(once)
            if len(at) < 2:
                continue
            near, far = bucket(x[at], ids[at])
            records = np.empty(near.shape, _RECORD)
            records["distance"], records["cls"] = np.maximum(far, 0.0), ids[at][near]
            rows += full[at].tolist()
            packed += [r.tobytes() for r in records]
            if len(rows) >= 10_000:
                yield flush()
                rows, packed = [], []
        if rows:
            yield flush()

    return run


def _records(packed: Column) -> Column:
    size = _RECORD.itemsize
    return F.transform(F.sequence(F.lit(0), (F.octet_length(packed) / size - 1).cast("int")), lambda i: F.substring(packed, (i * size + 1).cast("int"), F.lit(size)))


def _distance(packed: Column) -> Column:
    """The double that a big-endian one's bytes stand for; 0 for no bytes (a copy)."""
    bits = F.conv(F.hex(packed), 16, 10).cast("decimal(20,0)").cast("long")
    exponent = F.shiftright(bits, 52)
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") / float(1 << 52)
    return F.when((F.octet_length(packed) == 0) | (exponent == 0), 0.0).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - 1023))


def nearest(
    points: DataFrame,
    *,
    dim: int,
    k: int = 5,
    tables: int = 3,
    probes: int = 1,
    per_bucket: int = 16,
    rows_per_range: int = 40_000,
) -> DataFrame:
    """``(point_id, neighbour_id, distance, rank)``: the k points of smallest cosine distance of every usable point.

    ``points`` has ``point_id`` and ``vector``. Vectors that can't be used (wrong number of entries, a null, NaN or infinite entry,
    all zero) and rows without a ``point_id`` take no part. A ``point_id`` that is repeated counts once per distinct
    vector. Vectors that differ only in length have distance 0. Ties are ordered by ``point_id`` among copies and by a
    digest of the vector otherwise. Fewer than k other points give fewer rows; one point or none gives an empty result.
    The number of buckets follows the number of classes (``per_bucket`` of them a bucket on average) at every size.
    """
    spark = points.sparkSession
    units = unit_points(points, dim)
    members = units.select("point_id", "cls").distinct()
    reps = units.groupBy("cls").agg(F.first("vec").alias("vec"))
    n = units.select(F.approx_count_distinct("cls", 0.02)).head()[0]
    family = CrossPolytope(dim, tables, max(1, n // per_bucket), probes)
    prefix = 2 + np.dtype(family.digit).itemsize * family.digits
    ranges = max(spark.sparkContext.defaultParallelism, math.ceil(n * tables * (1 + min(probes, family.digits)) / rows_per_range))
    coded = reps.mapInArrow(_hash(family), _CODED)
    best = coded.repartitionByRange(ranges, "code").sortWithinPartitions("code").mapInArrow(_rerank(dim, k, prefix), _BEST)
    # a class has one list per table and probe, so what is collected here is bounded
    records = F.flatten(F.transform(F.collect_list("best"), _records))
    merged = best.groupBy("cls").agg(F.slice(F.array_sort(F.array_distinct(records)), 1, k).alias("best"))

    first_ids = Window.partitionBy("cls").orderBy("point_id")
    # a limit on row_number is applied on the map side too, so a class of many copies never moves as a whole
    heads = members.withColumn("at", F.row_number().over(first_ids)).where(F.col("at") <= k + 1).select("cls", "point_id")
    others = (
        merged.select("cls", F.explode("best").alias("b"))
        .select(F.substring("b", 9, 16).alias("near"), "cls", F.substring("b", 1, 8).alias("far"))
        .join(heads.select(F.col("cls").alias("near"), "point_id"), "near")
        .select("cls", F.struct("far", "near", "point_id").alias("c"))
    )
    copies = heads.select("cls", F.struct(F.lit(b"").alias("far"), F.col("cls").alias("near"), "point_id").alias("c"))
    # at most k lists of k + 1 heads and the class's own heads
    lists = others.unionByName(copies).groupBy("cls").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return (
        members.join(lists, "cls")
        .select("point_id", F.slice(F.filter("c", lambda c: c["point_id"] != F.col("point_id")), 1, k).alias("c"))
        .select("point_id", F.posexplode("c").alias("at", "c"))
        .select(
            "point_id",
            F.col("c.point_id").alias("neighbour_id"),
            _distance(F.col("c.far")).alias("distance"),
            (F.col("at") + 1).alias("rank"),
        )
    )


def neighbour_pairs(points: DataFrame, **how) -> DataFrame:
    """``(point_a, point_b)``, ``point_a < point_b``: pairs of which one is among the k nearest of the other."""
    found = nearest(points, **how)
    return found.select(F.least("point_id", "neighbour_id").alias("point_a"), F.greatest("point_id", "neighbour_id").alias("point_b")).distinct()
