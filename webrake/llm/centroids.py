"""Centroid clustering with the threshold algorithm.

Vectors are turned into integers, so sums, distances and ties are exact and
any split of the input gives the same clusters.  Nearest centroids are found by
walking sorted lists: every dimension lists the centroids by their component,
and from a vector's own component the walk goes outward, one centroid of each
list per step.  A centroid met for the first time gets its exact distance.  A
centroid not met yet is at least as far off in each dimension as the frontier
there; once the sum of the squared frontier distances strictly exceeds the best
exact distance, no other centroid can be nearer or tie.

Each round is one pass over a narrow packed table (four bytes a component, in
the shared checkpoint folder, deleted after the last round); a task sums its
vectors per centroid, so what is shuffled per task and round is one row per
centroid and dimension, however large a cluster is.  What reaches the driver is
centroids x dimensions.  The last pass runs over the given rows themselves.

Integers are limited to +-2**27, beyond which a squared distance would not fit
a long.  Defined results: vectors that are null, of another length, or hold a
null or non-finite component are left out; very long vectors too, being of
another length; with fewer vectors than centroids every vector starts one; equal
start hashes go by id, then by vector; a null id hashes as an empty one; repeated
rows each count; ties of distance go to the smaller number; an empty table
gives an empty result; extra columns are kept, but for those named like an
added one, which are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrake.llm.common import python_ready
from webrake.session import delete_path, scratch_path

#: Vectors walked at a time, and the limit of a component.
BLOCK, LIMIT = 2048, 1 << 27
_FAR = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Lists:
    """The centroids and, per dimension, their components in order."""
    centroids: np.ndarray    # (k, dims)
    values: np.ndarray       # (dims, k + 2), with a wall on either side
    order: np.ndarray        # (dims, k + 2): whose component it is

    @staticmethod
    def of(centroids: np.ndarray) -> Lists:
        order = np.argsort(centroids.T, axis=1, kind="stable")
        values = np.take_along_axis(centroids.T, order, axis=1)
        wall = np.full((len(values), 1), 8 * LIMIT)
        return Lists(centroids, np.hstack([-wall, values, wall]), np.pad(order, ((0, 0), (1, 1))))


def nearest(vectors: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to each vector's nearest centroid."""
    k, dims = lists.centroids.shape
    number, best = np.zeros(len(vectors), np.int64), np.full(len(vectors), _FAR)
    exact = np.full((len(vectors), k), _FAR)
    rows, v = np.arange(len(vectors)), vectors
    above = np.stack([np.searchsorted(lists.values[d], v[:, d]) for d in range(dims)], axis=1)
    below, dim = above - 1, np.arange(dims)
    while len(rows):
        down, up = v - lists.values[dim, below], lists.values[dim, above] - v
        lower = down <= up
        frontier = np.where(lower, down, up)
        met = np.zeros((len(rows), k), dtype=bool)
        met[np.arange(len(rows))[:, None], lists.order[dim, np.where(lower, below, above)]] = True
        met &= exact[rows] == _FAR
        at, c = np.nonzero(met)
        exact[rows[at], c] = ((v[at] - lists.centroids[c]) ** 2).sum(axis=1)
        found = exact[rows]
        number[rows], best[rows] = found.argmin(axis=1), found.min(axis=1)   # the first of equals
        on = ((frontier ** 2).sum(axis=1) <= best[rows]) & (found == _FAR).any(axis=1)
        rows, v = rows[on], v[on]
        below, above = (below - lower)[on], (above + ~lower)[on]
    return number, best


def whole_vectors(col: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an Arrow list column that hold ``dims`` finite components, and
    those as integers ``floor(scale * x)``."""
    sizes = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)   # null: NaN
    rows = np.flatnonzero(sizes == dims)
    x = flat[(np.cumsum(sizes) - sizes)[rows][:, None] + np.arange(dims)]
    fine = np.isfinite(x).all(axis=1)
    x = np.clip(x[fine], -LIMIT / scale, LIMIT / scale)
    return rows[fine], np.floor(scale * x).astype(np.int64)


def _packed(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = whole_vectors(b.column(1), dims, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)),
                                              pa.array([x.tobytes() for x in v.astype("<i4")], pa.binary())], ["id", "v"])

    return vectors.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), vector_col) \
        .mapInArrow(run, "id string, v binary")


def _sums(packed: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Per centroid with vectors: their number, summed distance and summed
    components (one row per task, centroid and dimension is shuffled)."""
    k, dims = centroids.shape
    lists = Lists.of(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # column 0 counts, column 1 sums distances, the others components
        total, any_rows = np.zeros((k, dims + 2), np.int64), False
        for b in batches:
            v = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)
            for lo in range(0, len(v), BLOCK):
                part = v[lo:lo + BLOCK]
                number, far = nearest(part, lists)
                for c in np.unique(number):
                    mine = number == c
                    total[c] += np.concatenate(([mine.sum(), far[mine].sum()], part[mine].sum(axis=0)))
                any_rows = True
        if any_rows:
            c, at = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (c, at, total.ravel())], ["c", "at", "s"])

    rows = packed.select("v").mapInArrow(run, "c long, at long, s long") \
        .groupBy("c", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()   # k * (dims + 2) rows
    found = np.zeros((k, dims + 2), dtype=object)
    for r in rows:
        found[r["c"], r["at"]] = int(r["s"])
    return {c: (x[0], x[1], list(x[2:])) for c, x in enumerate(found) if x[0]}


def _start(packed: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(seed), F.col("id")), 256)
    first = packed.select(digest.alias("h"), "id", "v").orderBy("h", "id", "v").limit(k).collect()   # k rows
    return np.frombuffer(b"".join(bytes(r["v"]) for r in first), "<i4").reshape(-1, dims).astype(np.int64)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0,
            seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vectors`` (those that are whole) with ``cluster``, ``distance``
    (squared), ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    The ``k`` vectors with the smallest SHA-256 of ``seed`` and id are the first
    centroids; ``rounds`` times every centroid with vectors moves to the floor
    of their mean.  The rounds run when this is called."""
    python_ready(vectors)
    spark = vectors.sparkSession
    path = scratch_path(spark, "vectors")
    _packed(vectors, id_col, vector_col, dims, scale).write.parquet(path)
    packed = spark.read.parquet(path)
    centroids = _start(packed, k, seed, dims)
    sums: dict = {}
    for last in [False] * rounds + [True]:
        sums = _sums(packed, centroids) if len(centroids) else {}
        if not last:
            for c, (n, _, total) in sums.items():
                centroids[c] = [x // n for x in total]
    delete_path(spark, path)
    inertia = [sums[c][1] if c in sums else 0 for c in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in centroids.tolist()]
    return _assigned(vectors, centroids, inertia, names, vector_col, dims, scale)


def _assigned(vectors: DataFrame, centroids: np.ndarray, inertia: list[int], names: list[str],
              vector_col: str, dims: int, scale: float) -> DataFrame:
    added = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    columns = [c.split()[0] for c in added.split(", ")]
    given = vectors.drop(*[c for c in columns if c != vector_col])
    at = given.columns.index(vector_col)
    out = [f for f in given.schema.fields if f.name not in columns]
    kept = [given.columns.index(f.name) for f in out]
    lists = Lists.of(centroids) if len(centroids) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, v = whole_vectors(b.column(at), dims, scale)
            parts = [nearest(v[lo:lo + BLOCK], lists) for lo in range(0, len(v), BLOCK)]
            if not parts:
                continue
            number, far = (np.concatenate(x) for x in zip(*parts))
            mine = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*[mine.column(i) for i in kept], pa.array(number, pa.int32()), pa.array(far, pa.int64()),
                 pa.array([inertia[c] for c in number], pa.int64()),
                 pa.array([sum(inertia)] * len(number), pa.int64()),
                 pa.array([names[c] for c in number], pa.string())], [*[f.name for f in out], *columns])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out)
    return given.mapInArrow(run, fields + added)
