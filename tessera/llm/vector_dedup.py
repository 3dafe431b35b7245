"""Embedding near-dedup (operator 13): cells of spherical k-means, cosine products within cells.

Equal vectors are one point with a weight first. Centroids are fitted by pyspark.ml's KMeans
with cosine distance on a hashed sample of about SAMPLE points (documented bound); those
near an earlier one are left out, so that a dense group isn't cut up. Each point lives in
the cell of its nearest centroid, and is a guest of each other cell whose border plane is
near to it; residents meet residents and guests. Two linked points of different cells lie
on either side of the plane between the centroids, and one of them within half of what
their difference has across it. That is half the chord of the limit at most, and nearly
always far less: a difference of D dimensions has a share of about 1/sqrt(D) in a given
direction. The border taken is `sigmas` such shares (4 by default: a pair at the very limit
is lost with a chance of 6 in 100,000, one that is nearer with less), D being the effective
number of dimensions of the points; with 16 or fewer, or sigmas of None, the half chord
itself, so that no pair is lost whatever the data. README has the recall that was measured.

Cells are dealt out in blocks of BLOCK residents and BLOCK guests, a pair of blocks in a
task's group of its own, and compared by matrix products in double precision. A pair that
meets in both of its cells counts in the one of the smaller number. Groups send each
point's sum of weights, and one edge a point that ties it to its part's first point, never
all pairs. Components of those edges are the groups; the smallest id of one is kept.

Vectors that are null, empty, zero, or hold null or non-finite entries link with nothing
and are their own component, as vectors of different lengths are not compared. Repeated
rows link with each other. A null id is no smallest id unless a group has no other: then its
component is null, and its row is kept. An empty table gives an empty one. Only the two
named columns are read, so that others may have any name.

Time: pairs of residents with residents and guests of about sqrt(n) cells (see README).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged
from tessera.llm.jaccard_join import components

LIMIT = 0.95
#: Points that the centroids are fitted on, about; most cells; nearest cosine of two centroids.
SAMPLE, CELLS, APART = 262_144, 16_384, 0.8
#: Bytes of all centroids, which are broadcast; points whose effective dimensions are told.
CENTROID_BYTES, SOME = 64 << 20, 1_024
#: Width of borders (see above).
SIGMAS = 4.0
#: Residents, or guests, of a cell that one group holds.
BLOCK = 4_096
#: Numbers of a matrix product at a time.
STRIP = 1 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; entries are made small first, so that squares neither overflow nor vanish."""
    rows = vectors.astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def keyed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector and point (a digest of the vector), both null where the vector links with nothing."""
    vector = F.col(f"`{vector_col}`")
    single = df.schema[vector_col].dataType.elementType.simpleString() == "float"
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    nonzero = F.exists(vector, lambda c: c != 0)
    kind = "float" if single else "double"
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.when(finite & nonzero, vector.cast(f"array<{kind}>")).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [None if v is None else hashlib.blake2b((np.array(v, "<f4" if single else "<f8") + 0).tobytes(), digest_size=16).digest() for v in _lists(batch.column("vector"))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(points, pa.binary())], ["id", "vector", "point"])

    return rows.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, vector array<{kind}>, point binary")


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for k, there in enumerate(column.is_valid().to_numpy(zero_copy_only=False)):
        yield flat[at[k] : at[k + 1]] if there else None


def fit_centroids(points: DataFrame, many: int) -> np.ndarray:
    """Unit centroids of cells, as rows: about sqrt(many) of them, CELLS at most."""
    first = points.first()["vector"]
    k = min(CELLS, CENTROID_BYTES // (8 * len(first)), math.ceil(math.sqrt(many)))
    if k < 2:
        return _units(np.array([first]))
    rows = hashed_part(points, many, SAMPLE).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    centres = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=8, seed=13).fit(rows).clusterCenters()
    centres = _units(np.array([c for c in centres if np.isfinite(c).all() and np.abs(c).max() > 0]))
    made, kept = np.empty_like(centres), 0
    for c in centres:
        if not kept or (made[:kept] @ c).max() < APART:
            made[kept], kept = c, kept + 1
    return made[:kept]


def hashed_part(points: DataFrame, many: int, most: int) -> DataFrame:
    """About `most` of the points, by a hash; all if they are no more."""
    return points.where(F.pmod(F.xxhash64("point"), F.lit(math.ceil(many / most))) == 0)


def border(points: DataFrame, many: int, limit: float, sigmas: float | None) -> float:
    """How near the plane between two cells a point is a guest beyond it."""
    half = math.sqrt(max(0.0, 2 - 2 * limit)) / 2
    if sigmas is None:
        return half + 1e-7
    some = hashed_part(points, many, SOME).limit(2 * SOME).collect()
    if len(some) < 2:
        return half + 1e-7
    z = _units(np.array([r["vector"] for r in some]))
    z -= z.mean(0)
    products = z @ z.T
    own = np.diag(products).copy()
    np.fill_diagonal(products, 0.0)
    n = len(z)
    # The square of the trace of the covariance over the trace of its square.
    effective = own.mean() ** 2 / max((products**2).sum() / (n * (n - 1)), 1e-30)
    return half * min(1.0, sigmas / math.sqrt(max(1.0, effective))) + 1e-7


def assigned(points: DataFrame, centroids: np.ndarray, width: float) -> DataFrame:
    """point, weight, vector, home (its cell) and guest (the cells that it is a guest of)."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)
    kind = points.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        step = max(1, STRIP // len(centres))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                near = _units(_matrix(part.column("vector"))) @ centres.T
                home = near.argmax(axis=1)
                apart = np.sqrt(np.maximum(2 - 2 * (centres[home] @ centres.T), 0.0))
                guest = near[np.arange(len(near)), home][:, None] - near <= width * apart
                guest[np.arange(len(near)), home] = False
                row, cell = np.nonzero(guest)
                offsets = np.append(0, np.cumsum(np.bincount(row, minlength=len(near)))).astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(cell.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("point"), part.column("weight"), part.column("vector"), pa.array(home.astype(np.int32)), cells], ["point", "weight", "vector", "home", "guest"])

    return points.select("point", "weight", "vector").mapInArrow(run, f"point binary, weight long, vector {kind}, home int, guest array<int>")


def dealt(members: DataFrame) -> DataFrame:
    """The rows of members for each pair of blocks: cell, lo and hi tell the group, block the row's own."""
    each = members.select("*", F.explode(F.concat(F.array("home"), "guest")).alias("cell")).withColumn("resident", F.col("cell") == F.col("home"))
    sizes = each.groupBy("cell").agg(F.count_if("resident").alias("residents"), F.count_if(~F.col("resident")).alias("guests"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = sizes.where("residents > 0").select("cell", blocks("residents").alias("rb"), blocks("guests").alias("gb"))
    # At most CELLS rows, so that they can be broadcast.
    each = each.join(F.broadcast(sizes), "cell")
    alone = (F.col("rb") == 1) & (F.col("gb") <= 1)
    own = F.pmod(F.xxhash64("point"), F.when(F.col("resident"), F.col("rb")).otherwise(F.col("gb"))).cast("int")
    each = each.withColumn("block", F.when(alone, 0).when(F.col("resident"), own).otherwise(F.col("rb") + own))
    last = F.when(F.col("resident"), F.col("rb") + F.col("gb") - 1).otherwise(F.col("rb") - 1)
    each = each.withColumn("other", F.explode(F.when(alone, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last))))
    return each.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "rb", "gb")


class _Parts:
    """Connected parts of a group's points, by the smallest place of each."""

    def __init__(self, many: int):
        self.of = np.arange(many)

    def tie(self, places: np.ndarray) -> None:
        met = np.unique(self.of[places])
        if len(met) > 1:
            self.of[np.isin(self.of, met)] = met[0]


def _linked(table: pa.Table, limit: float) -> pa.Table:
    """point, links (the weights that it links with in this group) and other (the first point of its part, if another)."""
    cell, lo, hi = (table.column(c)[0].as_py() for c in ("cell", "lo", "hi"))
    resident, block = (table.column(c).to_numpy() for c in ("resident", "block"))
    home, weight = (table.column(c).to_numpy() for c in ("home", "weight"))
    units = _units(_matrix(table.column("vector")))
    left = np.flatnonzero(resident & (block == lo))
    guest = table.column("guest").combine_chunks()
    visits = np.repeat(np.arange(len(home)), np.diff(guest.offsets.to_numpy())).astype(np.int64) << 32 | guest.flatten().to_numpy().astype(np.int64)
    parts, links = _Parts(len(home)), np.zeros(len(home), np.int64)

    def meet(right: np.ndarray, once: bool, guests: bool) -> None:
        step = max(1, STRIP // max(1, len(right)))
        for begin in range(0, len(left), step):
            rows = left[begin : begin + step]
            i, j = np.nonzero(units[rows] @ units[right].T >= limit)
            a, b = rows[i], right[j]
            keep = b > a if once else np.ones(len(a), bool)
            if guests:
                # The other cell has the pair as well, and a smaller number.
                keep &= ~((home[b] < cell) & np.isin(a << 32 | home[b].astype(np.int64), visits))
            a, b = a[keep], b[keep]
            if len(a):
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                cuts = np.flatnonzero(np.diff(a)) + 1
                for x, of in zip(a[np.append(0, cuts)], np.split(b, cuts), strict=True):
                    parts.tie(np.append(of, x))

    if lo == hi:
        meet(left, True, False)
    else:
        meet(np.flatnonzero(resident & (block == hi)), False, False)
    meet(np.flatnonzero(~resident), False, True)
    told = np.flatnonzero(links > 0)
    point = table.column("point").combine_chunks()
    first = parts.of[told]
    other = point.take(pa.array(first, mask=first == told))
    return pa.table({"point": point.take(pa.array(told)), "other": other, "links": links[told]})


def linked(points: DataFrame, limit: float = LIMIT, sigmas: float | None = SIGMAS) -> DataFrame:
    """point, other, links (see _linked) of points of one length, each a vector of its own."""
    many = points.count()
    members = staged(assigned(points, fit_centroids(points, many), border(points, many, limit, sigmas)), "cells")
    return dealt(members).groupBy("cell", "lo", "hi").applyInArrow(lambda t: _linked(t, limit), "point binary, other binary, links long")


def near_duplicates(df: DataFrame, limit: float = LIMIT, id_col: str = "vec_id", vector_col: str = "embedding", sigmas: float | None = SIGMAS) -> DataFrame:
    """id, n_links, component_id and kept of every row; with sigmas of None exact, at the cost of wider borders."""
    rows = keyed(df, id_col, vector_col)
    equal = rows.where("point IS NOT NULL").groupBy("point").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.any_value("vector").alias("vector"))
    points = staged(equal.withColumn("length", F.size("vector")), "points")
    met = None
    for (length,) in points.select("length").distinct().orderBy("length").collect():
        made = linked(points.where(F.col("length") == length), limit, sigmas)
        met = made if met is None else met.unionByName(made)
    if met is None:
        told = points.select("point", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    else:
        met = staged(met, "met")
        counts = met.groupBy("point").agg(F.sum("links").alias("links"))
        roots = components(met.where("other IS NOT NULL").select(F.col("point").alias("a"), F.col("other").alias("b")).distinct())
        classes = staged(points.select("point", "weight", "least").join(counts, "point", "left").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point")), "classes")
        top = classes.groupBy("root").agg(F.min("least").alias("component_id"))
        told = classes.join(top, "root").select("point", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    made = rows.select("id", "point").join(told, "point", "left")
    component = F.when(F.col("point").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return made.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op13(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
