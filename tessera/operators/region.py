"""Region merge: adjacent cells of a volume are merged until a budget of regions is left.

The merge is greedy and sequential within a volume, so that labels come from a function
of one volume at a time (a volume has a fixed number of cells, set by its encoder). What
follows from the labels (means, centroids, extents, position blocks) is aggregation.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.grid import Shape, edge_padded, position

# The least spread that position blocks are divided by, and what is added to it.
FLOOR = 0.10
TINY = 1e-6


@lru_cache(maxsize=8)
def edges(shape: Shape, connectivity: int) -> np.ndarray:
    """Pairs (a, b), a < b, of adjacent cells, in order; kept for the volumes that follow."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    t, h, w = shape
    at = np.arange(t * h * w).reshape(shape)
    found = []
    for i, j, k in product((-1, 0, 1), repeat=3):
        if not 0 < abs(i) + abs(j) + abs(k) <= most or (i, j, k) < (0, 0, 0):
            continue
        a = at[max(0, -i) : t - max(0, i), max(0, -j) : h - max(0, j), max(0, -k) : w - max(0, k)]
        b = at[max(0, i) : t + min(0, i), max(0, j) : h + min(0, j), max(0, k) : w + min(0, k)]
        found.append(np.stack([a.ravel(), b.ravel()], 1))
    pairs = np.sort(np.concatenate([np.zeros((0, 2), int), *found]), axis=1)
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]


def adjacency(shape: Shape, connectivity: int | None) -> list[set[int]]:
    """The neighbours of every cell; all others without connectivity."""
    n = math.prod(shape)
    return [set(range(n)) - {i} for i in range(n)] if connectivity is None else _near(edges(shape, connectivity), n)


def merge_order(x: np.ndarray, shape: Shape, linkage: str = "ward", connectivity: int | None = 6) -> list[tuple[int, int]]:
    """Merges (a, b) in order; the k-th makes cluster n + k. Equal costs go by number, where cells are adjacent.

    Ward's cost is the growth of the summed squared distances. Average and complete linkage
    know the distances of adjacent clusters only, which are joined on merging: where one
    side alone is adjacent to a third cluster, its distance stays. Without connectivity all
    clusters are adjacent.
    """
    x = np.asarray(x, float)
    if connectivity is None:
        return _unconstrained(x, linkage)
    return _ward(x, edges(shape, connectivity)) if linkage == "ward" else _joined(x, edges(shape, connectivity), linkage)


def _near(pairs: np.ndarray, n: int) -> list[set[int]]:
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in pairs.tolist():
        near[a].add(b)
        near[b].add(a)
    return near


def _ward(x: np.ndarray, pairs: np.ndarray) -> list[tuple[int, int]]:
    n = len(x)
    near = _near(pairs, n)
    centre, size = np.zeros((2 * n, x.shape[1])), np.ones(2 * n)
    centre[:n] = x
    d = x[pairs[:, 0]] - x[pairs[:, 1]]
    heap = list(zip((np.einsum("ij,ij->i", d, d) / 2).tolist(), pairs[:, 0].tolist(), pairs[:, 1].tolist()))
    heapq.heapify(heap)
    alive = [True] * n
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < n - 1:
        _, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        new = n + len(merges)
        merges.append((a, b))
        alive[a] = alive[b] = False
        alive.append(True)
        size[new] = size[a] + size[b]
        centre[new] = (size[a] * centre[a] + size[b] * centre[b]) / size[new]
        around = (near[a] | near[b]) - {a, b}
        near.append(around)
        near[a] = near[b] = set()
        if around:
            others = list(around)
            d = centre[others] - centre[new]
            k = size[others]
            for c, cost in zip(others, (k * size[new] / (k + size[new]) * np.einsum("ij,ij->i", d, d)).tolist()):
                near[c] -= {a, b}
                near[c].add(new)
                heapq.heappush(heap, (cost, c, new))
    return merges


def _joined(x: np.ndarray, pairs: np.ndarray, linkage: str) -> list[tuple[int, int]]:
    n = len(x)
    apart: list[dict[int, float]] = [{} for _ in range(n)]
    length = np.linalg.norm(x[pairs[:, 0]] - x[pairs[:, 1]], axis=1)
    heap = []
    for a, b, cost in zip(pairs[:, 0].tolist(), pairs[:, 1].tolist(), length.tolist()):
        apart[a][b] = apart[b][a] = cost
        heap.append((cost, a, b))
    heapq.heapify(heap)
    size, alive = [1] * n, [True] * n
    merges: list[tuple[int, int]] = []
    while heap and len(merges) < n - 1:
        _, a, b = heapq.heappop(heap)
        if not (alive[a] and alive[b]):
            continue
        new = n + len(merges)
        merges.append((a, b))
        alive[a] = alive[b] = False
        alive.append(True)
        size.append(size[a] + size[b])
        left, right = apart[a], apart[b]
        apart[a] = apart[b] = {}
        both: dict[int, float] = {}
        for c in (left.keys() | right.keys()) - {a, b}:
            p, q = left.get(c), right.get(c)
            if p is None or q is None:
                both[c] = q if p is None else p
            else:
                both[c] = (size[a] * p + size[b] * q) / size[new] if linkage == "average" else max(p, q)
            apart[c].pop(a, None)
            apart[c].pop(b, None)
            apart[c][new] = both[c]
            heapq.heappush(heap, (both[c], c, new))
        apart.append(both)
    return merges


class _Distances:
    """The distances of all pairs of rows, each pair once, in single precision; made a block at a time."""

    def __init__(self, x: np.ndarray, block: int = 256):
        self.n = n = len(x)
        #: Where the pairs (i, j > i) begin, less i + 1.
        self.start = np.arange(n, dtype=np.int64) * n - np.arange(n, dtype=np.int64) * (np.arange(n, dtype=np.int64) + 1) // 2 - np.arange(n) - 1
        self.values = np.empty(n * (n - 1) // 2, np.float32)
        square = np.einsum("ij,ij->i", x, x)
        for begin in range(0, n, block):
            rows = slice(begin, begin + block)
            made = np.sqrt(np.maximum(square[rows, None] + square[None, begin:] - 2 * x[rows] @ x[begin:].T, 0))
            for k, row in enumerate(made):
                i = begin + k
                self.values[self.start[i] + i + 1 : self.start[i] + n] = row[k + 1 :]

    def row(self, a: int) -> np.ndarray:
        made = np.empty(self.n)
        made[:a] = self.values[self.start[:a] + a]
        made[a] = np.inf
        made[a + 1 :] = self.values[self.start[a] + a + 1 : self.start[a] + self.n]
        return made

    def put(self, a: int, row: np.ndarray) -> None:
        self.values[self.start[:a] + a] = row[:a]
        self.values[self.start[a] + a + 1 : self.start[a] + self.n] = row[a + 1 :]


def _unconstrained(x: np.ndarray, linkage: str) -> list[tuple[int, int]]:
    """The same with all clusters adjacent, by chains of nearest neighbours.

    Ward needs memory in proportion to the cells, the others 4 bytes for each pair of cells
    (382 MB at 13,824 cells).
    """
    n = len(x)
    size, alive = np.ones(n), np.ones(n, bool)
    centre = x.copy()
    apart = None if linkage == "ward" else _Distances(x)

    def costs(a: int) -> np.ndarray:
        if apart is None:
            d = centre - centre[a]
            row = size * size[a] / (size + size[a]) * np.einsum("ij,ij->i", d, d)
        else:
            row = apart.row(a)
        row[~alive] = np.inf
        row[a] = np.inf
        return row

    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        row = costs(chain[-1])
        best = int(np.argmin(row))
        if len(chain) > 1 and row[chain[-2]] <= row[best]:
            best = chain[-2]
        if len(chain) > 1 and best == chain[-2]:
            a, b = chain.pop(), chain.pop()
            found.append((float(row[best]), a, b))
            if apart is not None:
                p, q = apart.row(a), apart.row(b)
                apart.put(b, (size[a] * p + size[b] * q) / (size[a] + size[b]) if linkage == "average" else np.maximum(p, q))
            centre[b] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
            size[b] += size[a]
            alive[a] = False
        else:
            chain.append(best)
    # A chain finds merges in another order than that of their costs.
    top = list(range(n))
    name = list(range(n))

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    merges = []
    for cost, a, b in sorted(found, key=lambda f: f[0]):
        p, q = root(a), root(b)
        merges.append((min(name[p], name[q]), max(name[p], name[q])))
        top[p] = q
        name[q] = n + len(merges) - 1
    return merges


def cut(merges: list[tuple[int, int]], n: int, budget: int) -> np.ndarray:
    """Labels when budget regions are left; a region is named by its first cell."""
    done = merges[: max(0, n - budget)]
    top = np.arange(n + len(done))
    for k in range(len(done) - 1, -1, -1):
        top[list(done[k])] = top[n + k]
    first: dict[int, int] = {}
    for i, r in enumerate(top[:n].tolist()):
        first.setdefault(r, i)
    return np.array([first[r] for r in top[:n].tolist()])


def clustered_features(x: np.ndarray, organ: np.ndarray | None = None, lam: float = 0.0, standardize: bool = False) -> np.ndarray:
    """Features to cluster by: whitened, or with a mask block of lam times their variance."""
    if standardize:
        x = (x - x.mean(0)) / (x.std(0) + TINY)
    if organ is None or lam <= 0:
        return x
    scale = math.sqrt(lam * x.var(0).sum() / (organ.var(0).sum() + 1e-9))
    return np.concatenate([x, scale * organ], axis=1)


def region_labels(
    volumes: DataFrame, shape: Shape, budgets: list[int], feature: str = "features", organ: str | None = None, lam: float = 0.0,
    standardize: bool = False, linkage: str = "ward", connectivity: int | None = 6,
) -> DataFrame:
    """(vid, budget, pos, region) from (vid, array of one feature array a cell).

    One tree a volume serves all budgets. Volumes are dealt out first, a few for each of
    the shuffle partitions or cores, as a file may hold many and each takes seconds.
    """
    session = volumes.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions", "200")), 2 * session.sparkContext.defaultParallelism)
    columns = ["vid", F.col(feature).alias("features"), *([F.col(organ).alias("organ")] if organ else [])]

    def run(frames):
        for frame in frames:
            for row in frame.itertuples():
                x = np.array([np.asarray(v, float) for v in row.features])
                mask = np.array([np.asarray(v, float) for v in row.organ]) if organ else None
                merges = merge_order(clustered_features(x, mask, lam, standardize), shape, linkage, connectivity)
                for budget in budgets:
                    yield pd.DataFrame({"vid": row.vid, "budget": budget, "pos": np.arange(len(x)), "region": cut(merges, len(x), budget)})

    kind = volumes.schema["vid"].dataType.simpleString()
    return volumes.select(*columns).repartition(tasks, "vid").mapInPandas(run, f"vid {kind}, budget int, pos int, region int")


def region_means(grid: DataFrame, labels: DataFrame, shape: Shape) -> DataFrame:
    """(vid, budget, region, c, v): the mean of the original features of a region."""
    cells = grid.withColumn("pos", position(shape))
    return cells.join(labels, ["vid", "pos"]).groupBy("vid", "budget", "region", "c").agg(F.avg("v").alias("v"))


def region_places(labels: DataFrame, shape: Shape) -> DataFrame:
    """Centroid and extent of each region, in parts of the grid's sizes."""
    t, h, w = shape
    at = {"t": F.expr(f"pos div {h * w}") / t, "h": F.expr(f"pos div {w} % {h}") / h, "w": F.expr(f"pos % {w}") / w}
    made = []
    for a, x in at.items():
        made += [F.avg(x).alias(f"{a}_mean"), F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(0.0))).alias(f"{a}_extent")]
    return labels.groupBy("vid", "budget", "region").agg(F.count("*").alias("cells"), *made)


def position_block(places: DataFrame, freqs: int = 4, encoding: str = "sinusoidal", extent: bool = False) -> DataFrame:
    """(vid, budget, region, dim, value): the position of each region, of unit spread.

    sinusoidal: sines, then cosines, of each axis at freqs frequencies. raw: the centroid.
    Spread is that over the regions of one volume; below FLOOR it counts as FLOOR. With
    extent the extents follow, divided by their spread without a floor.
    """
    waves = []
    for a in ("t", "h", "w"):
        if encoding == "raw":
            waves.append(F.col(f"{a}_mean"))
        elif encoding == "sinusoidal":
            for fn in (F.sin, F.cos):
                waves += [fn(F.col(f"{a}_mean") * (2**k * math.pi)) for k in range(freqs)]
        else:
            raise ValueError(f"unknown encoding {encoding}")
    n = len(waves)
    if extent:
        waves += [F.col(f"{a}_extent") for a in ("t", "h", "w")]
    each = places.select("vid", "budget", "region", F.posexplode(F.array(*waves)).alias("dim", "x"))
    spread = F.stddev_pop("x").over(Window.partitionBy("vid", "budget", "dim")) + TINY
    by = F.when(F.col("dim") < n, F.greatest(spread, F.lit(FLOOR))).otherwise(spread)
    return each.select("vid", "budget", "region", "dim", (F.col("x") / by).alias("value"))


def volumes_of(grid: DataFrame, shape: Shape, organ: DataFrame | None = None) -> DataFrame:
    """(vid, features, organ): an array of one array a cell, of grids in long form; cells are complete."""

    def packed(df: DataFrame, channel: str, name: str) -> DataFrame:
        cells = df.groupBy("vid", position(shape).alias("pos")).agg(F.array_sort(F.collect_list(F.struct(channel, "v"))).alias("x"))
        arrays = cells.select("vid", F.struct("pos", F.transform("x", lambda s: s["v"]).alias("x")).alias("cell"))
        return arrays.groupBy("vid").agg(F.transform(F.array_sort(F.collect_list("cell")), lambda s: s["x"]).alias(name))

    made = packed(grid, "c", "features")
    return made if organ is None else made.join(packed(organ, "grp", "organ"), "vid")


def region_tokens(
    grid: DataFrame, labels: DataFrame, shape: Shape, channels: int, centroid: bool = False, scale: float = 1.0, encoding: str = "raw", freqs: int = 4, extent: bool = False
) -> DataFrame:
    """(vid, budget, region, c, v): means of regions and, after them, their positions as further channels."""
    means = region_means(grid, labels, shape)
    if not centroid:
        return means
    block = position_block(region_places(labels, shape), freqs, encoding, extent)
    return means.unionByName(scaled_positions(block, grid, scale).select("vid", "budget", "region", (F.col("dim") + channels).alias("c"), F.col("value").alias("v")))


def block_tokens(
    grid: DataFrame, shape: Shape, channels: int, r: int = 2, centroid: bool = False, scale: float = 1.0, encoding: str = "raw", freqs: int = 4
) -> DataFrame:
    """(vid, budget, region, c, v): averages of r^3 blocks and, after them, the blocks' positions.

    Centroids are those of the grid padded to whole blocks, in parts of the padded sizes.
    """
    padded: Shape = tuple(n + -n % r for n in shape)  # type: ignore[assignment]
    t, h, w = (n // r for n in padded)
    full = edge_padded(grid, shape, (r, r, r))
    region = ((F.floor(F.col("t") / r) * h + F.floor(F.col("h") / r)) * w + F.floor(F.col("w") / r)).cast("int")
    labels = full.select("vid", position(padded).alias("pos"), region.alias("region"), F.lit(t * h * w).alias("budget")).distinct()
    tokens = region_means(full, labels, padded)
    if not centroid:
        return tokens
    block = scaled_positions(position_block(region_places(labels, padded), freqs, encoding), grid, scale)
    return tokens.unionByName(block.select("vid", "budget", "region", (F.col("dim") + channels).alias("c"), F.col("value").alias("v")))


def scaled_positions(block: DataFrame, grid: DataFrame, scale: float = 1.0) -> DataFrame:
    """Position values times scale and the spread of all features of the volume."""
    spread = grid.groupBy("vid").agg((F.stddev_pop("v") + TINY).alias("spread"))
    return block.join(spread, "vid").select("vid", "budget", "region", "dim", (F.col("value") * scale * F.col("spread")).alias("value"))
