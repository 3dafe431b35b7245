"""Operators over feature grids in long form: a row (vid, t, h, w, c, v) for each value.

Every operator partitions by vid; none needs a volume in one row. Sizes of grids are
arguments (t, h, w), as they are a property of the encoder, not of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import uniform_mix
from tessera.operators.tables import seeded

Shape = tuple[int, int, int]
AXES = ("t", "h", "w")


def position(shape: Shape) -> Column:
    """Row-major place of a cell."""
    return ((F.col("t") * shape[1] + F.col("h")) * shape[2] + F.col("w")).cast("int")


def from_arrays(df: DataFrame, vid: str, array: str, shape: Shape, channels: int = 1) -> DataFrame:
    """Long form of arrays of shape (t, h, w, c), row-major."""
    flat = df.select(F.col(vid).alias("vid"), F.posexplode(array).alias("i", "v"))
    cell = F.expr(f"i div {channels}")
    return flat.select(
        "vid", F.expr(f"cast(i div {channels * shape[1] * shape[2]} as int)").alias("t"), (F.expr(f"i div {channels * shape[2]}") % shape[1]).cast("int").alias("h"),
        (cell % shape[2]).cast("int").alias("w"), (F.col("i") % channels).cast("int").alias("c"), F.col("v").cast("double").alias("v"),
    )


def edge_padded(grid: DataFrame, shape: Shape, factor: Shape) -> DataFrame:
    """Cells up to a multiple of factor, by repeating the last one of each axis."""
    for axis, size, f in zip(AXES, shape, factor):
        more = -size % f
        if more:
            last = F.when(F.col(axis) == size - 1, F.sequence(F.lit(size - 1), F.lit(size - 1 + more))).otherwise(F.array(axis))
            grid = grid.withColumn(axis, F.explode(last))
    return grid


def _block(factor: Shape) -> list[Column]:
    return [F.floor(F.col(a) / f).cast("int").alias(a) for a, f in zip(AXES, factor)]


def block_average(grid: DataFrame, shape: Shape, factor: Shape) -> DataFrame:
    return edge_padded(grid, shape, factor).groupBy("vid", *_block(factor), "c").agg(F.avg("v").alias("v"))


def block_max(grid: DataFrame, shape: Shape, factor: Shape) -> DataFrame:
    return edge_padded(grid, shape, factor).groupBy("vid", *_block(factor), "c").agg(F.max("v").alias("v"))


def block_pack(grid: DataFrame, shape: Shape, factor: Shape, channel_first: bool = True, pad: bool = True) -> DataFrame:
    """Values of a block as one array: by (c, dt, dh, dw), or by (dt, dh, dw, c).

    Without pad, cells that don't fill a block are dropped.
    """
    if pad:
        grid = edge_padded(grid, shape, factor)
    else:
        for a, size, f in zip(AXES, shape, factor):
            grid = grid.where(F.col(a) < size - size % f)
    inner = [(F.col(a) % f).alias(f"d{a}") for a, f in zip(AXES, factor)]
    order = [F.col("c"), *inner] if channel_first else [*inner, F.col("c")]
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col("v"))))
    return grid.groupBy("vid", *_block(factor)).agg(F.transform(packed, lambda x: x["v"]).alias("feature"))


def bins(size: int, out: int) -> list[tuple[int, int]]:
    """(bin, place) of adaptive pooling: bin i covers [i n / out, (i + 1) n / out), outwards.

    Bins may overlap. The pairs are listed, so that pooling is an equi-join.
    """
    return [(i, x) for i in range(out) for x in range(i * size // out, -(-(i + 1) * size // out))]


def adaptive_pool(grid: DataFrame, shape: Shape, out: Shape, how: str = "avg") -> DataFrame:
    """Average, maximum or any (> 0) of overlapping bins."""
    for axis, size, n in zip(AXES, shape, out):
        of = {x: [i for i, y in bins(size, n) if y == x] for x in range(size)}
        table = F.array(*[F.array(*map(F.lit, of[x])) for x in range(size)])
        grid = grid.withColumn(axis, F.explode(F.get(table, F.col(axis))))
    made = {"avg": F.avg("v"), "max": F.max("v"), "any": F.max((F.col("v") > 0).cast("int"))}[how]
    return grid.groupBy("vid", *AXES, "c").agg(made.alias("v"))


def pool_shape(shape: Shape, budget: int) -> Shape:
    """About budget cells in the proportions of shape; halves are rounded to even."""
    scale = (budget / math.prod(shape)) ** (1 / 3)
    return tuple(max(1, round(x * scale)) for x in shape)  # type: ignore[return-value]


def cubic_factors(n: int) -> Shape:
    """The factors t >= h >= w of n that differ least; the first such found."""
    found = ((t, h, n // t // h) for t in range(1, n + 1) if n % t == 0 for h in range(1, n // t + 1) if n // t % h == 0)
    return min((tuple(sorted(x, reverse=True)) for x in found), key=lambda x: x[0] - x[2])  # type: ignore[return-value]


def trilinear(grid: DataFrame, shape: Shape, out: Shape) -> DataFrame:
    """Trilinear resampling with half-cell centres, as weights of two cells an axis."""
    return _weighted(grid, shape, out, lambda i, size, n: max(0.0, (i + 0.5) * size / n - 0.5))


def _weighted(grid: DataFrame, shape: Shape, out: Shape, place: Callable[[int, int, int], float]) -> DataFrame:
    """Cells of out as weighted sums of two cells an axis, around the place that each has in the grid."""
    for axis, size, n in zip(AXES, shape, out):
        near: dict[int, list[tuple[int, float]]] = {x: [] for x in range(size)}
        for i in range(n):
            at = place(i, size, n)
            low = min(int(at), size - 1)
            high, part = min(low + 1, size - 1), at - low
            for x, weight in ((low, 1 - part), (high, part)):
                if weight:
                    near[x].append((i, weight))
        empty = F.expr("cast(array() as array<struct<i:int,k:double>>)")
        table = F.array(*[F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in near[x]]) if near[x] else empty for x in range(size)])
        grid = grid.withColumn("z", F.explode(F.get(table, F.col(axis)))).withColumn(axis, F.col("z.i")).withColumn("v", F.col("v") * F.col("z.k")).drop("z")
    return grid.groupBy("vid", *AXES, "c").agg(F.sum("v").alias("v"))


def nearest(grid: DataFrame, shape: Shape, out: Shape) -> DataFrame:
    """Each cell of out from the nearest one on a lattice whose corners agree."""
    for axis, size, n in zip(AXES, shape, out):
        of: dict[int, list[int]] = {x: [] for x in range(size)}
        for i in range(n):
            of[math.floor(i * (size - 1) / max(1, n - 1) + 0.5) if n > 1 else 0].append(i)
        empty = F.expr("cast(array() as array<int>)")
        grid = grid.withColumn(axis, F.explode(F.get(F.array(*[F.array(*map(F.lit, x)) if x else empty for x in of.values()]), F.col(axis))))
    return grid


def linear_zoom(grid: DataFrame, shape: Shape, out: Shape) -> DataFrame:
    """Linear resampling on a lattice whose corners agree, as weights of two cells an axis."""
    return _weighted(grid, shape, out, lambda i, size, n: i * (size - 1) / (n - 1) if n > 1 else 0.0)


def centre_crop(grid: DataFrame, shape: Shape, out: Shape, fill: float = 0.0) -> DataFrame:
    """The middle of a grid; where out is larger, fill around it."""
    lattice = grid.select("vid", "c").distinct()
    for a, n in zip(AXES, out):
        lattice = lattice.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    moved = grid
    for a, size, n in zip(AXES, shape, out):
        shift = (n - size) // 2 if n >= size else -((size - n) // 2)
        moved = moved.withColumn(a, F.col(a) + shift)
    return lattice.join(moved, ["vid", *AXES, "c"], "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def depth_crop(grid: DataFrame, depth: int) -> DataFrame:
    """The first 1 + 4 n layers."""
    return grid.where(F.col("t") < 1 + (depth - 1) // 4 * 4)


def step_crop(grid: DataFrame, step: int, depth: int, taken: int) -> DataFrame:
    """taken layers from (17 step) mod (room + 1) on, moved to 0."""
    start = step * 17 % (depth - taken + 1)
    return grid.where(F.col("t").between(start, start + taken - 1)).withColumn("t", F.col("t") - start)


def space_to_depth(grid: DataFrame, k: int = 2) -> DataFrame:
    """k x k neighbours of a layer as channels, by (c, p1, p2)."""
    channel = (F.col("c") * k + F.col("h") % k) * k + F.col("w") % k
    return grid.withColumn("c", channel.cast("int")).withColumn("h", F.floor(F.col("h") / k).cast("int")).withColumn("w", F.floor(F.col("w") / k).cast("int"))


def depth_to_space(grid: DataFrame, k: int = 2) -> DataFrame:
    p1, p2 = F.floor(F.col("c") / k) % k, F.col("c") % k
    moved = grid.withColumn("h", (F.col("h") * k + p1).cast("int")).withColumn("w", (F.col("w") * k + p2).cast("int"))
    return moved.withColumn("c", F.floor(F.col("c") / (k * k)).cast("int"))


def transposed(grid: DataFrame, order: Sequence[str], shape: Shape, flipped: Sequence[str] = ()) -> DataFrame:
    """Axes in another order; flipped ones are mirrored first."""
    sizes = dict(zip(AXES, shape))
    source = [(F.lit(sizes[a] - 1) - F.col(a) if a in flipped else F.col(a)).alias(to) for a, to in zip(order, AXES)]
    return grid.select("vid", *source, "c", "v")


def neighbours(grid: DataFrame, shape: Shape, connectivity: int = 6) -> DataFrame:
    """(vid, a, b) for each pair of adjacent cells, both ways round."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 0 < abs(i) + abs(j) + abs(k) <= most]
    offsets = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{a}") for a, x in zip(AXES, s)]) for s in steps]))
    inside = [(F.col(a) + F.col(f"d.d{a}")).between(0, n - 1) for a, n in zip(AXES, shape)]
    step = (F.col("d.dt") * shape[1] + F.col("d.dh")) * shape[2] + F.col("d.dw")
    cells = grid.select("vid", *AXES).distinct().withColumn("d", offsets)
    return cells.where(inside[0] & inside[1] & inside[2]).select("vid", position(shape).alias("a"), (position(shape) + step).alias("b"))


# --- weights and masks -----------------------------------------------------------------


def mean_one(df: DataFrame, by: str = "vid", weight: str = "weight") -> DataFrame:
    """Weights scaled to a mean of 1; a total of 0 or less is an error."""
    w = Window.partitionBy(by)
    total = F.sum(weight).over(w)
    scaled = F.when(total <= 0, F.raise_error(F.lit("weights add up to nothing"))).otherwise(F.col(weight) * F.count("*").over(w) / total)
    return df.withColumn(weight, scaled)


def masked_mean(cells: DataFrame, by: Sequence[str] = ("vid",), value: str = "v", mask: str = "mask", least: float = 1e-6) -> DataFrame:
    """Mean of value weighted by mask, over `least` of weight at least; a mask that is empty throughout is an error."""
    total = F.sum(F.coalesce(F.col(mask).cast("double"), F.lit(0.0)))
    summed = cells.groupBy(*by).agg(F.sum(F.col(value) * F.col(mask)).alias("_s"), total.alias("_m"))
    mean = F.when(F.col("_m") > 0, F.col("_s") / F.greatest("_m", F.lit(least))).otherwise(F.raise_error(F.lit("a mask is empty")))
    return summed.select(*by, mean.alias(value))


def class_fraction(cells: DataFrame, classes: Sequence[int], factor: Shape) -> DataFrame:
    """Share of each class among the cells of a block, zero included."""
    shares = [F.avg(F.when(F.col("class_id") == k, 1.0).otherwise(0.0)).alias(f"class_{k}") for k in classes]
    return cells.groupBy("vid", *_block(factor)).agg(*shares)


def group_bits(fractions: DataFrame, group_of: DataFrame, threshold: float) -> DataFrame:
    """(vid, pos, class_id, frac) and (class_id, bit): bits whose classes exceed threshold."""
    summed = fractions.join(group_of, "class_id").groupBy("vid", "pos", "bit").agg(F.sum("frac").alias("frac"))
    bit = F.when(F.col("frac") > threshold, F.expr("shiftleft(1, bit)")).otherwise(0)
    return summed.groupBy("vid", "pos").agg(F.bit_or(bit).alias("mask"))


def voxel_weights(weights: DataFrame, shape: Shape, full: Shape, share: float, step: int, taken: int) -> DataFrame:
    """Weights of tokens mixed with a uniform share, upsampled to full, cropped by the step, to a mean of 1.

    A mean below a millionth counts as one.
    """
    mixed = weights.withColumn("v", uniform_mix(F.col("v"), share))
    cut = step_crop(trilinear(mixed, shape, full), step, full[0], taken)
    mean = F.avg("v").over(Window.partitionBy("vid"))
    return cut.withColumn("v", F.col("v") / F.greatest(mean, F.lit(1e-6)))


# --- selection -------------------------------------------------------------------------


def top_tokens(tokens: DataFrame, k: int, score: str = "score", by: str = "vid", place: str = "pos") -> DataFrame:
    """The k tokens with the highest score, ties by place, with their rank in place order."""
    best = Window.partitionBy(by).orderBy(F.desc(score), place)
    kept = tokens.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k).drop("_rank")
    return kept.withColumn("token", (F.row_number().over(Window.partitionBy(by).orderBy(place)) - 1).cast("int"))


def tied_score(tokens: DataFrame, importance: str = "importance", size: str = "norm", by: str = "vid") -> DataFrame:
    """Importance, and a millionth of the relative norm to order what is equal."""
    most = F.max(size).over(Window.partitionBy(by))
    return tokens.withColumn("score", F.col(importance) + 1e-6 * (F.col(size) / (most + 1e-9)))


def strided_places(m: int, budget: int) -> list[int]:
    """Evenly spaced places of m, halves rounded to even, without repeats."""
    return sorted({round(i * (m - 1) / (budget - 1)) if budget > 1 else 0 for i in range(budget)})


def hashed_sample(tokens: DataFrame, k: int, seed: int, by: str = "vid", place: str = "pos") -> DataFrame:
    """k tokens of each volume in the order of a seeded hash (not numpy's random order)."""
    order = Window.partitionBy(by).orderBy(seeded(seed, F.col(by), F.col(place)), place)
    return tokens.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def regrouped(grid: DataFrame, shape: Shape, budget: int, fine: int = -1) -> DataFrame:
    """Coarse tokens of the whole grid first, then the fine ones of the largest norm.

    The number of tokens is what cubic_factors can hold.
    """
    fine = budget // 2 if fine < 0 else min(fine, budget)
    coarse_shape = cubic_factors(budget - fine) if budget > fine else (0, 0, 0)
    tokens = grid.groupBy("vid", position(shape).alias("pos")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("score"))
    picked = top_tokens(tokens, fine).select("vid", "pos", (F.col("token") + math.prod(coarse_shape)).alias("token"))
    fine_rows = grid.withColumn("pos", position(shape)).join(picked, ["vid", "pos"]).select("vid", "token", "c", "v")
    if budget == fine:
        return fine_rows
    coarse = adaptive_pool(grid, shape, coarse_shape).select("vid", position(coarse_shape).alias("token"), "c", "v")
    return coarse.unionByName(fine_rows)
