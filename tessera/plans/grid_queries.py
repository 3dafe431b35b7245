"""Queries over grids: each embedding of 64 numbers is a grid of 4 x 4 x 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import grid as G
from tessera.operators import learned as L
from tessera.operators import region as R
from tessera.plans.registry import query, table

SHAPE = (4, 4, 4)
WIDE = (2, 2, 2)

GRID = """
g AS (SELECT vec_id AS vid, ((i - 1) // 16)::INT AS t, ((i - 1) // 4 % 4)::INT AS h, ((i - 1) % 4)::INT AS w, 0 AS c,
             embedding[i]::DOUBLE AS v, (i - 1)::INT AS pos
      FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
#: The same as 2 x 2 x 2 cells of 8 channels.
WIDE_GRID = """
g AS (SELECT vec_id AS vid, ((i - 1) // 32)::INT AS t, ((i - 1) // 16 % 2)::INT AS h, ((i - 1) // 8 % 2)::INT AS w,
             ((i - 1) % 8)::INT AS c, embedding[i]::DOUBLE AS v, ((i - 1) // 8)::INT AS pos
      FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
LABELS = """
l AS (SELECT vid, pos, (t // 2 * 32 + h // 2 * 8 + w // 2 * 2)::INT AS region, t, h, w, c, v FROM g)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SHAPE)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", WIDE, 8)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names or ("v",)})


def block_labels(df: DataFrame) -> DataFrame:
    """Labels by a rule that SQL can say: the first cell of a 2 x 2 x 2 block."""
    region = F.expr("t div 2 * 32 + h div 2 * 8 + w div 2 * 2").cast("int")
    return df.select("vid", G.position(SHAPE).alias("pos"), region.alias("region"), F.lit(8).alias("budget")).distinct()


@query(f"WITH {GRID} SELECT vid, pos, v FROM g")
def g1_flatten(spark, sf_dir):
    return grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), "v")


@query(f"""WITH {GRID}, a AS (SELECT unnest(range(6))::INT AS x)
SELECT vid, i.x AS t, j.x AS h, k.x AS w, v FROM g, a i, a j, a k
WHERE g.t = least(i.x, 3) AND g.h = least(j.x, 3) AND g.w = least(k.x, 3)""")
def g2_edge_pad(spark, sf_dir):
    return G.edge_padded(grid(spark, sf_dir), SHAPE, (3, 3, 3)).select("vid", "t", "h", "w", "v")


@query(f"WITH {GRID} SELECT vid, (t // 2)::INT AS t, (h // 2)::INT AS h, (w // 2)::INT AS w, c, round(avg(v), 6) AS v FROM g GROUP BY ALL")
def g3_grid_block_avg(spark, sf_dir):
    return rounded(G.block_average(grid(spark, sf_dir), SHAPE, (2, 2, 2)))


@query(f"""WITH {GRID}, a AS (SELECT unnest(range(6))::INT AS x)
SELECT vid, (i.x // 3)::INT AS t, (j.x // 3)::INT AS h, (k.x // 3)::INT AS w, c, round(avg(v), 6) AS v FROM g, a i, a j, a k
WHERE g.t = least(i.x, 3) AND g.h = least(j.x, 3) AND g.w = least(k.x, 3) GROUP BY ALL""")
def g3_grid_block_avg_padded(spark, sf_dir):
    return rounded(G.block_average(grid(spark, sf_dir), SHAPE, (3, 3, 3)))


@query(f"WITH {GRID} SELECT vid, t, (h // 2)::INT AS h, (w // 2)::INT AS w, c, max(v) AS v FROM g GROUP BY ALL")
def g4_block_max(spark, sf_dir):
    return G.block_max(grid(spark, sf_dir), SHAPE, (1, 2, 2))


@query(f"WITH {GRID} SELECT vid, t, (h // 2)::INT AS h, (w // 2)::INT AS w, c, round(avg(v), 6) AS v FROM g GROUP BY ALL")
def g13_layer_avg(spark, sf_dir):
    return rounded(G.block_average(grid(spark, sf_dir), SHAPE, (1, 2, 2)))


@query(f"""WITH {WIDE_GRID} SELECT vid, 0 AS t, 0 AS h, 0 AS w, unnest(range(1, 65))::INT AS k, unnest(list(v ORDER BY c, t, h, w)) AS v FROM g GROUP BY vid""")
def g5_block_pack(spark, sf_dir):
    packed = G.block_pack(wide(spark, sf_dir), WIDE, (2, 2, 2))
    return packed.select("vid", "t", "h", "w", F.posexplode("feature").alias("k", "v")).withColumn("k", F.col("k") + 1)


@query(f"""WITH {GRID} SELECT vid, (t // 3)::INT AS t, (h // 3)::INT AS h, (w // 3)::INT AS w, count(*) AS n, list(v ORDER BY t, h, w)[2] AS second
FROM g WHERE t < 3 AND h < 3 AND w < 3 GROUP BY ALL""")
def g17_truncate_pack(spark, sf_dir):
    packed = G.block_pack(grid(spark, sf_dir), SHAPE, (3, 3, 3), channel_first=False, pad=False)
    return packed.select("vid", "t", "h", "w", F.size("feature").cast("long").alias("n"), F.element_at("feature", 2).alias("second"))


_BINS3 = "b AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)) AS b(i, x))"


@query(f"""WITH {GRID}, {_BINS3} SELECT vid, bt.i AS t, bh.i AS h, bw.i AS w, c, round(avg(v), 6) AS v
FROM g JOIN b bt ON g.t = bt.x JOIN b bh ON g.h = bh.x JOIN b bw ON g.w = bw.x GROUP BY ALL""")
def g6_adaptive_avg(spark, sf_dir):
    return rounded(G.adaptive_pool(grid(spark, sf_dir), SHAPE, (3, 3, 3)))


@query(f"""WITH {GRID}, {_BINS3} SELECT vid, bt.i AS t, bh.i AS h, bw.i AS w, c, max(v) AS v
FROM g JOIN b bt ON g.t = bt.x JOIN b bh ON g.h = bh.x JOIN b bw ON g.w = bw.x GROUP BY ALL""")
def g7_adaptive_max(spark, sf_dir):
    return G.adaptive_pool(grid(spark, sf_dir), SHAPE, (3, 3, 3), "max")


@query(f"""WITH {GRID}, k AS (SELECT * FROM (VALUES (0, 0, 0.5), (0, 1, 0.5), (1, 2, 0.5), (1, 3, 0.5)) AS k(i, x, q))
SELECT vid, kt.i AS t, kh.i AS h, kw.i AS w, c, round(sum(v * kt.q * kh.q * kw.q), 6) AS v
FROM g JOIN k kt ON g.t = kt.x JOIN k kh ON g.h = kh.x JOIN k kw ON g.w = kw.x GROUP BY ALL""")
def g8_trilinear(spark, sf_dir):
    return rounded(G.trilinear(grid(spark, sf_dir), SHAPE, (2, 2, 2)))


@query(f"""WITH {GRID} SELECT vid, (t // 3)::INT AS t, (h // 3)::INT AS h, (w // 3)::INT AS w, c, v FROM g WHERE t % 3 = 0 AND h % 3 = 0 AND w % 3 = 0""")
def g9_nearest(spark, sf_dir):
    return G.nearest(grid(spark, sf_dir), SHAPE, (2, 2, 2))


@query(f"""WITH {GRID}, a AS (SELECT unnest(range(6))::INT AS x), b AS (SELECT unnest(range(2))::INT AS x)
SELECT e.vec_id AS vid, i.x AS t, j.x AS h, k.x AS w, 0 AS c, coalesce(v, -1.0) AS v
FROM embeddings e, a i, b j, a k LEFT JOIN g ON g.vid = e.vec_id AND g.t = i.x - 1 AND g.h = j.x + 1 AND g.w = k.x - 1""")
def g10_centre_crop(spark, sf_dir):
    return G.centre_crop(grid(spark, sf_dir), SHAPE, (6, 2, 6), -1.0)


@query(f"WITH {GRID} SELECT vid, t, h, w, v FROM g WHERE t < 1")
def g11_depth_crop(spark, sf_dir):
    return G.depth_crop(grid(spark, sf_dir), 4).select("vid", "t", "h", "w", "v")


@query(f"WITH {GRID} SELECT vid, t, (h // 2)::INT AS h, (w // 2)::INT AS w, ((c * 2 + h % 2) * 2 + w % 2)::INT AS c, v FROM g")
def g12_space_to_depth(spark, sf_dir):
    return G.space_to_depth(grid(spark, sf_dir))


@query(f"WITH {GRID} SELECT vid, t, h, w, c, v FROM g")
def g12_depth_to_space(spark, sf_dir):
    return G.depth_to_space(G.space_to_depth(grid(spark, sf_dir)))


@query(f"WITH {GRID} SELECT vid, w AS t, 3 - h AS h, t AS w, c, v FROM g")
def g14_transpose_flip(spark, sf_dir):
    return G.transposed(grid(spark, sf_dir), ("w", "h", "t"), SHAPE, ("h",))


_CLASS = "CASE WHEN v < -0.1 THEN 0 WHEN v < 0.1 THEN 1 ELSE 2 END"


def classes(df: DataFrame) -> DataFrame:
    return df.withColumn("class_id", F.expr(_CLASS))


@query(f"""WITH {GRID}, k AS (SELECT *, {_CLASS} AS class_id FROM g)
SELECT vid, (t // 2)::INT AS t, (h // 2)::INT AS h, (w // 2)::INT AS w, avg((class_id = 0)::INT) AS class_0, avg((class_id = 2)::INT) AS class_2 FROM k GROUP BY ALL""")
def g15_class_fraction(spark, sf_dir):
    return G.class_fraction(classes(grid(spark, sf_dir)), [0, 2], (2, 2, 2))


@query(f"""WITH {GRID}, k AS (SELECT *, {_CLASS} AS class_id FROM g)
SELECT vid, (t // 2)::INT AS t, (h // 2)::INT AS h, (w // 2)::INT AS w, avg(CASE class_id WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS findings FROM k GROUP BY ALL""")
def g16_finding_count(spark, sf_dir):
    """Findings that each class stands for, looked up, and averaged over blocks."""
    lookup = spark.createDataFrame([(0, 2), (2, 1)], "class_id int, n int")
    cells = classes(grid(spark, sf_dir)).join(F.broadcast(lookup), "class_id", "left").withColumn("v", F.coalesce("n", F.lit(0)).cast("double"))
    return G.block_average(cells, SHAPE, (2, 2, 2)).select("vid", "t", "h", "w", F.col("v").alias("findings"))


@query(f"""WITH {GRID}, k AS (SELECT vid, pos, t, {_CLASS} AS class_id FROM g), f AS (SELECT vid, t AS pos, class_id, count(*) / 16 AS frac FROM k GROUP BY ALL),
s AS (SELECT vid, pos, class_id // 2 AS bit, sum(frac) AS frac FROM f GROUP BY ALL)
SELECT vid, pos, bit_or(CASE WHEN frac > 0.25 THEN 1 << bit ELSE 0 END)::INT AS mask FROM s GROUP BY ALL""")
def a26_group_bitmask(spark, sf_dir):
    cells = classes(grid(spark, sf_dir))
    fractions = cells.groupBy("vid", F.col("t").alias("pos"), "class_id").agg((F.count("*") / 16).alias("frac"))
    bits = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "class_id int, bit int")
    return G.group_bits(fractions, F.broadcast(bits), 0.25)


@query(f"""WITH {GRID}, d AS (SELECT * FROM (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) AS d(dt, dh, dw)),
m AS (SELECT vid, pos, t + dt AS t, h + dh AS h, w + dw AS w FROM g, d) SELECT m.vid, m.pos AS a, g.pos AS b FROM m JOIN g USING (vid, t, h, w)""")
def j17_neighbours(spark, sf_dir):
    return G.neighbours(grid(spark, sf_dir), SHAPE)


@query("""WITH p AS (SELECT vec_id AS vid, unnest(range(64)) AS a FROM embeddings), d AS (SELECT *, unnest([-16, -4, -1, 1, 4, 16]) AS d FROM p)
SELECT vid, a::INT AS a, string_agg((a + d)::VARCHAR, ',' ORDER BY a + d) AS near FROM d WHERE a + d BETWEEN 0 AND 63 AND abs(d) >= 16
OR abs(d) = 4 AND a // 16 = (a + d + 64) // 16 - 4 OR abs(d) = 1 AND a // 4 = (a + d + 64) // 4 - 16 GROUP BY vid, a""")
def j17_neighbour_lists(spark, sf_dir):
    """The neighbours of each cell as one text, by places alone in SQL."""
    near = G.neighbours(grid(spark, sf_dir), SHAPE).groupBy("vid", "a").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return near.select("vid", F.col("a").cast("int").alias("a"), F.array_join("b", ",").alias("near"))


@query(f"WITH {GRID} SELECT vid, pos, round(abs(v) * 64 / sum(abs(v)) OVER (PARTITION BY vid), 6) AS weight FROM g")
def a28_mean_one(spark, sf_dir):
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), F.abs("v").alias("weight"))
    return rounded(G.mean_one(cells), "weight")


@query(f"""WITH {GRID}, m AS (SELECT vid, pos, 0.7 * abs(v) + 0.3 AS k, t FROM g)
SELECT vid, pos, round(k * 32 / sum(k) OVER (PARTITION BY vid), 6) AS weight FROM m WHERE t BETWEEN 1 AND 2""")
def g18_weight_crop(spark, sf_dir):
    """Mixed with a uniform weight, cropped by the step, and scaled to a mean of 1 again."""
    mixed = grid(spark, sf_dir).withColumn("v", S.uniform_mix(F.abs("v"), 0.3))
    cut = G.step_crop(mixed, 2, 4, 2)
    cells = cut.select("vid", (F.col("t") + 1).alias("t"), "h", "w", F.col("v").alias("weight"))
    return rounded(G.mean_one(cells).select("vid", G.position(SHAPE).alias("pos"), "weight"), "weight")


@query(f"WITH {GRID} SELECT vid, round(avg(abs(v - 0.1) * (1 + abs(v))), 6) AS loss FROM g GROUP BY vid")
def g19_weighted_l1(spark, sf_dir):
    return grid(spark, sf_dir).groupBy("vid").agg(F.round(F.avg(F.abs(F.col("v") - 0.1) * (1 + F.abs("v"))), 6).alias("loss"))


@query(f"""WITH {GRID}, s AS (SELECT vid, pos, row_number() OVER (PARTITION BY vid ORDER BY abs(v) DESC, pos) AS r FROM g)
SELECT vid, pos, (row_number() OVER (PARTITION BY vid ORDER BY pos) - 1)::INT AS token FROM s WHERE r <= 8""")
def t2_top_norm(spark, sf_dir):
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), F.abs("v").alias("score"))
    return G.top_tokens(cells, 8).select("vid", "pos", "token")


@query(f"""WITH {GRID}, s AS (SELECT vid, pos, t + 1e-6 * (abs(v) / (max(abs(v)) OVER (PARTITION BY vid) + 1e-9)) AS k FROM g),
r AS (SELECT vid, pos, row_number() OVER (PARTITION BY vid ORDER BY k DESC, pos) AS r FROM s) SELECT vid, pos FROM r WHERE r <= 20""")
def t3_top_importance(spark, sf_dir):
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), F.col("t").cast("double").alias("importance"), F.abs("v").alias("norm"))
    return G.top_tokens(G.tied_score(cells), 20).select("vid", "pos")


@query(f"""WITH {GRID} SELECT vid, pos, v FROM g WHERE pos IN (SELECT round_even(i * 63 / 9, 0) FROM (SELECT unnest(range(10)) AS i))""")
def t4_strided(spark, sf_dir):
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), "v")
    return cells.where(F.col("pos").isin(*G.strided_places(64, 10)))


@query(f"""WITH {GRID} SELECT vid, pos, v FROM g QUALIFY row_number() OVER (PARTITION BY vid ORDER BY md5(vid || ':' || pos || ':2026'), pos) <= 8""")
def t5_hashed_sample(spark, sf_dir):
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), "v")
    return G.hashed_sample(cells, 8, 2026)


@query(f"""WITH {GRID}, s AS (SELECT vid, pos, v, row_number() OVER (PARTITION BY vid ORDER BY abs(v) DESC, pos) AS r FROM g),
f AS (SELECT vid, 8 + row_number() OVER (PARTITION BY vid ORDER BY pos) - 1 AS token, v FROM s WHERE r <= 8)
SELECT vid, token::INT AS token, round(v, 6) AS v FROM f UNION ALL
SELECT vid, (t // 2 * 4 + h // 2 * 2 + w // 2)::INT, round(avg(v), 6) FROM g GROUP BY ALL""")
def t6_regroup(spark, sf_dir):
    return rounded(G.regrouped(grid(spark, sf_dir), SHAPE, 16).select("vid", "token", "v"))


@query(f"WITH {GRID} SELECT vid, (t - 2)::INT AS t, h, w, v FROM g WHERE t BETWEEN 2 AND 3")
def t14_depth_window(spark, sf_dir):
    return G.step_crop(grid(spark, sf_dir), 1, 4, 2).select("vid", F.col("t").cast("int").alias("t"), "h", "w", "v")


@query(f"WITH {GRID}, {LABELS} SELECT vid, region, c, round(avg(v), 6) AS v FROM l GROUP BY ALL")
def a1_region_mean(spark, sf_dir):
    df = grid(spark, sf_dir)
    return rounded(R.region_means(df, block_labels(df), SHAPE).select("vid", "region", "c", "v"))


@query(f"""WITH {GRID}, {LABELS} SELECT vid, region, count(*) AS cells, round(avg(t / 4), 6) AS t_mean, round(avg(w / 4), 6) AS w_mean,
round(sqrt(greatest(avg(h / 4 * h / 4) - avg(h / 4) * avg(h / 4), 0)), 6) AS h_extent FROM l GROUP BY ALL""")
def a2_region_places(spark, sf_dir):
    places = R.region_places(block_labels(grid(spark, sf_dir)), SHAPE)
    return rounded(places.select("vid", "region", "cells", "t_mean", "w_mean", "h_extent"), "t_mean", "w_mean", "h_extent")


@query(f"""WITH {GRID}, {LABELS}, p AS (SELECT vid, region, avg(t / 4) AS a, avg(h / 4) AS b, avg(w / 4) AS c FROM l GROUP BY ALL),
k AS (SELECT unnest(range(2)) AS k),
d AS (SELECT vid, region, k AS dim, sin(a * 2 ** k * pi()) AS x FROM p, k UNION ALL SELECT vid, region, k + 2, cos(a * 2 ** k * pi()) FROM p, k
UNION ALL SELECT vid, region, k + 4, sin(b * 2 ** k * pi()) FROM p, k UNION ALL SELECT vid, region, k + 6, cos(b * 2 ** k * pi()) FROM p, k
UNION ALL SELECT vid, region, k + 8, sin(c * 2 ** k * pi()) FROM p, k UNION ALL SELECT vid, region, k + 10, cos(c * 2 ** k * pi()) FROM p, k)
SELECT vid, region, dim::INT AS dim, round(x / greatest(stddev_pop(x) OVER (PARTITION BY vid, dim) + 1e-6, 0.1), 6) + 0.0 AS value FROM d""")
def f22_position_block(spark, sf_dir):
    places = R.region_places(block_labels(grid(spark, sf_dir)), SHAPE)
    return rounded(R.position_block(places, 2).select("vid", "region", "dim", "value"), "value").withColumn("value", F.col("value") + 0.0)


@query(f"""WITH {GRID}, {LABELS}, p AS (SELECT vid, region, avg(t / 4) AS a FROM l GROUP BY ALL), s AS (SELECT vid, stddev_pop(v) + 1e-6 AS s FROM g GROUP BY vid),
d AS (SELECT vid, region, sin(a * pi()) AS x FROM p)
SELECT vid, region, round(x / greatest(stddev_pop(x) OVER (PARTITION BY vid) + 1e-6, 0.1) * 0.5 * s, 6) AS value FROM d JOIN s USING (vid)""")
def r5_scaled_positions(spark, sf_dir):
    df = grid(spark, sf_dir)
    block = R.position_block(R.region_places(block_labels(df), SHAPE), 1).where("dim = 0")
    return rounded(R.scaled_positions(block, df, 0.5).select("vid", "region", "value"), "value")


@query(f"""WITH {GRID}, {LABELS} SELECT vid, region, round(avg(v), 6) AS v, round(avg(t / 4), 6) AS t_mean FROM l GROUP BY ALL""")
def r4_block_centroid(spark, sf_dir):
    df = grid(spark, sf_dir)
    labels = block_labels(df)
    means = R.region_means(df, labels, SHAPE).select("vid", "region", "v")
    return rounded(means.join(R.region_places(labels, SHAPE).select("vid", "region", "t_mean"), ["vid", "region"]), "v", "t_mean")


@query(f"""WITH {GRID}, a AS (SELECT unnest(range(6)) AS x),
m AS (SELECT vid, (i.x // 3 * 4 + j.x // 3 * 2 + k.x // 3)::INT AS region, avg(v) AS v FROM g, a i, a j, a k WHERE g.t = least(i.x, 3) AND g.h = least(j.x, 3) AND g.w = least(k.x, 3) GROUP BY ALL),
s AS (SELECT vid, (stddev_pop(v) + 1e-6) * 0.5 / (0.25 + 1e-6) AS s FROM g GROUP BY vid), d AS (SELECT unnest([4, 2, 1]) AS bit, unnest([1, 2, 3]) AS c)
SELECT vid, region, 0 AS c, round(v, 6) AS v FROM m UNION ALL SELECT vid, region, c::INT, round((1 + 3 * (region // bit % 2)) / 6 * s, 6) FROM m JOIN s USING (vid), d""")
def r4_block_tokens(spark, sf_dir):
    """Blocks of 3^3 of a grid that is padded for them, with raw centroids in parts of the padded sizes."""
    return rounded(R.block_tokens(grid(spark, sf_dir), SHAPE, 1, 3, centroid=True, scale=0.5).select("vid", "region", "c", "v"))


_UNEVEN = "CASE WHEN t + h + w = 0 THEN 0 WHEN t < 2 AND h < 3 AND w < 2 THEN 1 ELSE 2 END"


@query(f"""WITH {GRID}, l AS (SELECT *, {_UNEVEN} AS region FROM g), s AS (SELECT vid, (stddev_pop(v) + 1e-6) * 2 AS s FROM g GROUP BY vid),
p AS (SELECT vid, region, avg(v) AS m, avg(t / 4) AS a, avg(h / 4) AS b, avg(w / 4) AS c, sqrt(greatest(avg(t / 4 * t / 4) - avg(t / 4) ** 2, 0)) AS d, sqrt(greatest(avg(h / 4 * h / 4) - avg(h / 4) ** 2, 0)) AS e, sqrt(greatest(avg(w / 4 * w / 4) - avg(w / 4) ** 2, 0)) AS f FROM l GROUP BY ALL),
q AS (SELECT vid, region, unnest([1, 2, 3, 4, 5, 6]) AS c, unnest([a, b, c, d, e, f]) AS x FROM p), n AS (SELECT vid, region, c, x / greatest(stddev_pop(x) OVER (PARTITION BY vid, c) + 1e-6, CASE WHEN c < 4 THEN 0.1 ELSE 0 END) AS x FROM q)
SELECT vid, region, 0 AS c, round(m, 5) AS v FROM p UNION ALL SELECT vid, region, c::INT, round(x * s, 5) FROM n JOIN s USING (vid)""")
def r1_tokens_with_places(spark, sf_dir):
    """Means of regions with raw centroids and extents as further channels."""
    df = grid(spark, sf_dir)
    labels = df.select("vid", G.position(SHAPE).alias("pos"), F.expr(_UNEVEN).alias("region"), F.lit(3).alias("budget")).distinct()
    made = R.region_tokens(df, labels, SHAPE, 1, centroid=True, scale=2.0, extent=True)
    return made.select("vid", "region", F.col("c").cast("int").alias("c"), F.round("v", 5).alias("v"))


@query(f"""WITH {GRID}, k AS (SELECT * FROM (VALUES (0, 0, 1.0), (1, 1, 0.5), (1, 2, 0.5), (2, 3, 1.0)) AS k(i, x, q))
SELECT vid, kt.i AS t, kh.i AS h, kw.i AS w, c, round(sum(v * kt.q * kh.q * kw.q), 6) AS v FROM g JOIN k kt ON g.t = kt.x JOIN k kh ON g.h = kh.x JOIN k kw ON g.w = kw.x GROUP BY ALL""")
def g9_linear_zoom(spark, sf_dir):
    return rounded(G.linear_zoom(grid(spark, sf_dir), SHAPE, (3, 3, 3)))


@query(f"""WITH {GRID}, m AS (SELECT vid, t, h, w, 0.7 * abs(v) + 0.3 AS v FROM g), k AS (SELECT unnest(range(8)) AS i), e AS (SELECT i, greatest(0, (i + 0.5) / 2 - 0.5) AS y FROM k),
q AS (SELECT i, floor(y)::INT AS x, 1 - (y - floor(y)) AS q FROM e UNION ALL SELECT i, least(floor(y)::INT + 1, 3), y - floor(y) FROM e),
u AS (SELECT vid, a.i AS t, b.i AS h, c.i AS w, sum(v * a.q * b.q * c.q) AS v FROM m JOIN q a ON m.t = a.x JOIN q b ON m.h = b.x JOIN q c ON m.w = c.x GROUP BY ALL)
SELECT vid, (t - 4)::INT AS t, h::INT AS h, w::INT AS w, round(v / avg(v) OVER (PARTITION BY vid), 6) AS v FROM u WHERE t BETWEEN 4 AND 6""")
def g18_voxel_weights(spark, sf_dir):
    """Mixed, upsampled to 8 x 8 x 8, three layers by the step, and scaled to a mean of 1."""
    made = G.voxel_weights(grid(spark, sf_dir).withColumn("v", F.abs("v")), SHAPE, (8, 8, 8), 0.3, 2, 3)
    return rounded(made.select("vid", F.col("t").cast("int").alias("t"), "h", "w", "v"))


def _volumes(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    organ = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array((i < 32).cast("double"), (i >= 48).cast("double")))
    return e.select(F.col("vec_id").alias("vid"), F.transform("embedding", lambda x: F.array(x.cast("double"))).alias("features"), organ.alias("organ"))


@query()
def r1_ward_merge(spark, sf_dir):
    labels = R.region_labels(_volumes(spark, sf_dir), SHAPE, [8])
    return rounded(R.region_means(grid(spark, sf_dir), labels, SHAPE).select("vid", "region", "v"))


@query()
def r2_organ_merge(spark, sf_dir):
    return R.region_labels(_volumes(spark, sf_dir), SHAPE, [8], organ="organ", lam=1.0)


@query()
def r3_multi_budget(spark, sf_dir):
    """One tree for three budgets: the labels of each."""
    return R.region_labels(_volumes(spark, sf_dir), SHAPE, [27, 8, 4])


@query()
def r7_other_linkages(spark, sf_dir):
    average = R.region_labels(_volumes(spark, sf_dir), SHAPE, [8], linkage="average")
    return average.unionByName(R.region_labels(_volumes(spark, sf_dir), SHAPE, [8], linkage="complete", standardize=True))


@query(f"WITH {WIDE_GRID} SELECT vid, c, round(avg(v), 6) AS v FROM g GROUP BY ALL")
def m1_mean_pool(spark, sf_dir):
    return rounded(wide(spark, sf_dir).groupBy("vid", "c").agg(F.avg("v").alias("v")))


@query(f"""WITH {WIDE_GRID}, a AS (SELECT vid, pos, sum(v * (c + 1) / 8) AS z FROM g GROUP BY ALL),
k AS (SELECT vid, pos, exp(z) / sum(exp(z)) OVER (PARTITION BY vid) AS k FROM a)
SELECT vid, c, round(sum(v * k), 6) AS v FROM g JOIN k USING (vid, pos) GROUP BY ALL""")
def m2_attention_pool(spark, sf_dir):
    """Softmax of a given linear score of each cell, as weights of a mean."""
    made = L.attention_pool(_cells(spark, sf_dir), [[(c + 1) / 8 for c in range(8)]])
    return rounded(made.select("vid", F.posexplode("x").alias("c", "v")))


def _cells(spark, sf_dir):
    """(vid, pos, x): 8 cells of 8 channels."""
    chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.transform("embedding", lambda v: v.cast("double")), i * 8 + 1, 8))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.posexplode(chunks).alias("pos", "x"))


@query(f"""WITH {WIDE_GRID}, a AS (SELECT vid, pos, sum(v * (c + 1) / 8) + 0.1 AS p, sum(v * (c % 2)) - 0.2 AS q, sum(v * (c % 3)) + 0.3 AS r, sum(v * (7 - c) / 4) AS s FROM g WHERE pos < 6 GROUP BY ALL),
u AS (SELECT vid, pos, tanh(p) / (1 + exp(-r)) AS a, tanh(q) / (1 + exp(-s)) AS b FROM a), z AS (SELECT vid, pos, 0 AS head, 2 * a - b AS z FROM u UNION ALL SELECT vid, pos, 1, 900 * a + 3 * b FROM u),
k AS (SELECT vid, pos, head, exp(z - max(z) OVER (PARTITION BY vid, head)) AS k FROM z)
SELECT vid, head, c, round(sum(v * k) / sum(k), 6) AS v FROM g JOIN k USING (vid, pos) GROUP BY ALL""")
def m2_gated_attention(spark, sf_dir):
    """Two gated heads over the first six cells; one head's scores run into the hundreds."""
    channel = range(8)
    gate = ([[(c + 1) / 8 for c in channel], [c % 2 for c in channel]], [0.1, -0.2], [[c % 3 for c in channel], [(7 - c) / 4 for c in channel]], [0.3, 0.0])
    made = L.attention_pool(_cells(spark, sf_dir).withColumn("real", F.col("pos") < 6), [[2.0, -1.0], [900.0, 3.0]], gate, mask="real")
    return rounded(made.select("vid", "head", F.posexplode("x").alias("c", "v")))


@query(f"""WITH {GRID}, m AS (SELECT vid, t < 2 AS inside, v, avg(v) OVER (PARTITION BY vid, t // 2, h // 2, w // 2) AS b FROM g),
s AS (SELECT vid, count_if(inside)::BIGINT AS cells_in, count_if(NOT inside)::BIGINT AS cells_out, avg((v - b) ** 2) FILTER (inside) AS i, avg((v - b) ** 2) FILTER (NOT inside) AS o FROM m GROUP BY vid)
SELECT vid, cells_in, cells_out, round(i, 8) AS mse_in, round(o, 8) AS mse_out, round(log10(4 / i) / log10(4 / o), 5) AS ratio_psnr FROM s""")
def a33_split_reconstruction(spark, sf_dir):
    """Error of blocks replaced by their means, in the upper half of a grid and in the lower."""
    from tessera.operators import metrics as M

    cells = grid(spark, sf_dir).select("*", *[F.expr(f"{a} div 2").alias(f"b{a}") for a in "thw"])
    mean = cells.groupBy("vid", "bt", "bh", "bw").agg(F.avg("v").alias("b"))
    rows = cells.withColumnRenamed("v", "a").join(mean, ["vid", "bt", "bh", "bw"]).withColumn("inside", F.col("t") < 2)
    made = M.split_reconstruction(rows, 2.0, ["vid"])
    return made.select("vid", "cells_in", "cells_out", F.round("mse_in", 8).alias("mse_in"), F.round("mse_out", 8).alias("mse_out"), F.round("ratio_psnr", 5).alias("ratio_psnr"))


@query(f"""WITH {GRID} SELECT vid, round(sum(v * greatest(v, 0)) / greatest(sum(greatest(v, 0)), 1e-6), 6) AS v FROM g GROUP BY vid""")
def a29_mask_mean(spark, sf_dir):
    return rounded(G.masked_mean(grid(spark, sf_dir).withColumn("mask", F.greatest("v", F.lit(0.0))), ["vid"]))


@query(f"""WITH {GRID} SELECT vid, round(avg(v), 6) AS mean, arg_max(v, pos) AS last FROM g WHERE v > -0.05 GROUP BY vid""")
def a30_sequence_pool(spark, sf_dir):
    rows = grid(spark, sf_dir).withColumn("pos", G.position(SHAPE)).where("v > -0.05")
    return rounded(rows.groupBy("vid").agg(F.avg("v").alias("mean"), F.max_by("v", "pos").alias("last")), "mean")


@query("""WITH e AS (SELECT vec_id AS vid, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
n AS (SELECT vid, label, list_transform(x, lambda y: y / sqrt(list_dot_product(x, x))) AS x FROM e)
SELECT a.vid AS a, b.vid AS b, round(list_dot_product(a.x, b.x), 5) AS sim FROM n a JOIN n b ON a.label = b.label AND a.vid // 64 = b.vid // 64 AND a.vid < b.vid""")
def j15_same_key_similarity(spark, sf_dir):
    """Cosine of pairs with one key within batches of 64 volumes."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 64").alias("batch"), F.col("vec_id").alias("vid"), "label", S.unit(F.col("embedding")).alias("x"))
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.batch") == F.col("b.batch")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.vid") < F.col("b.vid")))
    return pairs.select(F.col("a.vid").alias("a"), F.col("b.vid").alias("b"), F.round(S.dot(F.col("a.x"), F.col("b.x")), 5).alias("sim"))


@query("""WITH e AS (SELECT vec_id AS vid, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings)
SELECT vid, round(sqrt(list_dot_product(x, x)), 6) AS norm, round(list_dot_product(list_transform(x, lambda y: y - 0.01), list_transform(range(64), lambda i: (i % 3 - 1)::DOUBLE)), 6) AS axis FROM e""")
def f24_f26_norm_and_projection(spark, sf_dir):
    axis = [float(i % 3 - 1) for i in range(64)]
    e = table(spark, sf_dir, "embeddings")
    made = e.select(F.col("vec_id").alias("vid"), S.norm(F.col("embedding")).alias("norm"), S.project(F.col("embedding"), [0.01] * 64, [axis])[0].alias("axis"))
    return rounded(made, "norm", "axis")


@query(f"""WITH {GRID}, s AS (SELECT vid, pos, avg(v) OVER (PARTITION BY pos) AS m, stddev_pop(v) OVER (PARTITION BY pos) + 1e-6 AS s, v FROM g)
SELECT vid, pos, round((v - m) / s, 6) AS z FROM s""")
def p10_standardise(spark, sf_dir):
    """By the figures of each place, joined back."""
    cells = grid(spark, sf_dir).select("vid", G.position(SHAPE).alias("pos"), "v")
    stats = cells.groupBy("pos").agg(F.avg("v").alias("m"), (F.stddev_pop("v") + 1e-6).alias("s"))
    return rounded(cells.join(stats, "pos").select("vid", "pos", ((F.col("v") - F.col("m")) / F.col("s")).alias("z")), "z")


@query(f"""WITH {GRID} SELECT vid, count(*) AS cells, round(avg((v - m) ** 2), 8) AS mse, round(10 * log10(4 / avg((v - m) ** 2)), 5) AS psnr
FROM (SELECT *, avg(v) OVER (PARTITION BY vid, t // 2, h // 2, w // 2) AS m FROM g) GROUP BY vid""")
def a33_reconstruction(spark, sf_dir):
    """Error of blocks replaced by their means."""
    from tessera.operators import metrics as M

    df = grid(spark, sf_dir)
    block = [F.expr(f"{a} div 2").alias(f"b{a}") for a in "thw"]
    cells = df.select("*", *block)
    mean = cells.groupBy("vid", "bt", "bh", "bw").agg(F.avg("v").alias("b"))
    made = M.reconstruction(cells.withColumnRenamed("v", "a").join(mean, ["vid", "bt", "bh", "bw"]), 2.0, ["vid"])
    return made.select("vid", "cells", F.round("mse", 8).alias("mse"), F.round("psnr", 5).alias("psnr"))


@query(f"""WITH {GRID} SELECT vid, round(sum(v), 6) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, round(avg((v >= 0.1)::INT), 6) AS share, count_if(v >= 0.1)::BIGINT AS n,
round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.9), 6) AS p90 FROM g GROUP BY vid""")
def a25_a35_map_statistics(spark, sf_dir):
    v = F.col("v")
    made = grid(spark, sf_dir).groupBy("vid").agg(
        F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg((v >= 0.1).cast("int")).alias("share"),
        F.count_if(v >= 0.1).alias("n"), F.stddev_pop(v).alias("sd"), F.percentile(v, F.lit(0.9)).alias("p90"),
    )
    return rounded(made, "total", "mean", "share", "sd", "p90")


@query(f"""WITH {GRID}, k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 2), (1, 3)) AS k(i, x))
SELECT vid, k.i AS grp, h, w, max(v) AS v FROM g JOIN k ON g.t = k.x GROUP BY ALL""")
def a27_mask_union(spark, sf_dir):
    """Layers as masks: the largest of those in a group."""
    groups = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (1, 3)], "grp int, t int")
    return grid(spark, sf_dir).join(F.broadcast(groups), "t").groupBy("vid", "grp", "h", "w").agg(F.max("v").alias("v"))
