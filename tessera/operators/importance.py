"""Importance maps of tokens: from attention that an encoder gave, or from organs that findings name.

A map has a weight for each token of a volume, of mean 1, mixed with a uniform share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import uniform_mix
from tessera.operators import grid as G
from tessera.sources.readers import named_npy_grids, npy_grids

#: Session setting: which of the stored attention maps is read, and the ones there are.
ATTENTION_VARIANT = "spark.tessera.attentionVariant"
VARIANTS = ("all", "last", "last4")


def attention_variant(spark: SparkSession) -> str:
    told = spark.conf.get(ATTENTION_VARIANT, VARIANTS[0])
    if told not in VARIANTS:
        raise ValueError(f"{ATTENTION_VARIANT} is {told}; known are {VARIANTS}")
    return told


def attention_scores(spark: SparkSession, root: str, split: str, shape: G.Shape, volumes: DataFrame | None = None) -> DataFrame:
    """(vid, t, h, w, v): attention received by each cell, a file a volume; a map of another shape is an error.

    volumes: (vid) of the volumes that are asked for, whose files are opened by name; all that the folder lists if not given.
    """
    folder = f"{root.rstrip('/')}/{split}/attn_received/{attention_variant(spark)}"
    maps = npy_grids(spark, folder) if volumes is None else named_npy_grids(volumes, folder)
    lattice = F.when(F.col("shape") != F.array(*map(F.lit, shape)), F.raise_error(F.concat(F.lit("another shape than the grid's: "), "vid"))).otherwise(F.col("features"))
    return G.from_arrays(maps.select("vid", lattice.alias("x")), "vid", "x", shape).drop("c")


def pooled(cells: DataFrame, shape: G.Shape, out: G.Shape) -> DataFrame:
    """(vid, t, h, w, weight) of the token grid: averages of (vid, t, h, w, v) over its bins."""
    made = G.adaptive_pool(cells.withColumn("c", F.lit(0)), shape, out)
    return made.select("vid", *G.AXES, F.col("v").alias("weight"))


def organ_counts(masks: DataFrame, findings: DataFrame) -> DataFrame:
    """(vid, t, h, w, v): how many findings name the class of each cell.

    masks: (vid, t, h, w, class_id); findings: (finding, class_id), a class once a finding.
    A volume without any class that is named is an error.
    """
    named = findings.select("finding", "class_id").distinct().groupBy("class_id").agg(F.count("*").alias("n"))
    each = masks.join(named, "class_id", "left").select("vid", *G.AXES, F.coalesce("n", F.lit(0)).cast("double").alias("v"))
    relevant = each.groupBy("vid").agg(F.max("v").alias("most"))
    checked = F.when(F.col("most") > 0, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("no organ that a finding names in "), F.col("vid").cast("string"))))
    return each.join(relevant, "vid").select("vid", *G.AXES, checked.alias("v"))


def finished(raw: DataFrame, share: float) -> DataFrame:
    """Weights of mean 1, mixed with a uniform share."""
    if not 0 <= share <= 1:
        raise ValueError(f"share {share} isn't between 0 and 1")
    return G.mean_one(raw).withColumn("weight", uniform_mix(F.col("weight"), share))


def importance_map(raw: Callable[[], DataFrame], lattice: DataFrame, share: float) -> DataFrame:
    """(vid, t, h, w, weight); a share of 1 is uniform on the lattice (vid, t, h, w), and raw isn't made."""
    if share == 1:
        return lattice.select("vid", *G.AXES, F.lit(1.0).alias("weight"))
    return finished(raw(), share)
