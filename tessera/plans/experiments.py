"""Experiments: validated configurations, catalogues, sweeps and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from typing import Any

from pydantic import BaseModel, ConfigDict, model_validator
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import grid as G
from tessera.operators import importance as I
from tessera.operators import learned as L
from tessera.operators import region as R
from tessera.plans.registry import Registry

COMPRESSORS = Registry("compressor")
READOUTS = Registry("readout")
IMPORTANCE = Registry("importance variant")


@COMPRESSORS.register("avgpack")
def avgpack(df: DataFrame, shape: G.Shape, r: int = 2) -> DataFrame:
    return G.block_average(df, shape, (r, r, r))


@COMPRESSORS.register("pack")
def pack(df: DataFrame, shape: G.Shape, r: int = 2) -> DataFrame:
    return G.block_pack(df, shape, (r, r, r))


@COMPRESSORS.register("uniform_pool")
def uniform_pool(df: DataFrame, shape: G.Shape, budget: int = 8) -> DataFrame:
    return G.adaptive_pool(df, shape, G.pool_shape(shape, budget))


@COMPRESSORS.register("trilinear")
def trilinear(df: DataFrame, shape: G.Shape, budget: int = 8) -> DataFrame:
    return G.trilinear(df, shape, G.pool_shape(shape, budget))


@COMPRESSORS.register("l2norm")
def l2norm(df: DataFrame, shape: G.Shape, budget: int = 8) -> DataFrame:
    tokens = df.groupBy("vid", G.position(shape).alias("pos")).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("score"))
    return G.top_tokens(tokens, budget)


@COMPRESSORS.register("regroup")
def regroup(df: DataFrame, shape: G.Shape, budget: int = 16, fine: int = -1) -> DataFrame:
    return G.regrouped(df, shape, budget, fine)


@COMPRESSORS.register("avgpack_places")
def avgpack_places(
    df: DataFrame, shape: G.Shape, channels: int = 1, r: int = 2, centroid_scale: float = 1.0, centroid_encoding: str = "raw", centroid_freqs: int = 4
) -> DataFrame:
    """Block averages with the blocks' positions as further channels."""
    return R.block_tokens(df, shape, channels, r, True, centroid_scale, centroid_encoding, centroid_freqs)


@COMPRESSORS.register("agglo_merge")
def agglo_merge(
    df: DataFrame, shape: G.Shape, budget: int, channels: int = 1, standardize: bool = False, centroid: bool = False, centroid_scale: float = 1.0,
    centroid_encoding: str = "raw", centroid_freqs: int = 4, extent: bool = False, connectivity: int | None = 6, linkage: str = "ward",
) -> DataFrame:
    """Means of the regions that adjacent cells are merged into."""
    labels = R.region_labels(R.volumes_of(df, shape), shape, [budget], standardize=standardize, linkage=linkage, connectivity=connectivity)
    return R.region_tokens(df, labels, shape, channels, centroid, centroid_scale, centroid_encoding, centroid_freqs, extent)


@COMPRESSORS.register("agglo_organ")
def agglo_organ(
    df: DataFrame, shape: G.Shape, budget: int, channels: int = 1, organ: DataFrame | None = None, lam: float = 0.5, centroid: bool = False,
    centroid_scale: float = 1.0, centroid_encoding: str = "raw", centroid_freqs: int = 4, extent: bool = False,
) -> DataFrame:
    """The same, guided by the organs of cells: organ (vid, t, h, w, grp, v) in long form."""
    guided = organ is not None and lam > 0
    volumes = R.volumes_of(df, shape, organ if guided else None)
    labels = R.region_labels(volumes, shape, [budget], organ="organ" if guided else None, lam=lam)
    return R.region_tokens(df, labels, shape, channels, centroid, centroid_scale, centroid_encoding, centroid_freqs, extent)


@IMPORTANCE.register("uniform")
def uniform(df: DataFrame) -> DataFrame:
    return df.withColumn("weight", F.lit(1.0))


@IMPORTANCE.register("findings")
def by_findings(df: DataFrame, share: float = 0.0) -> DataFrame:
    """The number of findings of a cell, mixed with a uniform share, to a mean of 1."""
    from tessera.functions.scalars import uniform_mix

    scaled = G.mean_one(df.withColumn("weight", F.col("findings").cast("double")))
    return scaled.withColumn("weight", uniform_mix(F.col("weight"), share))


@IMPORTANCE.register("organ_soft")
def by_organs(df: DataFrame, findings: DataFrame, shape: G.Shape, out: G.Shape, share: float = 0.0) -> DataFrame:
    """Findings of the organs of masks (vid, t, h, w, class_id), averaged over tokens."""
    return I.finished(I.pooled(I.organ_counts(df, findings), shape, out), share)


@IMPORTANCE.register("attention")
def by_attention(df: DataFrame, shape: G.Shape, out: G.Shape, share: float = 0.0) -> DataFrame:
    """Attention (vid, t, h, w, v), averaged over tokens."""
    return I.finished(I.pooled(df, shape, out), share)


@READOUTS.register("mean")
def mean_readout(df: DataFrame) -> DataFrame:
    return df.groupBy("vid", "c").agg(F.avg("v").alias("v"))


@READOUTS.register("attention")
def attention_readout(df: DataFrame, weights: list[float], gate: tuple[list, list, list, list], mask: str | None = None) -> DataFrame:
    """One gated head over cells (vid, pos, x)."""
    return L.attention_pool(df, [weights], gate, mask).select("vid", "x")


@READOUTS.register("attention_multi")
def multi_attention_readout(df: DataFrame, weights: list[list[float]], gate: tuple[list, list, list, list], mask: str | None = None) -> DataFrame:
    """Several gated heads, one after the other in x."""
    heads = L.attention_pool(df, weights, gate, mask).groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("head", "x"))).alias("h"))
    return heads.select("vid", F.flatten(F.transform("h", lambda h: h["x"])).alias("x"))


@dataclass(frozen=True)
class Family:
    """Targets that one read-out predicts, named by the header of their label files; log_columns are taken by log(1 + scale x)."""

    name: str
    kind: str
    log_scale: float | None = None
    readout: str = "attention_multi"
    role: str = "primary"
    log_columns: tuple[int, ...] = ()

    @property
    def metric(self) -> str:
        return "auroc" if self.kind == "classify" else "r2"


FAMILIES: dict[str, Family] = {}


def register_family(family: Family) -> None:
    if family.name in FAMILIES:
        raise KeyError(f"family {family.name} is registered twice")
    FAMILIES[family.name] = family


# Kinds, scales and places of logarithms, and read-outs of the families.
register_family(Family("disease", "classify", readout="attention"))
register_family(Family("disease_abdomen", "classify", readout="attention"))
register_family(Family("size", "regress"))
register_family(Family("size_abdomen", "regress"))
register_family(Family("density", "regress", 1000.0, log_columns=(0, 3)))
register_family(Family("density_abdomen", "regress"))
register_family(Family("location", "regress", role="aux"))
register_family(Family("location_abdomen", "regress"))
register_family(Family("radiomics", "regress", 1.0, log_columns=(0, 1)))


def transformed(family: Family, labels: DataFrame, id_col: str = "vid") -> DataFrame:
    """labels with the targets that the family takes by their logarithm, by place; null stays null."""
    names = [c for c in labels.columns if c != id_col]
    taken = [names[i] for i in family.log_columns if i < len(names)]
    return labels.withColumns({t: S.log_scaled(F.col(f"`{t}`"), family.log_scale or 1.0) for t in taken})


#: Budgets of an encoder that differ from those of the method.
BUDGETS: dict[tuple[str, str | None], list[int]] = {("avgpack", None): [8], ("uniform_pool", None): [8, 27], ("uniform_pool", "wide"): [1, 4]}


def budgets_for(method: str, encoder: str) -> list[int]:
    return BUDGETS.get((method, encoder)) or BUDGETS.get((method, None)) or []


def catalogue(spark: SparkSession, arms: dict[str, dict[str, Any]], sets: dict[str, list[str]] | None = None) -> DataFrame:
    """(arm, method, budget, folder, grid, dim, bundle_set) of the token sets that are stored.

    arms: by name, its method ("merge", "grid" for block averages), budgets, channels and,
    for merges, freqs of the position block and the organ weight. Regions have no lattice;
    block averages have a cube.
    """
    rows = []
    for name, arm in arms.items():
        for budget in arm["budgets"]:
            merged = arm["method"] == "merge"
            dim = arm["channels"] + (6 * arm.get("freqs", 4) if merged else 0)
            edge = round(budget ** (1 / 3))
            if not merged and edge**3 != budget:
                raise ValueError(f"{name}: {budget} is no cube")
            tail = f"_lam{str(arm['lam']).replace('.', 'p')}" if merged and "lam" in arm else ""
            rows.append((name, arm["method"], budget, f"{name}_b{budget}_d{dim}{tail}", [budget, 1, 1] if merged else [edge] * 3, dim))
    made = spark.createDataFrame(rows, "arm string, method string, budget int, folder string, grid array<int>, dim int")
    named = [(s, a) for s, members in (sets or {"all": list(arms)}).items() for a in members]
    return made.join(spark.createDataFrame(named, "bundle_set string, arm string"), "arm", "left")


#: Session settings: whether tokens are kept, where, and a list of the volumes that lack them.
NO_CACHE, CACHE_ROOT, UNCACHED_LIST = "spark.tessera.noCache", "spark.tessera.cacheRoot", "spark.tessera.uncachedList"


def cache_root(spark: SparkSession) -> str | None:
    """The folder of kept tokens, which driver and executors share; none where they aren't kept."""
    if spark.conf.get(NO_CACHE, "false").lower() in ("1", "true"):
        return None
    return (spark.conf.get(CACHE_ROOT, "") or "").rstrip("/") or None


def kept_ids(spark: SparkSession, path: str, vid: str = "vid") -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(vid).distinct()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def compress_shard(spark: SparkSession, experiment: Experiment, volumes: DataFrame, vid: str, array: str, shards: int = 1, shard: int = 0, split: str = "both") -> int:
    """Adds the tokens of one shard's volumes that aren't kept yet; how many volumes those were.

    A volume's shard is that of its id's hash, so that shards need no common numbering.
    volumes may have a column split ("train" or "valid").
    """
    root = cache_root(spark)
    if not root:
        raise ValueError(f"{CACHE_ROOT} has to name a shared folder")
    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    added = 0
    for part in ("train", "valid") if split == "both" else (split,):
        mine = volumes.where(F.pmod(F.xxhash64(F.col(vid).cast("string")), F.lit(shards)) == shard)
        if "split" in volumes.columns:
            mine = mine.where(F.col("split") == part)
        elif part == "valid" and split == "both":
            continue
        if listed := spark.conf.get(UNCACHED_LIST, ""):
            ids = spark.read.text(listed).select(F.trim("value").alias("_id")).where("_id <> ''")
            mine = mine.join(ids, F.col(vid).cast("string") == F.col("_id"), "left_semi")
        path = f"{root}/{experiment.exp_id}/{part}"
        done = kept_ids(spark, path)
        if done is not None:
            mine = mine.join(done.withColumnRenamed("vid", "_done"), F.col(vid) == F.col("_done"), "left_anti")
        if n := mine.select(vid).distinct().count():
            experiment.plan(G.from_arrays(mine, vid, array, experiment.shape, experiment.channels)).write.mode("append").parquet(path)
            added += n
    return added


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Compression(Strict):
    method: str
    budget: int | None = None
    params: dict[str, Any] = {}

    @model_validator(mode="after")
    def known(self) -> Compression:
        if self.method not in COMPRESSORS.entries:
            raise ValueError(f"unknown method {self.method}")
        names = COMPRESSORS.parameters(self.method) - {"df", "shape", "channels", "organ"}
        if lost := set(self.params) - names:
            raise ValueError(f"{self.method} has no parameters {sorted(lost)}")
        if "budget" in names and self.budget is None:
            raise ValueError(f"{self.method} needs a budget")
        return self


class Probe(Strict):
    """How read-outs are trained: seeds, epochs, and the parameters of tessera.operators.heads.MaskedHead."""

    seeds: list[int] = [0]
    epochs: int = 10
    readout: str | None = None
    hidden: int = 256
    heads: int = 4
    steps: int = 1
    rate: float = 1e-3
    decay: float = 1e-2
    clip: float = 1.0
    plain: bool = False
    scale: float = 1.0

    @model_validator(mode="after")
    def known(self) -> Probe:
        if not self.seeds or len(set(self.seeds)) != len(self.seeds) or self.epochs < 1 or self.steps < 1:
            raise ValueError("seeds have to differ, epochs and steps to be 1 at least")
        return self


class LabelFiles(Strict):
    train: str
    valid: str


class Experiment(Strict):
    exp_id: str
    encoder: str
    shape: tuple[int, int, int] = (4, 4, 4)
    channels: int = 1
    compression: Compression
    families: list[str] = []
    probe: Probe = Probe()
    labels: dict[str, LabelFiles] = {}

    @model_validator(mode="after")
    def known(self) -> Experiment:
        if lost := set(self.families) - set(FAMILIES):
            raise ValueError(f"unknown families {sorted(lost)}")
        if lost := set(self.labels) - set(self.families):
            raise ValueError(f"labels of families {sorted(lost)}, which aren't run")
        return self

    def plan(self, grid: DataFrame, organ: DataFrame | None = None) -> DataFrame:
        params = dict(self.compression.params)
        names = COMPRESSORS.parameters(self.compression.method)
        params |= {k: v for k, v in (("channels", self.channels), ("organ", organ)) if k in names}
        if self.compression.budget is not None and "budget" in COMPRESSORS.parameters(self.compression.method):
            params["budget"] = self.compression.budget
        return COMPRESSORS.apply(self.compression.method, grid, shape=self.shape, **params)


def sweep(spark: SparkSession, arms: list[dict[str, str]], families: list[str]) -> DataFrame:
    """A row for each arm and family; both are lists of the configuration."""
    cells = [(a["encoder"], a["method"], int(a["budget"]), f) for a in arms for f in families]
    rows = spark.createDataFrame(cells, "encoder string, method string, budget int, family string")
    return rows.withColumn("exp_id", F.concat_ws("_", F.lit("exp"), "method", "encoder", F.concat(F.lit("b"), "budget"), "family"))


def ordered_commands(commands: dict[str, list[str]]) -> list[str]:
    """Commands after those that they depend on; unknown ones and circles are errors."""
    done: list[str] = []
    open_: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        if name not in commands:
            raise ValueError(f"{open_[-1]} depends on {name}, which isn't there")
        if name in open_:
            raise ValueError(f"{' > '.join([*open_, name])} is a circle")
        open_.append(name)
        for other in commands[name]:
            visit(other)
        done.append(open_.pop())

    for name in commands:
        visit(name)
    return done


def main(argv: list[str] | None = None) -> int:
    """Compresses the grids of a Parquet table by a YAML configuration, or runs its families from end to end."""
    import yaml

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("config")
    parser.add_argument("--grids", required=True, help="Parquet with vid and a flat array")
    parser.add_argument("--out", help="where the tokens go, unless they are only kept")
    parser.add_argument("--policy", choices=("error", "skip", "overwrite"), default="error")
    parser.add_argument("--vid", default="vec_id")
    parser.add_argument("--array", default="embedding")
    parser.add_argument("--organ", help="Parquet with vid, t, h, w, grp and v")
    parser.add_argument("--run", action="store_true", help="train and score the configuration's families; --grids has a column split, or --valid-grids is given")
    parser.add_argument("--valid-grids", help="Parquet of the validation split")
    parser.add_argument("--compress-only", action="store_true", help=f"keep the tokens of a shard below {CACHE_ROOT}")
    parser.add_argument("--num-shards", type=int, default=1)
    parser.add_argument("--shard-id", type=int, default=0)
    parser.add_argument("--split", choices=("train", "valid", "both"), default="both")
    told = parser.parse_args(argv)
    if not told.compress_only and not told.out:
        parser.error("--out is needed")
    with open(told.config, encoding="utf-8") as file:
        experiment = Experiment.model_validate(yaml.safe_load(file))
    from tessera.sources.writers import write

    spark = SparkSession.builder.getOrCreate()
    volumes = spark.read.parquet(told.grids)
    if told.compress_only:
        compress_shard(spark, experiment, volumes, told.vid, told.array, told.num_shards, told.shard_id, told.split)
        return 0
    if told.run:
        from tessera.plans import family_run

        if not told.valid_grids and "split" not in volumes.columns:
            parser.error("--run needs --valid-grids, or grids with a column split")
        both = (volumes, spark.read.parquet(told.valid_grids)) if told.valid_grids else [volumes.where(F.col("split") == s) for s in ("train", "valid")]
        grids = [G.from_arrays(v, told.vid, told.array, experiment.shape, experiment.channels) for v in both]
        family_run.run(spark, experiment, FAMILIES, *grids, told.out, spark.read.parquet(told.organ) if told.organ else None)
        return 0
    if "split" in volumes.columns and told.split != "both":
        volumes = volumes.where(F.col("split") == told.split)
    grid = G.from_arrays(volumes, told.vid, told.array, experiment.shape, experiment.channels)
    write(experiment.plan(grid, spark.read.parquet(told.organ) if told.organ else None), told.out, told.policy)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
