"""A family's run from end to end: tokens, labels, a read-out for each seed, scores by epoch.

Tokens are compressed once and written; each family trains on them for each seed, and after
each epoch its validation rows are scored. Scores go to a log by seed and epoch, predictions
to a table by seed and epoch; a run that is started again replaces its rows, seed by seed
and epoch by epoch, after the first epoch of the first seed has started the log anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import grid as G
from tessera.operators import metrics as M
from tessera.operators.heads import MaskedHead, MaskedHeadModel
from tessera.plans.experiments import Experiment, Family, transformed
from tessera.sources.readers import label_csv
from tessera.sources.writers import append_epoch


@dataclass(frozen=True)
class Labels:
    """Targets in the order of the label file's header, and (vid, y), y an array with null where one is missing."""

    names: list[str]
    rows: DataFrame


@dataclass
class Split:
    """The tokens (vid, tokens) of a split, and its labels by family."""

    tokens: DataFrame
    labels: dict[str, Labels] = field(default_factory=dict)


def family_labels(spark: SparkSession, path: str, family: Family, id_col: str = "VolumeName") -> Labels:
    """Labels by the file's header; the family's log columns are taken by log(1 + scale x). Of an id's rows the smallest counts."""
    raw = label_csv(spark, path, id_col)
    names = [c for c in raw.columns if c != "vid"]
    if lost := [k for k in family.log_columns if k >= len(names)]:
        raise ValueError(f"{path} has no columns {lost}, which {family.name} takes by their logarithm")

    finite = raw.withColumns({n: S.finite_or_null(F.col(f"`{n}`")) for n in names})
    y = F.array(*[F.col(f"`{n}`") for n in names])
    return Labels(names, transformed(family, finite).select("vid", y.alias("y")).groupBy("vid").agg(F.min("y").alias("y")))


def token_sets(made: DataFrame, grid: DataFrame, shape: G.Shape) -> DataFrame:
    """(vid, tokens) of what a compressor gives: a volume's tokens, one after the other, as one flat array."""
    columns = set(made.columns)
    if "feature" in columns:
        parts = made.select("vid", F.struct(*G.AXES).alias("at"), "feature")
        ordered = F.array_sort(F.collect_list(F.struct("at", "feature")))
        return parts.groupBy("vid").agg(F.flatten(F.transform(ordered, lambda x: x["feature"])).alias("tokens"))
    if "v" not in columns:
        # Places of tokens, whose features are those of the grid.
        made = grid.withColumn("pos", G.position(shape)).join(made.select("vid", "pos", "token"), ["vid", "pos"])
        columns = {"token"}
    place = F.struct(*G.AXES) if "t" in columns else F.col("region" if "region" in columns else "token")
    ordered = F.array_sort(F.collect_list(F.struct(place.alias("at"), "c", "v")))
    return made.groupBy("vid").agg(F.transform(ordered, lambda x: x["v"]).alias("tokens"))


def token_channels(spark: SparkSession, experiment: Experiment) -> int:
    """Channels of a token, told by compressing one volume of zeros and ones."""
    t, h, w = experiment.shape
    many = t * h * w * experiment.channels
    one = spark.range(1).select(F.lit("0").alias("vid"), F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: (i % 7).cast("double")).alias("x"))
    made = experiment.plan(G.from_arrays(one, "vid", "x", experiment.shape, experiment.channels))
    if "feature" in made.columns:
        return made.select(F.size("feature")).first()[0]
    return made.agg(F.max("c")).first()[0] + 1 if "c" in made.columns else experiment.channels


def scores(predicted: DataFrame, family: Family, names: list[str]) -> DataFrame:
    """(target, metric, score) of (vid, y, y_pred): a row a target, then their mean, or macro and micro.

    Classes are named by the header and scored by AUROC, measured targets by their place and
    R2; a score that isn't defined is null. Scores are rounded to 4 places.
    """
    pairs = predicted.select("vid", F.posexplode(F.arrays_zip("y", "y_pred")).alias("k", "z")).select("k", F.col("z.y").alias("y_true"), F.col("z.y_pred").alias("y_pred"))
    known = pairs.where("y_true IS NOT NULL")
    every = predicted.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("k"))
    rounded = lambda c: F.round(c, 4).alias("score")
    if family.kind == "classify":
        ranked = known.select("k", F.col("y_true").cast("int").alias("label"), S.sigmoid(F.col("y_pred")).alias("score"))
        each = every.join(M.auroc(ranked, ["k"]).select("k", "auroc"), "k", "left")
        named = F.get(F.array(*map(F.lit, names)), F.col("k"))
        rows = each.select(named.alias("target"), F.lit("auroc").alias("metric"), rounded(F.col("auroc")))
        rows = rows.unionByName(each.agg(rounded(F.avg("auroc"))).select(F.lit("macro").alias("target"), F.lit("auroc").alias("metric"), "score"))
        micro = M.auroc(ranked).select(F.lit("micro").alias("target"), F.lit("auroc").alias("metric"), rounded(F.col("auroc")))
        return rows.unionByName(micro)
    each = every.join(M.r2(known, ["k"]).select("k", "r2"), "k", "left")
    rows = each.select(F.col("k").cast("string").alias("target"), F.lit("r2").alias("metric"), rounded(F.col("r2")))
    return rows.unionByName(each.agg(rounded(F.avg("r2"))).select(F.lit("mean").alias("target"), F.lit("r2").alias("metric"), "score"))


def run_family(experiment: Experiment, family: Family, train: Split, valid: Split, channels: int, out: str) -> None:
    """Trains for each seed of the experiment and writes scores and predictions of each epoch below out."""
    probe = experiment.probe
    mine, other = train.labels[family.name], valid.labels[family.name]
    if mine.names != other.names:
        raise ValueError(f"{family.name}: targets of training {mine.names} and validation {other.names} differ")
    rows = train.tokens.join(mine.rows, "vid")
    judged = valid.tokens.join(other.rows, "vid")
    for seed, epoch, model in trained(rows, family, experiment, channels):
        told = {"seed": F.lit(seed), "epoch": F.lit(epoch)}
        made = model.transform(judged)
        anew = seed == probe.seeds[0] and epoch == 1
        targets = F.array(*map(F.lit, other.names))
        matrix = made.select("vid", F.col("y").alias("y_true"), "y_pred", targets.alias("targets")).withColumns(told)
        append_epoch(matrix, f"{out}/predictions/{experiment.encoder}_{family.name}", anew)
        kept = made.sparkSession.read.parquet(f"{out}/predictions/{experiment.encoder}_{family.name}").where((F.col("seed") == seed) & (F.col("epoch") == epoch))
        log = scores(kept.withColumnRenamed("y_true", "y"), family, other.names)
        append_epoch(log.withColumns({"family": F.lit(family.name), **told}), f"{out}/scores/{experiment.encoder}_{family.name}", anew)
        if epoch == probe.epochs:
            model.write().overwrite().save(f"{out}/models/{experiment.encoder}_{family.name}_seed{seed}")


def trained(rows: DataFrame, family: Family, experiment: Experiment, channels: int) -> Iterator[tuple[int, int, MaskedHeadModel]]:
    probe = experiment.probe
    for seed in probe.seeds:
        head = MaskedHead(
            channels=channels, task=family.kind, readout=probe.readout or family.readout, hidden=probe.hidden, heads=probe.heads, epochs=probe.epochs, steps=probe.steps,
            rate=probe.rate, decay=probe.decay, clip=probe.clip, plain=probe.plain, scale=probe.scale, seed=seed,
        )
        for epoch, model in enumerate(head.fitted_epochs(rows), 1):
            yield seed, epoch, model


def run(spark: SparkSession, experiment: Experiment, families: dict[str, Family], train_grid: DataFrame, valid_grid: DataFrame, out: str, organ: DataFrame | None = None) -> None:
    """The whole run of an experiment: grids (vid, t, h, w, c, v) of both splits to scores below out."""
    if lost := [f for f in experiment.families if f not in experiment.labels]:
        raise ValueError(f"families {lost} have no label files")
    channels = token_channels(spark, experiment)
    splits = {}
    for name, grid in (("train", train_grid), ("valid", valid_grid)):
        path = f"{out}/tokens/{name}"
        token_sets(experiment.plan(grid, organ), grid, experiment.shape).withColumn("vid", F.col("vid").cast("string")).write.mode("overwrite").parquet(path)
        labels = {f: family_labels(spark, getattr(experiment.labels[f], name), families[f]) for f in experiment.families}
        splits[name] = Split(spark.read.parquet(path), labels)
    for name in experiment.families:
        run_family(experiment, families[name], splits["train"], splits["valid"], channels, out)


def score_log(spark: SparkSession, out: str, encoder: str, family: str) -> DataFrame:
    """The rows that a run wrote: seed, epoch, family, target, metric and score."""
    return spark.read.parquet(f"{out}/scores/{encoder}_{family}").select("seed", "epoch", "family", "target", "metric", "score")
