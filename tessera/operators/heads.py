"""Trained read-outs: heads over a volume's tokens for several targets, some labels missing.

An Estimator and its Model in the manner of pyspark.ml, with parameters, saved and loaded.
Tokens (a flat array of a volume's tokens by channels) are normalised by token, pooled (by
their mean, or by gated attention of one or several heads) and taken through a network of
one hidden layer, or none. A step is a pass over the rows of its share: tasks add up the
gradients of their rows, groups of tasks those of theirs, and the driver those of GROUPS
groups. Missing labels have no part in loss or gradient.
The number of steps is fixed; a seed decides first weights and shares.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.numeric import gelu, gelu_slope, sigmoid

Weights = dict[str, np.ndarray]
#: Sums of gradients that the driver adds up, at most.
GROUPS = 16
#: Numbers of tokens that a task holds at a time.
NUMBERS = 1 << 21


def first_weights(channels: int, targets: int, readout: str, hidden: int, heads: int, scale: float, seed: int) -> Weights:
    """Normal weights of spread scale / sqrt(inputs), biases of 0."""
    rng = np.random.default_rng(seed)
    made: Weights = {}

    def layer(name: str, rows: int, columns: int) -> None:
        made[name] = rng.standard_normal((rows, columns)) * (scale / math.sqrt(rows))
        made[f"{name}_bias"] = np.zeros(columns)

    many = {"mean": 1, "attention": 1, "attention_multi": heads}[readout]
    if readout != "mean":
        layer("gate_tanh", channels, max(1, hidden))
        layer("gate_sigmoid", channels, max(1, hidden))
        layer("focus", max(1, hidden), many)
    if hidden:
        layer("inner", channels * many, hidden)
    layer("outer", hidden or channels * many, targets)
    return made


def normalised(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    """Tokens with a mean of 0 and a variance of 1 over their channels."""
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


def forward(x: np.ndarray, w: Weights) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Outputs of volumes x [volumes, tokens, channels], and what the gradient needs."""
    x = normalised(x)
    kept = {"x": x}
    if "focus" in w:
        kept["t"] = np.tanh(x @ w["gate_tanh"] + w["gate_tanh_bias"])
        kept["s"] = sigmoid(x @ w["gate_sigmoid"] + w["gate_sigmoid_bias"])
        z = (kept["t"] * kept["s"]) @ w["focus"] + w["focus_bias"]
        a = np.exp(z - z.max(1, keepdims=True))
        kept["a"] = a / a.sum(1, keepdims=True)
        pooled = np.matmul(kept["a"].transpose(0, 2, 1), x).reshape(len(x), -1)
    else:
        pooled = x.mean(1)
    kept["pooled"] = last = pooled
    if "inner" in w:
        kept["before"] = pooled @ w["inner"] + w["inner_bias"]
        kept["h"] = last = gelu(kept["before"])
    return last @ w["outer"] + w["outer_bias"], kept


def backward(d: np.ndarray, kept: dict[str, np.ndarray], w: Weights) -> Weights:
    """Gradients of the weights, for gradients d of the outputs."""
    g: Weights = {"outer": kept.get("h", kept["pooled"]).T @ d, "outer_bias": d.sum(0)}
    d = d @ w["outer"].T
    if "inner" in w:
        d = d * gelu_slope(kept["before"])
        g |= {"inner": kept["pooled"].T @ d, "inner_bias": d.sum(0)}
        d = d @ w["inner"].T
    if "focus" in w:
        x, a, t, s = kept["x"], kept["a"], kept["t"], kept["s"]
        of_a = np.matmul(x, d.reshape(len(x), a.shape[2], -1).transpose(0, 2, 1))
        z = a * (of_a - (a * of_a).sum(1, keepdims=True))
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g |= {"focus": flat(t * s).T @ flat(z), "focus_bias": flat(z).sum(0)}
        gate = z @ w["focus"].T
        for name, part in (("gate_tanh", gate * s * (1 - t * t)), ("gate_sigmoid", gate * t * s * (1 - s))):
            g |= {name: flat(x).T @ flat(part), f"{name}_bias": flat(part).sum(0)}
    return g


def loss_slope(out: np.ndarray, y: np.ndarray, task: str, weight: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Summed loss over known labels, its gradient by the outputs, and how many are known. NaN is unknown."""
    known = np.isfinite(y)
    y = np.where(known, y, 0.0)
    if task == "regress":
        d = (out - y) * known
        return float((d * d).sum()), 2 * d, int(known.sum())
    soft = lambda z: np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
    p = sigmoid(out)
    loss = (weight * y * soft(-out) + (1 - y) * soft(out)) * known
    return float(loss.sum()), (weight * y * (p - 1) + (1 - y) * p) * known, int(known.sum())


def by_length(tokens: pa.Array, channels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of volumes with equally many tokens, and those as [volumes, tokens, channels], in bounded parts."""
    at = tokens.offsets.to_numpy().astype(np.int64)
    flat = tokens.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(at)
    if tokens.null_count or (sizes % channels).any() or (sizes == 0).any():
        raise ValueError(f"every volume has to have tokens of {channels} channels")
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        step = max(1, NUMBERS // int(size))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            yield some, flat[at[some][:, None] + np.arange(size)].astype(np.float64).reshape(len(some), -1, channels)


def _labels(column: pa.Array, targets: int) -> np.ndarray:
    rows = column.to_pylist()
    if any(r is None or len(r) != targets for r in rows):
        raise ValueError(f"every row has to have {targets} labels, null where one is missing")
    return np.array(rows, np.float64).reshape(len(rows), targets)


def tree_summed(df: DataFrame, function: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum of function over batches: in tasks, in GROUPS groups of tasks, one sum at a time, and on the driver."""

    def rows(total: np.ndarray) -> pa.RecordBatch:
        group = TaskContext.get().partitionId() % GROUPS
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["g", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(width), False
        for batch in batches:
            if batch.num_rows:
                total, any_ = total + function(batch), True
        if any_:
            yield rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros(width), False
        for batch in batches:
            for part in batch.column("total"):
                total, any_ = total + np.frombuffer(part.as_buffer()), True
        if any_:
            yield rows(total)

    partial = df.mapInArrow(run, "g int, total binary").repartition(GROUPS, "g").mapInArrow(add, "g int, total binary")
    return sum((np.frombuffer(bytes(r["total"])) for r in partial.collect()), np.zeros(width))


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    made, at = {}, 0
    for k in sorted(like):
        made[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return made


@dataclass
class Steps:
    """AdamW, or plain steps, on one flat array of weights; gradients are shortened to `clip`."""

    rate: float
    decay: float
    clip: float
    plain: bool
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0
    taken: int = 0

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        size = float(np.linalg.norm(g))
        if self.clip and size > self.clip:
            g = g * (self.clip / (size + 1e-6))
        if self.plain:
            return w - self.rate * g
        self.taken += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        up = self.first / (1 - 0.9**self.taken)
        down = np.sqrt(self.second / (1 - 0.999**self.taken)) + 1e-8
        return w * (1 - self.rate * self.decay) - self.rate * up / down


class HeadParams(Params):
    tokensCol = Param(Params._dummy(), "tokensCol", "flat array of a volume's tokens by channels", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "array of predictions: in the targets' own units, or logits", TypeConverters.toString)
    channels = Param(Params._dummy(), "channels", "channels of a token", TypeConverters.toInt)
    task = Param(Params._dummy(), "task", "regress or classify", TypeConverters.toString)

    def _own_defaults(self) -> None:
        self._setDefault(tokensCol="tokens", predictionCol="y_pred", channels=1, task="regress")


class MaskedHead(Estimator, HeadParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits a read-out to (tokens, labels), labels an array of doubles in which null or NaN is missing."""

    labelsCol = Param(Params._dummy(), "labelsCol", "array of labels, null where one is missing", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "id that deals rows to steps", TypeConverters.toString)
    readout = Param(Params._dummy(), "readout", "mean, attention or attention_multi", TypeConverters.toString)
    hidden = Param(Params._dummy(), "hidden", "width of the hidden layer, 0 for none, and of attention", TypeConverters.toInt)
    heads = Param(Params._dummy(), "heads", "heads of attention_multi", TypeConverters.toInt)
    epochs = Param(Params._dummy(), "epochs", "passes over all rows", TypeConverters.toInt)
    steps = Param(Params._dummy(), "steps", "steps of an epoch, each over a share of the rows", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "step size", TypeConverters.toFloat)
    decay = Param(Params._dummy(), "decay", "weight decay", TypeConverters.toFloat)
    clip = Param(Params._dummy(), "clip", "longest gradient, 0 for any", TypeConverters.toFloat)
    plain = Param(Params._dummy(), "plain", "plain steps instead of AdamW", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "spread of first weights", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "seed of first weights and shares", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._own_defaults()
        self._setDefault(labelsCol="y", idCol="vid", readout="attention_multi", hidden=256, heads=4, epochs=10, steps=1, rate=1e-3, decay=1e-2, clip=1.0, plain=False, scale=1.0, seed=0)
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> MaskedHeadModel:
        model = None
        for model in self.fitted_epochs(dataset):
            pass
        if model is None:
            raise ValueError("epochs has to be 1 at least")
        return model

    def fitted_epochs(self, dataset: DataFrame) -> Iterator[MaskedHeadModel]:
        """The model after each epoch."""
        told = {p.name: self.getOrDefault(p) for p in self.params}
        if told["task"] not in ("regress", "classify") or told["readout"] not in ("mean", "attention", "attention_multi"):
            raise ValueError(f"task {told['task']} or readout {told['readout']} is unknown")
        tokens, labels, vid, channels = told["tokensCol"], told["labelsCol"], told["idCol"], told["channels"]
        y = F.transform(F.col(labels), lambda v: F.when(F.isnan(v.cast("double")), None).otherwise(v.cast("double")))
        rows = dataset.select(F.col(vid).alias("id"), F.col(tokens).cast("array<double>").alias("tokens"), y.alias("y")).where(F.exists("y", lambda v: v.isNotNull()))
        centre, spread, weight = self._scales(rows, told["task"])
        targets = len(centre)
        w = first_weights(channels, targets, told["readout"], told["hidden"], told["heads"], told["scale"], told["seed"])
        values = flat(w)
        way = Steps(told["rate"], told["decay"], told["clip"], told["plain"])
        for epoch in range(1, told["epochs"] + 1):
            for step in range(told["steps"]):
                share = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(told["seed"]), F.lit(epoch)), F.lit(told["steps"])) == step
                now = shaped(values, w)

                def slopes(batch: pa.RecordBatch, now=now) -> np.ndarray:
                    y = (_labels(batch.column("y"), targets) - centre) / spread
                    total = np.zeros(len(values) + 2)
                    for places, x in by_length(batch.column("tokens"), channels):
                        out, kept = forward(x, now)
                        loss, d, known = loss_slope(out, y[places], told["task"], weight)
                        total[:-2] += flat(backward(d, kept, now))
                        total[-2:] += loss, known
                    return total

                made = tree_summed(rows if told["steps"] == 1 else rows.where(share), slopes, len(values) + 2)
                if made[-1] and np.isfinite(made).all():
                    values = way.step(values, made[:-2] / made[-1])
            yield self._copyValues(MaskedHeadModel(shaped(values, w), centre, spread))

    @staticmethod
    def _scales(rows: DataFrame, task: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means and spreads to normalise labels by (0 and 1 for classes), and weights of positives."""
        v = F.col("v")
        told = rows.select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.avg(v).alias("m"), F.stddev_pop(v).alias("s")).orderBy("k").collect()
        if not told:
            raise ValueError("no row has a label")
        mean, sd = (np.array([np.nan if r[c] is None else r[c] for r in told], float) for c in ("m", "s"))
        if task == "regress":
            return np.nan_to_num(mean), np.nan_to_num(sd) + 1e-6, np.ones(len(told))
        share = np.clip(np.nan_to_num(mean), 1e-3, 1 - 1e-3)
        return np.zeros(len(told)), np.ones(len(told)), np.minimum((1 - share) / share, 100.0)


class MaskedHeadModel(Model, HeadParams, MLWritable, MLReadable):
    """Adds predictions: in the units of the labels, or logits of classes."""

    def __init__(self, weights: Weights, centre: np.ndarray, spread: np.ndarray):
        super().__init__()
        self._own_defaults()
        self.weights, self.centre, self.spread = weights, centre, spread

    def _transform(self, dataset: DataFrame) -> DataFrame:
        name, made = self.getOrDefault(self.tokensCol), self.getOrDefault(self.predictionCol)
        channels, targets = self.getOrDefault(self.channels), len(self.centre)
        if made in dataset.columns:
            raise ValueError(f"there is a column {made} already")
        shared = dataset.sparkSession.sparkContext.broadcast((self.weights, self.centre, self.spread))
        schema = T.StructType([*dataset.schema.fields, T.StructField(made, T.ArrayType(T.DoubleType()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, centre, spread = shared.value
            for batch in batches:
                out = np.zeros((batch.num_rows, targets))
                for places, x in by_length(batch.column(name).cast(pa.list_(pa.float64())), channels):
                    out[places] = forward(x, weights)[0] * spread + centre
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * targets), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, made])

        return dataset.mapInArrow(run, schema)

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: MaskedHeadModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession)
        every = model.weights | {"_centre": model.centre, "_spread": model.spread}
        rows = [(k, list(v.shape), v.ravel().tolist()) for k, v in every.items()]
        self.sparkSession.createDataFrame(rows, "name string, shape array<int>, numbers array<double>").coalesce(1).write.parquet(f"{path}/weights")


class _ModelReader(MLReader):
    def load(self, path: str) -> MaskedHeadModel:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        told = DefaultParamsReader.loadMetadata(path, spark)
        every = {r["name"]: np.array(r["numbers"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/weights").collect()}
        centre, spread = every.pop("_centre"), every.pop("_spread")
        model = MaskedHeadModel(every, centre, spread)
        model._resetUid(told["uid"])
        DefaultParamsReader.getAndSetParams(model, told)
        return model
