"""Read-outs and clusterings with Spark's own learners, and a score of images' structure."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.numeric import gelu


def pooled_vectors(cells: DataFrame, channels: int) -> DataFrame:
    """(vid, x): the mean of each channel over the cells of a volume."""
    means = [F.avg(F.when(F.col("c") == c, F.col("v"))) for c in range(channels)]
    return cells.groupBy("vid").agg(F.array(*means).alias("x"))


def linear_readout(train: DataFrame, test: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """Trains on (x, y) and gives (vid, y_true, y_pred) of test; rows without y aren't used."""
    model = LinearRegression(featuresCol="f", labelCol="y", regParam=ridge, solver="normal").fit(_vectors(train.where("y is not null")))
    return model.transform(_vectors(test)).select("vid", F.col("y").alias("y_true"), F.col("prediction").alias("y_pred"))


def logistic_readout(train: DataFrame, test: DataFrame, ridge: float = 1e-3) -> DataFrame:
    """The same for labels of 0 and 1; y_pred is a probability."""
    model = LogisticRegression(featuresCol="f", labelCol="y", regParam=ridge).fit(_vectors(train.where("y is not null")))
    made = model.transform(_vectors(test))
    return made.select("vid", F.col("y").alias("label"), vector_to_array("probability")[1].alias("score"))


def _vectors(df: DataFrame) -> DataFrame:
    return df.withColumn("f", array_to_vector(F.transform("x", lambda v: v.cast("double"))))


def _scored(cells: DataFrame, score) -> DataFrame:
    """(vid, pos, head, z): score takes a matrix of cells by channels and gives cells by heads."""
    kind = cells.schema["vid"].dataType.simpleString()

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            z = score(np.array(frame["x"].tolist(), float))
            heads = z.shape[1]
            yield pd.DataFrame({"vid": np.repeat(frame["vid"].to_numpy(), heads), "pos": np.repeat(frame["pos"].to_numpy(), heads), "head": np.tile(np.arange(heads), len(z)), "z": z.ravel()})

    return cells.select("vid", "pos", "x").mapInPandas(run, f"vid {kind}, pos int, head int, z double")


def attention_pool(cells: DataFrame, weights: list[list[float]], gate: tuple[list, list, list, list] | None = None, mask: str | None = None) -> DataFrame:
    """(vid, pos, x) pooled by the softmax of each head's score: (vid, head, x).

    weights: a row a head. gate: V, its bias, U, its bias, so that heads score
    tanh(V x + v) * sigmoid(U x + u) instead of x. Cells whose mask isn't true have no part.
    """
    w = np.array(weights, float)

    def score(x: np.ndarray) -> np.ndarray:
        if gate is not None:
            v, v0, u, u0 = (np.array(p, float) for p in gate)
            x = np.tanh(x @ v.T + v0) / (1 + np.exp(-np.clip(x @ u.T + u0, -700, 700)))
        return x @ w.T

    if mask:
        cells = cells.where(F.coalesce(F.col(mask).cast("boolean"), F.lit(False)))
    top = F.max("z").over(Window.partitionBy("vid", "head"))
    kept = _scored(cells, score).withColumn("k", F.exp(F.col("z") - top)).select("vid", "pos", "head", "k")
    parts = kept.join(cells.select("vid", F.col("pos").cast("int").alias("pos"), "x"), ["vid", "pos"]).select("vid", "head", "k", F.posexplode("x").alias("c", "v"))
    sums = parts.groupBy("vid", "head", "c").agg((F.sum(F.col("k") * F.col("v")) / F.sum("k")).alias("v"))
    return sums.groupBy("vid", "head").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: s["v"]).alias("x"))


def layer_normed(cells: DataFrame, eps: float = 1e-5) -> DataFrame:
    """x of each cell with a mean of 0 and a variance of 1."""
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / n
    centred = F.transform("x", lambda v: v - mean)
    spread = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v) / n + eps)
    return cells.withColumn("x", F.transform(centred, lambda v: v / spread))


def token_scores(cells: DataFrame, first: list[list[float]], first_bias: list[float], last: list[float], last_bias: float = 0.0) -> DataFrame:
    """(vid, pos, score): a network of one hidden layer with GELU, by given weights."""
    a, a0, b = np.array(first, float), np.array(first_bias, float), np.array(last, float)

    def score(x: np.ndarray) -> np.ndarray:
        return (gelu(x @ a.T + a0) @ b + last_bias)[:, None]

    return _scored(cells, score).select("vid", "pos", F.col("z").alias("score"))


def representative(clustered: DataFrame) -> DataFrame:
    """Of (vid, cluster, cosine), the member of the largest cluster nearest its centre; the first cluster if equal."""
    largest = clustered.groupBy("cluster").agg(F.count("*").alias("members")).orderBy(F.desc("members"), "cluster").limit(1)
    near = clustered.join(largest, "cluster")
    return near.orderBy(F.desc("cosine"), "vid").limit(1)


def clusters(vectors: DataFrame, low: int, high: int, seed: int = 7) -> tuple[int, DataFrame]:
    """k between low and high with a better silhouette than its half, by bisection; (vid, k, cosine)."""
    data = _vectors(vectors)
    judge = ClusteringEvaluator(featuresCol="f", distanceMeasure="squaredEuclidean")

    def fitted(k: int):
        made = KMeans(featuresCol="f", k=k, seed=seed).fit(data)
        labelled = made.transform(data)
        return made, labelled, judge.evaluate(labelled)

    a, b = fitted(low), fitted(high)
    while high - low > 1:
        mid = (low + high) // 2
        m = fitted(mid)
        if a[2] > b[2]:
            high, b = mid, m
        else:
            low, a = mid, m
    k, (model, labelled, _) = (low, a) if a[2] >= b[2] else (high, b)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    own = F.get(centres, F.col("prediction"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    x = F.transform("x", lambda v: v.cast("double"))
    cosine = dot(x, own) / F.sqrt(dot(x, x) * dot(own, own))
    return k, labelled.select("vid", F.col("prediction").alias("cluster"), cosine.alias("cosine"))


def ssim(pairs: DataFrame, shape: tuple[int, int, int], span: float = 2.0, size: int = 7) -> DataFrame:
    """(vid, a, b) -> (vid, ssim): mean over all windows of size^3 that fit (smaller grids: one)."""

    def windows(x: np.ndarray, n: tuple[int, ...]) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(x, n).reshape(-1, int(np.prod(n)))

    def score(a: np.ndarray, b: np.ndarray) -> float:
        n = tuple(min(size, s) for s in shape)
        p, q = windows(a, n), windows(b, n)
        m, k = p.mean(1), q.mean(1)
        d = max(1, p.shape[1] - 1)
        vp, vq = p.var(1) * p.shape[1] / d, q.var(1) * p.shape[1] / d
        vpq = ((p - m[:, None]) * (q - k[:, None])).sum(1) / d
        c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
        return float((((2 * m * k + c1) * (2 * vpq + c2)) / ((m**2 + k**2 + c1) * (vp + vq + c2))).mean())

    def run(frames):
        for frame in frames:
            made = [score(np.asarray(a, float).reshape(shape), np.asarray(b, float).reshape(shape)) for a, b in zip(frame["a"], frame["b"])]
            yield pd.DataFrame({"vid": frame["vid"], "ssim": made})

    kind = pairs.schema["vid"].dataType.simpleString()
    return pairs.select("vid", "a", "b").mapInPandas(run, f"vid {kind}, ssim double")
