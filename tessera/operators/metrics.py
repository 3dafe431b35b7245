"""Scores and summaries. Missing values are null: a null label isn't a negative one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.functions.texts import aligned, runs_of
from tessera.operators.tables import running


def _by(by: Sequence[str]) -> list[str]:
    return list(by)


def usable(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are all finite."""
    for c in columns:
        df = df.where(S.finite_or_null(F.col(c).cast("double")).isNotNull())
    return df


def distinct_scores(df: DataFrame, by: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """Positives and rows of each distinct score: what curves are made from."""
    return df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))


def auroc(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Area under ROC by ranks with average ties; null with one class or one row.

    Rows are summed to distinct scores, which are ranked by ranges of the score.
    """
    rows = usable(df, label, score)
    each = running(distinct_scores(rows, by, label, score), by, score, ["n"], spread=rows)
    ranked = each.withColumn("r", F.col("before_n") + (F.col("n") + 1) / 2)
    p, n = F.sum("pos"), F.sum("n")
    area = (F.sum(F.col("r") * F.col("pos")) - p * (p + 1) / 2) / (p * (n - p))
    return ranked.groupBy(*by).agg(p.alias("positives"), n.alias("rows"), F.when((p > 0) & (p < n), area).alias("auroc"))


def average_precision(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Sum of precision times gained recall over distinct thresholds."""
    rows = usable(df, label, score)
    each = running(distinct_scores(rows, by, label, score), by, score, ["pos", "n"], descending=True, spread=rows)
    curve = each.withColumn("precision", (F.col("before_pos") + F.col("pos")) / (F.col("before_n") + F.col("n")))
    return curve.groupBy(*by).agg(F.when(F.sum("pos") > 0, F.sum(F.col("precision") * F.col("pos")) / F.sum("pos")).alias("ap"))


def roc_points(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rates by descending threshold."""
    rows = usable(df, label, score)
    each = running(distinct_scores(rows, by, label, score), by, score, ["pos", "n"], descending=True, spread=rows)
    tp, total = F.col("before_pos") + F.col("pos"), F.col("total_pos")
    fp, rest = F.col("before_n") + F.col("n") - tp, F.col("total_n") - total
    return each.select(*by, F.col(score).alias("threshold"), F.try_divide(fp, rest).alias("fpr"), F.try_divide(tp, total).alias("tpr"))


def confusion(df: DataFrame, by: Sequence[str] = (), truth: Column | None = None, said: Column | None = None) -> DataFrame:
    truth = F.col("y_true") == 1 if truth is None else truth
    said = F.col("y_pred") == 1 if said is None else said
    cell = lambda t, s: F.count_if((truth if t else ~truth) & (said if s else ~said))
    return df.groupBy(*by).agg(cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(0, 0).alias("tn"))


def f1(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """F1 of score > 0.5; 0 where it is undefined."""
    c = confusion(usable(df, label, score), by, F.col(label) == 1, F.col(score) > 0.5)
    below = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select(*by, F.when(below > 0, 2.0 * F.col("tp") / below).otherwise(0.0).alias("f1"))


def weighted_scores(df: DataFrame, by: str) -> DataFrame:
    """Precision, recall and F1 of each label, averaged by its positives."""
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = confusion(df, [by])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = c.select((tp + fn).alias("k"), zero(tp, tp + fp).alias("p"), zero(tp, tp + fn).alias("r"), zero(2 * tp, 2 * tp + fp + fn).alias("f"))
    mean = lambda x: F.sum(F.col(x) * F.col("k")) / F.sum("k")
    return each.agg(mean("p").alias("precision"), mean("r").alias("recall"), mean("f").alias("f1"))


def r2(df: DataFrame, by: Sequence[str], truth: str = "y_true", said: str = "y_pred") -> DataFrame:
    """R2 of each target over finite rows, within -1 and 1; null below two rows."""
    t, p = F.col(truth), F.col(said)
    # The spread is merged from partial moments, so that one pass does and no task holds a target.
    sums = usable(df, truth, said).groupBy(*by).agg(F.count("*").alias("rows"), F.sum((t - p) * (t - p)).alias("sse"), F.var_pop(t).alias("_v"))
    sst = F.col("_v") * F.col("rows")
    return sums.select(*by, "rows", F.when(F.col("rows") >= 2, S.clip(1 - F.col("sse") / (sst + 1e-9), -1, 1)).alias("r2"))


def errors(df: DataFrame, by: Sequence[str], truth: str = "y_true", said: str = "y_pred") -> DataFrame:
    d = F.col(truth) - F.col(said)
    return usable(df, truth, said).groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.stddev_pop(truth).alias("target_sd"))


def error_histogram(df: DataFrame, error: str, low: float, high: float, n: int = 50) -> DataFrame:
    """Rows by equal bins of [low, high]; the last bin has its upper edge."""
    at = F.least(F.floor((F.col(error) - low) * n / (high - low)), F.lit(n - 1)).cast("int")
    return df.where(F.col(error).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("rows"))


def masked_loss(df: DataFrame, by: Sequence[str] = (), kind: str = "mse", positive: str | None = None) -> DataFrame:
    """Mean loss over rows with a label, over 1 row at least. BCE takes logits."""
    x, y = F.col("y_pred"), F.col("y_true")
    known = y.isNotNull()
    if kind == "mse":
        loss = (x - y) * (x - y)
    else:
        weight = F.lit(1.0) if positive is None else F.col(positive)
        soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        loss = weight * y * soft(-x) + (1 - y) * soft(x)
    return df.groupBy(*by).agg((F.coalesce(F.sum(F.when(known, loss)), F.lit(0.0)) / F.greatest(F.count_if(known), F.lit(1))).alias("loss"))


def positive_weight(df: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    share = S.clip(F.avg(F.col(label).cast("double")), 1e-3, 1 - 1e-3)
    return df.groupBy(*by).agg(F.least((1 - share) / share, F.lit(100.0)).alias("pos_weight"))


def token_loss(df: DataFrame, by: Sequence[str] = (), loss: str = "loss", tokens: str = "tokens") -> DataFrame:
    mean = F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)
    return df.groupBy(*by).agg(mean.alias("loss")).withColumn("ppl", S.perplexity(F.col("loss")))


def code_usage(df: DataFrame, vocabulary: int, by: Sequence[str] = (), code: str = "code") -> DataFrame:
    """Distinct codes, their share, entropy in nats and its exponent, share of the commonest."""
    counts = df.groupBy(*by, code).agg(F.count("*").alias("k"))
    n, k = F.sum("k"), F.col("k")
    nats = F.log(n) - F.sum(k * F.log(k)) / n
    return counts.groupBy(*by).agg(
        F.count("*").alias("codes"), (F.count("*") / F.least(F.lit(vocabulary), n)).alias("usage"), nats.alias("entropy"),
        F.exp(nats).alias("perplexity"), (F.max("k") / n).alias("top1"),
    )


def reconstruction(df: DataFrame, span: float, by: Sequence[str] = (), a: str = "a", b: str = "b") -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.count("*").alias("cells"), F.avg(d * d).alias("mse")).withColumn("psnr", S.psnr(F.col("mse"), span))


# --- logs of experiments ---------------------------------------------------------------


def best_epoch(log: DataFrame, run: Sequence[str], score: str = "score") -> DataFrame:
    """The epoch with the best mean over seeds, of those that every seed has; the first if equal.

    log: run..., seed, epoch, score by target. Gives epoch, mean, sd (n - 1) and n_seed.
    """
    cell = log.groupBy(*run, "seed", "epoch").agg(F.avg(score).alias("m"))
    seeds = log.groupBy(*run).agg(F.countDistinct("seed").alias("n_seed"))
    epochs = cell.groupBy(*run, "epoch").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.count("m").alias("k"))
    whole = epochs.join(seeds, list(run)).where("k = n_seed")
    return first_by(whole, run, [F.desc(F.round("mean", 12)), F.asc("epoch")]).select(*run, "epoch", "mean", "sd", "n_seed")


def first_by(df: DataFrame, by: Sequence[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that settles ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def best_step(log: DataFrame, run: Sequence[str], score: str = "score") -> DataFrame:
    """The step with the highest score; the smallest if equal."""
    return first_by(log.where(F.col(score).isNotNull()), run, [F.desc(score), F.asc("step")])


def upper_median(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """The element at n div 2 of the sorted column."""
    each = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("n"))
    at = F.floor(F.col("total_n") / 2)
    placed = running(each, by, x, ["n"], spread=df).where((F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n")))
    return placed.select(*by, F.col(x).alias("upper_median"))


def scaled_to_range(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """x by its minimum and maximum; 0.5 where all are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return df.withColumn("scaled", F.when(F.col(x).isNull(), None).when(high > low, (F.col(x) - low) / (high - low)).otherwise(0.5))


def aligned_mean(log: DataFrame, run: Sequence[str], targets: list[str], score: str = "score") -> DataFrame:
    """Mean over a fixed set of targets, of epochs that have all of them."""
    rows = log.where(F.col("target").isin(*targets) & F.col(score).isNotNull())
    means = rows.groupBy(*run, "epoch").agg(F.avg(score).alias("mean"), F.countDistinct("target").alias("k"))
    return means.where(F.col("k") == len(targets)).drop("k")


def summary(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    points = {f"p{p}": F.percentile(x, F.lit(p / 100)) for p in (50, 75, 90, 95)}
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), *[v.alias(k) for k, v in points.items()], F.max(x).alias("max"))


# --- generated texts -------------------------------------------------------------------


def ngrams(x: Column, n: int) -> Column:
    """n-grams of an array of words, as strings."""
    grams = F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.array_join(F.slice(x, i + 1, n), " "))
    return F.when(F.size(x) < n, F.expr("cast(array() as array<string>)")).otherwise(grams)


def _words(c: Column) -> Column:
    return F.array_join(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), " ")


def bleu(pairs: DataFrame, most: int = 4) -> DataFrame:
    """Corpus BLEU-1 to BLEU-most of (id, generated, reference), one reference each.

    Clipped counts are those of one row, so that only their sums leave it.
    """
    names = [f"{kind}_{n}" for n in range(1, most + 1) for kind in ("hit", "all")]

    def run(frames):
        for frame in frames:
            if not len(frame):
                continue
            made = []
            for a, b in zip(frame["g"], frame["r"]):
                x, y = (a or "").split(), (b or "").split()
                row = [len(x), len(y)]
                for n in range(1, most + 1):
                    said, told = (Counter(zip(*[w[i:] for i in range(n)])) for w in (x, y))
                    row += [sum(min(k, told[gram]) for gram, k in said.items() if gram in told), max(0, len(x) - n + 1)]
                made.append(row)
            yield pd.DataFrame(made, columns=["size_g", "size_r", *names]).sum().to_frame().T

    texts = pairs.select(_words(F.col("generated")).alias("g"), _words(F.col("reference")).alias("r"))
    parts = texts.mapInPandas(run, ", ".join(f"{c} long" for c in ("size_g", "size_r", *names)))
    total = parts.agg(*[F.sum(c).alias(c) for c in ("size_g", "size_r", *names)])
    share = lambda n: F.when(F.col(f"all_{n}") > 0, F.col(f"hit_{n}") / F.col(f"all_{n}")).otherwise(0.0)
    brevity = F.when(F.col("size_g") >= F.col("size_r"), 1.0).otherwise(F.exp(1 - F.col("size_r") / F.col("size_g")))

    def upto(n: int) -> Column:
        logs = sum((F.log(F.when(share(k) > 0, share(k))) for k in range(1, n + 1)), F.lit(0.0))
        return F.struct(F.lit(n).alias("n"), F.coalesce(F.exp(logs / n) * brevity, F.lit(0.0)).alias("bleu"))

    return total.select(F.explode(F.array(*[upto(n) for n in range(1, most + 1)])).alias("x")).select("x.n", "x.bleu")


def rouge_l(pairs: DataFrame, beta: float = 1.2) -> DataFrame:
    """ROUGE-L of (id, generated, reference): F of the longest common subsequence of words."""

    def score(a: str | None, b: str | None) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        if not x or not y or not row[-1]:
            return 0.0
        p, r = row[-1] / len(x), row[-1] / len(y)
        return (1 + beta**2) * p * r / (r + beta**2 * p)

    def run(frames):
        for frame in frames:
            scores = [score(a, b) for a, b in zip(frame["generated"], frame["reference"])]
            yield pd.DataFrame({"id": frame["id"], "rouge_l": scores})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "generated", "reference").mapInPandas(run, f"id {kind}, rouge_l double")


def meteor(pairs: DataFrame, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5, stems: bool = True) -> DataFrame:
    """METEOR of (id, generated, reference) by equal words, then by equal stems; no synonyms.

    Words are paired as often as they can be, in the fewest runs (see functions.texts).
    """

    def score(a: str | None, b: str | None) -> float:
        x, y = (a or "").lower().split(), (b or "").lower().split()
        matched = aligned(x, y, stems)
        if not matched:
            return 0.0
        p, r = len(matched) / len(x), len(matched) / len(y)
        return p * r / (alpha * p + (1 - alpha) * r) * (1 - gamma * (runs_of(matched) / len(matched)) ** beta)

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "meteor": [score(a, b) for a, b in zip(frame["generated"], frame["reference"])]})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "generated", "reference").mapInPandas(run, f"id {kind}, meteor double")


def cider(pairs: DataFrame, most: int = 4) -> DataFrame:
    """CIDEr of (id, generated, reference): cosine of TF-IDF n-grams, averaged over n, times 10.

    Document frequencies are those of all references. n-grams are compared by 64-bit hashes.
    """
    split = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    rows = pairs.select("id", split("generated").alias("g"), split("reference").alias("r"))
    side = lambda x, n, g, r: F.transform(ngrams(F.col(x), n), lambda w: F.struct(F.lit(n).alias("n"), F.xxhash64(w).alias("x"), F.lit(g).alias("g"), F.lit(r).alias("r")))
    grams = F.concat(*[side(*of) for n in range(1, most + 1) for of in (("g", n, 1, 0), ("r", n, 0, 1))])
    counts = rows.select("id", F.explode(grams).alias("w")).groupBy("id", "w.n", "w.x").agg(F.sum("w.g").alias("g"), F.sum("w.r").alias("r"))
    df = counts.where("r > 0").groupBy("n", "x").agg(F.count("*").alias("df"))
    # One row: how many pairs there are.
    total = rows.agg(F.count("*").alias("total"))
    weight = F.log(F.col("total") / F.coalesce("df", F.lit(1)))
    both = counts.join(df, ["n", "x"], "left").crossJoin(F.broadcast(total)).select("id", "n", (F.col("g") * weight).alias("g"), (F.col("r") * weight).alias("r"))
    size = F.sqrt(F.sum(F.col("g") * F.col("g")) * F.sum(F.col("r") * F.col("r")))
    each = both.groupBy("id", "n").agg(F.when(size > 0, F.sum(F.col("g") * F.col("r")) / size).otherwise(0.0).alias("s"))
    made = each.groupBy("id").agg((F.sum("s") * 10 / most).alias("cider"))
    return rows.select("id").join(made, "id", "left").select("id", F.coalesce("cider", F.lit(0.0)).alias("cider"))


def masked_group_loss(cells: DataFrame, labels: DataFrame, weights: list[float]) -> DataFrame:
    """BCE of a linear score of the mask-weighted mean feature of each (vid, grp) with a label.

    cells: vid, grp, mask, c, v. labels: vid, grp, y (null: not labelled).
    """
    w = F.array(*map(F.lit, weights))
    pooled = cells.groupBy("vid", "grp", "c").agg((F.sum(F.col("v") * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1e-6))).alias("v"))
    scored = pooled.groupBy("vid", "grp").agg(F.sum(F.col("v") * F.get(w, F.col("c"))).alias("y_pred"))
    return masked_loss(scored.join(labels, ["vid", "grp"]).select("y_pred", F.col("y").cast("double").alias("y_true")), kind="bce")


def split_reconstruction(df: DataFrame, span: float, by: Sequence[str] = (), a: str = "a", b: str = "b", inside: str = "inside") -> DataFrame:
    """MSE, PSNR and cells of the cells inside and outside of a mask, and the ratio of the PSNRs.

    A side without cells has NaN, one without error an infinite PSNR; the ratio is NaN then.
    """
    d2 = (F.col(a) - F.col(b)) * (F.col(a) - F.col(b))
    nan, inf = F.lit(float("nan")), float("inf")
    sides = {"in": F.coalesce(F.col(inside).cast("boolean"), F.lit(False)), "out": ~F.coalesce(F.col(inside).cast("boolean"), F.lit(False))}
    made = df.groupBy(*by).agg(
        *[F.count_if(on).alias(f"cells_{k}") for k, on in sides.items()], *[F.coalesce(F.avg(F.when(on, d2)), nan).alias(f"mse_{k}") for k, on in sides.items()]
    )
    made = made.withColumns({f"psnr_{k}": F.when(F.isnan(f"mse_{k}"), nan).otherwise(S.psnr(F.col(f"mse_{k}"), span)) for k in sides})
    told = [~F.isnan(f"psnr_{k}") & (F.col(f"psnr_{k}") != inf) for k in sides]
    return made.withColumn("ratio_psnr", F.when(told[0] & told[1], F.try_divide(F.col("psnr_in"), F.col("psnr_out"))).otherwise(nan))


def contrastive_loss(left: DataFrame, right: DataFrame, temperature: float = 0.07, batch: str = "batch", i: str = "i", key: str = "k", x: str = "x") -> DataFrame:
    """(batch, loss): symmetric contrastive loss with several positives, of rows (batch, i, k, x).

    Rows of both sides with one i, or one k, are positives. A batch has a fixed size, so that
    its pairs are bounded.
    """
    a = left.select(F.col(batch).alias("batch"), F.col(i).alias("i"), F.col(key).alias("k"), S.unit(F.col(x)).alias("x"))
    b = right.select(F.col(batch).alias("batch"), F.col(i).alias("j"), F.col(key).alias("l"), S.unit(F.col(x)).alias("y"))
    logit = S.dot(F.col("x"), F.col("y")) / max(temperature, 1e-6)
    pairs = a.join(b, "batch").select("batch", "i", "j", ((F.col("k") == F.col("l")) | (F.col("i") == F.col("j"))).alias("same"), logit.alias("z"))

    def one_way(side: str) -> DataFrame:
        top = F.max("z").over(Window.partitionBy("batch", side))
        shifted = pairs.withColumn("m", top)
        same = F.coalesce(F.col("same"), F.lit(False))
        each = shifted.groupBy("batch", side).agg(
            (F.log(F.sum(F.exp(F.col("z") - F.col("m")))) + F.max("m")).alias("all"), F.coalesce(F.avg(F.when(same, F.col("z"))), F.lit(0.0)).alias("own"), F.count_if(same).alias("n")
        )
        return each.groupBy("batch").agg(F.avg(F.when(F.col("n") > 0, F.col("all") - F.col("own")).otherwise(0.0)).alias("loss"))

    return one_way("i").unionByName(one_way("j")).groupBy("batch").agg(F.avg("loss").alias("loss"))
