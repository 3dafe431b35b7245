"""Queries over scores and logs: metrics, the best epochs, sweeps.

lineitem is a metric log (seed l_linenumber, epoch the month, target l_returnflag, score
l_discount) and a table of predictions (score l_tax, label l_linestatus).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import metrics as M
from tessera.plans.registry import query, table

LOG = """log AS (SELECT l_returnflag AS run, l_linenumber AS seed, month(l_shipdate)::INT AS epoch, l_linestatus AS target, l_discount AS score, l_quantity AS q FROM lineitem)"""
PRED = """p AS (SELECT l_returnflag AS k, (l_linestatus = 'O')::INT AS label, l_discount * 10 AS score, l_extendedprice / 1e5 AS y_true, l_quantity / 50 AS y_pred FROM lineitem)"""


def log(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("seed"), F.month("l_shipdate").alias("epoch"),
        F.col("l_linestatus").alias("target"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("q"),
    )


def predictions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("k"), (F.col("l_linestatus") == "O").cast("int").alias("label"), (F.col("l_discount") * 10).alias("score"),
        (F.col("l_extendedprice") / 1e5).alias("y_true"), (F.col("l_quantity") / 50).alias("y_pred"),
    )


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


_AUROC = """r AS (SELECT k, label, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2 AS r FROM p)
SELECT k, sum(label)::BIGINT AS positives, count(*) AS rows,
CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) END AS auroc FROM r GROUP BY k"""


@query(f"WITH {PRED}, {_AUROC}")
def a4_auroc_per_label(spark, sf_dir):
    return rounded(M.auroc(predictions(spark, sf_dir), ["k"]), "auroc")


@query(f"""WITH {PRED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM p)
SELECT round((sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auroc FROM r""")
def a7_auroc_micro(spark, sf_dir):
    return rounded(M.auroc(predictions(spark, sf_dir)).select("auroc"), "auroc")


@query(f"""WITH {PRED}, r AS (SELECT k, label, rank() OVER (PARTITION BY k ORDER BY score) + (count(*) OVER (PARTITION BY k, score) - 1) / 2 AS r FROM p),
a AS (SELECT k, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(r * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))) END AS a FROM r GROUP BY k)
SELECT round(avg(a), 6) AS auroc, count(a) AS labels FROM a""")
def a7_auroc_macro(spark, sf_dir):
    return M.auroc(predictions(spark, sf_dir), ["k"]).agg(F.round(F.avg("auroc"), 6).alias("auroc"), F.count("auroc").alias("labels"))


@query(f"""WITH {PRED}, d AS (SELECT k, score, sum(label) AS pos, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT k, pos, sum(pos) OVER w / sum(n) OVER w AS precision FROM d WINDOW w AS (PARTITION BY k ORDER BY score DESC))
SELECT k, CASE WHEN sum(pos) > 0 THEN round(sum(precision * pos) / sum(pos), 6) END AS ap FROM c GROUP BY k""")
def a5_average_precision(spark, sf_dir):
    return rounded(M.average_precision(predictions(spark, sf_dir), ["k"]), "ap")


@query(f"""WITH {PRED}, d AS (SELECT k, score, sum(label) AS pos, count(*) AS n FROM p GROUP BY ALL)
SELECT k, round(score, 6) AS threshold, round((sum(n) OVER w - sum(pos) OVER w) / nullif(sum(n) OVER a - sum(pos) OVER a, 0), 6) AS fpr, round(sum(pos) OVER w / nullif(sum(pos) OVER a, 0), 6) AS tpr
FROM d WINDOW w AS (PARTITION BY k ORDER BY score DESC), a AS (PARTITION BY k)""")
def a43_roc_points(spark, sf_dir):
    return rounded(M.roc_points(predictions(spark, sf_dir), ["k"]), "threshold", "fpr", "tpr")


@query(f"""WITH {PRED} SELECT k, CASE WHEN sum(label) + count_if(score > 0.5) > 0 THEN round(2 * count_if(label = 1 AND score > 0.5) / (sum(label) + count_if(score > 0.5)), 6) ELSE 0 END::DOUBLE AS f1 FROM p GROUP BY k""")
def a6_f1_at_half(spark, sf_dir):
    return rounded(M.f1(predictions(spark, sf_dir), ["k"]), "f1")


@query(f"""WITH {PRED}, m AS (SELECT *, avg(y_true) OVER (PARTITION BY k) AS m FROM p)
SELECT k, count(*) AS rows, round(greatest(-1, least(1, 1 - sum((y_true - y_pred) ** 2) / (sum((y_true - m) ** 2) + 1e-9))), 6) AS r2 FROM m GROUP BY k""")
def a3_r2_per_target(spark, sf_dir):
    return rounded(M.r2(predictions(spark, sf_dir), ["k"]), "r2")


@query(f"""WITH {PRED} SELECT k, round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse, round(avg(abs(y_true - y_pred)), 6) AS mae, round(stddev_pop(y_true), 6) AS target_sd FROM p GROUP BY k""")
def a42_errors(spark, sf_dir):
    return rounded(M.errors(predictions(spark, sf_dir), ["k"]), "rmse", "mae", "target_sd")


@query(f"""WITH {PRED}, e AS (SELECT y_true - y_pred AS e FROM p) SELECT least(floor((e + 1) * 50 / 2), 49)::INT AS bin, count(*) AS rows FROM e WHERE e BETWEEN -1 AND 1 GROUP BY ALL""")
def a44_error_histogram(spark, sf_dir):
    rows = predictions(spark, sf_dir).select((F.col("y_true") - F.col("y_pred")).alias("e"))
    return M.error_histogram(rows, "e", -1.0, 1.0)


@query("""WITH d AS (SELECT d.doc_id, l.toxic AS y, d.n_chars / 1000 - 1 AS x FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT round(sum((x - y) ** 2) / greatest(count(y), 1), 6) AS mse,
round(sum(3 * y * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - y) * (greatest(x, 0) + ln(1 + exp(-abs(x))))) / greatest(count(y), 1), 6) AS bce FROM d""")
def a8_masked_loss(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = d.select(F.col("toxic").alias("y_true"), (F.col("n_chars") / 1000 - 1).alias("y_pred"), F.lit(3.0).alias("w"))
    mse, bce = M.masked_loss(rows), M.masked_loss(rows, kind="bce", positive="w")
    return mse.select(F.round("loss", 6).alias("mse")).crossJoin(F.broadcast(bce.select(F.round("loss", 6).alias("bce"))))


@query(f"""WITH {PRED}, s AS (SELECT k, greatest(1e-3, least(1 - 1e-3, avg(label))) AS s FROM p GROUP BY k) SELECT k, round(least((1 - s) / s, 100), 6) AS pos_weight FROM s""")
def a9_positive_weight(spark, sf_dir):
    return rounded(M.positive_weight(predictions(spark, sf_dir), ["k"]), "pos_weight")


_PAIRS = "c AS (SELECT l_suppkey % 18 AS finding, (l_linestatus = 'O')::INT AS y_true, (l_quantity > 25)::INT AS y_pred FROM lineitem)"


def findings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 18).alias("finding"), (F.col("l_linestatus") == "O").cast("int").alias("y_true"), (F.col("l_quantity") > 25).cast("int").alias("y_pred")
    )


@query(f"""WITH {_PAIRS}, t AS (SELECT count_if(y_true = 1 AND y_pred = 1)::BIGINT AS tp, count_if(y_true = 0 AND y_pred = 1)::BIGINT AS fp, count_if(y_true = 1 AND y_pred = 0)::BIGINT AS fn, count_if(y_true = 0 AND y_pred = 0)::BIGINT AS tn FROM c),
w AS (SELECT *, (fp + tn) / (2 * (tp + fn)) AS w FROM t)
SELECT tp, fp, fn, tn, round(w * (tp + fn) / (2 * w * (tp + fn) - (w * (tp - fn) - fp)), 6) AS crg FROM w""")
def a10_a11_confusion_crg(spark, sf_dir):
    c = M.confusion(findings(spark, sf_dir))
    return c.withColumn("crg", F.round(S.crg(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), 6))


@query(f"""WITH {_PAIRS}, f AS (SELECT finding, count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp, count_if(y_true = 1 AND y_pred = 0) AS fn FROM c GROUP BY finding)
SELECT round(sum(tp / (tp + fp) * (tp + fn)) / sum(tp + fn), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall, round(sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn), 6) AS f1 FROM f""")
def a12_weighted_scores(spark, sf_dir):
    return rounded(M.weighted_scores(findings(spark, sf_dir), "finding"), "precision", "recall", "f1")


@query("""WITH q AS (SELECT l_returnflag AS axis, l_linestatus AS target, (l_linenumber = least(l_suppkey % 7 + 1, 7))::INT AS hit FROM lineitem)
SELECT axis, target, sum(hit)::BIGINT AS hits, count(*) AS n, round(avg(hit), 6) AS acc FROM q GROUP BY GROUPING SETS ((axis, target), (axis), ())""")
def a13_exact_match(spark, sf_dir):
    """By axis and target, by axis, and over all, in one pass."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("axis"), F.col("l_linestatus").alias("target"), (F.col("l_linenumber") == F.least(F.col("l_suppkey") % 7 + 1, F.lit(7))).cast("int").alias("hit")
    )
    sets = rows.groupingSets([["axis", "target"], ["axis"], []], "axis", "target")
    return sets.agg(F.sum("hit").alias("hits"), F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("acc"))


@query("""SELECT l_returnflag AS run, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS loss, round(exp(sum(l_discount * l_quantity) / sum(l_quantity)), 6) AS ppl FROM lineitem GROUP BY ALL""")
def a14_token_loss(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_discount").alias("loss"), F.col("l_quantity").alias("tokens"))
    return rounded(M.token_loss(rows, ["run"]), "loss", "ppl")


_BEST = """c AS (SELECT run, seed, epoch, avg(score) AS m FROM log GROUP BY ALL), s AS (SELECT run, count(DISTINCT seed) AS n_seed FROM log GROUP BY run),
e AS (SELECT run, epoch, avg(m) AS mean, stddev_samp(m) AS sd, count(*) AS k FROM c GROUP BY ALL),
b AS (SELECT e.run, epoch, mean, sd, n_seed, row_number() OVER (PARTITION BY e.run ORDER BY round(mean, 12) DESC, epoch) AS r FROM e JOIN s ON e.run = s.run AND k = n_seed)
SELECT run, epoch, round(mean, 6) AS mean, round(sd, 6) AS sd, n_seed FROM b WHERE r = 1"""


@query(f"WITH {LOG}, {_BEST}")
def w1_best_epoch(spark, sf_dir):
    return rounded(M.best_epoch(log(spark, sf_dir), ["run"]), "mean", "sd")


@query(f"""WITH {LOG}, c AS (SELECT run, target, seed, epoch, avg(score) AS m FROM log GROUP BY ALL),
e AS (SELECT run, target, epoch, avg(m) AS mean FROM c GROUP BY ALL HAVING count(*) = 7),
b AS (SELECT *, row_number() OVER (PARTITION BY run, target ORDER BY round(mean, 12) DESC, epoch) AS r FROM e)
SELECT run, target, epoch, round(mean, 6) AS mean FROM b WHERE r = 1""")
def w9_best_epoch_per_target(spark, sf_dir):
    best = M.best_epoch(log(spark, sf_dir), ["run", "target"])
    return rounded(best.select("run", "target", "epoch", "mean"), "mean")


@query("""WITH s AS (SELECT o_orderpriority AS run, dayofyear(o_orderdate)::INT AS step, max(o_totalprice) AS score FROM orders GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, step) AS r FROM s) SELECT run, step, score FROM b WHERE r = 1""")
def w2_best_step(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("run"), F.dayofyear("o_orderdate").alias("step")).agg(F.max("o_totalprice").alias("score"))
    return M.best_step(steps, ["run"])


@query("""WITH s AS (SELECT CASE WHEN o_orderdate < '1995-01-01' THEN 's1' ELSE 's2' END AS stage, year(o_orderdate)::INT AS step, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT stage, step, row_number() OVER (ORDER BY stage, step)::INT AS place, round(score, 2) AS score, round(max(score) OVER (), 2) AS best FROM s""")
def w7_w8_two_stages(spark, sf_dir):
    """Stage by stage, then by step; a row for each step of a run."""
    from pyspark.sql.window import Window

    stage = F.when(F.col("o_orderdate") < "1995-01-01", "s1").otherwise("s2")
    s = table(spark, sf_dir, "orders").groupBy(stage.alias("stage"), F.year("o_orderdate").alias("step")).agg(F.avg("o_totalprice").alias("score"))
    w = Window.partitionBy(F.lit(1))
    return s.select("stage", "step", F.row_number().over(w.orderBy("stage", "step")).alias("place"), F.round("score", 2).alias("score"), F.round(F.max("score").over(w), 2).alias("best"))


@query("""SELECT path, step::INT AS step, dense_rank() OVER (ORDER BY step)::INT AS place FROM (SELECT DISTINCT 'runs/a/step_' || lpad(l_linenumber::VARCHAR, 4, '0') || '/m.json' AS path, l_linenumber AS step FROM lineitem)""")
def w6_step_order(spark, sf_dir):
    from pyspark.sql.window import Window

    path = F.concat(F.lit("runs/a/step_"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"), F.lit("/m.json"))
    steps = table(spark, sf_dir, "lineitem").select(path.alias("path")).distinct().withColumn("step", S.step_number(F.col("path")))
    return steps.withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("step")))


@query("""WITH m AS (SELECT l_suppkey AS label, avg(l_discount) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9), label) AS a, row_number() OVER (ORDER BY round(score, 9) DESC, label) AS b FROM m)
SELECT label, round(score, 6) AS score, a <= 3 AS weak FROM r WHERE a <= 3 OR b <= 3""")
def w10_weakest_and_strongest(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("label")).agg(F.avg("l_discount").alias("score"))
    key = F.round("score", 9)
    weak = m.orderBy(key, "label").limit(3).withColumn("weak", F.lit(True))
    strong = m.orderBy(F.desc(key), "label").limit(3).withColumn("weak", F.lit(False))
    return rounded(weak.unionByName(strong), "score")


@query(f"""WITH {LOG}, e AS (SELECT run, epoch, avg(score) AS s FROM log GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(s, 12) DESC, epoch DESC) AS r FROM e)
SELECT run, epoch, round(s, 6) AS score FROM b WHERE r = 1""")
def a16_best_row(spark, sf_dir):
    """The dashboard's rule: of equal scores the latest epoch."""
    e = log(spark, sf_dir).groupBy("run", "epoch").agg(F.avg("score").alias("score"))
    return rounded(M.first_by(e, ["run"], [F.desc(F.round("score", 12)), F.desc("epoch")]).select("run", "epoch", "score"), "score")


@query(f"""WITH {LOG}, w AS (SELECT run, epoch, target, avg(score) AS s FROM log GROUP BY ALL) SELECT run, epoch, round(avg(s), 6) AS mean FROM w GROUP BY ALL HAVING count(DISTINCT target) = 2""")
def a17_aligned_mean(spark, sf_dir):
    w = log(spark, sf_dir).groupBy("run", "epoch", "target").agg(F.avg("score").alias("score"))
    return rounded(M.aligned_mean(w, ["run"], ["F", "O"]), "mean")


@query("""WITH s AS (SELECT o_orderpriority AS enc, o_orderstatus AS method, avg(o_totalprice) AS x FROM orders GROUP BY ALL)
SELECT enc, method, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0.5 END, 6) AS scaled FROM s WINDOW w AS (PARTITION BY enc)""")
def a18_range_scaled(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("enc"), F.col("o_orderstatus").alias("method")).agg(F.avg("o_totalprice").alias("x"))
    return rounded(M.scaled_to_range(s, ["enc"], "x").select("enc", "method", "scaled"), "scaled")


@query(f"""WITH {LOG}, c AS (SELECT run, epoch, seed, avg(score) AS m FROM log GROUP BY ALL)
SELECT run, epoch, {', '.join(f'round(max(m) FILTER (seed = {i}), 6) AS s{i}' for i in range(1, 8))} FROM c GROUP BY ALL HAVING count(*) = 7""")
def a15_pivot_of_seeds(spark, sf_dir):
    """Seeds as columns; epochs that lack a seed are dropped."""
    c = log(spark, sf_dir).groupBy("run", "epoch").pivot("seed", list(range(1, 8))).agg(F.round(F.avg("score"), 6))
    return c.na.drop().toDF("run", "epoch", *[f"s{i}" for i in range(1, 8)])


@query("""WITH s AS (SELECT l_returnflag AS k, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT k, x AS upper_median FROM s WHERE r = n // 2""")
def a20_upper_median(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("x"))
    return M.upper_median(rows, ["k"], "x")


@query("""SELECT lang, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.75), 6) AS p75, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.95), 6) AS p95, max(n_chars) AS max FROM documents GROUP BY ALL""")
def a21_distribution(spark, sf_dir):
    return rounded(M.summary(table(spark, sf_dir, "documents"), ["lang"], "n_chars"), "mean", "p50", "p75", "p90", "p95")


@query("""SELECT source, count(*) AS n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 20""")
def a22_top_categories(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(20)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def a19_a40_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""WITH c AS (SELECT l_partkey & 262143 AS code, count(*) AS k FROM lineitem GROUP BY ALL)
SELECT count(*) AS codes, round(count(*) / least(262144, sum(k)), 6) AS usage, round(ln(sum(k)) - sum(k * ln(k)) / sum(k), 6) AS entropy, round(exp(ln(sum(k)) - sum(k * ln(k)) / sum(k)), 3) AS perplexity, round(max(k) / sum(k), 6) AS top1 FROM c""")
def a31_code_usage(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").bitwiseAND(F.lit(262143)).alias("code"))
    return rounded(M.code_usage(codes, 262144), "usage", "entropy", "top1").withColumn("perplexity", F.round("perplexity", 3))


@query("""WITH d AS (SELECT c_custkey, c_acctbal - 5000 AS d FROM customer) SELECT round(avg(abs(d)), 4) AS mean_abs, round(max(abs(d)), 4) AS max_abs, round(avg(abs(d)) FILTER (c_custkey IN (SELECT o_custkey FROM orders)), 4) AS touched FROM d""")
def a32_delta_stats(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.abs(F.col("c_acctbal") - 5000).alias("d"))
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("used", F.lit(True))
    d = d.join(used, "c_custkey", "left")
    return d.agg(F.round(F.avg("d"), 4).alias("mean_abs"), F.round(F.max("d"), 4).alias("max_abs"), F.round(F.avg(F.when(F.col("used"), F.col("d"))), 4).alias("touched"))


@query("""SELECT event_type, round(avg(CASE WHEN value > 10 THEN value END), 6) AS finite_mean, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last, round(max(value), 6) AS top, round(median(value), 6) AS median FROM events GROUP BY ALL""")
def a34_a36_a39_step_log(spark, sf_dir):
    gone = F.when(F.col("value") > 10, F.col("value")).otherwise(F.lit(float("nan")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.avg(S.finite_or_null(gone)), 6).alias("finite_mean"), F.min_by("value", "event_id").alias("first"), F.max_by("value", "event_id").alias("last"),
        F.round(F.max("value"), 6).alias("top"), F.round(F.median("value"), 6).alias("median"),
    )


@query("""SELECT n_name, p_brand, count_if(l_quantity > 45)::BIGINT AS positives FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def a37_positives_by_group(spark, sf_dir):
    """A line is positive above a quantity of 45; groups without positives have 0."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    place = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    rows = line.join(place, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("n_name", "p_brand").agg(F.count_if(F.col("l_quantity") > 45).alias("positives"))


@query("""WITH g AS (SELECT l_linenumber AS matched, l_suppkey % 3 AS a, l_suppkey % 2 AS b FROM lineitem), s AS (SELECT *, CASE WHEN matched = 0 THEN 0 ELSE matched / (matched + a + b) END AS green FROM g)
SELECT round(avg(green), 6) AS mean, round(stddev_pop(green), 6) AS sd, round(avg((a = 0)::INT), 6) AS zero_a, round(avg((b = 0)::INT), 6) AS zero_b FROM s""")
def a38_judged_summary(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("m"), (F.col("l_suppkey") % 3).alias("a"), (F.col("l_suppkey") % 2).alias("b"))
    s = g.withColumn("green", S.green_score(F.col("m"), [F.col("a"), F.col("b")]))
    zero = lambda c: F.round(F.avg((F.col(c) == 0).cast("int")), 6).alias(f"zero_{c}")
    return s.agg(F.round(F.avg("green"), 6).alias("mean"), F.round(F.stddev_pop("green"), 6).alias("sd"), zero("a"), zero("b"))


@query("""SELECT c_mktsegment AS enc, count(*) AS runs, count_if(n > 10)::BIGINT AS multi FROM (SELECT c_custkey, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL) GROUP BY ALL""")
def a41_runs_by_encoder(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("enc")).agg(
        F.count("*").alias("runs"), F.count_if(F.col("n") > 10).alias("multi")
    )


@query("""WITH a AS (SELECT label AS k, vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
s AS (SELECT a.i, b.i AS j, a.k = b.k AS same, list_dot_product(a.x, b.x) / 0.07 AS s FROM a JOIN a b ON a.i // 32 = b.i // 32)
SELECT round(avg(l), 5) AS loss FROM (SELECT i, ln(sum(exp(s))) - ln(sum(exp(s)) FILTER (same)) AS l FROM s GROUP BY i)""")
def m6_contrastive_loss(spark, sf_dir):
    """Log-sum-exp of all minus that of the positives, within batches of 32 volumes."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 32").alias("batch"), F.col("vec_id").alias("i"), F.col("label").alias("k"), F.col("embedding").alias("x"))
    s = e.join(e.toDF("batch", "j", "k2", "y"), "batch").select("i", (F.col("k") == F.col("k2")).alias("same"), F.exp(S.dot(F.col("x"), F.col("y")) / 0.07).alias("s"))
    each = s.groupBy("i").agg((F.log(F.sum("s")) - F.log(F.sum(F.when(F.col("same"), F.col("s"))))).alias("l"))
    return each.agg(F.round(F.avg("l"), 5).alias("loss"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def m4_correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("""WITH p AS (SELECT a.doc_id AS id, list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda w: w <> '') AS g, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '') AS r
  FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
n AS (SELECT unnest([1, 2, 3, 4]) AS n),
g AS (SELECT id, n, x, count(*) AS k FROM (SELECT id, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], ' '))) AS x FROM p, n) GROUP BY ALL),
r AS (SELECT id, n, x, count(*) AS k FROM (SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS x FROM p, n) GROUP BY ALL),
c AS (SELECT g.n, sum(least(g.k, coalesce(r.k, 0))) / sum(g.k) AS p FROM g LEFT JOIN r USING (id, n, x) GROUP BY g.n),
z AS (SELECT sum(len(g)) AS g, sum(len(r)) AS r FROM p)
SELECT a.n, CASE WHEN min(b.p) > 0 THEN round(exp(avg(ln(CASE WHEN b.p > 0 THEN b.p END))) * min(CASE WHEN z.g >= z.r THEN 1 ELSE exp(1 - z.r / z.g) END), 6) ELSE 0 END::DOUBLE AS bleu
FROM c a JOIN c b ON b.n <= a.n, z GROUP BY a.n""")
def m9_bleu(spark, sf_dir):
    """Each text against the next one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = d.select(F.col("doc_id").alias("id"), F.col("text").alias("generated"))
    pairs = pairs.join(d.select((F.col("doc_id") - 1).alias("id"), F.col("text").alias("reference")), "id")
    return rounded(M.bleu(pairs), "bleu")


def neighbours(spark, sf_dir):
    """Each benchmark item against the next one."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("generated")).join(b.select((F.col("item_id") - 1).alias("id"), F.col("text").alias("reference")), "id")


_NEXT = """p AS (SELECT a.item_id AS id, list_filter(regexp_split_to_array(lower(a.text), '\\s+'), lambda w: w <> '') AS g, list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '') AS r
  FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"""


@query(f"""WITH {_NEXT}, d AS (SELECT id, g, r, list_reduce(g, lambda row, w: list_transform(range(1, len(r) + 1), lambda j:
  list_max(list_transform(range(1, j + 1), lambda k: greatest(row_at(row, k), CASE WHEN r[k] = w THEN row_at(row, k - 1) + 1 ELSE 0 END)))), list_transform(r, lambda x: 0)) AS t FROM p),
s AS (SELECT id, t[-1] / len(g) AS p, t[-1] / len(r) AS q FROM d)
SELECT id, round(CASE WHEN p > 0 THEN 2.44 * p * q / (q + 1.44 * p) ELSE 0 END, 6) AS rouge_l FROM s""".replace("row_at(row, k - 1)", "coalesce(row[k - 1], 0)").replace("row_at(row, k)", "row[k]"))
def m9_rouge_l(spark, sf_dir):
    return rounded(M.rouge_l(neighbours(spark, sf_dir)), "rouge_l")


@query()
def m9_meteor(spark, sf_dir):
    return rounded(M.meteor(neighbours(spark, sf_dir)), "meteor")


@query(f"""WITH {_NEXT}, u AS (SELECT id, list_filter(g, lambda w, i: list_position(g, w) = i) AS g, list_filter(r, lambda w, i: list_position(r, w) = i) AS r FROM p),
m AS (SELECT id, i, list_position(r, g[i]) AS j FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM u) WHERE list_contains(r, g[i])),
s AS (SELECT id, count(*) AS m, count_if(lag_i IS NULL OR lag_i <> i - 1 OR lag_j <> j - 1) AS runs FROM (SELECT *, lag(i) OVER w AS lag_i, lag(j) OVER w AS lag_j FROM m WINDOW w AS (PARTITION BY id ORDER BY i)) GROUP BY id)
SELECT u.id, round(coalesce((m / len(g)) * (m / len(r)) / (0.9 * m / len(g) + 0.1 * m / len(r)) * (1 - 0.5 * (runs / m) ** 3), 0), 6) AS meteor FROM u LEFT JOIN s USING (id)""")
def m9_meteor_exact(spark, sf_dir):
    """The stage of equal words, of texts in which each word counts once, so that there is one alignment."""
    once = lambda c: F.array_join(F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")), " ")
    pairs = neighbours(spark, sf_dir).withColumns({c: once(c) for c in ("generated", "reference")})
    return rounded(M.meteor(pairs, stems=False), "meteor")


@query(f"""WITH {_NEXT}, n AS (SELECT unnest([1, 2, 3, 4]) AS n),
g AS (SELECT id, n, x, count(*) AS g FROM (SELECT id, n, unnest(list_transform(range(1, len(g) - n + 2), lambda i: array_to_string(g[i:i + n - 1], ' '))) AS x FROM p, n) GROUP BY ALL),
r AS (SELECT id, n, x, count(*) AS r FROM (SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS x FROM p, n) GROUP BY ALL),
f AS (SELECT n, x, count(*) AS df FROM r GROUP BY ALL), b AS (SELECT coalesce(g.id, r.id) AS id, coalesce(g.n, r.n) AS n, coalesce(g.x, r.x) AS x, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM g FULL JOIN r ON g.id = r.id AND g.n = r.n AND g.x = r.x),
w AS (SELECT id, n, g * ln((SELECT count(*) FROM p) / coalesce(df, 1)) AS g, r * ln((SELECT count(*) FROM p) / coalesce(df, 1)) AS r FROM b LEFT JOIN f USING (n, x)),
s AS (SELECT id, n, CASE WHEN sum(g * g) * sum(r * r) > 0 THEN sum(g * r) / sqrt(sum(g * g) * sum(r * r)) ELSE 0 END AS s FROM w GROUP BY ALL)
SELECT p.id, round(coalesce(sum(s) * 10 / 4, 0), 6) AS cider FROM p LEFT JOIN s USING (id) GROUP BY p.id""")
def m9_cider(spark, sf_dir):
    return rounded(M.cider(neighbours(spark, sf_dir)), "cider")


@query("""WITH e AS (SELECT vec_id // 32 AS batch, vec_id AS i, label AS k, list_transform(embedding, lambda x: x::DOUBLE) AS x, list_transform(list_reverse(embedding), lambda x: x::DOUBLE) AS y FROM embeddings),
p AS (SELECT a.batch, a.i, b.i AS j, a.k = b.k AS same, list_dot_product(a.x, b.y) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.y, b.y)) / 0.07 AS z FROM e a JOIN e b ON a.batch = b.batch),
v AS (SELECT batch, i, ln(sum(exp(z))) - avg(z) FILTER (same) AS l FROM p GROUP BY ALL), t AS (SELECT batch, j, ln(sum(exp(z))) - avg(z) FILTER (same) AS l FROM p GROUP BY ALL)
SELECT batch, round((a + b) / 2, 5) AS loss FROM (SELECT batch, avg(l) AS a FROM v GROUP BY batch) JOIN (SELECT batch, avg(l) AS b FROM t GROUP BY batch) USING (batch)""")
def m6_symmetric_loss(spark, sf_dir):
    """Volumes against texts (their reversed vectors), both ways, in batches of 32."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 32").alias("batch"), F.col("vec_id").alias("i"), F.col("label").alias("k"), F.col("embedding").alias("x"))
    made = M.contrastive_loss(e, e.withColumn("x", F.reverse("x")))
    return made.select("batch", F.round("loss", 5).alias("loss"))


@query("""WITH g AS (SELECT vec_id AS vid, (i // 32)::INT AS grp, greatest(embedding[i + 1], 0)::DOUBLE AS mask, embedding[i + 1]::DOUBLE AS v, label FROM embeddings, (SELECT unnest(range(64)) AS i)),
p AS (SELECT vid, grp, sum(v * mask) / greatest(sum(mask), 1e-6) * 2 AS x, (min(label) > 4)::INT AS y FROM g GROUP BY ALL)
SELECT round(sum(y * (greatest(-x, 0) + ln(1 + exp(-abs(x)))) + (1 - y) * (greatest(x, 0) + ln(1 + exp(-abs(x))))) / count(*), 6) AS loss FROM p""")
def m7_masked_group_loss(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    cells = e.select(F.col("vec_id").alias("vid"), F.posexplode("embedding").alias("i", "x")).select(
        "vid", F.expr("i div 32").alias("grp"), F.greatest(F.col("x").cast("double"), F.lit(0.0)).alias("mask"), F.lit(0).alias("c"), F.col("x").cast("double").alias("v")
    )
    labels = e.select(F.col("vec_id").alias("vid"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("grp"), (F.col("label") > 4).cast("int").alias("y"))
    return rounded(M.masked_group_loss(cells, labels, [2.0]), "loss")
