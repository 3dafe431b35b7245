import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import grid as G
from tessera.operators import learned as L
from tessera.operators import metrics as M
from tessera.operators import region as R
from tessera.operators import tables as T
from tessera.plans import experiments as E


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# Published confusion totals and the scores that belong to them.
@pytest.mark.parametrize(
    "tp,fp,fn,tn,want",
    [
        (550, 1766, 9985, 42401, 0.335), (1561, 1804, 8974, 42363, 0.359), (2224, 3081, 8311, 41086, 0.368), (1504, 2694, 9031, 41473, 0.352),
        (0, 0, 10535, 44167, 1 / 3), (10535, 44167, 0, 0, 1 / 3), (10535, 0, 0, 44167, 1.0),
    ],
)
def test_crg(spark, tp, fp, fn, tn, want):
    assert value(spark, S.crg(*map(F.lit, (tp, fp, fn, tn)))) == pytest.approx(want, abs=0.005 if want not in (1.0, 1 / 3) else 1e-9)


def test_crg_is_null_without_positives(spark):
    assert value(spark, S.crg(*map(F.lit, (0, 3, 0, 5)))) is None


def test_ids_and_gate(spark):
    for raw, want in (("train_1_a_1.nii.gz", "train_1_a_1"), ("img_valid_2_b_1.nii.gz", "valid_2_b_1"), ("x/seg_valid_2_b_1.npy", "valid_2_b_1")):
        assert value(spark, S.volume_id(F.lit(raw))) == want
    assert value(spark, S.residual_gate(F.lit(1.0), F.lit(2.0), 0.25)) == 1.25
    with pytest.raises(ValueError):
        S.uniform_mix(F.lit(1.0), 2)


@pytest.mark.parametrize("code", [0, 1, 7, 12345, 262143])
def test_codes_round_trip(spark, code):
    bits = value(spark, S.unpack_code(F.lit(code)))
    assert len(bits) == 18 and set(bits) <= {-1, 1} and (code & 1) == (bits[-1] > 0)
    assert value(spark, S.pack_code(F.array(*map(F.lit, bits)))) == code
    assert value(spark, S.pack_code(S.unpack_code(F.lit(code), low_first=True), low_first=True)) == code


def volumes(spark, n=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [[float(v)] for v in rng.normal(size=64)]) for i in range(n)]
    return spark.createDataFrame(rows, "vid int, features array<array<double>>")


def brute_merge(x, shape, budget):
    """Merges the adjacent pair of least cost, over all pairs, again and again."""
    near = R.adjacency(shape, 6)
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > budget:
        best = None
        for a in groups:
            for b in groups:
                if a < b and any(j in near[i] for i in groups[a] for j in groups[b]):
                    d = x[groups[a]].mean(0) - x[groups[b]].mean(0)
                    na, nb = len(groups[a]), len(groups[b])
                    cost = na * nb / (na + nb) * float(d @ d)
                    if best is None or cost < best[0]:
                        best = (cost, a, b)
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("budget", [1, 5, 12])
def test_ward_matches_brute_force(budget):
    x = np.random.default_rng(budget).normal(size=(27, 3))
    labels = R.cut(R.merge_order(x, (3, 3, 3)), 27, budget)
    assert {frozenset(np.flatnonzero(labels == r).tolist()) for r in set(labels.tolist())} == brute_merge(x, (3, 3, 3), budget)


def test_regions_are_connected_and_keep_mass(spark):
    v = volumes(spark)
    labels = R.region_labels(v, (4, 4, 4), [8, 4])
    grid = G.from_arrays(v.select("vid", F.flatten("features").alias("f")), "vid", "f", (4, 4, 4))
    means = R.region_means(grid, labels, (4, 4, 4))
    sizes = labels.groupBy("vid", "budget", "region").agg(F.count("*").alias("k"))
    assert sizes.groupBy("vid", "budget").count().where("count <> budget").isEmpty()
    total = means.join(sizes, ["vid", "budget", "region"]).groupBy("vid", "budget").agg(F.sum(F.col("v") * F.col("k")).alias("t"))
    want = grid.groupBy("vid").agg(F.sum("v").alias("w"))
    assert total.join(want, "vid").where("abs(t - w) > 1e-9").isEmpty()
    near = R.adjacency((4, 4, 4), 6)
    for (vid, budget), group in labels.toPandas().groupby(["vid", "budget"]):
        for _, cells in group.groupby("region")["pos"]:
            left, seen = set(cells), [int(min(cells))]
            while seen:
                x = seen.pop()
                if x in left:
                    left.discard(x)
                    seen += [y for y in near[x] if y in left]
            assert not left, (vid, budget)


def test_no_organ_weight_is_plain_merge(spark):
    v = volumes(spark).withColumn("organ", F.transform("features", lambda x: F.array(F.lit(1.0))))
    plain = R.region_labels(v, (4, 4, 4), [8]).orderBy("vid", "pos").collect()
    assert plain == R.region_labels(v, (4, 4, 4), [8], organ="organ", lam=0.0).orderBy("vid", "pos").collect()


def test_multi_budget_equals_single(spark):
    v = volumes(spark, 3)
    both = R.region_labels(v, (4, 4, 4), [27, 8])
    assert both.where("budget = 8").exceptAll(R.region_labels(v, (4, 4, 4), [8])).isEmpty()


def test_space_to_depth_is_undone(spark):
    grid = G.from_arrays(volumes(spark, 2).select("vid", F.flatten("features").alias("f")), "vid", "f", (4, 4, 4))
    assert G.depth_to_space(G.space_to_depth(grid)).exceptAll(grid).isEmpty()


def test_weights_have_mean_one(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0)], "vid int, weight double")
    assert G.mean_one(df).groupBy("vid").agg(F.avg("weight").alias("m")).where("abs(m - 1) > 1e-12").isEmpty()
    with pytest.raises(Exception, match="nothing"):
        G.mean_one(df.withColumn("weight", F.lit(0.0))).collect()


def test_shapes():
    assert G.cubic_factors(216) == (6, 6, 6) and G.cubic_factors(7) == (7, 1, 1)
    assert G.pool_shape((24, 24, 24), 216) == (6, 6, 6)
    assert G.bins(4, 3) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)]
    assert G.strided_places(5, 5) == [0, 1, 2, 3, 4]


def test_shards_cover(spark):
    ids = spark.range(10).withColumnRenamed("id", "k")
    assert sorted(r["k"] for r in T.shard(ids, "k", 3, 0).collect()) == [0, 3, 6, 9]
    assert sum(T.shard(ids, "k", 3, i).count() for i in range(3)) == 10


def test_guards(spark):
    a, b = spark.range(3).withColumnRenamed("id", "k"), spark.range(2).withColumnRenamed("id", "k")
    with pytest.raises(ValueError, match="2"):
        T.strict_join(a, b, ["k"])
    assert [r["k"] for r in T.resume(a, b, ["k"]).collect()] == [2]
    with pytest.raises(ValueError):
        T.resume(b, a, ["k"])
    assert T.alias_closure({"x": ["a", "y"], "y": ["b"]}, "x") == {"a", "b"}
    with pytest.raises(ValueError, match="circle"):
        T.alias_closure({"x": ["y"], "y": ["x"]}, "x")


def test_scores_of_one_class_are_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3), (None, 0.5)], "label int, score double")
    assert M.auroc(df).first()["auroc"] is None


def test_readouts(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(a), float(b)], float(3 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "vid int, x array<double>, y double")
    assert M.r2(L.linear_readout(df, df), []).first()["r2"] > 0.99
    made = L.logistic_readout(df.withColumn("y", (F.col("y") > 0).cast("double")), df.withColumn("y", (F.col("y") > 0).cast("double")))
    assert M.auroc(made).first()["auroc"] > 0.99
    k, named = L.clusters(spark.createDataFrame([(i, [10.0 * (i % 3), 1.0]) for i in range(30)], "vid int, x array<double>"), 2, 4)
    assert k >= 2 and named.count() == 30
    heads = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [2.0, 3.0])], "vid int, pos int, x array<double>")
    assert L.attention_pool(heads, [[0.0, 0.0]]).first()["x"] == [1.0, 2.0]


def test_ssim_of_equal_grids_is_one(spark):
    x = [float(v) for v in np.random.default_rng(1).uniform(-1, 1, 512)]
    df = spark.createDataFrame([(1, x, x), (2, x, [-v for v in x])], "vid int, a array<double>, b array<double>")
    got = {r["vid"]: r["ssim"] for r in L.ssim(df, (8, 8, 8)).collect()}
    assert got[1] == pytest.approx(1) and got[2] < 0.5


def test_experiments_are_checked():
    good = {"exp_id": "e", "encoder": "x", "compression": {"method": "uniform_pool", "budget": 8}, "families": ["size"]}
    E.Experiment.model_validate(good)
    for bad in ({"method": "nope"}, {"method": "avgpack", "params": {"q": 1}}, {"method": "uniform_pool"}):
        with pytest.raises(ValueError):
            E.Experiment.model_validate(good | {"compression": bad})
    with pytest.raises(ValueError):
        E.Experiment.model_validate(good | {"families": ["nope"]})
    with pytest.raises(KeyError):
        E.COMPRESSORS.register("avgpack")(E.avgpack)
    assert E.ordered_commands({"b": ["a"], "a": []}) == ["a", "b"]
    with pytest.raises(ValueError, match="circle"):
        E.ordered_commands({"b": ["a"], "a": ["b"]})
    assert E.budgets_for("uniform_pool", "wide") == [1, 4] and E.budgets_for("uniform_pool", "x") == [8, 27]


def test_plan_and_sweep(spark):
    grid = G.from_arrays(volumes(spark, 2).select("vid", F.flatten("features").alias("f")), "vid", "f", (4, 4, 4))
    for method, budget, rows in (("avgpack", None, 16), ("uniform_pool", 8, 16), ("trilinear", 8, 16), ("l2norm", 5, 10), ("regroup", 16, 32)):
        e = E.Experiment.model_validate({"exp_id": "e", "encoder": "x", "compression": {"method": method, "budget": budget}})
        assert e.plan(grid).count() == rows, method
    assert E.sweep(spark, [{"encoder": "a", "method": "m", "budget": "8"}], ["size", "disease"]).count() == 2


def test_incremental(spark, tmp_path):
    from tessera.streaming import incremental as I

    df = spark.createDataFrame([(i, math.sqrt(i)) for i in range(5)], "k int, v double")
    df.write.parquet(str(tmp_path / "in"))
    run = lambda: I.process_new(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "c"), lambda d: d.where("k > 0"))
    run()
    df.where("k = 3").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_text_scores(spark):
    pairs = spark.createDataFrame([(1, "a b c d e", "a b c d e"), (2, "x y", "p q"), (3, "a b x c", "a b c"), (4, "", "a")], "id int, generated string, reference string")
    rouge = {r["id"]: r["rouge_l"] for r in M.rouge_l(pairs).collect()}
    assert rouge[1] == pytest.approx(1) and rouge[2] == 0 and 0.8 < rouge[3] < 1 and rouge[4] == 0
    meteor = {r["id"]: r["meteor"] for r in M.meteor(pairs).collect()}
    assert meteor[1] == pytest.approx(1 - 0.5 / 125) and meteor[2] == 0 and meteor[1] > meteor[3] > 0
    cider = {r["id"]: r["cider"] for r in M.cider(pairs).collect()}
    assert cider[1] == pytest.approx(10) and cider[2] == 0 and 0 < cider[3] < 10 and cider[4] == 0
    bleu = {r["n"]: r["bleu"] for r in M.bleu(pairs.where("id = 1")).collect()}
    assert bleu == {n: pytest.approx(1) for n in (1, 2, 3, 4)}


def test_epochs_that_lack_seeds_or_targets(spark):
    log = spark.createDataFrame([("a", 1, 1, "F", 0.5), ("a", 2, 1, "F", 0.7), ("a", 1, 2, "F", 0.9), ("a", 1, 1, "O", 0.1)], "run string, seed int, epoch int, target string, score double")
    best = M.best_epoch(log, ["run"]).first()
    assert best["epoch"] == 1 and best["n_seed"] == 2 and best["mean"] == pytest.approx(0.5)
    assert [r["epoch"] for r in M.aligned_mean(log, ["run"], ["F", "O"]).collect()] == [1]


def naive_merge(x, near, budget, linkage):
    """Average and complete linkage by the distances of adjacent clusters, over all pairs, again and again."""
    apart = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i in range(len(x)) for j in near[i] if i < j}
    groups = {i: [i] for i in range(len(x))}
    new = len(x)
    while len(groups) > budget:
        (a, b), _ = min(apart.items(), key=lambda e: (e[1], e[0]))
        na, nb = len(groups[a]), len(groups[b])
        groups[new] = groups.pop(a) + groups.pop(b)
        far = {k: v for k, v in apart.items() if a not in k and b not in k}
        for c in groups:
            p, q = (apart.get((min(c, z), max(c, z))) for z in (a, b))
            if p is not None and q is not None:
                far[c, new] = (na * p + nb * q) / (na + nb) if linkage == "average" else max(p, q)
            elif p is not None or q is not None:
                far[c, new] = q if p is None else p
        apart, new = far, new + 1
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("linkage", ["average", "complete"])
@pytest.mark.parametrize("connectivity", [6, 18, 26, None])
def test_other_linkages_match_naive_merging(linkage, connectivity):
    x = np.random.default_rng(5).normal(size=(36, 3))
    for budget in (2, 7, 20):
        labels = R.cut(R.merge_order(x, (3, 4, 3), linkage, connectivity), 36, budget)
        got = {frozenset(np.flatnonzero(labels == r).tolist()) for r in set(labels.tolist())}
        assert got == naive_merge(x, R.adjacency((3, 4, 3), connectivity), budget, linkage)


def test_ward_without_connectivity_matches_brute_force():
    x = np.random.default_rng(6).normal(size=(30, 2))
    groups = {i: [i] for i in range(30)}
    cost = lambda p, q: len(p) * len(q) / (len(p) + len(q)) * float(((x[p].mean(0) - x[q].mean(0)) ** 2).sum())
    merges = R.merge_order(x, (30, 1, 1), "ward", None)
    for budget in range(29, 0, -1):
        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda e: cost(groups[e[0]], groups[e[1]]))
        groups[a] += groups.pop(b)
        labels = R.cut(merges, 30, budget)
        assert {frozenset(np.flatnonzero(labels == r).tolist()) for r in set(labels.tolist())} == {frozenset(g) for g in groups.values()}


def test_merging_methods_run_from_a_configuration(spark):
    v = volumes(spark, 3)
    grid = G.from_arrays(v.select("vid", F.flatten("features").alias("f")), "vid", "f", (4, 4, 4))
    organ = grid.select("vid", "t", "h", "w", F.explode(F.array(F.lit(0), F.lit(1))).alias("grp")).withColumn("v", (F.col("t") < 2).cast("double") * F.col("grp"))
    plan = lambda method, params=None, given=None: E.Experiment.model_validate(
        {"exp_id": "e", "encoder": "x", "compression": {"method": method, "budget": 8, "params": params or {}}}
    ).plan(grid, given)
    means = R.region_means(grid, R.region_labels(v, (4, 4, 4), [8]), (4, 4, 4))
    plain = plan("agglo_merge")
    assert plain.select("vid", "region", F.round("v", 9)).exceptAll(means.select("vid", "region", F.round("v", 9))).isEmpty() and plain.count() == 24
    assert plan("agglo_organ", {"lam": 0.0}, organ).count() == 24 and plan("agglo_organ", {"lam": 50.0}, organ).count() == 24
    halves = R.region_labels(R.volumes_of(grid, (4, 4, 4), organ), (4, 4, 4), [2], organ="organ", lam=1e6)
    assert halves.groupBy("vid", "region").agg(F.count("*").alias("n")).where("n <> 32").isEmpty()
    full = plan("agglo_merge", {"centroid": True, "centroid_encoding": "sinusoidal", "centroid_freqs": 2, "extent": True})
    assert full.count() == 3 * 8 * (1 + 12 + 3) and full.select("c").distinct().count() == 16
    assert plan("avgpack_places", {"centroid_freqs": 1, "centroid_encoding": "sinusoidal"}).count() == 3 * 8 * 7
    with pytest.raises(ValueError):
        plan("agglo_merge", {"organ": 1})


def test_kept_tokens(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i + k) for k in range(8)], "train" if i < 8 else "valid") for i in range(12)], "vec_id long, embedding array<double>, split string")
    e = E.Experiment.model_validate({"exp_id": "e", "encoder": "x", "shape": [2, 2, 2], "compression": {"method": "avgpack"}})
    with pytest.raises(ValueError):
        E.compress_shard(spark, e, df, "vec_id", "embedding")
    spark.conf.set(E.CACHE_ROOT, str(tmp_path / "kept"))
    try:
        first = [E.compress_shard(spark, e, df, "vec_id", "embedding", 3, k) for k in range(3)]
        assert sum(first) == 12 and E.compress_shard(spark, e, df, "vec_id", "embedding", 3, 1) == 0
        assert {r["vid"] for r in spark.read.parquet(str(tmp_path / "kept/e/valid")).collect()} == set(range(8, 12))
        spark.conf.set(E.NO_CACHE, "true")
        assert E.cache_root(spark) is None
    finally:
        spark.conf.unset(E.CACHE_ROOT)
        spark.conf.unset(E.NO_CACHE)


def test_catalogue_and_families(spark):
    arms = {"wide_merge": {"method": "merge", "budgets": [8, 27], "channels": 768, "lam": 0.5}, "wide_grid": {"method": "grid", "budgets": [8, 216], "channels": 768}}
    got = {(r["arm"], r["budget"]): r for r in E.catalogue(spark, arms, {"reports": ["wide_merge"]}).collect()}
    assert got["wide_merge", 8]["folder"] == "wide_merge_b8_d792_lam0p5" and got["wide_merge", 8]["grid"] == [8, 1, 1] and got["wide_merge", 27]["bundle_set"] == "reports"
    assert got["wide_grid", 216]["grid"] == [6, 6, 6] and got["wide_grid", 216]["dim"] == 768 and got["wide_grid", 8]["bundle_set"] is None
    with pytest.raises(ValueError):
        E.catalogue(spark, {"a": {"method": "grid", "budgets": [10], "channels": 1}})
    assert len(E.FAMILIES) == 9 and E.FAMILIES["disease"].metric == "auroc" and E.FAMILIES["location"].role == "aux"
    made = E.transformed(E.FAMILIES["density"], spark.createDataFrame([(1.0, 2.0, None)], "aorta_calc double, vert_median double, lung_high double")).first()
    assert made["aorta_calc"] == pytest.approx(math.log1p(1000)) and made["vert_median"] == 2.0 and made["lung_high"] is None


def test_step_indexed_batches(spark):
    rows = spark.range(23).withColumnRenamed("id", "row")
    every = T.batches(rows, 23, 2, 3, 1, 8)
    by = {}
    for r in every.collect():
        by.setdefault((r["step"], r["rank"]), []).append((r["slot"], r["row"]))
    assert T.steps_of_epoch(23, 2, 3) == 3 and T.steps_of_epoch(23, 2, 3, drop_last=False) == 4 and set(s for s, _ in by) == set(range(1, 9))
    assert [x for _, x in sorted(by[5, 1])] == [9, 10, 11] and all(len(v) == 3 for v in by.values())
    mixed = T.batches(rows, 23, 2, 3, 2, 7, drop_last=False, seed=4)
    per_epoch = mixed.groupBy("epoch").agg(F.countDistinct("row").alias("d"), F.count("*").alias("n"))
    assert {(r["epoch"], r["d"], r["n"]) for r in per_epoch.collect()} == {(0, 17, 17), (1, 18, 18)}
    first = mixed.where("epoch = 1 and step = 5").orderBy("rank", "slot").select("row")
    assert [r["row"] for r in first.collect()] != list(range(6)) and first.collect() == T.batches(rows, 23, 2, 3, 5, 5, drop_last=False, seed=4).orderBy("rank", "slot").select("row").collect()
    with pytest.raises(ValueError):
        T.steps_of_epoch(5, 2, 3)
    grouped = T.length_grouped(rows.withColumn("n", F.col("row") * 7 % 23), "n", F.col("row"), 10).orderBy("place").collect()
    assert sorted(r["place"] for r in grouped) == list(range(23)) and all(a["n"] >= b["n"] for a, b in zip(grouped[:9], grouped[1:10]))


def test_usable_ids(spark):
    ids, bad = spark.range(10).withColumnRenamed("id", "k"), spark.range(2, 4).withColumnRenamed("id", "k")
    listed = spark.range(0, 8).withColumnRenamed("id", "k")
    assert [r["k"] for r in T.usable_ids(ids, listed, bad, "k", 8, 3).collect()] == [0, 1, 4]
    with pytest.raises(ValueError, match="8"):
        T.usable_ids(ids, listed, bad, "k", 7)


def test_scores_by_ranges_match_single_sort(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else i % 3, int(rng.random() < 0.3), float(np.round(rng.normal(), 2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, label int, score double")
    got = {r["k"]: r for r in M.auroc(df, ["k"]).join(M.average_precision(df, ["k"]).withColumnRenamed("k", "j"), F.col("k").eqNullSafe(F.col("j"))).collect()}
    for k in (None, 0, 1, 2):
        y, s = np.array([r[1] for r in rows if r[0] == k]), np.array([r[2] for r in rows if r[0] == k])
        wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None]).mean()
        cuts = sorted(set(s.tolist()), reverse=True)
        ap = sum(y[s >= c].mean() * y[s == c].sum() for c in cuts) / y.sum()
        assert got[k]["auroc"] == pytest.approx(wins) and got[k]["ap"] == pytest.approx(ap)
    scores = sorted(r[2] for r in rows)
    assert M.upper_median(df.withColumn("one", F.lit(1)), ["one"], "score").first()["upper_median"] == scores[1500]


def test_split_reconstruction_of_empty_and_equal_sides(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, True), (1, 0.0, 0.0, False), (2, 0.0, 1.0, True), (3, 0.0, 1.0, True), (3, 0.0, 0.5, False)], "vid int, a double, b double, inside boolean")
    got = {r["vid"]: r for r in M.split_reconstruction(df, 2.0, ["vid"]).collect()}
    assert got[1]["psnr_out"] == float("inf") and math.isnan(got[1]["ratio_psnr"])
    assert math.isnan(got[2]["mse_out"]) and got[2]["cells_out"] == 0 and math.isnan(got[2]["ratio_psnr"])
    assert got[3]["ratio_psnr"] == pytest.approx(math.log10(4) / math.log10(16))


def test_networks_by_given_weights(spark):
    cells = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [0.0, -1.0]), (2, 0, [3.0, 3.0])], "vid int, pos int, x array<double>")
    gelu = lambda z: 0.5 * z * (1 + math.erf(z / math.sqrt(2)))
    got = {(r["vid"], r["pos"]): r["score"] for r in L.token_scores(cells, [[1.0, 0.5], [-1.0, 0.0]], [0.1, 0.2], [2.0, 1.0], 0.3).collect()}
    assert got[1, 0] == pytest.approx(2 * gelu(2.1) + gelu(-0.8) + 0.3)
    normed = {r["pos"]: r["x"] for r in L.layer_normed(cells.where("vid = 1")).collect()}
    assert normed[0] == pytest.approx([-1, 1], abs=1e-4)
    named = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.95), (3, 1, 1.0), (4, 2, 0.1)], "vid int, cluster int, cosine double")
    assert L.representative(named).first()["vid"] == 2
    gate = ([[1.0, 0.0]], [0.0], [[0.0, 0.0]], [0.0])
    multi = E.READOUTS.apply("attention_multi", cells, weights=[[0.0], [800.0]], gate=gate).collect()
    assert {r["vid"]: r["x"] for r in multi}[1] == pytest.approx([0.5, 0.5, 1.0, 2.0])
    assert E.READOUTS.apply("attention", cells.withColumn("m", F.col("pos") == 1), weights=[5.0], gate=gate, mask="m").collect()[0]["x"] == [0.0, -1.0]


def test_texts_of_findings(spark):
    got = lambda *xs: value(spark, S.pair_finding(*[F.lit(x).cast("string") for x in xs]))
    assert got(None, "  mass\u00a0", "x", "y") == "mass" and got(" ", None, "", " Finding: a. Finding: b ") == " a. Finding: b" and got(None, None, None, None) == ""
    assert value(spark, S.without_nan(F.lit(float("nan")))) == 0.5 and value(spark, S.without_nan(F.lit(float("-inf")))) == 0.0
    flat = value(spark, S.leaf_paths(F.lit('{"a": {"b": {"c": 1}}, "d": [1], "e": "x{y}"}')))
    assert [(r["path"], r["value"]) for r in flat] == [("a.b.c", "1"), ("d", "[1]"), ("e", "x{y}")]
    assert value(spark, S.cell_text(F.lit(0.51234), F.lit(None).cast("double"), F.lit(1))) == "NUM{0.512}"
    matched = value(spark, S.judged_sentences(F.lit("2. one; two:. three; four"), matched=True))
    assert matched == ["three", "four"] and value(spark, S.judged_matches(F.lit("12. x"))) == 12
    assert value(spark, S.judged_section(F.lit("[A]: x\ny\n\n[B]: z"), "A")) == "x\ny" and value(spark, S.judged_section(F.lit("no"), "A")) is None
