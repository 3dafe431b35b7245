import math

import numpy as np
import pytest
import yaml

from tessera.functions import numeric as N
from tessera.operators import heads as H
from tessera.plans import experiments as E
from tessera.plans import family_run as R
from tessera.sources import writers as W


def test_error_function():
    x = np.concatenate([np.linspace(-8, 8, 20_001), [0.0, -0.0, 1e-300, 5.9999, 6.0, 1e9]])
    assert np.abs(N.erf(x) - [math.erf(v) for v in x]).max() < 3e-15
    h = 1e-6
    assert np.allclose(N.gelu_slope(x[:-1]), (N.gelu(x[:-1] + h) - N.gelu(x[:-1] - h)) / (2 * h), atol=1e-8)


@pytest.mark.parametrize("task", ["regress", "classify"])
@pytest.mark.parametrize("readout,hidden", [("mean", 0), ("mean", 5), ("attention", 4), ("attention_multi", 3)])
def test_gradients_match_differences(task, readout, hidden):
    rng = np.random.default_rng(1)
    x, y = rng.standard_normal((6, 7, 4)), (rng.random((6, 3)) < 0.5).astype(float)
    y[0, 1] = y[3] = np.nan
    w = H.first_weights(4, 3, readout, hidden, 2, 1.0, 5)
    positive = np.array([1.0, 2.0, 0.5])
    out, kept = H.forward(x, w)
    _, d, known = H.loss_slope(out, y, task, positive)
    assert known == 14
    got, at = H.flat(H.backward(d, kept, w)), H.flat(w)
    loss = lambda v: H.loss_slope(H.forward(x, H.shaped(v, w))[0], y, task, positive)[0]
    for k in rng.permutation(len(at))[:40]:
        step = np.zeros(len(at))
        step[k] = 1e-6
        assert got[k] == pytest.approx((loss(at + step) - loss(at - step)) / 2e-6, abs=1e-5, rel=1e-5)


def volumes(spark, many=40, channels=3, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(many):
        tokens = rng.standard_normal(((2 + i % 2), channels))
        y = [float(tokens[:, 0].mean() > 0), None if i % 4 == 0 else float(tokens[:, 1].max() > 0.5)]
        rows.append((f"v{i}", tokens.ravel().tolist(), y))
    return rows, spark.createDataFrame(rows, "vid string, tokens array<double>, y array<double>").repartition(4)


@pytest.mark.parametrize("task", ["regress", "classify"])
def test_fit_equals_numpy(spark, task):
    rows, df = volumes(spark)
    told = {"channels": 3, "task": task, "hidden": 4, "heads": 2, "epochs": 5, "seed": 9, "rate": 0.05}
    got = [m.weights for m in H.MaskedHead(**told).fitted_epochs(df)]
    y = np.array([[np.nan if v is None else v for v in r[2]] for r in rows])
    centre, spread = (np.nanmean(y, 0), np.nanstd(y, 0) + 1e-6) if task == "regress" else (np.zeros(2), np.ones(2))
    share = np.nanmean(y, 0)
    weight = np.ones(2) if task == "regress" else (1 - share) / share
    w = H.first_weights(3, 2, "attention_multi", 4, 2, 1.0, 9)
    values, m1, m2 = H.flat(w), 0.0, 0.0
    for k in range(1, 6):
        g, known = 0.0, 0
        for r, label in zip(rows, y, strict=True):
            out, kept = H.forward(np.array(r[1]).reshape(1, -1, 3), H.shaped(values, w))
            _, d, n = H.loss_slope(out, (label[None] - centre) / spread, task, weight)
            g, known = g + H.flat(H.backward(d, kept, H.shaped(values, w))), known + n
        g = g / known
        g = g * min(1.0, 1.0 / (np.linalg.norm(g) + 1e-6))
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        values = values * (1 - 0.05 * 0.01) - 0.05 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
        assert np.allclose(H.flat(got[k - 1]), values, rtol=1e-9, atol=1e-9)  # a bias without effect has a gradient of rounding errors, which AdamW magnifies


def test_missing_labels_leave_no_trace(spark):
    rows, df = volumes(spark)
    more = spark.createDataFrame([("x1", [9.0] * 6, [None, None]), ("x2", [1.0, 2.0, 4.0], [float("nan"), None])], df.schema)
    told = {"channels": 3, "hidden": 0, "readout": "mean", "epochs": 3, "plain": True, "rate": 0.5}
    a, b = H.MaskedHead(**told).fit(df), H.MaskedHead(**told).fit(df.unionByName(more))
    assert np.allclose(H.flat(a.weights), H.flat(b.weights), rtol=1e-12)
    with pytest.raises(ValueError, match="no row has a label"):
        H.MaskedHead(**told).fit(more)
    assert b.transform(more).count() == 2


def test_model_is_saved_and_loaded(spark, tmp_path):
    _, df = volumes(spark)
    head = H.MaskedHead(channels=3, hidden=3, heads=2, epochs=2, steps=2, predictionCol="said")
    model = head.fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = H.MaskedHeadModel.load(str(tmp_path / "m"))
    key = lambda m: {r["vid"]: r["said"] for r in m.transform(df).collect()}
    assert key(again) == key(model) and again.uid == model.uid
    head.save(str(tmp_path / "h"))
    assert H.MaskedHead.load(str(tmp_path / "h")).getOrDefault("steps") == 2
    with pytest.raises(ValueError, match="already"):
        model.transform(df.withColumnRenamed("y", "said"))
    with pytest.raises(Exception, match="3 channels"):
        model.transform(spark.createDataFrame([("a", [1.0])], "vid string, tokens array<double>")).collect()
    assert model.transform(df.limit(0)).collect() == []


def test_a_read_out_learns(spark):
    _, df = volumes(spark, 120, seed=6)
    model = H.MaskedHead(channels=3, task="classify", hidden=16, heads=2, epochs=40, rate=0.05, clip=0.0).fit(df)
    right = [(p > 0) == (y == 1) for r in model.transform(df).collect() for p, y in zip(r["y_pred"], r["y"], strict=True) if y is not None]
    assert np.mean(right) > 0.75


def grids(spark, tmp_path, many=40):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((many, 16))
    rows = [(i, x[i].tolist(), "train" if i % 4 else "valid") for i in range(many)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, split string").write.parquet(str(tmp_path / "grids"))
    for split, part in (("train", lambda i: i % 4), ("valid", lambda i: not i % 4)):
        lines = [f"train_{i},{x[i, 0]},{'' if i % 3 == 0 else x[i].sum()}" for i in range(many) if part(i)]
        (tmp_path / f"{split}.csv").write_text("VolumeName,first,total\n" + "\n".join(lines).replace("train_", "") + "\n")
    return {"train": str(tmp_path / "train.csv"), "valid": str(tmp_path / "valid.csv")}


@pytest.mark.parametrize("method,budget", [("avgpack", None), ("pack", None), ("l2norm", 3), ("agglo_merge", 3)])
def test_one_command_runs_a_family(spark, tmp_path, method, budget):
    files = grids(spark, tmp_path)
    told = {
        "exp_id": "e", "encoder": "x", "shape": [2, 2, 2], "channels": 2, "compression": {"method": method, "budget": budget}, "families": ["size"], "labels": {"size": files},
        "probe": {"seeds": [3, 4], "epochs": 2, "hidden": 4, "heads": 2, "rate": 0.01},
    }
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(told))
    argv = [str(tmp_path / "c.yaml"), "--grids", str(tmp_path / "grids"), "--out", str(tmp_path / "out"), "--run"]
    key = lambda: sorted(map(tuple, R.score_log(spark, str(tmp_path / "out"), "x", "size").collect()))
    assert E.main(argv) == 0
    log = key()
    assert [r[:5] for r in log] == [(s, e, "size", t, "r2") for s in (3, 4) for e in (1, 2) for t in ("0", "1", "mean")]
    if method == "avgpack":
        assert E.main(argv) == 0 and key() == log
        made = spark.read.parquet(str(tmp_path / "out/predictions/x_size"))
        assert made.count() == 4 * 10 and made.first()["targets"] == ["first", "total"] and len(made.first()["y_pred"]) == 2


def test_runs_are_checked(spark, tmp_path):
    files = grids(spark, tmp_path)
    base = {"exp_id": "e", "encoder": "x", "compression": {"method": "avgpack"}, "families": ["size"]}
    for bad in ({"labels": {"density": files}}, {"probe": {"seeds": []}}, {"probe": {"seeds": [1, 1]}}, {"probe": {"epochs": 0}}, {"probe": {"what": 1}}):
        with pytest.raises(ValueError):
            E.Experiment.model_validate(base | bad)
    with pytest.raises(ValueError, match="no label files"):
        R.run(spark, E.Experiment.model_validate(base), E.FAMILIES, None, None, str(tmp_path))
    with pytest.raises(ValueError, match="no columns"):
        R.family_labels(spark, files["train"], E.FAMILIES["density"])
    got = R.family_labels(spark, files["train"], E.Family("f", "regress", 10.0, log_columns=()))
    assert got.names == ["first", "total"] and got.rows.count() == 30


def test_a_log_is_rerun_safe(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda seed, epoch, score: spark.createDataFrame([(seed, epoch, "t", score)], "seed int, epoch int, target string, score double")
    read = lambda: sorted((r["seed"], r["epoch"], r["score"]) for r in spark.read.parquet(path).collect())
    for _ in range(2):
        for seed in (1, 2):
            for epoch in (1, 2):
                W.append_epoch(rows(seed, epoch, float(seed * epoch)), path, anew=seed == 1 and epoch == 1)
        assert read() == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 2, 4.0)]
    W.append_epoch(rows(2, 1, 9.0), path)
    assert read() == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 9.0), (2, 2, 4.0)]
    for anew in (False, True):
        with pytest.raises(Exception, match="broken"):
            W.append_epoch(rows(2, 1, 5.0).selectExpr("seed", "epoch", "target", "raise_error('broken') + score AS score"), path, anew)
        assert len(read()) == 4 and read()[2] == (2, 1, 9.0)
    W.append_epoch(rows(1, 1, 7.0), path, anew=True)
    assert read() == [(1, 1, 7.0)]
