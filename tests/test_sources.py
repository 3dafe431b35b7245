import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R
from tessera.sources import writers as W


def test_npy_grids(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"img_train_{i}_a_1.npy", np.arange(24, dtype=np.float32).reshape(2, 3, 4, 1) + i)
    np.savez(tmp_path / "train_9_a_1.npz", organ=np.ones((2, 2)))
    rows = {r["vid"]: r for r in R.npy_grids(spark, str(tmp_path), member=None).collect()}
    assert set(rows) == {"train_0_a_1", "train_1_a_1", "train_2_a_1", "train_9_a_1"}
    assert rows["train_1_a_1"]["shape"] == [2, 3, 4, 1] and rows["train_1_a_1"]["features"][:2] == [1.0, 2.0]
    assert rows["train_9_a_1"]["features"] == [1.0] * 4


def test_label_csv_keeps_missing_apart_from_zero(spark, tmp_path):
    (tmp_path / "l.csv").write_text("VolumeName,a,b\ntrain_1_a_1.nii.gz,0,nan\ntrain_2_a_1,1.5,\n")
    rows = R.label_csv(spark, str(tmp_path / "l.csv")).orderBy("vid").collect()
    assert [tuple(r) for r in rows] == [("train_1_a_1", 0.0, None), ("train_2_a_1", 1.5, None)]


def test_lists_lines_and_predictions(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" a \n\nb\n")
    assert [r[0] for r in R.id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["a", "b"]
    (tmp_path / "p.jsonl").write_text(json.dumps({"volume_id": "v", "generated_text": "x", "reference_text": "y"}) + "\n")
    assert R.predictions(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        R.jsonl(spark, str(tmp_path / "bad.jsonl"), "volume_id string").collect()
    (tmp_path / "none.jsonl").write_text("")
    with pytest.raises(ValueError):
        R.predictions(spark, str(tmp_path / "none.jsonl"))


def test_run_logs_with_and_without_seed(spark, tmp_path):
    for run, text in (("exp_001_a", "epoch,seed,family,target,metric,score\n1,7,size,0,r2,0.5\n"), ("exp_002_b", "epoch,family,target,metric,score\n2,size,mean,r2,\n")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "x.csv").write_text(text)
    rows = [tuple(r) for r in R.run_logs(spark, str(tmp_path)).orderBy("run").collect()]
    assert rows == [("exp_001_a", 1, 7, "size", "0", "r2", 0.5), ("exp_002_b", 2, None, "size", "mean", "r2", None)]


def test_steps_shards_and_required_columns(spark, tmp_path):
    for k in (2, 10):
        (tmp_path / f"evaluations/step_{k:06d}").mkdir(parents=True)
        (tmp_path / f"evaluations/step_{k:06d}/m.json").write_text(json.dumps({"acc": k / 10}))
    rows = R.step_files(spark, str(tmp_path / "evaluations"), "acc double").orderBy("step").collect()
    assert [tuple(r) for r in rows] == [(0.2, 2), (1.0, 10)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/shard_0.csv").write_text("a,b\n1,2\n")
    assert R.shard_stats(spark, str(tmp_path / "s")).first()["source_file"] == "shard_0.csv"
    assert R.csv_with(spark, str(tmp_path / "s/shard_0.csv"), ["a"]).count() == 1
    with pytest.raises(ValueError, match="Volumename"):
        R.csv_with(spark, str(tmp_path / "s/shard_0.csv"), ["Volumename"])


def test_stacked_codebook_and_shards(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "row int, features array<double>")
    ids = spark.createDataFrame([(0, "a"), (1, "b")], "row int, vid string")
    assert {r["vid"] for r in R.stacked_grids(rows, ids, 2, 1).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        R.stacked_grids(rows, ids.limit(1), 2, 1)
    codes = spark.createDataFrame([("a", 0, 7)], "vid string, pos int, code int")
    book = spark.createDataFrame([(7, "x")], "code int, entry string")
    assert R.codebook_grids(codes, book).first()["entry"] == "x"
    index = spark.createDataFrame([("a", 1, "k")], "vid string, shard int, key string")
    payload = spark.createDataFrame([(1, "k", [1])], "shard int, key string, tokens array<int>")
    assert R.token_shards(index, payload).first()["tokens"] == [1]
    files = spark.createDataFrame([("enc/x_b216/a.npy",), ("enc/x_b27/a.npy",), ("other/x_b27/a",)], "path string")
    assert R.bundle_files(files, [27], ["enc"]).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], "vid string, seed int, epoch int")
    path = str(tmp_path / "t")
    W.write(df, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        W.write(df, path)
    W.write(df.limit(0), path, "skip")
    assert spark.read.parquet(path).count() == 2
    log = str(tmp_path / "log")
    W.append_epoch(df, log)
    W.append_epoch(df.withColumn("seed", F.lit(2)), log)
    assert spark.read.parquet(log).count() == 4
    cells = spark.createDataFrame([("a", 1, 2.0), ("a", 0, 1.0)], "vid string, pos int, v double")
    assert W.matrix(cells, 2).first()["features"] == [1.0, 2.0]
    with pytest.raises(Exception, match="another length"):
        W.matrix(cells, 3).collect()
    facts = {"model": "m", "n": 3, "splits": {"train": 1}}
    meta = str(tmp_path / "meta")
    assert not W.is_fresh(spark, meta, facts)
    W.manifest(spark, meta, facts)
    assert W.is_fresh(spark, meta, facts) and not W.is_fresh(spark, meta, facts | {"n": 4})
    assert W.enriched(df, model="x").first()["model"] == "x"
    W.jsonl(df, str(tmp_path / "j"))
    wanted = spark.createDataFrame([("b", 0), ("a", 1)], "vid string, k int")
    W.subset(df, wanted, "vid", "k", str(tmp_path / "sub"))
    assert spark.read.json(str(tmp_path / "sub")).count() == 2


def test_manifests_of_arms(spark):
    arms = spark.createDataFrame([("x", "train"), ("x", "valid")], "arm string, split string")
    have = arms.withColumn("path", F.concat_ws("/", "arm", "split"))
    assert W.arm_manifests(arms, have).first()["splits"] == {"train": "x/train", "valid": "x/valid"}
    with pytest.raises(ValueError, match="valid"):
        W.arm_manifests(arms, have.where("split = 'train'"))


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a<b", 0.5), ("c", 1.0)], "name string, score double")
    page = tmp_path / "d.html"
    W.dashboard({"runs": df}, str(page))
    assert "a&lt;b" in page.read_text() and "hsl(120" in page.read_text()
    with pytest.raises(ValueError):
        W.dashboard({"runs": df}, str(page), most=1)
    tex = tmp_path / "t.tex"
    tex.write_text("x\n% BEGIN main\nold\n% END main\ny\n")
    W.splice(str(tex), "main", W.latex_rows(df))
    assert "old" not in tex.read_text() and "c & 1.0 \\\\" in tex.read_text()
    buffer = io.BytesIO()
    np.save(buffer, np.zeros(1))
    assert buffer.tell()


@pytest.mark.parametrize("order,packed", [("<", True), (">", False)])
def test_nifti(spark, tmp_path, order, packed):
    import gzip

    x = np.arange(24, dtype=np.int16).reshape(2, 3, 4)
    head = bytearray(352)
    put = lambda at, kind, *v: head.__setitem__(slice(at, at + np.dtype(kind).itemsize * len(v)), np.array(v, order + kind).tobytes())
    put(0, "i4", 348), put(40, "i2", 3, 2, 3, 4, 1, 1, 1, 1), put(70, "i2", 4), put(108, "f4", 352), put(112, "f4", 2), put(116, "f4", -1000)
    head[344:348] = b"n+1\0"
    raw = bytes(head) + x.astype(order + "i2").tobytes(order="F")
    (tmp_path / ("img_train_1_a_1.nii" + ".gz" * packed)).write_bytes(gzip.compress(raw) if packed else raw)
    got = R.nifti_grids(spark, str(tmp_path)).collect()
    assert [(r["vid"], r["shape"]) for r in got] == [("train_1_a_1", [2, 3, 4])] and got[0]["features"] == (x * 2.0 - 1000).ravel().tolist()
    with pytest.raises(ValueError):
        R.nifti_array(b"\0" * 400)
