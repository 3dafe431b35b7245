import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import files, shards, stacked


def bundle(tmp_path, rows=50, cells=6, channels=2, ids=None):
    x = np.arange(rows * cells * channels, dtype=np.float32).reshape(rows, cells, channels)
    np.save(tmp_path / "a.npy", x)
    (tmp_path / "a.txt").write_text("".join(f" v{i}\n\n" if i % 7 == 0 else f"v{i}\n" for i in range(rows)) if ids is None else ids)
    facts = {"artifact_type": "npy_stacked", "grid_shape": [1, 2, 3], "visual_dim": channels, "splits": {"train": {"array": "a.npy", "ids": "a.txt"}}}
    (tmp_path / "m.json").write_text(json.dumps(facts))
    return str(tmp_path / "m.json"), x


def test_rows_are_read_by_several_tasks(spark, tmp_path):
    path, x = bundle(tmp_path)
    df = stacked.stacked(spark, path, taskBytes=7 * 48)
    assert df.rdd.getNumPartitions() == 8
    assert {r["vid"]: r["features"] for r in df.collect()} == {f"v{i}": x[i].ravel().tolist() for i in range(50)}
    assert stacked.stacked_file(spark, str(tmp_path / "a.npy"), str(tmp_path / "a.txt")).count() == 50


def test_a_filter_of_ids_reads_their_rows_only(spark, tmp_path):
    path, x = bundle(tmp_path)
    reader = stacked.StackedReader({"path": path, "taskBytes": "96"}, "features")
    other = stacked.EqualTo(("features",), 1)
    assert list(reader.pushFilters([stacked.In(("vid",), ("v3", "v9", "v41", "none")), other])) == [other]
    parts = reader.partitions()
    assert [p.single for p in parts] == [((3, "v3"), (9, "v9")), ((41, "v41"),)]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 3
    got = stacked.stacked(spark, path).where(F.col("vid").isin("v3", "v41") & (F.element_at("features", 1) > 0)).collect()
    assert {r["vid"]: r["features"] for r in got} == {v: x[int(v[1:])].ravel().tolist() for v in ("v3", "v41")}
    assert stacked.stacked(spark, path).where("vid = 'none'").collect() == []
    assert stacked.stacked(spark, path).where("vid = 'v3' and vid = 'v4'").collect() == []


def test_a_file_of_a_gigabyte(spark, tmp_path):
    x = np.lib.format.open_memmap(tmp_path / "a.npy", "w+", np.float32, (4096, 64, 1024))
    for i in range(0, 4096, 409):
        x[i] = i
    x.flush()
    (tmp_path / "a.txt").write_text("".join(f"v{i}\n" for i in range(4096)))
    df = stacked.stacked_file(spark, str(tmp_path / "a.npy"), str(tmp_path / "a.txt"))
    assert df.rdd.getNumPartitions() == 16
    ten = df.where(F.col("vid").isin(*[f"v{i}" for i in range(0, 4096, 409)])).select("vid", F.element_at("features", -1).alias("x"))
    assert {r["vid"]: r["x"] for r in ten.collect()} == {f"v{i}": float(i) for i in range(0, 4096, 409)}


@pytest.mark.parametrize("change,error", [
    (lambda d: (d / "a.txt").write_text("v1\nv2\n"), "2 ids"),
    (lambda d: np.save(d / "a.npy", np.zeros((50, 5, 2), np.float32)), r"rows of \(5, 2\)"),
    (lambda d: os.truncate(d / "a.npy", 500), "500 bytes"),
    (lambda d: np.save(d / "a.npy", np.asfortranarray(np.zeros((50, 6, 2), np.float32))), "row-major"),
    (lambda d: (d / "m.json").write_text("{}"), "no manifest"),
])
def test_what_does_not_fit_is_an_error(tmp_path, change, error):
    path, _ = bundle(tmp_path)
    change(tmp_path)
    with pytest.raises(ValueError, match=error):
        stacked.StackedReader({"path": path}, "features").partitions()


def test_splits_and_missing_files(tmp_path, spark):
    path, _ = bundle(tmp_path)
    with pytest.raises(KeyError, match="valid.*train"):
        stacked.StackedReader({"path": path, "split": "valid"}, "features")
    os.remove(tmp_path / "a.npy")
    with pytest.raises(FileNotFoundError):
        stacked.StackedReader({"path": path}, "features").partitions()
    with pytest.raises(Exception, match="kind x"):
        stacked.stacked(spark, path, kind="x").count()


def test_write_appends_overwrites_and_fails_whole(spark, tmp_path):
    manifest = str(tmp_path / "m.json")
    df = lambda *rows: spark.createDataFrame(list(rows), "vid string, features array<double>")
    stacked.write_stacked(df(("a", [1.0, 2.0]), ("b", [3.0, 4.0])), manifest, (2, 1), gridShape="2")
    stacked.write_stacked(df(("c", [5.0, 6.0])), manifest, (2, 1))
    stacked.write_stacked(df(("d", [7.0, 8.0])), manifest, (2, 1), "valid")
    read = lambda split="train": {r["vid"]: r["features"] for r in stacked.stacked(spark, manifest, split).collect()}
    assert read() == {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0, 6.0]} and read("valid") == {"d": [7.0, 8.0]}
    for bad in (("x", [1.0]), (None, [1.0, 2.0]), ("y", None), ("two\nlines", [1.0, 2.0])):
        with pytest.raises(Exception, match="has to have|have to be"):
            stacked.write_stacked(df(("e", [1.0, 1.0]), bad), manifest, (2, 1))
    assert len(read()) == 3
    old = [p["array"] for p in json.loads((tmp_path / "m.json").read_text())["splits"]["train"]["parts"]]
    stacked.write_stacked(df(("z", [0.0, 0.0])), manifest, (2, 1), mode="overwrite")
    assert read() == {"z": [0.0, 0.0]} and read("valid") == {"d": [7.0, 8.0]}
    assert old and not any((tmp_path / p).exists() for p in old)
    stacked.write_stacked(df(), manifest, (2, 1), mode="overwrite")
    assert read() == {}


def shard(tmp_path, **tensors):
    (tmp_path / "train").mkdir(exist_ok=True)
    (tmp_path / "train/s.safetensors").write_bytes(shards.shard_bytes(tensors))


def index(spark, *keys):
    return spark.createDataFrame([(f"v{k}", "train", "s.safetensors", k) for k in keys], "volume_id string, split string, shard string, key string")


def test_only_the_asked_ranges_of_a_shard_are_read(spark, tmp_path, monkeypatch):
    x = np.arange(48, dtype=np.float32).reshape(2, 2, 3, 4)
    shard(tmp_path, a=x, b=x + 100, c=x + 200)
    rows = {r["vid"]: r for r in shards.token_shards(index(spark, "c", "a"), str(tmp_path), 2).collect()}
    assert set(rows) == {"va", "vc"} and rows["va"]["shape"] == [2, 3, 4, 2]
    assert rows["vc"]["features"] == (x + 200).transpose(1, 2, 3, 0).ravel().tolist()
    asked = []

    class Seen(io.BytesIO):
        def read_at(self, n, at):
            asked.append((at, n))
            return self.getvalue()[at : at + n]

    raw = (tmp_path / "train/s.safetensors").read_bytes()
    begin, head = shards.shard_head(Seen(raw), "s", len(raw))
    assert (shards.tensor(Seen(raw), "s", len(raw), begin, head, "b") == x + 100).all()
    assert asked[-1] == (begin + 192, 192) and sum(n for _, n in asked) == begin + 192


@pytest.mark.parametrize("told,error", [
    ({"dtype": "F32", "shape": [4], "data_offsets": [0, 12]}, "lies at"),
    ({"dtype": "F32", "shape": [4], "data_offsets": [8, 24]}, "lies at"),
    ({"dtype": "F32", "shape": [4], "data_offsets": [-4, 12]}, "lies at"),
    ({"dtype": "Q4", "shape": [4], "data_offsets": [0, 16]}, "isn't read"),
])
def test_bad_ranges_of_a_shard(told, error):
    class File(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    with pytest.raises(ValueError, match=error):
        shards.tensor(File(b"\0" * 16), "s", 16, 0, {"k": told}, "k")


def test_kinds_and_broken_shards(spark, tmp_path):
    class File(io.BytesIO):
        def read_at(self, n, at):
            return self.getvalue()[at : at + n]

    half = (np.array([1.5, -2.0], np.float32).view(np.uint32) >> 16).astype("<u2").tobytes()
    got = shards.tensor(File(half), "s", 4, 0, {"k": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}, "k")
    assert got.tolist() == [1.5, -2.0]
    for raw in (b"", b"\xff" * 8 + b"{}"):
        with pytest.raises(ValueError):
            shards.shard_head(File(raw), "s", len(raw))
    shard(tmp_path, a=np.zeros((2, 3), np.float32))
    for keys, channels, error in (("b", None, "no key b"), ("a", None, "C, D, H, W")):
        with pytest.raises(Exception, match=error):
            shards.token_shards(index(spark, keys), str(tmp_path), channels).collect()
    shard(tmp_path, a=np.zeros((2, 3, 1, 1), np.float32))
    with pytest.raises(Exception, match="2 channels"):
        shards.token_shards(index(spark, "a"), str(tmp_path), 3).collect()
    assert shards.token_shards(index(spark, "a").limit(0), str(tmp_path)).collect() == []


def test_shards_are_written_by_tasks_and_found_by_their_index(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"v{i}", [float(i + k) for k in range(4)]) for i in range(30)], "vid string, features array<double>").repartition(3)
    shards.write_token_shards(rows, str(tmp_path), "valid", (2, 1, 1, 2)).write.json(str(tmp_path / "index"))
    read = shards.token_shards(shards.token_index(spark, str(tmp_path / "index")), str(tmp_path))
    assert {r["vid"]: r["features"] for r in read.collect()} == {f"v{i}": [float(i), i + 2.0, i + 1.0, i + 3.0] for i in range(30)}


def test_lines_of_any_chunk(tmp_path):
    text = "\n a\r\nbb\n\n  \nccc"
    (tmp_path / "t").write_bytes(text.encode())
    for chunk in range(1, 9):
        got = list(files.filled_lines(str(tmp_path / "t"), 0, chunk))
        assert [t for _, t in got] == ["a", "bb", "ccc"]
        assert all([t for _, t in files.filled_lines(str(tmp_path / "t"), at, chunk)][0] == name for at, name in got)
    assert files.joined("s3://b/x/", "y") == "s3://b/x/y" and files.joined("/x", "/y") == "/y" and files.joined("/x", "s3://y") == "s3://y"
