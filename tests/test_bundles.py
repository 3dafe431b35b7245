import fnmatch
import os

import pytest

from tessera.operators import grid as G
from tessera.operators import importance as I
from tessera.operators import region as R
from tessera.plans import experiments as E
from tessera.sources import bundles as B
from tessera.sources import readers
from tessera.sources import writers as W

KNOWN = {
    "small": B.Bundle(("a/{encoder}/*_b{budget}_*/**", "a/list.txt"), "data/a", 1.5, "tokens"),
    "large": B.Bundle(("**",), "data/", 2.0),
    "flat": B.Bundle(("b/*.npy",), "data/b", 0.5),
}
PATHS = ["a/x/t_b8_d1/s/1.npy", "a/x/t_b27_d1/1.npy", "a/y/t_b8_d1/1.npy", "a/list.txt", "a/b/c", "b/1.npy", "b/c/1.npy", "top", "b/1.npyx", "ab/x/t_b8_d1/2"]


def test_bundles_are_resolved():
    sets = {"all": ["small", "rest"], "rest": ["large", "flat", "small"]}
    assert B.resolved(KNOWN, sets, ["all", "flat"]) == ["flat", "large", "small"]
    with pytest.raises(ValueError, match="nope"):
        B.resolved(KNOWN, sets, ["nope"])
    with pytest.raises(ValueError, match="circle"):
        B.resolved(KNOWN, {"p": ["q"], "q": ["p"]}, ["p"])


@pytest.mark.parametrize("budget,encoder,want", [
    (None, None, {0: "data/a/x/t_b8_d1/s/1.npy", 1: "data/a/x/t_b27_d1/1.npy", 2: "data/a/y/t_b8_d1/1.npy", 3: "data/a/list.txt"}),
    (8, None, {0: "data/a/x/t_b8_d1/s/1.npy", 2: "data/a/y/t_b8_d1/1.npy", 3: "data/a/list.txt"}),
    (8, "y", {2: "data/a/t_b8_d1/1.npy", 3: "data/a/list.txt"}),
])
def test_members(spark, budget, encoder, want):
    listing = spark.createDataFrame([(p, len(p)) for p in PATHS], "path string, bytes long")
    table = B.bundle_table(spark, KNOWN, ["small", "large", "flat"], budget, encoder)
    members = B.bundle_members(listing, table)
    got = {}
    for r in members.collect():
        got.setdefault(r["bundle"], {})[r["path"]] = r["target"]
    assert got["small"] == {PATHS[k]: v for k, v in want.items()}
    assert got["large"] == {p: f"data/{p}" for p in PATHS} and got["flat"] == {"b/1.npy": "data/b/1.npy"}
    sizes = {r["bundle"]: (r["files"], r["bytes"], r["size_gb"]) for r in B.bundle_sizes(members, table).collect()}
    assert sizes["flat"] == (1, 7, 0.5) and sizes["large"][0] == len(PATHS)
    with pytest.raises(Exception, match="no file of flat"):
        B.bundle_sizes(members.where("bundle <> 'flat'"), table).collect()


def test_expressions_match_whole_paths():
    import re

    for pattern in ("a/*/c", "a/**", "*.npy", "a.b/*", "**/x"):
        for path in ("a/b/c", "a/b/d/c", "a/x", "q.npy", "a/q.npy", "axb/y", "a.b/y", "p/q/x"):
            simple = "**" not in pattern and path.count("/") == pattern.count("/")
            if simple:
                assert bool(re.match(B.expression(pattern), path)) == fnmatch.fnmatchcase(path, pattern), (pattern, path)
    assert re.match(B.expression("a/**"), "a/b/c") and not re.match(B.expression("a/*"), "a/b/c")


def test_an_empty_mask_is_an_error(spark):
    cells = spark.createDataFrame([("a", 2.0, 1.0), ("a", 4.0, 3.0), ("a", 9.0, None), ("b", 1.0, 0.0), ("b", 2.0, None)], "vid string, v double, mask double")
    assert G.masked_mean(cells.where("vid = 'a'")).first()["v"] == pytest.approx(3.5)
    with pytest.raises(Exception, match="a mask is empty"):
        G.masked_mean(cells).collect()


def test_importance_maps(spark, tmp_path):
    maps = spark.createDataFrame([("a", [2, 2, 2], [float(k) for k in range(8)]), ("b", [2, 2, 2], [1.0] * 8)], "vid string, shape array<int>, features array<double>")
    W.npy_files(maps, str(tmp_path / "train/attn_received/all")).collect()
    cells = I.attention_scores(spark, str(tmp_path), "train", (2, 2, 2))
    made = E.IMPORTANCE.apply("attention", cells, shape=(2, 2, 2), out=(1, 1, 2), share=0.5)
    got = {(r["vid"], r["w"]): r["weight"] for r in made.collect()}
    assert got == {("a", 0): pytest.approx(0.5 + 0.5 * 3 / 3.5), ("a", 1): pytest.approx(0.5 + 0.5 * 4 / 3.5), ("b", 0): 1.0, ("b", 1): 1.0}
    with pytest.raises(Exception, match="another shape"):
        I.attention_scores(spark, str(tmp_path), "train", (4, 2, 1)).collect()
    spark.conf.set(I.ATTENTION_VARIANT, "some")
    try:
        with pytest.raises(ValueError, match="some"):
            I.attention_variant(spark)
    finally:
        spark.conf.unset(I.ATTENTION_VARIANT)
    with pytest.raises(Exception, match="can't name a file"):
        W.npy_files(maps.selectExpr("'x/y' AS vid", "shape", "features"), str(tmp_path)).collect()

    masks = spark.createDataFrame([("a", 0, 0, w, c) for w, c in enumerate((5, 7, 0, 5))] + [("b", 0, 0, w, 0) for w in range(4)], "vid string, t int, h int, w int, class_id int")
    findings = spark.createDataFrame([("f", 5), ("f", 7), ("g", 5), ("g", 5), ("h", 9)], "finding string, class_id int")
    made = E.IMPORTANCE.apply("organ_soft", masks.where("vid = 'a'"), findings=findings, shape=(1, 1, 4), out=(1, 1, 2))
    assert {r["w"]: r["weight"] for r in made.collect()} == {0: pytest.approx(1.5 / 1.25), 1: pytest.approx(1.0 / 1.25)}
    with pytest.raises(Exception, match="no organ"):
        E.IMPORTANCE.apply("organ_soft", masks, findings=findings, shape=(1, 1, 4), out=(1, 1, 2)).collect()
    lattice = masks.select("vid", "t", "h", "w")
    assert {r["weight"] for r in I.importance_map(lambda: 1 / 0, lattice, 1).collect()} == {1.0}
    with pytest.raises(ValueError):
        I.finished(made, 1.5)


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_distances_of_pairs(linkage):
    import numpy as np

    x = np.random.default_rng(2).standard_normal((301, 5))
    d = R._Distances(x, block=37)
    full = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(full, np.inf)
    assert len(d.values) == 301 * 300 // 2 and np.allclose([d.row(i) for i in range(301)], full, atol=1e-5)
    d.put(7, full[9])
    assert np.allclose(np.delete(d.row(7), 7), np.delete(full[9], 7), atol=1e-5) and d.row(100)[7] == pytest.approx(full[9][100], abs=1e-5)
    merges = R._unconstrained(x, linkage)
    assert len(merges) == 300


def test_maps_of_named_volumes(spark, tmp_path):
    """Files are opened by name in tasks whose number doesn't follow theirs; the folder isn't listed."""
    n = 200
    maps = spark.range(n).selectExpr("'v' || id AS vid", "array(1, 1, 2) AS shape", "array(id + 1D, id + 2D) AS features")
    folder = tmp_path / "train/attn_received/all"
    assert W.npy_files(maps, str(folder)).count() == n
    assert sorted(os.listdir(folder)) == sorted(f"v{k}.npy" for k in range(n))
    (folder / "broken.npy").write_bytes(b"not an array")
    asked = spark.createDataFrame([(f"v{k}",) for k in (*range(n), 3, 3)], "vid string")
    cells = I.attention_scores(spark, str(tmp_path), "train", (1, 1, 2), asked)
    assert cells.rdd.getNumPartitions() <= max(4, 2 * spark.sparkContext.defaultParallelism)
    assert sorted((r["vid"], r["w"], r["v"]) for r in cells.collect()) == sorted((f"v{k}", w, k + 1.0 + w) for k in range(n) for w in (0, 1))
    large = spark.createDataFrame([("v0",), ("v7",)], "vid string")
    assert {r["vid"]: list(r["features"]) for r in readers.named_npy_grids(large, str(folder), most=1).collect()} == {"v0": [1.0, 2.0], "v7": [8.0, 9.0]}
    with pytest.raises(Exception, match="absent"):
        I.attention_scores(spark, str(tmp_path), "train", (1, 1, 2), asked.selectExpr("'absent' AS vid")).collect()
