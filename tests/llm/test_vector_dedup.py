import numpy as np
import pytest

from tessera.llm import vector_dedup as V


def brute(rows, limit=0.95):
    """(id, n_links, component_id, kept) by all pairs."""
    unit = []
    for _, v in rows:
        good = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit:
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, links[i], least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed: int, d: int, families: int, singles: int, spread: float):
    rng = np.random.default_rng(seed)
    made = [rng.standard_normal(d) for _ in range(singles)]
    for f in range(families):
        base = rng.standard_normal(d)
        # Copies with noise around the limit, so that chains and misses occur.
        made += [base * rng.uniform(0.5, 2) + rng.standard_normal(d) * spread * rng.uniform(0, 1) * np.linalg.norm(base) / np.sqrt(d) for _ in range(3 + 4 * f)]
    made += [made[0], made[0], made[5] * 3]
    order = rng.permutation(len(made))
    rows = [(int(10 + k), [float(c) for c in np.float32(made[i])]) for k, i in enumerate(order)]
    odd = [None, [], [0.0] * d, [None] * d, [float("nan")] * d, [float("inf"), *[1.0] * (d - 1)], [-0.0] * d, [1.0] * (d + 1), [1.0] * (d + 1)]
    return rows + [(k, v) for k, v in enumerate(odd)] + [(None, rows[3][1]), (None, rows[4][1]), (12, rows[2][1]), (None, None), (3000, None)]


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, point string, cell int").repartition(3)
    return sorted(map(tuple, V.op13(df).collect()), key=repr)


@pytest.mark.parametrize("seed,d,spread,block,cells", [(1, 16, 0.4, 4096, 2048), (2, 16, 0.35, 7, 2048), (3, 8, 0.5, 3, 4), (4, 3, 0.3, 5, 2048), (5, 2, 0.6, 40, 8)])
def test_op13_matches_all_pairs(spark, monkeypatch, seed, d, spread, block, cells):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "CELLS", cells)
    rows = corpus(seed, d, 6, 60, spread)
    assert run(spark, rows, "float" if seed % 2 else "double") == brute(rows)


def test_every_vector_near_every_other(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 20)
    rng = np.random.default_rng(8)
    rows = [(i, [float(c) for c in np.float32(1 + 0.02 * rng.standard_normal(12))]) for i in range(150)]
    assert run(spark, rows) == [(i, 149, 0, i == 0) for i in sorted(range(150), key=lambda i: repr((i,)))]


def test_small_and_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(4, None)]) == [(4, 0, 4, True)]
    assert run(spark, [(4, [1.0, 0.0])]) == [(4, 0, 4, True)]
    assert run(spark, [(4, [1e-30, 0.0]), (2, [1e30, 0.0])], "double") == [(2, 1, 2, True), (4, 1, 2, False)]


@pytest.mark.parametrize("sigmas", [None, 4.0])
def test_recall_in_many_dimensions(spark, sigmas):
    """With borders of half a chord nothing is lost; with narrow ones next to nothing, and nothing is linked that isn't."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal((700, 64))
    near = np.concatenate([base[:300] + rng.standard_normal((300, 64)) * s for s in (0.15, 0.25, 0.32)])
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(np.concatenate([base, near]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, V.near_duplicates(df, sigmas=sigmas).collect()), key=repr)
    want = brute(rows)
    if sigmas is None:
        assert got == want
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.999 * there <= found <= there and there > 1000
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_borders_of_few_dimensions_are_exact(spark):
    rng = np.random.default_rng(1)
    points = spark.createDataFrame([(bytes([i]), rng.standard_normal(8).tolist()) for i in range(200)], "point binary, vector array<double>")
    half = np.sqrt(0.1) / 2
    assert V.border(points, 200, 0.95, 4.0) == pytest.approx(half, abs=1e-6) == pytest.approx(V.border(points, 200, 0.95, None), abs=1e-6)
    assert V.border(points, 200, 0.95, 1.0) < 0.5 * half
