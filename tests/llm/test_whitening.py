import math
import random

import numpy as np
import pytest

from tessera.llm import whitening as W


def table(spark, vectors, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in vectors], f"vec_id long, embedding array<{kind}>, x string").repartition(3)


def brute(vectors, d: int):
    """{(id, component)}: n, deviation, whitened up to its sign, explained, by a dense eigenproblem."""
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in vectors if v and len(v) == d and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    e, q = np.linalg.eigh(z.T @ z / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(16, int((e > 1e-12 * e[0]).sum()))
    rows = []
    for i, x in kept:
        t = [n * a - s for a, s in zip(x, sums, strict=True)]
        w = np.array(t) / n @ q[:, :k] / np.sqrt(e[:k])
        rows += [(i, c + 1, n, sum(a * a for a in t), abs(w[c]), e[c] / e.sum()) for c in range(k)]
    return sorted(rows, key=repr)


def same(got, want):
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=repr)
    assert [g[:4] for g in sorted(got, key=lambda g: repr(g[:4]))] == [w[:4] for w in sorted(want, key=lambda w: repr(w[:4]))]
    for g, w in zip(sorted(got, key=lambda g: (repr(g[:2]), g[3], g[4])), sorted(want, key=lambda w: (repr(w[:2]), w[3], w[4])), strict=True):
        assert g[4] == pytest.approx(w[4], abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9)


def vectors(seed: int, many: int, d: int):
    rng = np.random.default_rng(seed)
    scale = np.linspace(3, 0.3, d)
    made = [(i, (rng.standard_normal(d) * scale).astype(np.float32).tolist()) for i in range(many)]
    odd = [(1000, None), (1001, []), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf"), *[0.0] * (d - 1)]), (None, made[3][1]), (7, made[7][1]), (1005, [1.0] * (d + 1))]
    return made + odd


@pytest.mark.parametrize("d,many", [(24, 300), (5, 60), (1, 20)])
def test_op12_matches_a_dense_eigenproblem(spark, d, many):
    rows = vectors(d, many, d)
    got = W.op12(table(spark, rows)).collect()
    same(got, brute(rows, d))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_few_dimensions_with_variance_break_down_and_end(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(9)), 0.0, float(rng.randrange(5)), *[2.0] * 20]) for i in range(80)]
    got = W.op12(table(spark, rows, "double")).collect()
    assert {r["component"] for r in got} == {1, 2}
    same(got, brute(rows, 23))


def test_nothing_to_whiten(spark):
    assert W.op12(table(spark, [])).collect() == []
    assert W.op12(table(spark, [(1, None), (2, [])])).collect() == []
    assert W.op12(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []


def test_large_entries_are_exact():
    rng = random.Random(5)
    for most in (10, 2**20, 2**40, 2**61):
        x = [[rng.randrange(-most, most) for _ in range(3)] for _ in range(7)]
        centre = W.Centre(7, tuple(sum(c) for c in zip(*x, strict=True)))
        want = [sum((7 * a - s) ** 2 for a, s in zip(row, centre.sums, strict=True)) for row in x]
        assert centre.deviations(np.array(x)) == [w if w < 2**63 else None for w in want]


@pytest.mark.parametrize("block,most", [(1, 20), (4, 24), (16, 64), (7, 1)])
def test_restarts_reach_the_dense_result(block, most):
    rng = np.random.default_rng(block)
    a = rng.standard_normal((90, 400))
    a = a @ a.T
    values, q = W.leading(lambda b: a @ b, 90, 8, block, most)
    e, v = np.linalg.eigh(a)
    assert np.allclose(values, e[::-1][:8], rtol=1e-11) and np.allclose(np.abs((q * v[:, ::-1][:, :8]).sum(0)), 1, atol=1e-10)


def test_equal_eigenvalues_and_rank_below_the_block():
    a = np.diag([5.0, 5.0, 5.0, *[0.0] * 37])
    values, q = W.leading(lambda b: a @ b, 40, 6, 4, 16)
    assert np.allclose(values, [5, 5, 5, 0, 0, 0], atol=1e-12) and np.allclose(q.T @ q, np.eye(6))
