import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as M
from tessera.operators import tables as T


def even(lengths, ranks):
    """Each row to the smallest sum that has room, by search."""
    if len(lengths) % ranks:
        return [i % ranks for i in range(len(lengths))]
    sums, room, made = [0] * ranks, [len(lengths) // ranks] * ranks, []
    for n in lengths:
        k = min((k for k in range(ranks) if room[k]), key=lambda k: (sums[k], k))
        sums[k], room[k] = sums[k] + n, room[k] - 1
        made.append(k)
    return made


def brute(rows, ranks, size, seed):
    """{row: (run, rank, slot, place)} in plain loops."""
    mega = ranks * size
    key = lambda *k: int(hashlib.md5(":".join(map(str, [*k, seed])).encode()).hexdigest()[:12], 16)
    runs = {}
    for one in (True, False):
        mine = sorted((r for r in rows if (r[1] > 0) == one), key=lambda r: (key(r[0]), r[0]))
        runs[one] = [mine[i : i + mega] for i in range(0, len(mine), mega)]
    both = bool(runs[True] and runs[False])
    listed = [(one, k) for one in (True, False) for k in range(len(runs[one]) - both)]
    if both:
        listed.sort(key=lambda x: key(int(x[0]), x[1]))
    made, at = {}, 0
    for run, (one, k) in enumerate(listed):
        group = sorted(runs[one][k], key=lambda r: -abs(r[1]))
        dealt = even([abs(r[1]) for r in group], ranks)
        for rank in range(ranks):
            for slot, i in enumerate(i for i, d in enumerate(dealt) if d == rank):
                made[group[i][0]] = (run, rank, slot, at)
                at += 1
    if both:
        for i, r in enumerate(sorted(runs[True][-1] + runs[False][-1])):
            made[r[0]] = (len(listed), i % ranks, i // ranks, at + i)
    return made


@pytest.mark.parametrize("n,share,ranks,size", [(100, 0.4, 3, 4), (37, 0.5, 2, 3), (64, 0.0, 4, 4), (50, 1.0, 4, 4), (3, 0.5, 4, 4), (48, 0.5, 1, 8)])
def test_length_groups_match_brute_force(spark, n, share, ranks, size):
    rng = random.Random(n)
    rows = [(i * 7 % 1000, rng.randrange(1, 9) * (-1 if rng.random() < share else 1)) for i in range(n)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "row int, length int, rest string").repartition(5)
    got = {r["row"]: (r["run"], r["rank"], r["slot"], r["place"]) for r in T.length_grouped_ranks(df, "row", "length", ranks, size, 3).collect()}
    assert got == brute(rows, ranks, size, 3)
    full = {}
    for run, rank, _, _ in got.values():
        full.setdefault(run, []).append(rank)
    assert all(len({r.count(k) for k in range(ranks)}) == 1 for run, r in full.items() if len(r) == ranks * size)


def test_length_groups_are_checked(spark):
    df = spark.createDataFrame([(1, 2), (2, 0)], "row int, length int")
    for bad in (df, df.withColumn("length", F.lit(None).cast("int"))):
        with pytest.raises(Exception, match="no length"):
            T.length_grouped_ranks(bad, "row", "length", 1, 1, 0).collect()
    with pytest.raises(ValueError):
        T.length_grouped_ranks(df, "row", "length", 0, 1, 0)
    made = T.length_grouped_ranks(df.limit(0), "row", "length", 2, 2, 0)
    assert made.collect() == [] and made.columns == ["row", "length", "run", "rank", "slot", "place"]


@pytest.mark.parametrize("seed", range(200))
def test_even_ranks(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 6) for _ in range(rng.randrange(1, 30))]
    for ranks in (1, 2, 3, 5):
        assert T.even_ranks(lengths, ranks) == even(lengths, ranks)


def test_rows_without_order_keep_their_number(spark):
    rows = [(i, None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(4)
    got = {r["k"]: r["row"] for r in T.numbered_rows(df, "x", tie="k").collect()}
    want = sorted(rows, key=lambda r: (0 if r[1] is None else 2 if r[1] != r[1] else 1, 0.0 if r[1] is None or r[1] != r[1] else r[1], r[0]))
    assert got == {k: i for i, (k, _) in enumerate(want)}
    assert sorted(r["row"] for r in T.numbered_rows(df.where("x IS NULL"), "x").collect()) == list(range(10))
    assert T.shard(df, "x", 4, 1).count() == 25
    summed = T.running(df.withColumn("n", F.lit(1)), [], "x", ["n"]).collect()
    assert len(summed) == 100 and {r["total_n"] for r in summed} == {100}


def test_scores_by_the_ranges_of_their_rows(spark):
    rng = random.Random(4)
    rows = [(i % 3, int(rng.random() < 0.3), round(rng.gauss(0, 1), 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, label int, score double").repartition(4)
    for r in M.auroc(df, ["k"]).collect():
        pos = [s for k, y, s in rows if k == r["k"] and y]
        neg = [s for k, y, s in rows if k == r["k"] and not y]
        wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
        assert r["auroc"] == pytest.approx(wins / (len(pos) * len(neg)))
