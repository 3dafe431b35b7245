import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard_join as J


def shingles(text: str | None, k: int) -> frozenset:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows: list[tuple], k: int, percent: int) -> list[tuple]:
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids: dict[int, list] = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(top(i), []).extend([d] if d is not None else [])
    return sorted(((d, len(sets[i]), min(ids[top(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(seed: int, families: int = 12, copies: int = 8) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "é", *("w%d" % i for i in range(300))]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = prose(40)
    rows: list[tuple] = [(None, "a b c d"), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c d"), (7, "x"), (7, "x")]
    n = 10
    for f in range(families):
        base = prose(rng.choice((5, 30, 60, 90, 200)))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 50))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                text += passage
            rows.append((n, "  ".join(text) if rng.random() < 0.3 else "\n".join(text).upper()))
            n += 1
    return rows


@pytest.mark.parametrize("seed,k,percent,small,rounds", [(1, 3, 90, 24, 3), (2, 5, 80, 24, 3), (3, 3, 90, 2, 3), (4, 3, 80, 3, 1), (5, 3, 90, 2, 0)])
def test_components_match_brute_force(spark, monkeypatch, seed, k, percent, small, rounds):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "BLOCK", small)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, point string")
    got = sorted(map(tuple, J.op3(docs, k, percent).collect()), key=repr)
    assert got == brute(rows, k, percent)


def test_keep_one(spark):
    rows = corpus(9)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, point string")
    kept = J.keep_one(docs).collect()
    want = {(d, c) for d, n, c in brute(rows, 5, 80) if n == 0 or d == c}
    assert {r["doc_id"] for r in kept} == {d for d, _ in want}
    assert len([r for r in kept if r["text"] == "x"]) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "point"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert J.op3(docs).collect() == []


def test_keep_one_of_null_and_repeated_ids(spark):
    near = [" ".join(f"w{i}" for i in range(60)) + end for end in ("", " x", " y")]
    far = [" ".join(f"v{i}" for i in range(60)) + end for end in ("", " x")]
    rows = [(None, near[0]), (None, near[1]), (7, far[0]), (7, far[1]), (7, "quite another text of more than five words"), (None, ""), (7, "")]
    kept = [tuple(r) for r in J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 5 and sum(t in near for _, t in kept) == 1 and sum(t in far for _, t in kept) == 1
    rows = [(None, near[0]), (3, near[1]), (3, near[2])]
    kept = J.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 1 and kept[0]["doc_id"] == 3


def test_ids_and_texts_that_join_to_one_string(spark):
    rows = [("a|b", "c d e f g h"), ("a", "b|c d e f g h"), ("7", None), ("7", ""), ("-", "x y"), (None, "x y z z z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, J.keep_one(docs).collect()), key=repr) == sorted(rows, key=repr)
    assert {(r["doc_id"], r["component_id"]) for r in J.op3(docs).collect()} >= {("a|b", "a|b"), ("a", "a")}


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[60_000:]))]
    got = {r["doc_id"]: r for r in J.op3(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3)] == [1, 1, 3]
    assert [got[i]["n_shingles"] for i in (1, 2, 3)] == [len(shingles(t, 3)) for _, t in rows]


def family(n, words=120, edits=3, seed=1):
    """Copies of one text with some words exchanged, many of which link through others only."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(words)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("small,rounds", [(24, 3), (8, 1), (8, 0)])
def test_a_family_whose_links_run_through_others(spark, monkeypatch, small, rounds):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "BLOCK", small)
    rows = family(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.op3(docs).collect()), key=repr) == brute(rows, 3, 90)


def test_rows_dealt_to_blocks_are_in_proportion(spark, monkeypatch):
    dealt = []
    real = J._shells

    def counted(rows, *rest):
        at = F.col("root").eqNullSafe(F.col("main"))
        for r in rows.groupBy("pivot").agg(F.count("*").alias("n"), F.count_if(~at).alias("u")).collect():
            dealt.append(2 * (r["u"] * -(-r["n"] // J.BLOCK) + r["n"] * -(-r["u"] // J.BLOCK)))
        return real(rows, *rest)

    monkeypatch.setattr(J, "_shells", counted)
    n = 4000
    J.op3(spark.createDataFrame(family(n), "doc_id long, text string")).collect()
    assert sum(dealt) <= 20 * n


def test_later_rounds_take_the_sets_of_open_points_only(spark, monkeypatch):
    """A family that one round leaves open, among pairs that it settles."""
    monkeypatch.setattr(J, "SMALL", 4)
    taken, own = [], J.compared
    monkeypatch.setattr(J, "compared", lambda pairs, sets: taken.append(sets.count()) or own(pairs, sets))
    rng = random.Random(5)
    rows = [(1000 + i, text) for i, text in family(60)]
    for k in range(40):
        words = [str(rng.randrange(10**9)) for _ in range(60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.op3(docs).collect()), key=repr) == brute(rows, 3, 90)
    assert len(taken) > 1 and taken[0] > 80 and max(taken[1:]) <= 60, taken
