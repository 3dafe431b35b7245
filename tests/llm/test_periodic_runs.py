import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs as P


def brute(words: list, least: int = 6, exponent: int = 4) -> list[tuple]:
    """(start, length, period): stretches whose words are equal q apart, kept where q is their smallest period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, exponent * q):
                u = words[i : i + length]
                if all(u[: length - d] != u[d:] for d in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def want(doc_id, text) -> tuple:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), n)


def texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    made = []
    for _ in range(60):
        w = [rng.choice(["a", "b", "é", "word", "x y", " "]) if rng.random() < 0.5 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p, at = rng.randint(1, 7), rng.randrange(len(w) + 1)
            part = [f"v{rng.randrange(3)}" for _ in range(p)]
            w[at:at] = (part * 7)[: rng.randint(p, 7 * p)]
        made.append("".join(x + rng.choice([" ", "\n", "\t \x0b", "\r\n"]) for x in w))
    return made


@pytest.mark.parametrize("alphabet", [1, 2, 3, 5])
def test_all_repetitions_match_brute_force(alphabet):
    rng = random.Random(alphabet)
    for _ in range(300):
        w = [rng.randrange(alphabet) for _ in range(rng.randrange(60))]
        assert P.runs_of(np.array([*w, alphabet]), max(1, len(w) // 2), 2, 2) == brute(w, 2, 2)


def test_squares_of_a_string_are_all_found():
    rng = random.Random(4)
    for _ in range(100):
        w = [rng.randrange(2) for _ in range(rng.randint(2, 40))]
        symbols = np.array([*w, 2])
        ext = P.Extensions(symbols)
        tree = P.SuffixTree(symbols, ext)
        marks = P.vocabulary(tree, P.covering_squares(P.blocks(tree), ext, len(w)))
        got = {tuple(w[tree.least[v] : tree.least[v] + length]) for v, length in marks}
        assert len(got) == len(marks)
        assert got == {tuple(w[i : i + 2 * k]) for i in range(len(w)) for k in range(1, len(w)) if i + 2 * k <= len(w) and w[i : i + k] == w[i + k : i + 2 * k]}


def test_op11_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts(1) + texts(2) + texts(3))]
    rows += [(None, "a a a a a a"), (None, None), (500, None), (501, ""), (502, " \n\t"), (503, "x"), (504, "a " * 5), (505, "a " * 6), (505, "a " * 6)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string").repartition(3)
    got = sorted(map(tuple, P.op11(docs).collect()), key=repr)
    assert got == sorted((want(*r) for r in rows), key=repr)


def test_whole_runs_and_other_columns(spark):
    docs = spark.createDataFrame([("k", "one two one two one two one two end", 1)], "id string, body string, collapsed long")
    (row,) = P.find_runs(docs, "id", "body").collect()
    assert row["collapsed"] == "one two end" and [tuple(r) for r in row["runs"]] == [(0, 8, 2)]


def test_very_long_text(spark):
    n = 60_000
    text = " ".join(["z"] * n + [f"u{i}" for i in range(n)] + [f"p{i % 9_000}" for i in range(n)])
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = P.find_runs(docs).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, n, 1), (2 * n, n, 9_000)]
    assert row["n_words"] == 3 * n and len(row["collapsed"].split()) == 1 + n + 9_000


def test_empty_table(spark):
    assert P.op11(spark.createDataFrame([], "doc_id long, text string")).collect() == []
