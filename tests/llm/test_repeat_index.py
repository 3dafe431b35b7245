import hashlib
import random

import pytest

from tessera.llm import repeat_index as R


def brute(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        out.append(R.merged([{"lo": i, "hi": i + length} for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]))
    return out


def corpus(seed: int, n: int = 40) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(12, 60)) for _ in range(6)]
    texts = ["", "x", "ab" * 300, "For " * 200, prose(900)]
    for _ in range(n):
        parts = [prose(rng.randint(0, 60)), rng.choice(passages), prose(rng.randint(0, 60)), rng.choice(passages)[: rng.randint(0, 300)]]
        texts.append(" ".join(parts))
    texts += texts[5:9]
    near = texts[7]
    texts += [near[:k] + "#" + near[k + 1 :] for k in range(0, len(near), 37)]
    return texts


@pytest.mark.parametrize("length", [64, 100, 131])
def test_index_matches_brute_force(length):
    strings = [t.encode() for t in corpus(length)]
    index = R.RunLengthIndex(strings)
    assert index.run_size.sum() == sum(len(s) + 1 for s in strings)
    assert len(index.run_char) < 0.8 * index.length
    got = [R.merged([{"lo": a, "hi": b + length - 1} for a, b in found]) for found in index.repeated(length)]
    assert got == brute(strings, length)


@pytest.mark.parametrize("length,hot", [(64, 1024), (100, 1024), (100, 2), (131, 1024)])
def test_operator_matches_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(R, "HOT", hot)
    texts = [None, *corpus(length + hot)]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "x"), (9, texts[9], "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    want = sorted(
        (r[0] or -1, len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(R.without(t, runs)).hexdigest())
        for r, t, runs in zip(rows, [(r[1] or "").encode() for r in rows], brute([(r[1] or "").encode() for r in rows], length))
    )
    got = sorted((r[0] or -1, *r[1:]) for r in map(tuple, R.op5(docs, length).collect()))
    assert got == want
    cut = {(r["doc_id"], r["text"]) for r in R.cut_repeats(docs, length).collect()}
    assert (None, None) in cut and len(cut) <= len(rows)


def test_long_texts_are_cut_into_pieces(monkeypatch):
    monkeypatch.setattr(R, "PIECE_BYTES", 500)
    texts = [t.encode() for t in corpus(5)]
    _, start, size, _, _ = R.segments(texts, 100)
    assert int((size - 99).sum()) == sum(max(0, len(t) - 99) for t in texts)
    assert size.min() >= 100


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert R.op5(docs).collect() == []


def test_string_ids_and_clashing_columns(spark):
    passage = "".join(random.Random(1).choice("abcdef ") for _ in range(500))
    rows = [("a|b", passage), ("a", "b|" + passage), (None, "x" + passage + "y"), ("7", None), ("7", "")]
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id string, text string, row int, spans string, start int")
    got = {r["doc_id"]: r["n_removed"] for r in R.op5(docs.where("doc_id is null or doc_id <> '7'")).collect()}
    assert got == {"a|b": 500, "a": 500, None: 500}
    cut = R.cut_repeats(docs)
    assert cut.columns == docs.columns and {r["text"] for r in cut.collect()} == {"", "b|", "xy", None}


def test_spans_are_merged_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(R, "STRETCH", 300)
    texts = ["z" * 20_000, "ab" * 3000, *corpus(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["row"]: r["spans"] for r in R.repeated_spans(docs, 100).collect()}
    assert max(map(len, spans.values())) <= 20_000 // 300 + 1
    got = {r["doc_id"]: r["n_removed"] for r in R.op5(docs, 100).collect()}
    assert got == {i: sum(b - a for a, b in s) for i, s in enumerate(brute([t.encode() for t in texts], 100))}


def shared_places(rows: list[tuple], words: int) -> dict[int, int]:
    holders: dict[tuple, set] = {}
    windows = {}
    for id_, text in rows:
        found = (text or "").encode().split()
        windows[id_] = [tuple(found[i : i + words]) for i in range(len(found) - words + 1)]
        for w in windows[id_]:
            holders.setdefault(w, set()).add((id_, text))
    return {id_: sum(len(holders[w]) > 1 for w in ws) for id_, ws in windows.items()}


@pytest.mark.parametrize("length,words,piece,hot", [(400, 51, 1 << 17, 4096), (100, 8, 1 << 17, 4096), (100, 51, 40, 4), (64, 17, 1 << 17, 2)])
def test_passages_of_other_rows_match_brute_force(spark, monkeypatch, length, words, piece, hot):
    monkeypatch.setattr(R, "PIECE_WORDS", piece)
    monkeypatch.setattr(R, "HOT", hot)
    monkeypatch.setattr(R, "COUNTED", 200)
    rng = random.Random(1000 + words)
    prose = lambda k: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(k))
    planted = [prose(k) for k in (words - 1, words, words, words + 4, words + 40)]
    texts = [None, "", *corpus(words)]
    for k in range(30):
        p = planted[k % 5]
        texts.append(f"{prose(rng.randint(0, 80))}\n{p.replace(' ', chr(10)) if k % 2 else p}\t {prose(rng.randint(0, 80))}")
    alone = prose(words + 9)
    texts += ["x " + alone + " y " + alone, "ab " * 300]
    rows = [*enumerate(texts), (5, texts[5]), (len(texts) - 2, texts[-2])]
    want = shared_places(rows, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = R.op5(docs, length, words).collect()
    assert {r["doc_id"]: r["n_passages"] for r in got} == want
    assert sum(n > 0 for n in want.values()) >= 24 and want[len(texts) - 2] == 0
    plain = R.op5(docs, length).collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r)[:5] for r in got)


def test_query_tells_passages_below_the_bound_of_bytes(spark, tmp_path):
    from tessera.llm.queries import op5_suffix_array_dedup

    rng = random.Random(8)
    prose = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    passage = prose(55)
    texts = [f"{prose(70)} {passage} {prose(70)}", f"{prose(30)}\n{passage}", prose(200), passage[:290]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_passages"]) for r in op5_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {0: (0, 5), 1: (0, 5), 2: (0, 0), 3: (0, 0)}
