import hashlib
import random
import re
import struct

import pytest

from tessera.llm import bpe, chat_format, quality_rules, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))

TEXTS = [
    None, "", " ", "a", "Hello world, it's 12345 o'clock!!  \n\n\tNext", "<|endoftext|>", "a<|endoftext|> b <|endoftext|", "é ü ß 漢字 🙂🙂  x y",
    "\x1c\x1dcontrol\x00", "x" * 3000, "ab" * 500 + " end", "   leading   and trailing   ", "I'll we've they'RE 'tis", "\r\n\r\n", "naïve café ١٢٣ Ⅷ",
    "".join(chr(random.Random(5).randint(1, 0xD7FF)) for _ in range(400)),
]


@pytest.fixture(scope="module")
def model():
    return bpe.ByteBpe(bpe.read_vocabulary(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(VOCABULARY)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.mark.parametrize("text", [t for t in TEXTS if t is not None])
def test_bpe_is_that_of_the_library(model, library, text):
    ids = model.encode(text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rng = random.Random(len(text))
    some = [rng.randrange(50257) for _ in range(30)]
    assert model.decode(some) == library.decode(some, skip_special_tokens=False)


def test_scan_and_heap_merge_alike(model, monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdeth ing") for _ in range(rng.randint(1, 60))).encode() for _ in range(200)]
    scanned = [model.word(w) for w in words]
    monkeypatch.setattr(bpe, "LONG_WORD", 0)
    assert [model.word(w) for w in words] == scanned


def test_kept_words_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    small = bpe.ByteBpe(bpe.read_vocabulary(VOCABULARY))
    assert small.encode(" ".join(f"w{i}" for i in range(50))) and len(small.known) <= 5


def test_bpe_query(spark, library):
    docs = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate([*TEXTS, TEXTS[4]])], "doc_id long, text string, ids string")
    got = bpe.op9(spark, docs).collect()
    assert len(got) == len(TEXTS) + 1
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        r = by[i if i != 3 else None]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    whole = {r["doc_id"]: r for r in bpe.encode(docs, VOCABULARY).collect()}
    assert whole[4]["decoded"] == TEXTS[4] and whole[1]["ids"] == []
    assert bpe.op9(spark, docs.limit(0)).collect() == []


def test_counts_are_those_of_greedy_matching(spark):
    pieces = token_counts.vocabulary_pieces(bpe.read_vocabulary(VOCABULARY))
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word: bytes) -> int:
        n = at = 0
        while at < len(word):
            at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in known)
            n += 1
        return n

    automaton = token_counts.Automaton(pieces)
    rng = random.Random(2)
    for word in [b"", b"a", b" the", b"x" * 400, *("".join(rng.choice("theingouaé ") for _ in range(rng.randint(1, 40))).encode() for _ in range(500))]:
        assert automaton.count(word) == greedy(word)
    split = bpe.ByteBpe(bpe.read_vocabulary(VOCABULARY)).split
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    for r in token_counts.op10(docs).collect():
        found = split.findall(TEXTS[r["doc_id"]] or "")
        assert (r["n_words"], r["n_tokens"]) == (len(found), sum(greedy(w.encode()) for w in found))
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


def figures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_figures(spark):
    rng = random.Random(4)
    texts = [*TEXTS, "a a a a", "a b c a b c", "x y z", "l\nl\n\n \n\nl ", "#1 ** <b> 50% & $|"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "h" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    for r in quality_rules.judge(docs).collect():
        want = figures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert quality_rules.judge(docs.limit(0)).collect() == []


def test_bad_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 10 else "bad", f"host{i % 5}") for i in range(400)] + [(1000 + i, "bad" if i < 95 else good, "spam") for i in range(100)]
    rows += [(2000, good, None), (2001, "bad", "single"), (2001, "bad", "single")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, host int")
    kept = {(r["doc_id"], r["kept"]) for r in quality_rules.judge(docs).collect()}
    assert all((i, bool(i % 10)) in kept for i in range(400))
    assert all((1000 + i, False) in kept for i in range(100)) and (2000, True) in kept


def test_chats(spark):
    turns = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None)]
    rows = []
    for conv, n in ((1, 1), (2, 2), (3, 4), (4, 4), (5, 3)):
        rows += [(conv, k, *turns[k]) for k in range(n)]
    rows += [(6, 0, "user", "other"), (7, 0, "user", None), (8, 0, "user", ""), (9, 0, None, ""), (None, 0, "user", "hi"), (10, 0, "user", "hi"), (10, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat_format.format_chats(df).collect()}
    assert set(got) == {3, 6, 7, 8, 9, 10}
    assert got[3] == (4, "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nmore\n<|assistant|>\n\n")
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_hashes_of_many_turns(spark, monkeypatch):
    rows = [(1, k, "user" if k % 2 else "bot", f"turn {k}") for k in range(1000)] + [(2, k, "user" if k % 2 else "bot", f"turn {k}") for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    hashes = {r["conv_id"]: r["hashes"] for r in chat_format.conversations_of(df).collect()}
    assert len(hashes[1]) == len(set(hashes[1])) == 1000 and hashes[1][:700] == hashes[2]
    last = ""
    for (_, _, role, text), h in zip(rows, hashes[1]):
        last = hashlib.sha256(f"{last}{len(role)}:{role}:+{text}".encode()).hexdigest()
        assert h == last
    assert [(r["conv_id"], r["n_turns"]) for r in chat_format.format_chats(df).collect()] == [(1, 1000)]


def test_counts_of_a_very_long_text_repeated_rows_and_an_empty_table(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, "y" * 300_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in token_counts.op10(docs).collect())
    assert got[0] == got[1] and len(got) == 3 and got[2][2] > 1000
    assert token_counts.op10(docs.limit(0)).collect() == []


def test_a_shared_folder_is_asked_for_on_a_cluster():
    from tessera.llm import common

    class Session:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "spark://host:7077" if key == "spark.master" else default

    with pytest.raises(ValueError):
        common.shared_folder(Session())


def test_slices_are_cut_by_the_bytes_of_their_rows():
    import pyarrow as pa

    from tessera.llm import common

    texts = ["x" * 10] * 500 + ["y" * 3000] * 20 + [None, ""] + ["z" * 100_000] + ["x"] * 50
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    parts = list(common.slices(batch, 20_000))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    sizes = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert all(n <= 20_000 for n, p in zip(sizes, parts) if p.num_rows > 1) and max(sizes) == 100_000
    assert list(common.slices(batch.slice(0, 0))) == []
