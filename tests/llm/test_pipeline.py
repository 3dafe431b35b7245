import random

import pytest

import corpus_pipeline as P
from tessera.llm import bpe, repeat_index, toxicity
from tests.llm.test_jaccard_join import brute
from tests.llm.test_learned_operators import BAD, leak_cases, prose
from tests.llm.test_repeat_index import brute as brute_spans

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = []
    for i in range(500):
        w = prose(rng, rng.randint(30, 120))
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        texts.append(" ".join(w))
    item, again, _, _ = leak_cases(rng)
    passage = " ".join(w[:5] for w in prose(rng, 51))
    texts += [texts[1], texts[2] + " one", texts[3].upper(), None, "", "tiny", "tiny"]
    texts += [" ".join(prose(rng, 40)) + ". " + t + ". " + " ".join(prose(rng, 40)) for t in (item, again, passage, passage)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i % 5 == 0)) for i in range(500)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, (507, 508), (509, 510), len(passage)


def test_stages_against_brute_force(spark, folder):
    path, rows, leaking, sharing, size = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)

    clean = P.drop_toxic(spark, docs, path)
    assert clean.columns == docs.columns
    model = toxicity.train(docs.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"))
    score = dict(zip((r[0] for r in rows), model.score(model.compressors(), [toxicity._bytes_of(r[1]) for r in rows])))
    assert pairs(clean) == sorted(((r[0], r[1]) for r in rows if score[r[0]] < toxicity.TOXIC), key=repr)
    caught = [i for i in range(0, 500, 5) if score[i] >= toxicity.TOXIC]
    assert len(caught) > 95 and not [i for i in range(500) if i % 5 and score[i] >= toxicity.TOXIC]

    clean = P.staged(clean, "t")
    single = P.staged(P.keep_one_of_near_copies(spark, clean, path), "t")
    before = [(r["doc_id"], r["text"]) for r in clean.collect()]
    kept = {d for d, n, c in brute(before, 5, 80) if n == 0 or d == c}
    assert {d for d, _ in pairs(single)} == kept and single.count() == len(kept) and single.columns == docs.columns

    cut = P.staged(P.cut_long_repeats(spark, single, path), "t")
    data = [(r["doc_id"], r["text"]) for r in single.collect()]
    spans = brute_spans([(t or "").encode() for _, t in data], P.PASSAGE_WORDS * P.WORD_BYTES)
    want = [(d, t if t is None else repeat_index.without(t.encode(), s).decode("utf-8", "ignore")) for (d, t), s in zip(data, spans)]
    assert pairs(cut) == sorted(want, key=repr) and cut.columns == docs.columns
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in cut.collect())
    assert P.PASSAGE_WORDS * P.WORD_BYTES <= size < repeat_index.LENGTH and sum(len(s) > 0 for s in spans) == 2

    last = P.staged(P.drop_leaks(spark, cut, path), "t")
    assert {d for d, _ in pairs(cut)} - {d for d, _ in pairs(last)} == set(leaking)

    coded = {r["doc_id"]: r["n_tokens"] for r in P.encode(spark, last, path).collect()}
    import public_tokenizers

    model = bpe.ByteBpe(bpe.read_vocabulary(str(public_tokenizers.path("byte_bpe_50k.json"))))
    assert coded == {d: len(model.encode(t)) for d, t in pairs(last)}


def test_run_is_the_chain_of_stages(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES:
        docs = P.staged(stage(spark, docs, path), name)
    assert P.run(spark, path).exceptAll(docs).isEmpty() and len(P.STAGES) == 5


def test_stages_pass_on_columns_of_any_name_and_empty_tables(spark, folder):
    path = folder[0]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id < 20 or doc_id is null or doc_id > 499")
    extra = ("row", "spans", "root", "point", "toxicity", "h", "at", "id", "text_2", "runs", "slots", "linked", "minimizer")
    more = docs
    for i, name in enumerate(extra):
        more = more.withColumn(name, P.F.concat(P.F.lit(f"{name}-"), P.F.coalesce(P.F.col("doc_id").cast("string"), P.F.lit("none"))))
    for name, stage in P.STAGES[:-1]:
        made = P.staged(stage(spark, more, path), "t")
        assert made.columns == more.columns, name
        for r in made.collect():
            assert [r[c] for c in extra] == [f"{c}-{'none' if r['doc_id'] is None else r['doc_id']}" for c in extra], name
        assert stage(spark, more.limit(0), path).collect() == []
    assert P.encode(spark, more.limit(0), path).collect() == []
