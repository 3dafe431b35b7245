import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, gam_quality, samples, toxicity
from tessera.llm import html_extract as H

BAD = ["vermin", "scumlord", "filthwit", "dunghead", "lowlifer"]


def prose(rng, n):
    return [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n)]


SYLLABLES = ["ka", "to", "mi", "re", "lun", "pas", "dor", "vi", "est", "al", "ber", "no", "qui", "sha", "ond"]


def toxic_corpus(n=900, seed=0):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = prose(rng, rng.randint(20, 120))
        toxic = i % 4 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w).capitalize(), int(toxic)))
    return rows


def test_toxicity_of_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "a", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.op2(spark, docs, labels).collect()}
    assert len(got) == len(rows) + 3
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for _, r in held)
    assert np.mean([r["predicted"] == y for y, r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    assert got[9000]["score"] == got[9001]["score"] and got[9000]["predicted"] == 0


def test_windows_cover_every_byte():
    rng = random.Random(3)
    texts = [b"", b"x", b" " * 100, b"y" * 500, *(" ".join(prose(rng, rng.randint(1, 60))).encode() for _ in range(30))]
    joined, spans, owner = toxicity.windows(texts)
    for i, t in enumerate(texts):
        own = spans[owner == i]
        assert (own[:, 1] - own[:, 0]).sum() == len(t)
        assert (own[1:, 0] == own[:-1, 1]).all()
    assert len(joined) == sum(len(t) + 1 for t in texts)


def test_gains_match_windows_compressed_one_by_one():
    rows = toxic_corpus(300, seed=4)
    model = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    texts = [toxicity._bytes_of(t) for _, t, _ in rows[:40]] + [b"", b"\n", b"x" * 900]
    gains, owner = model.gains(model.compressors(), texts)
    joined, spans, _ = toxicity.windows(texts)
    ordinary, toxic = model.compressors()
    want = [len(ordinary.compress(joined[a:b])) - len(toxic.compress(joined[a:b])) for a, b in spans.tolist()]
    assert gains.tolist() == want and max(want) >= model.least_gain
    hits = [sum(g >= model.least_gain for g, o in zip(want, owner.tolist()) if o == i) for i in range(len(texts))]
    assert model.features(gains, owner, len(texts))[:, 1].tolist() == pytest.approx(np.log1p(hits).tolist())
    assert set(BAD) <= {w.decode() for w in toxicity.toxic_words([toxicity._bytes_of(t) for _, t, _ in rows], [y for _, _, y in rows])}


def test_toxicity_of_an_empty_table_and_a_clashing_column(spark):
    model = toxicity.fit(["a b"], [1])
    none = spark.createDataFrame([], "doc_id long, text string, toxicity string, text_2 int")
    assert toxicity.score(none, model).collect() == [] and toxicity.score(none, model).columns == ["doc_id", "text", "text_2", "toxicity"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.op2(spark, none, labels).collect() == []
    one = toxicity.score(spark.createDataFrame([(1, "a", "mine")], "doc_id long, text string, toxicity string"), model, out_col="t").first()
    assert one["toxicity"] == "mine" and one["t"] > 0.5


@pytest.mark.parametrize("labels", [[], [0, 0], [1]])
def test_toxicity_without_two_classes(labels):
    model = toxicity.fit(["a b"] * len(labels), labels)
    score = model.score(None, [b"a", b""])
    assert len(score) == 2 and ((score > 0.5) == (sum(labels) * 2 > len(labels))).all()


def quality_corpus(n=600, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = prose(rng, rng.randint(15, 150))
        good = i % 3 != 0
        if not good:
            kind = rng.randrange(3)
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + rng.choice(["%%%", "$$$"]) for x in w] if kind == 1 else w[:3] * 30
        rows.append((i, " ".join(w) + ("." if good else ""), int(good)))
    return rows


def test_quality_of_held_out_rows(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x")], "doc_id long, text string, figures string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in gam_quality.op8(spark, docs, labels).collect()}
    held = [(y, got[i]) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([r["predicted"] == y for y, r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == len(rows) + 2


def test_quality_of_empty_tables_and_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word and word, " * 30_000), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["score"]) for r in gam_quality.op8(spark, docs, labels).collect()} == {(1, 0.5), (2, 0.5)}
    assert gam_quality.op8(spark, docs.limit(0), labels).collect() == []


def test_pairs_learn_what_single_figures_cannot():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam_quality.fit(x[:2000], y[:2000])
    assert {0, 1} in [set(p) for p in model.pairs]
    assert np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.9
    single = model.score(x[:5])
    by_hand = [sum(t[np.searchsorted(c, v, "right")] for t, c, v in zip(model.tables, model.cuts, row)) for row in x[:5]]
    pairs = [sum(t[np.searchsorted(model.coarse[i], row[i], "right"), np.searchsorted(model.coarse[j], row[j], "right")] for (i, j), t in zip(model.pairs, model.pair_tables)) for row in x[:5]]
    assert np.allclose(single, 1 / (1 + np.exp(-(model.base + np.array(by_hand) + np.array(pairs)))))


def test_training_rows_leave_the_held_out(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    rows = samples.training_rows(docs, labels, "toxic", 40).collect()
    assert len(rows) == 80 and not any(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_training_rows_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(500)] + [(i, "t") for i in range(100, 160)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(7, 1)] * 20 + [(i, 1) for i in range(100, 160)] + [(8, 0)], "doc_id long, toxic int")
    every = samples.training_rows(docs, labels, "toxic", 1000).collect()
    ids = [r["doc_id"] for r in every]
    assert len(ids) == len(set(ids)) and 7 in ids
    assert samples.training_rows(docs, labels, "toxic", 10).count() == 10
    only = samples.training_rows(docs.where("doc_id = 7"), labels.where("doc_id = 7"), "toxic", 10)
    assert only.count() == 1 and only.collect() == only.collect()


def test_very_long_texts_give_a_window_to_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "LONGEST", 2_000)
    rows = toxic_corpus()
    rows = [(i, t * 60 if y == 0 and i % 5 == 0 else t, y) for i, t, y in rows]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(texts) or real(texts, y))
    toxicity.train(docs, labels)
    assert max(map(len, seen[0])) == 2_000 and len(seen[0]) > 300


def leak_cases(rng):
    item = "If Marta buys 12 apples and 30 pears in Lisbon for 5 euros each then how much does Marta pay for all 12 apples when every basket also holds a plum"
    again = item.replace("Marta", "Jonas").replace("12", "77").replace("30", "41").replace("Lisbon", "Madrid").replace("5 euros", "9 dollars")
    mixed = item.replace("12", "77", 1).replace("Marta", "Jonas", 1).replace("30", "41")
    plain = " ".join(prose(rng, 40))
    return item, again, mixed, plain


def test_leaks(spark):
    rng = random.Random(8)
    item, again, mixed, plain = leak_cases(rng)
    around = lambda t: " ".join(prose(rng, 30)) + ". " + t + ". " + " ".join(prose(rng, 30))
    docs = [
        (1, around(item)), (2, around(again)), (3, around(mixed)), (4, around(plain)), (5, " ".join(prose(rng, 100))), (6, None), (7, ""), (8, "short item here"),
        (9, around(" ".join(item.split()[:20]))), (None, item), (1, around(item)), (10, around(plain.upper().replace(" ", "!! "))),
    ]
    bench = [(0, item), (1, plain), (2, "short item here"), (3, None), (4, ""), (5, "12 13 14 15 16 17 18 19 20"), (None, " ".join(prose(rng, 20)))]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(*r, "x") for r in bench], "item_id long, text string, words string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}
    assert set(got) == {(1, 0), (2, 0), (4, 1), (8, 2), (9, 0), (None, 0), (10, 1)}
    assert got[1, 0]["n_exchanged"] == 0 and got[2, 0]["n_exchanged"] >= 4
    assert {r["doc_id"] for r in decontaminate.without_leaks(d, b).collect()} == {3, 5, 6, 7}
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_windows_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST", 0)
    item = leak_cases(random.Random(8))[0]
    d = spark.createDataFrame([(1, item), (2, "nothing here")], "doc_id long, text string")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(d, b).collect()] == [(1, 0)]


def test_clean_documents_of_a_leaking_id_stay(spark):
    item = leak_cases(random.Random(8))[0]
    docs = [(None, item), (None, "clean"), (None, None), (1, "x. " + item), (1, "clean"), (1, "clean"), (2, "other")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    left = decontaminate.without_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([r for r in docs if item not in (r[1] or "")], key=repr)


def leaking(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(d, b).collect()}


def test_items_of_few_plain_words(spark):
    names = "Alice Smith and Bob Jones met Carol King in Paris, France on 3 May 2011."
    numbers = "12 13 14 15 16 17 18 19 20"
    around = lambda t: "some words here: " + t + " and some more words"
    docs = [around(names), around(numbers), around("2 3 4 5 6 7 8 9 10"), names, "Ann Hall and Tom Dean met Eve Ross in Rome, Italy on 4 June 2012.", around(names.lower())]
    assert set(leaking(spark, docs, [names, numbers, "?!"])) == {(0, 0), (1, 1), (3, 0), (5, 0)}


def test_first_word_after_any_word(spark):
    items = [
        "What is the capital of the country that borders France to the west?",
        "Why does the moon look so large near the horizon?",
        "Where do old ships go to rest?",
        "Marta buys pears and does Marta eat them all?",
        "Alice Smith wrote a long letter about the old mill",
    ]
    docs = [f"{head} {t} More words" for head in ("some words. Question:", "some words.", "Heading", "as Bob") for t in items]
    got = leaking(spark, docs, items)
    assert set(got) == {(i, i % 5) for i in range(len(docs))} and all(r["n_exchanged"] == 0 for r in got.values())
    other = [f"{head} Jonas buys pears and does Jonas eat them all?" for head in ("Question:", "some words.")]
    assert set(leaking(spark, [*other, "Question: Paris is the capital of the country that borders France to the west?"], items)) == {(0, 3), (1, 3)}


def test_questions_that_begin_with_their_name(spark):
    items = ["Marta buys 12 apples and 30 pears.", "Tom has \u0663\u0664 stamps and gives away half of them.", "Yes", "No more rain"]
    docs = [
        "some words. Jonas buys 77 apples and 41 pears. And more", "He said yes to the plan. Yes", "first line\nYES.\nlast line", "There was no more rain here.",
        "no more rain", "well. Ann has \u0661\u0669 stamps and gives away half of them. So", "Ann has 19 stamps and gives away half of them.", "The buys 77 apples and 41 pears.",
    ]
    assert set(leaking(spark, docs, items)) == {(0, 0), (2, 2), (4, 3), (5, 1), (6, 1)}


COPIES = [
    "Tom has 5 red apples and gives 2 to Ann. How many apples are left?",
    "the treaty was signed by anna lind in stockholm and came into force two years later after all members had agreed",
    "The treaty was signed by Anna Lind in Stockholm and came into force two years later after all members had agreed.",
    "What is the capital of the country that borders France to the west?",
]


@pytest.mark.parametrize("way", [str, str.lower, str.upper, lambda t: t.replace(" ", "\n"), str.title])
def test_exact_copies_in_any_case(spark, way):
    docs = [f"some words come first. {way(t)} And others go on from there." for t in COPIES]
    docs += [f"other words about apples and treaties, {way(t)[: len(t) // 3]} and then something else" for t in COPIES]
    got = set(leaking(spark, docs, COPIES))
    assert {(k, k) for k in range(len(COPIES))} <= got and not {d for d, _ in got if d >= len(COPIES)}


@pytest.mark.parametrize("way", [str.lower, str.upper])
def test_recall_and_false_hits_of_copies_in_one_case(spark, way):
    rng = random.Random(31)
    made = exchanged_questions(rng, 120)
    around = lambda t: " ".join(prose(rng, 25)) + ". " + way(t) + " " + " ".join(prose(rng, 25))
    got = set(leaking(spark, [around(t) for t, _, _ in made] + [around(t) for _, _, t in made], [t for t, _, _ in made]))
    assert sum((i, i) in got for i in range(120)) == 120
    assert len({d for d, _ in got if d >= 120}) <= 6


def exchanged_questions(rng, n):
    """(item, the same with other values, another of the same form with other plain words)."""
    names, places, units = "Marta Jonas Nadia Oskar Priya Tomas".split(), "Lisbon Madrid Geneva Oslo Quito Lagos".split(), "kg miles hours euros".split()
    out = []
    for _ in range(n):
        w = prose(rng, rng.randint(8, 20))
        slots = sorted(rng.sample(range(len(w)), rng.randint(2, 4)))
        first, second, decoy = list(w), list(w), list(w)
        for k, at in enumerate(slots):
            a, b = rng.sample([str(rng.randint(2, 999)) for _ in range(2)] if k % 2 else names if k % 4 else places, 2)
            unit = rng.choice(units) if k % 2 else ""
            first[at], second[at], decoy[at] = (f"{x} {unit}".strip() for x in (a, b, b))
        for at in rng.sample([i for i in range(len(w)) if i not in slots], max(3, len(w) // 3)):
            decoy[at] = prose(rng, 1)[0]
        out.append(tuple(" ".join(x) + "." for x in (first, second, decoy)))
    return out


def test_recall_of_exchanged_questions(spark):
    rng = random.Random(31)
    made = exchanged_questions(rng, 120)
    around = lambda t: " ".join(prose(rng, 25)).capitalize() + ". " + t[0].upper() + t[1:] + " " + " ".join(prose(rng, 25))
    docs = [around(t) for _, t, _ in made] + [around(t) for t, _, _ in made] + [around(t) for _, _, t in made] + [" ".join(prose(rng, 60)) for _ in range(60)]
    got = set(leaking(spark, docs, [t for t, _, _ in made]))
    caught = [sum((i + part * 120, i) in got for i in range(120)) for part in range(3)]
    assert caught[0] >= 108 and caught[1] == 120 and caught[2] <= 6
    assert not [x for x in got if x[0] >= 360 or x[0] % 120 != x[1]]


def test_values_of_other_numbers_of_words(spark):
    item = "when the old train left the city at noon Ann saw that nobody else had come along"
    longer = item.replace("Ann", "Mary Lee")
    further = item.replace("Ann", "Mary of the Lee")
    two = "the baker sold 12 loaves before lunch and then gave away the rest of them to people who had waited in the cold since early that morning"
    docs = [f"words. {t}. words" for t in (longer, two.replace("12", "two hundred"), two.replace("gave away", "kindly gave away"), further)]
    assert {(0, 0), (1, 1), (2, 1)} == set(leaking(spark, docs, [item, two]))


def test_matches_of_neighbouring_diagonals(spark):
    rng = random.Random(12)
    w = prose(rng, 24)
    docs = [" ".join(w[:11] + ["inserted"] + w[11:22]), " ".join(w[:11] + prose(rng, 9) + w[11:22])]
    assert set(leaking(spark, docs, [" ".join(w)])) == {(0, 0)}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var t="</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies, yes.</div>
<div id="main"><%s><h1>Head &amp; line</h1><p>First   paragraph, with commas, and text that goes on for a while, as prose does.<br>Next
line &eacute;&#233;<p>Second <b>paragraph</b> <a href="#">a link</a>, also long enough to count as text, with commas, more, and more.
<script>bad()</script><blockquote>Quoted</blockquote><ul><li>item one<li>item two</ul><form><input><p>Name, mail, and so on</p></form>
<div class="ad">Buy now, cheap, good</div><table><tr><td>cell</td></tr></table></%s>
<section class="comments"><p>Great article, thanks, a lot, really, it was long and good, and so on and on.</p></section></div>
<aside><p>Read also, this, that, and the other thing, which is very long, indeed, as long as prose.</p></aside><footer>&copy; me</footer></body></html>"""
WANT = (
    "Head & line\nFirst paragraph, with commas, and text that goes on for a while, as prose does. Next line éé\n"
    "Second paragraph a link, also long enough to count as text, with commas, more, and more.\nQuoted\nitem one\nitem two\ncell"
)


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_main_text(tag):
    assert H.main_text(PAGE % (tag, tag)) == WANT


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("<p>", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("<article>x < y <b>z", "x < y z"), ("<script>never closed", ""), ("<p>1</p></div></p>2", "1\n2"), ("<nav>only</nav>", "")])
def test_odd_pages(html, want):
    assert H.main_text(html) == want


PROSE = "<p>%s is a paragraph, with commas, and text that goes on for a while, as prose does, and then some more.</p>"


@pytest.mark.parametrize("wrapper", ["class='site-wrapper has-sidebar'", "class='content no-sidebar'", "class='page with-nav'", "class='overflow-hidden'", "id='header-layout'"])
def test_wrappers_named_after_what_is_cut(wrapper):
    for tag in ("article", "main", "div"):
        body = f"<{tag}>{PROSE % 'One'}{PROSE % 'Two'}<div class='ad'>Buy now</div></{tag}>"
        assert H.main_text(f"<body><div {wrapper}>{body}</div><div class='sidebar'>{PROSE % 'Side'}</div></body>").split()[::21] == ["One", "Two"]


def test_sections_of_an_article():
    parts = [f"<section {a}>{PROSE % n}</section>" for n, a in (("A", "id='discussion'"), ("B", "id='related-work'"), ("C", "class='comments'"), ("D", "class='related-posts'"))]
    assert [line[0] for line in H.main_text(f"<article>{PROSE % 'X'}{''.join(parts)}</article>").split("\n")] == ["X", "A", "B"]
    thread = "".join(f"<article>{PROSE % 'Reader'}</article>" for _ in range(5))
    assert "Reader" not in H.main_text(f"<div>{PROSE % 'One'}{PROSE % 'Two'}<div id='comments'>{thread}</div></div>")


@pytest.mark.parametrize("around", ["<div id='content'>%s</div>", "<div><div id='content'>%s</div><div class='links'><a href='#'>One, two, three, and so on</a></div></div>", "%s"])
@pytest.mark.parametrize("n", [2, 3])
def test_sections_that_hold_containers(around, n):
    names = "ABC"[:n]
    sections = "".join(f"<section><h2>{x}</h2><div class='body'>{PROSE % x}{PROSE % x}</div></section>" for x in names)
    page = f"<body><div class='top'><a href='/'>Home, and so on</a></div>{around % sections}</body>"
    got = H.main_text(page).split("\n")
    assert [line[0] for line in got if len(line) > 80] == [x for x in names for _ in range(2)] and "Home" not in "".join(got)


def test_pages_query(spark):
    rows = [(1, "u", PAGE % ("article", "article"), "x"), (None, None, None, "x"), (1, "u", PAGE % ("article", "article"), "x"), (2, "v", "<div>" * 5000 + "deep", "x")]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 4 and {(r["page_id"], r["n_chars"]) for r in got} == {(1, len(WANT)), (None, 0), (2, 4)}
