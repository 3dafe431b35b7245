"""Benchmark decontamination (operator 7): templates of passages, and their slots.

Words of documents and benchmark items are made canonical: numbers, names and units
become typed placeholders, a run of one placeholder becomes one, other words are
lower-cased. Windows of WINDOW canonical words (all words of a shorter item) are
hash-joined. The matched windows of a document and an item that lie on one diagonal, or
on it and those DRIFT beside it, are one alignment; it counts if it has MATCHED windows
(words that runs hide count as windows), or all that the item has, and if its slots are
consistent: where one value of the item stands in several slots, one value of the document
does, but for CONFLICTS of the values. So a copied question is caught with its numbers and
names exchanged, and another text of the same form is not. Built-in functions only.

Whether a capitalised word is a name depends on the word before it. The first word of an
item has none, so that names of documents are read as plain words too where a window
starts, and a capitalised first word of an item or sentence as a name too, unless it is
one of the OPENERS.

Names can't be told by their capitals in a copy that is all lower case or all capitals: an
item is also read with its names as plain words, as such texts are, and found if it is there
in whole. A copy with a capital
on each word reads as long runs of names; in texts with a run of HIDDEN words items are
also looked for whole by their lower-cased words as they stand. So are, in all texts, items
with windows of too few plain words, and by MATCHED of them, so that copies of numbers and
names are found. An item of fewer than SHORT words says too little to be found inside a text: it is looked for as a whole line.

Null and empty texts match nothing, nor do items without a word. A null doc_id or
item_id is an id like any other. Repeated rows give one row a pair. Empty tables give an
empty table. Extra columns are not read. Whole texts are searched. The benchmark's
windows are broadcast only after they were counted and found to be at most BROADCAST.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, staged
from tessera.llm.repeat_index import row_key

WINDOW = 8
#: A window needs so many words that are not placeholders (a shorter one half).
LEAST_WORDS = 4
#: Where the first word is taken for a name, a window needs so many words that aren't OPENERS.
TELLING = 2
#: Texts with so many words in a run are also read without placeholders.
HIDDEN = 3
#: Items of fewer words are looked for as whole lines.
SHORT = 4
MATCHED = 6
DRIFT = 2
CONFLICTS = 0.25
BROADCAST = 2_000_000

#: A word with the sentence's end that follows it.
TOKEN = r"[\p{L}\p{N}]+(?:[.,:/'’-][\p{L}\p{N}]+)*[.!?]*"
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
# Words for numbers and units.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen "
    "seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "billion half third quarter dozen twice thrice"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks "
    "month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh"
).split()
# Words that begin sentences and aren't names.
OPENERS = (
    "a an the this that these those what which who whom whose when where why how if is are was were do does did can could will would "
    "shall should may might must has have had in on at by for from of to with without after before during under over about and or but "
    "so then there here it he she we they you i my his her its our their your all any both each every some no not one find give let "
    "solve compute calculate suppose consider given name list explain describe write choose select how many much while because as"
).split()


#: The start of a word that may be a name.
CAPITAL = r"^\p{Lu}\p{Ll}"


def bare(token: Column) -> Column:
    return F.rtrim(F.lower(token), F.lit(".!?"))


def within(tokens: Column, i: Column) -> Column:
    """Whether a word stands before tokens[i] in its sentence."""
    before = F.get(tokens, i - 1)
    return before.isNotNull() & ~F.substring(before, -1, 1).isin(".", "!", "?")


def canonical(tokens: Column) -> Column:
    """Placeholders and lower-cased words for an array of TOKENs; runs are left."""

    def one(raw: Column, i: Column) -> Column:
        def of(low: Column) -> Column:
            return (
                F.when((raw < ":") | (raw >= "\u0080") & raw.rlike(r"^\p{Nd}"), F.lit(NUMBER))
                .when(low.isin(*NUMBER_WORDS, *UNITS), F.when(low.isin(*UNITS), F.lit(UNIT)).otherwise(F.lit(NUMBER)))
                .when((low != raw) & within(tokens, i) & raw.rlike(CAPITAL), F.lit(NAME))
                .otherwise(low)
            )

        return let(bare(raw), of)

    return F.transform(tokens, one)


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def may_be_name(token: Column) -> Column:
    """Whether a word that begins a sentence may be a name."""
    return token.rlike(CAPITAL) & ~bare(token).isin(*OPENERS)


def run_starts(words: Column) -> Column:
    """Places in a non-empty array of words, without those that repeat the placeholder before them."""

    def first(i: Column) -> Column:
        return ~(F.get(words, i).startswith("<") & F.coalesce(F.get(words, i) == F.get(words, i - 1), F.lit(False)))

    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), first)


def window_hashes(hashes: Column, length: int, exact: bool = False) -> Column:
    """Hashes of the windows of an array of word hashes, by their first word; maybe empty."""
    whole = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - length),
        lambda i: hash_of(length, [F.get(hashes, i + k) for k in range(length)], exact),
    )
    return F.when(F.size(hashes) < length, F.expr("cast(array() as array<bigint>)")).otherwise(whole)


def hash_of(length: int, hashes: list[Column], exact: bool = False) -> Column:
    return F.xxhash64(F.lit(-length if exact else length), *hashes[:length])


def placed(hashes: Column) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))


def line_hashes(text: Column, lengths: list[int]) -> Column:
    """array<struct<h, at>> of the lines of a text that have so many words."""

    def of(line: Column, i: Column) -> Column:
        words = lambda raw: [F.xxhash64(bare(F.get(raw, k))) for k in range(max(lengths))]
        h = lambda raw: F.coalesce(*[F.when(F.size(raw) == n, hash_of(n, words(raw), True)) for n in lengths])
        return F.struct(let(tokens_of(line), h).alias("h"), i.alias("at"))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of), lambda x: x["h"].isNotNull())


def all_windows(text: Column, lengths: list[int], exact: list[int], hidden: list[int], named: bool, lines: list[int], places: bool = True) -> Column:
    """array<struct<h, at>> of a text: windows of every length, by other readings of their first word too.

    Without places it is an array of h alone.
    exact: the lengths of windows of lower-cased words; hidden: the same, for texts in which
    a run of one placeholder hides HIDDEN words. named: whether items have a name first.
    lines: the lengths of items that are whole lines.
    """
    name = F.xxhash64(F.lit(NAME))
    whole = placed if places else lambda hashes: hashes
    some = (lambda found: found) if places else lambda found: F.transform(found, lambda x: x["h"])

    def of(raw: Column, words: Column, starts: Column, hashes: Column) -> Column:
        runs = F.sequence(F.lit(0), F.size(hashes) - 1)
        here = lambda k: F.get(starts, k)
        after = lambda k, n: [F.get(hashes, k + i) for i in range(1, n)]
        names = F.filter(runs, lambda k: F.get(hashes, k) == name)

        def plainly(n: int) -> Column:
            def of_run(k: Column) -> Column:
                end = F.coalesce(here(k + 1), F.size(raw))

                def one(token: Column, i: Column) -> Column:
                    low, last = F.xxhash64(bare(token)), here(k) + i == end - 1
                    h = F.when(last, hash_of(n, [low, *after(k, n)])).otherwise(hash_of(n, [low, name, *after(k, n)]))
                    at = F.when(last, k).otherwise(k - 1)
                    return F.when(at + n <= F.size(hashes), F.struct(h.alias("h"), at.alias("at")))

                return F.transform(F.slice(raw, here(k) + 1, end - here(k)), one)

            return F.filter(F.flatten(F.transform(names, of_run)), lambda x: x.isNotNull())

        def as_names(n: int) -> Column:
            def begins(k: Column) -> Column:
                first = ~within(raw, here(k)) & ~F.get(words, here(k)).startswith("<") & may_be_name(F.get(raw, here(k)))
                return (k + n <= F.size(hashes)) & first

            return F.transform(F.filter(runs, begins), lambda k: F.struct(hash_of(n, [name, *after(k, n)]).alias("h"), k.alias("at")))

        parts = [part for n in lengths for part in (whole(window_hashes(hashes, n)), some(plainly(n)), *([some(as_names(n))] if named else []))]
        if exact:
            plain = F.transform(raw, lambda t: F.xxhash64(bare(t)))
            parts.append(let(plain, lambda p: F.concat(*[whole(window_hashes(p, n, True)) for n in exact])))
        if rest := [n for n in hidden if n not in exact]:
            plain = F.transform(raw, lambda t: F.xxhash64(bare(t)))
            long_run = F.exists(runs, lambda k: F.coalesce(here(k + 1), F.size(raw)) - here(k) >= HIDDEN)
            windows = let(plain, lambda p: F.concat(*[whole(window_hashes(p, n, True)) for n in rest]))
            parts.append(F.when(long_run, windows).otherwise(F.expr(f"cast(array() as array<{'struct<h:bigint,at:int>' if places else 'bigint'}>)")))
        return F.concat(*parts)

    def from_raw(raw: Column) -> Column:
        def from_words(words: Column) -> Column:
            def from_starts(starts: Column) -> Column:
                return let(F.transform(starts, lambda i: F.xxhash64(F.get(words, i))), lambda hashes: of(raw, words, starts, hashes))

            return let(run_starts(words), from_starts)

        return F.when(F.size(raw) > 0, let(canonical(raw), from_words))

    windows = let(tokens_of(text), from_raw)
    none = F.expr(f"cast(array() as array<{'struct<h:bigint,at:int>' if places else 'bigint'}>)")
    return F.concat(F.coalesce(windows, none), some(line_hashes(text, lines))) if lines else windows


def values_of(raw: Column, starts: Column) -> Column:
    """The lower-cased words of every run, as one string each."""

    def value(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), F.size(raw))
        return F.array_join(F.transform(F.slice(raw, i + 1, end - i), bare), " ")

    return F.transform(starts, value)


def item_views(benchmark: DataFrame) -> DataFrame:
    """The readings of every item, by a key v: words, values and sizes of runs, and windows.

    There is the plain reading, one with the first word as a name if it may be one, one with
    names as plain words (flat), and the lower-cased words: exact for items that have windows
    of too few plain words, else only to be matched whole; of short items a line alone.
    """
    items = (
        benchmark.select("item_id", tokens_of(F.col("text")).alias("raw"))
        .where(F.size("raw") > 0)
        .withColumn("n", F.size("raw"))
        .withColumn("plain", canonical(F.col("raw")))
        .withColumn("low", F.transform("raw", bare))
    )
    # Written first: the words are used many times below, and would be made anew each time.
    items = staged(items, "benchmark-words")
    first_named = ~F.get("plain", F.lit(0)).startswith("<") & may_be_name(F.get("raw", F.lit(0)))
    named = F.concat(F.array(F.lit(NAME)), F.slice("plain", F.lit(2), F.col("n")))
    flat = canonical(F.transform("raw", F.lower))
    view = lambda kind, words: F.struct(F.lit(kind).alias("kind"), words.alias("c"))
    long = F.col("n") >= SHORT
    views = F.array(
        F.when(long, view("plain", F.col("plain"))), F.when(long & first_named, view("named", named)), F.when(long & (flat != F.col("plain")), view("flat", flat)), F.when(long, view("exact", F.col("low"))).otherwise(view("line", F.col("low")))
    )
    read = (
        items.select("item_id", "raw", "n", F.explode(F.filter(views, lambda x: x.isNotNull())).alias("view"))
        .select("item_id", "raw", "n", "view.kind", "view.c")
        .withColumn("starts", run_starts(F.col("c")))
        .withColumn("words", F.transform("starts", lambda i: F.get("c", i)))
        .withColumn("values", values_of(F.col("raw"), F.col("starts")))
        .withColumn("sizes", F.transform("starts", lambda i, k: F.coalesce(F.get("starts", k + 1), F.col("n")) - i))
        .withColumn("length", F.least(F.lit(WINDOW), F.size("words")))
        .withColumn("v", F.expr("uuid()"))
        .drop("raw", "c", "starts")
    )
    read = staged(read, "benchmark-readings")
    hashes = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    exact = F.col("kind").isin("exact", "line")
    by_length = F.coalesce(
        *[F.when((F.col("length") == n) & (exact == e), let(hashes, partial(window_hashes, length=n, exact=e))) for n in range(1, WINDOW + 1) for e in (False, True)]
    )
    plain = lambda i: F.size(F.filter(F.slice("words", i + 1, F.col("length")), lambda w: ~w.startswith("<")))
    enough = F.least(F.lit(LEAST_WORDS), F.ceil(F.least(F.lit(WINDOW), F.col("n")) / 2))
    telling = lambda i: F.size(F.filter(F.slice("words", i + 1, F.col("length")), lambda w: ~w.startswith("<") & ~w.isin(*OPENERS)))
    good = lambda i: (F.col("kind") == "line") | (plain(i) >= enough) & ((F.col("kind") != "named") | (telling(i) >= TELLING))
    marked = F.transform(by_length, lambda h, i: F.struct(h.alias("h"), i.alias("at"), good(i).alias("good")))
    read = read.withColumn("marked", marked)
    poor = read.where((F.col("kind") == "plain") & F.exists("marked", lambda x: ~x["good"])).select(F.col("item_id").alias("poor_id")).distinct()
    whole = read.join(poor.withColumn("poor", F.lit(True)), F.col("item_id").eqNullSafe(F.col("poor_id")), "left")
    read = whole.withColumn("kind", F.when((F.col("kind") == "exact") & F.col("poor").isNull(), "whole").otherwise(F.col("kind"))).drop("poor_id", "poor")
    return read.withColumn("windows", F.filter("marked", lambda x: x["good"])).where(F.size("windows") > 0).drop("marked")


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (see row_key), doc_id, item_id, matched, windows and figures of the alignments that count."""
    docs = docs.select("doc_id", "text")
    items = staged(item_views(benchmark.select("item_id", "text")), "benchmark-items")
    windows = staged(
        items.select("v", "kind", "length", F.explode("windows").alias("w")).select("v", "kind", "length", "w.h", F.col("w.at").alias("item_at")),
        "benchmark-windows",
    )
    small = windows.count() <= BROADCAST
    hint = F.broadcast if small else lambda df: df
    kinds = [(r["kind"], r["length"]) for r in windows.select("kind", "length").distinct().collect()]
    lengths = sorted({n for kind, n in kinds if kind in ("plain", "named", "flat")}) or [WINDOW]
    exact, whole, lines = (sorted({n for kind, n in kinds if kind == wanted}) for wanted in ("exact", "whole", "line"))
    named = any(kind == "named" for kind, _ in kinds)
    wanted = windows.select("v", "h", "item_at")

    def found(places: bool) -> Column:
        return F.explode(all_windows(F.col("text"), lengths, exact, whole, named, lines, places))

    touched = docs.select("doc_id", found(False).alias("h")).join(hint(windows.select("h").distinct()), "h", "left_semi").select("doc_id").distinct()
    touched = staged(touched.withColumnRenamed("doc_id", "touched_id"), "touched")
    some = docs.join(touched, F.col("doc_id").eqNullSafe(F.col("touched_id")), "left_semi")
    runs = let(tokens_of(F.col("text")), lambda raw: F.when(F.size(raw) > 0, let(let(canonical(raw), run_starts), lambda starts: values_of(raw, starts))))
    keyed = some.withColumn("r", F.expr("uuid()")).withColumn("row", row_key(F.col("doc_id"), F.col("text"))).withColumn("runs", runs)
    some = staged(keyed, "touched-texts")
    beside = F.explode(F.sequence(F.lit(-DRIFT), F.lit(DRIFT)))
    hits = (
        some.select("r", found(True).alias("w"))
        .select("r", "w.h", F.col("w.at").alias("at"))
        .join(hint(wanted), "h")
        .select("r", "v", "item_at", (F.col("at") - F.col("item_at")).alias("at_shift"), beside.alias("off"))
        .groupBy("r", "v", (F.col("at_shift") + F.col("off")).alias("shift"))
        .agg(F.collect_set(F.struct(F.abs("off").alias("off"), "at_shift", "item_at")).alias("near"))
    )
    own = F.filter("near", lambda m: m["off"] == 0)
    # A diagonal by itself, and with those beside it.
    hits = hits.where(F.size(own) > 0).withColumn("near", F.explode(F.array_distinct(F.array(own, F.col("near")))))
    hits = hits.withColumn("matched", F.array_distinct(F.transform("near", lambda m: m["item_at"])))
    covered = lambda p: F.exists("matched", lambda m: (m <= p) & (p < m + F.col("length")))
    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), covered)
    hidden = F.aggregate(places, F.lit(0), lambda n, p: n + F.get("sizes", p) - 1)
    pairs = (
        hits.join(hint(items) if small else items, "v")
        .where((F.size("matched") >= F.size("windows")) | ~F.col("kind").isin("flat", "whole") & (F.size("matched") + hidden >= MATCHED))
        .join(some.select("r", "row", "doc_id", "runs"), "r")
    )

    def slot(p: Column, values: Column) -> Column:
        over = F.filter("near", lambda m: (m["item_at"] <= p) & (p < m["item_at"] + F.col("length")))
        doc, item = F.get(values, p + F.array_min(over)["at_shift"]), F.get("values", p)
        # At an item's ends a document's run may hold words from beside the item.
        same = ((p <= 1) & doc.endswith(F.concat(F.lit(" "), item))) | ((p == F.size("words") - 1) & doc.startswith(F.concat(item, F.lit(" "))))
        return F.struct(item.alias("item"), F.when(same, item).otherwise(doc).alias("doc"))

    def slots_by(values: Column) -> Column:
        return F.transform(F.filter(places, lambda p: F.get("words", p).startswith("<")), lambda p: slot(p, values))

    none = F.expr("cast(array() as array<struct<item string, doc string>>)")
    slots = F.array_distinct(F.when(F.col("kind").isin("exact", "whole", "line"), none).otherwise(slots_by(F.col("runs"))))
    # Written, as the slots are used many times below.
    told = staged(pairs.select("row", "doc_id", "item_id", "matched", "windows", slots.alias("slots")), "slots")
    return (
        told.withColumn("n_values", F.size(F.array_distinct(F.transform("slots", lambda s: s["item"]))))
        .withColumn("n_conflicts", F.size("slots") - F.col("n_values"))
        .where(F.col("n_conflicts") <= CONFLICTS * F.col("n_values"))
        .withColumn("exchanged", F.size(F.filter("slots", lambda s: ~s["item"].eqNullSafe(s["doc"]))))
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, and figures of the best alignment, for each leak."""
    judged = alignments(docs, benchmark)
    best = F.struct(F.size("matched").alias("n_windows"), (-F.col("exchanged")).alias("kept"), "n_values", F.size("windows").alias("of_windows"))
    return (
        judged.groupBy("doc_id", "item_id")
        .agg(F.max(best).alias("b"))
        .select(
            "doc_id", "item_id", F.col("b.n_windows").cast("long").alias("n_windows"), F.col("b.of_windows").cast("long").alias("item_windows"),
            F.col("b.n_values").cast("long").alias("n_values"), (-F.col("b.kept")).cast("long").alias("n_exchanged"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that leak an item, told by id and text: others of a leaking id stay."""
    leaked = staged(alignments(docs, benchmark).select(F.col("row").alias("__leaked__")).distinct(), "leaked")
    keyed = docs.withColumn("__row__", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(leaked, F.col("__row__") == F.col("__leaked__"), "left_anti").drop("__row__")
