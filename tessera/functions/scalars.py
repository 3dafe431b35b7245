"""Column functions: ids, texts, numbers, masks of bits, and packed codes."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- ids -------------------------------------------------------------------------------


def strip_suffix(x: Column) -> Column:
    """An id without the first known file suffix that it ends with."""
    return F.regexp_replace(x, r"\.(nii\.gz|nii|npz|npy)$", "")


def volume_id(x: Column) -> Column:
    """Base name without suffix, and without the prefixes img_ and then seg_."""
    base = strip_suffix(F.regexp_replace(x, r"^.*/", ""))
    return F.regexp_replace(F.regexp_replace(base, "^img_", ""), "^seg_", "")


def image_volume_id(x: Column) -> Column:
    """The volume of an image name; embedded arrays have a longer suffix."""
    return F.regexp_replace(F.regexp_replace(x, r"^.*/", ""), r"(\.nii_embedded\.npz|\.nii\.gz|\.nii|\.npz|\.npy)$", "")


def volume_parts(x: Column) -> Column:
    """split, number, series and index of an id like train_1_a_2."""
    part = F.split(x, "_")
    return F.struct(*[F.get(part, i).alias(n) for i, n in enumerate(("split", "number", "series", "index"))])


def nested_path(x: Column, suffix: str = ".nii.gz") -> Column:
    """train_1_a_2 -> train/train_1/train_1_a/train_1_a_2.nii.gz."""
    cut = lambda n: F.substring_index(x, "_", n)
    return F.concat(F.concat_ws("/", cut(1), cut(2), cut(3), x), F.lit(suffix))


def token_label(r: Column, budget: Column) -> Column:
    """r{r} where r is given and not 0, else b{budget}."""
    return F.when(F.coalesce(r, F.lit(0)) != 0, F.concat(F.lit("r"), r.cast("string"))).otherwise(F.concat(F.lit("b"), budget.cast("string")))


def token_size(budget: Column, r: Column, method: Column, shape: tuple[int, int, int], channels: int, kept: int, factors: list[int]) -> tuple[Column, Column]:
    """Tokens and channels of a run on grids of a shape.

    Without a budget there is a token for each block of r^3. Packing keeps all channels of
    a block, cropping at most `kept` of them, other methods those of a cell.
    """
    table = F.create_map(*[F.lit(x) for f in factors for x in (f, math.prod(-(-n // f) for n in shape))])
    packed = F.lit(channels) * r * r * r
    dim = F.when(method == "pack", packed).when(method == "crop", F.least(F.lit(kept), packed)).otherwise(channels)
    return F.coalesce(budget, F.try_element_at(table, r)).cast("long"), dim.cast("long")


def step_number(path: Column) -> Column:
    """The number of the step_N folder of a path."""
    return F.regexp_extract(path, r"step_0*(\d+)", 1).try_cast("int")


# --- numbers ---------------------------------------------------------------------------


def log_scaled(x: Column, scale: float) -> Column:
    """log(1 + scale * x); null stays null, a negative number is an error."""
    return F.when(x < 0, F.raise_error(F.lit("negative value"))).otherwise(F.log1p(F.lit(scale) * x))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def without_nan(x: Column) -> Column:
    """NaN -> 0.5, infinite -> 1 or 0."""
    inf = float("inf")
    return F.when(F.isnan(x), 0.5).when(x == inf, 1.0).when(x == -inf, 0.0).otherwise(x)


def finite_or_null(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def residual_gate(x: Column, weight: Column, strength: float, most: float | None = None) -> Column:
    gate = 1 + (weight - 1) * strength
    return x * (gate if most is None else F.least(gate, F.lit(most)))


def uniform_mix(weight: Column, share: float) -> Column:
    """(1 - share) * weight + share."""
    if not 0 <= share <= 1:
        raise ValueError(f"share {share} is not within 0 and 1")
    if share == 0:
        return weight
    return F.lit(1.0) if share == 1 else (1 - share) * weight + share


def hounsfield_scaled(x: Column, most: float = 1000.0) -> Column:
    return clip(x, -most, most) / most


def first_number(text: Column) -> Column:
    """The first number of a text like "[0.75, 0.75]"."""
    return F.regexp_extract(text, r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0).try_cast("double")


def perplexity(loss: Column) -> Column:
    return F.when(loss >= 100, float("inf")).otherwise(F.exp(loss))


def psnr(mse: Column, span: float) -> Column:
    """10 log10(span^2 / mse); infinite for no error."""
    return F.when(mse == 0, float("inf")).otherwise(10 * F.log10(F.lit(span * span) / mse))


def crg(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Score of findings relative to guessing; null without positives or negatives.

    With A positives of T cells, a hit gives and a miss takes (T - A) / (2 A), a false alarm
    takes 1. The score is S / (2 S - s) for the best sum S and the sum s.
    """
    positives, total = tp + fn, tp + fp + fn + tn
    worth = (total - positives) / (2.0 * positives)
    best, got = worth * positives, worth * (tp - fn) - fp
    return F.when((positives > 0) & (total > positives) & (2 * best != got), best / (2 * best - got))


def green_score(matched: Column, errors: list[Column]) -> Column:
    """matched / (matched + significant errors), 0 without matches."""
    return F.when(matched == 0, 0.0).otherwise(matched / (matched + reduce(lambda a, b: a + b, errors)))


def cache_bytes(layers: int, heads: int, size: int, tokens: Column) -> Column:
    return F.lit(2 * layers * heads * size * 2).cast("long") * tokens


def steps_per_epoch(rows: Column, batch: int = 16) -> Column:
    return F.ceil(rows / batch)


# --- vectors ---------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def project(x: Column, mean: list[float], components: list[list[float]]) -> Column:
    """(x - mean) times each component."""
    centred = F.zip_with(x, F.array(*map(F.lit, mean)), lambda a, m: a.cast("double") - m)
    return F.array(*[dot(centred, F.array(*map(F.lit, c))) for c in components])


def learned_row(base: Column, delta: Column, scale: float, reverse: bool = False) -> Column:
    made = F.zip_with(base, delta, lambda b, d: b + scale * d)
    return F.reverse(made) if reverse else made


# --- packed codes ----------------------------------------------------------------------


def unpack_code(code: Column, bits: int = 18, low_first: bool = False) -> Column:
    """Bits of a code as -1 and +1, the highest first."""
    made = F.array(*[(2 * F.shiftright(code, i).bitwiseAND(F.lit(1)) - 1).cast("int") for i in range(bits - 1, -1, -1)])
    return F.reverse(made) if low_first else made


def pack_code(signs: Column, low_first: bool = False) -> Column:
    """The code whose bits are set where signs are above 0."""
    ordered = F.reverse(signs) if low_first else signs
    return F.aggregate(ordered, F.lit(0).cast("long"), lambda s, x: s * 2 + F.when(x > 0, 1).otherwise(0))


# --- texts -----------------------------------------------------------------------------

#: White space of any kind.
WHITE = r"[\s\x0b\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(x: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(x, f"^{WHITE}+|{WHITE}+$", "")


def single_blanks(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(x, f"{WHITE}+", " "))


def finding_text(x: Column) -> Column:
    """Trimmed, lower-case, single blanks, without blanks and .;:, at the ends."""
    return F.btrim(single_blanks(F.lower(x)), F.lit(" .;:,"))


def plain_text(x: Column) -> Column:
    """Single blanks, trimmed, without blanks and dots at the end."""
    return F.rtrim(single_blanks(x), F.lit(" ."))


def text_hash(x: Column) -> Column:
    return F.substring(F.sha1(F.lower(plain_text(x))), 1, 16)


def target_text(region: Column, finding: Column) -> Column:
    return F.concat(F.lit("Region: "), F.replace(region, F.lit("_"), F.lit(" ")), F.lit(". Finding: "), plain_text(finding), F.lit("."))


def first_filled(*xs: Column) -> Column:
    """The first that isn't null or blank, without white space at its ends."""
    return F.coalesce(*[F.when(stripped(x) != "", stripped(x)) for x in xs])


def after(x: Column, mark: str) -> Column:
    """What follows the first mark, as it stands; the whole stripped text without one."""
    x = stripped(x)
    place = F.instr(x, mark)
    return F.when(place > 0, F.substr(x, place + len(mark))).otherwise(x)


def pair_finding(raw_text: Column, finding: Column, label: Column, text: Column) -> Column:
    """The finding that a row names, or else what follows "Finding:" in its text; never null."""
    return F.coalesce(first_filled(raw_text, finding, label), after(text, "Finding:"), F.lit(""))


#: Texts that say there is no finding.
NORMAL = ("no finding", "no findings")


def is_normal(x: Column) -> Column:
    return finding_text(x).isin(*NORMAL)


def option_letters(x: Column) -> Column:
    """Options A, B and C that stand alone in the upper-cased text, in order."""
    return F.regexp_extract_all(F.upper(x), F.lit(r"\b([ABC])\b"), F.lit(1))


def joined_sections(*xs: Column) -> Column:
    """Sections that aren't empty or "nan", with blanks between."""
    return F.concat_ws(" ", *[F.when((F.btrim(x) != "") & (F.lower(F.btrim(x)) != "nan"), F.btrim(x)) for x in xs])


def says_yes(x: Column) -> Column:
    return F.lower(stripped(x)).startswith("yes")


def first_words(x: Column, n: int = 300) -> Column:
    return F.array_join(F.slice(F.filter(F.split(x, r"\s+"), lambda w: w != ""), 1, n), " ")


def cleaned_reply(x: Column, marks: list[str], gone: list[str]) -> Column:
    """What follows the last of each mark, without some strings."""
    for m in marks:
        x = F.substring_index(x, m, -1)
    for g in gone:
        x = F.replace(x, F.lit(g), F.lit(""))
    return F.btrim(x)


def first_json(x: Column, *paths: str) -> Column:
    """The first of the JSON paths that is a number."""
    return F.coalesce(*[F.get_json_object(x, p).try_cast("double") for p in paths])


def source_kind(x: Column) -> Column:
    """Which scorer wrote a JSON blob, by the keys that it has."""
    has = lambda *paths: reduce(lambda a, b: a | b, [F.get_json_object(x, p).isNotNull() for p in paths])
    return F.when(has("$.green", "$.green_mean"), "green").when(has("$.llama", "$.llama_score"), "llama").when(has("$.fast", "$.clinical", "$.text"), "fast").otherwise("unknown")


def cell(n: Column, sd: Column) -> Column:
    """FIN with three seeds and a deviation, PROV with fewer, NUM without."""
    return F.when((n >= 3) & sd.isNotNull(), "FIN").when(sd.isNotNull(), "PROV").otherwise("NUM")


def cell_text(mean: Column, sd: Column, n: Column, digits: int = 3) -> Column:
    """A table's cell: the tag with the mean, and the deviation where there is one; null without a mean."""
    shown = lambda x: F.format_string(f"%.{digits}f", x)
    body = F.when(sd.isNull(), shown(mean)).otherwise(F.concat(shown(mean), F.lit("+-"), shown(sd)))
    return F.when(mean.isNotNull(), F.concat(cell(n, sd), F.lit("{"), body, F.lit("}")))


def leaf_paths(blob: Column) -> Column:
    """array<struct<path, value>> of the leaves of a JSON object, by dotted path; lists are leaves.

    Each turn replaces the objects of the array by their members, as deep as they go: the
    depth of an object is that of its braces.
    """
    entry = lambda p, v: F.struct(p.alias("path"), v.alias("value"))
    members = lambda x: F.transform(
        F.map_entries(F.from_json(x["value"], "map<string,string>")), lambda e: entry(F.concat(x["path"], F.when(x["path"] == "", "").otherwise("."), e["key"]), e["value"])
    )

    def turn(found: Column, _: Column) -> Column:
        return F.flatten(F.transform(found, lambda x: F.when(_is_object(x["value"]), members(x)).otherwise(F.array(entry(x["path"], x["value"])))))

    depth = F.length(F.regexp_replace(blob, r"[^{]", ""))
    start = F.array(entry(F.lit(""), blob))
    return F.when(_is_object(blob), F.aggregate(F.sequence(F.lit(1), depth), start, turn))


def _is_object(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^\s*\{[\s\S]*[^\s{][\s\S]*\}\s*$"), F.lit(False))


def summary_values(blob: Column, names: dict[str, str]) -> list[Column]:
    """Columns named as names says, from paths of a JSON blob; null where there is no number."""
    return [F.get_json_object(blob, f"$.{path}").try_cast("double").alias(name) for path, name in names.items()]


def prompt(system: str, question: Column) -> Column:
    return F.concat(F.lit(f"{system} USER: <image>\n"), question, F.lit(" ASSISTANT:"))


#: The categories of errors that a judged report lists.
ERROR_LETTERS = ("a", "b", "c", "d", "e", "f")


def judged_section(x: Column, name: str) -> Column:
    """The text of a section of a judgement, up to the next empty line; null if there is none."""
    found = F.regexp_extract_all(x, F.lit(rf"\[{name}\]:\s*([\s\S]*?)(?:\n\s*\n|$(?![\s\S]))"), F.lit(1))
    return F.get(found, 0)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def judged_lines(section: Column) -> Column:
    """The lines of a section that name a category by letter or, if none does so, by number; in order.

    A section that begins with "No" has none.
    """
    of = lambda marks: F.array_sort(F.regexp_extract_all(section, F.lit(rf"\([{marks}]\) [^\n]*"), F.lit(0)))
    none = F.expr("cast(array() as array<string>)")
    named = _once(of("a-f"), lambda lines: F.when(F.size(lines) > 0, lines).otherwise(of("1-6")))
    return F.when(section.isNull() | section.startswith("No"), none).otherwise(named)


def counted(lines: Column, letter: str) -> Column:
    """The number between ": " and "." of the last of the judged lines of a category that has one, or 0."""
    number = ERROR_LETTERS.index(letter) + 1
    own = F.filter(lines, lambda x: x.startswith(f"({letter}) ") | x.startswith(f"({number}) "))
    counts = F.filter(F.transform(own, lambda x: F.regexp_extract(x, r": (\d+)\.", 1)), lambda x: x != "")
    return _once(counts, lambda c: F.when(F.size(c) > 0, F.element_at(c, -1).cast("int")).otherwise(0))


def judged_count(section: Column, letter: str) -> Column:
    """The count of a category in a section; counted of lines that are a column spares finding them for each category."""
    return counted(judged_lines(section), letter)


def judged_matches(section: Column) -> Column:
    """The number that a section of matched findings begins with, or 0."""
    return F.when(section.startswith("No"), 0).otherwise(F.coalesce(F.regexp_extract(section, r"^(\d+)\.", 1).try_cast("int"), F.lit(0)))


def judged_sentences(line: Column, matched: bool = False) -> Column:
    """Sentences that semicolons part: after the last colon and the first dot behind it (matched: the last)."""
    tail = F.substring_index(line, ":", -1)
    dot = F.instr(tail, ".")
    body = F.substring_index(tail, ".", -1) if matched else F.when(dot > 0, F.substr(tail, dot + 1)).otherwise(tail)
    return F.filter(F.transform(F.split(body, ";"), stripped), lambda s: s != "")
