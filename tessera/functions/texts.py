"""Stems of words, and alignments of two texts' words, for work inside tasks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import lru_cache

# The suffixes of Porter's algorithm (1980) by step, each with what takes its place.
STEP_2 = dict(
    ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate",
    ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble",
)
STEP_3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
STEP_4 = dict.fromkeys("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), "")
#: Open alignments that are followed at a time; within them the result is the best there is.
STATES = 4096


def _kinds(word: str) -> str:
    """v for vowels and c for consonants; y is a vowel after a consonant."""
    made = ""
    for k, letter in enumerate(word):
        made += "v" if letter in "aeiou" or letter == "y" and k and made[-1] == "c" else "c"
    return made


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _ends_short(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _replaced(word: str, suffixes: dict[str, str], least: int) -> str:
    """The word with its longest suffix replaced, if what is before it has the measure."""
    for n in range(7, 1, -1):
        if (end := word[-n:]) in suffixes and len(word) > n:
            rest = word[:-n]
            if _measure(rest) > least and (end != "ion" or rest[-1] in "st"):
                return rest + suffixes[end]
            return word
    return word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word; words with other letters than a to z stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            rest = word[: -len(end)]
            if word.endswith(end) and "v" in _kinds(rest):
                if rest.endswith(("at", "bl", "iz")):
                    rest += "e"
                elif _double(rest) and rest[-1] not in "lsz":
                    rest = rest[:-1]
                elif _measure(rest) == 1 and _ends_short(rest):
                    rest += "e"
                word = rest
                break
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for suffixes, least in ((STEP_2, 0), (STEP_3, 0), (STEP_4, 1)):
        word = _replaced(word, suffixes, least)
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _ends_short(rest):
            word = rest
    if _double(word) and word.endswith("l") and _measure(word) > 1:
        word = word[:-1]
    return word


def runs_of(pairs: Sequence[tuple[int, int]]) -> int:
    """Stretches of neighbouring words on both sides, in pairs ordered by the first."""
    return sum(k == 0 or pairs[k - 1] != (i - 1, j - 1) for k, (i, j) in enumerate(pairs))


def fewest_runs(x: Sequence[str], y: Sequence[str], given: Sequence[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Pairs of places of equal words: as many as there can be, in as few runs as there can be.

    given: pairs that stand; their places aren't paired anew. Words of x are gone through in
    order, with the fewest runs for each set of used words of y (those that stand there
    more than once) and last pair; STATES of these at a time.
    """
    set_x, set_y = dict(given), {j for _, j in given}
    places: dict[str, list[int]] = {}
    for j, w in enumerate(y):
        if j not in set_y:
            places.setdefault(w, []).append(j)
    left = Counter(w for i, w in enumerate(x) if i not in set_x)
    due = {w: min(n, len(places.get(w, ()))) for w, n in left.items()}
    masks = {w: sum(1 << j for j in at) for w, at in places.items()}
    # By used places and last pair's place (-2 if the word before has none): runs, and the pairs as a chain.
    states: dict[tuple[int, int], tuple[int, tuple | None]] = {(0, -2): (0, None)}
    for i, w in enumerate(x):
        made: dict[tuple[int, int], tuple[int, tuple | None]] = {}

        def put(used: int, last: int, runs: int, chain: tuple | None) -> None:
            if (used, last) not in made or runs < made[used, last][0]:
                made[used, last] = (runs, chain)

        if i not in set_x:
            left[w] -= 1
        for (used, last), (runs, chain) in states.items():
            if i in set_x:
                j = set_x[i]
                put(used, j, runs + (j != last + 1), (i, j, chain))
                continue
            open_ = due[w] - (used & masks.get(w, 0)).bit_count()
            for j in places.get(w, ()) if open_ else ():
                if not used >> j & 1:
                    put(used | 1 << j, j, runs + (j != last + 1), (i, j, chain))
            if open_ <= left[w]:
                put(used, -2, runs, chain)
        if len(made) > STATES:
            made = dict(sorted(made.items(), key=lambda s: (s[1][0], s[0]))[:STATES])
        states = made
    _, chain = min(states.values(), key=lambda s: s[0])
    pairs = []
    while chain:
        pairs.append(chain[:2])
        chain = chain[2]
    return pairs[::-1]


def aligned(x: Sequence[str], y: Sequence[str], stems: bool = True) -> list[tuple[int, int]]:
    """Pairs of equal words, then of words of one stem among the rest."""
    pairs = fewest_runs(x, y)
    return fewest_runs([stem(w) for w in x], [stem(w) for w in y], pairs) if stems else pairs
