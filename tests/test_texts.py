import random
from itertools import permutations, product

import pytest

from tessera.functions import texts as X
from tessera.operators import metrics as M

# Words and stems that the algorithm's description gives as examples.
EXAMPLES = dict(
    caresses="caress", ponies="poni", ties="ti", caress="caress", cats="cat", feed="feed", agreed="agre", plastered="plaster", bled="bled", motoring="motor", sing="sing",
    conflated="conflat", troubled="troubl", sized="size", hopping="hop", tanned="tan", falling="fall", hissing="hiss", fizzed="fizz", failing="fail", filing="file", happy="happi",
    sky="sky", relational="relat", conditional="condit", rational="ration", valenci="valenc", digitizer="digit", conformabli="conform", radicalli="radic", differentli="differ",
    vileli="vile", analogousli="analog", vietnamization="vietnam", predication="predic", operator="oper", feudalism="feudal", decisiveness="decis", hopefulness="hope",
    callousness="callous", formaliti="formal", sensitiviti="sensit", sensibiliti="sensibl", triplicate="triplic", formative="form", formalize="formal", electriciti="electr",
    electrical="electr", hopeful="hope", goodness="good", revival="reviv", allowance="allow", inference="infer", airliner="airlin", gyroscopic="gyroscop", adjustable="adjust",
    defensible="defens", irritant="irrit", replacement="replac", adjustment="adjust", dependent="depend", adoption="adopt", homologou="homolog", communism="commun",
    activate="activ", angulariti="angular", homologous="homolog", effective="effect", bowdlerize="bowdler", probate="probat", rate="rate", cease="ceas", controll="control", roll="roll",
)


def test_stems():
    assert {w: X.stem(w) for w in EXAMPLES} == EXAMPLES
    assert [X.stem(w) for w in ("", "a", "is", "él", "x2s", "running,")] == ["", "a", "is", "él", "x2s", "running,"]


def brute(x, y, given=()):
    """The most pairs, and their fewest runs, over all alignments that keep the given pairs."""
    fixed = dict(given)
    free = [i for i in range(len(x)) if i not in fixed]
    options = [[None, *[j for j in range(len(y)) if y[j] == x[i] and j not in fixed.values()]] for i in free]
    best = None
    for choice in product(*options):
        used = [j for j in choice if j is not None]
        if len(set(used)) < len(used):
            continue
        pairs = sorted([*fixed.items(), *[(i, j) for i, j in zip(free, choice, strict=True) if j is not None]])
        key = (-len(pairs), X.runs_of(pairs))
        best = key if best is None or key < best else best
    return best


@pytest.mark.parametrize("seed", range(120))
def test_alignments_match_brute_force(seed):
    rng = random.Random(seed)
    words = "abcd"[: rng.randint(1, 4)]
    x, y = ([rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(2))
    got = X.fewest_runs(x, y)
    assert all(x[i] == y[j] for i, j in got) and len({j for _, j in got}) == len(got) and (-len(got), X.runs_of(got)) == brute(x, y)
    low = [w.translate(str.maketrans("cd", "ab")) for w in x], [w.translate(str.maketrans("cd", "ab")) for w in y]
    more = X.fewest_runs(*low, got)
    assert set(got) <= set(more) and (-len(more), X.runs_of(more)) == brute(*low, got)


def test_first_fit_is_not_the_fewest():
    assert X.runs_of(X.fewest_runs("the cat and the dog".split(), "the dog the cat and".split())) == 2
    assert X.aligned(["cats", "run"], ["running", "cat"]) == [(0, 1), (1, 0)] and X.aligned(["cats"], ["cat"], stems=False) == []


def test_long_texts_of_few_words_end():
    rng = random.Random(1)
    x, y = ([rng.choice("ab") for _ in range(60)] for _ in range(2))
    assert len(X.fewest_runs(x, y)) == sum(min(x.count(w), y.count(w)) for w in "ab")
    assert X.fewest_runs(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)] and all(len(p) == 3 for p in permutations("abc"))


def test_meteor_of_stages(spark):
    rows = [(1, "the cats sat", "the cat sat"), (2, None, "a"), (3, "", ""), (4, "one two", "three"), (5, "Words agree", "words agreed")]
    df = spark.createDataFrame(rows, "id int, generated string, reference string")
    exact, both = ({r["id"]: r["meteor"] for r in M.meteor(df, stems=s).collect()} for s in (False, True))
    assert both[1] == pytest.approx(1 - 0.5 / 27) and 0 < exact[1] < both[1] and both[5] == pytest.approx(1 - 0.5 / 8)
    assert both[2] == both[3] == both[4] == 0
