"""Quality classifier (operator 8): an additive model with pairwise interactions.

A text is measured by 20 figures. Each figure is cut into bins at quantiles.
Shallow trees are boosted in turn, figure by figure, with a small step, and each adds to
the lookup table of its figure; then, for the pairs that explain most of what is left,
trees over two figures add to tables over pairs of bins. A score is the sum of a text's
entries through the logistic curve: additions of looked-up numbers, for whole batches.

The model is fitted on the driver to figures of at most SAMPLE labelled rows of a class.
Null and empty texts have figures too (zeros) and get a score. If the sample has no
rows, all scores are 0.5; with one class they are near that class. Repeated rows are
scored alike; an empty table gives an empty one; extra columns are not read. Figures are
taken from the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_rows
from tessera.llm.samples import class_sizes, held_out, training_rows

#: Labelled rows of each class that a model is fitted to at most.
SAMPLE = 6000
BINS, PAIR_BINS = 48, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 6
STEP, PULL = 0.15, 4.0
LEAVES = 3
GOOD = 0.5

FIGURES = (
    "n_bytes", "n_words", "mean_word", "upper_share", "digit_share", "symbol_share", "bang_share", "comma_share",
    "stop_share", "wide_share", "line_bytes", "same_lines", "different_words", "same_triples", "commonest_word",
    "short_words", "long_words", "capital_words", "symbol_words", "ends_well",
)

_CLASS = np.zeros(256, np.int64)  # 0: other letters, then white space, capitals, digits, ...
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in "#*$%&|<>@^~=_\\/{}[]+`"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in ",;:"]] = 6
_CLASS[ord(".")] = 7
_CLASS[128:] = 8


def figures(text: str | None) -> list[float]:
    """FIGURES of a whole text."""
    text = text or ""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return [0.0] * len(FIGURES)
    by = np.bincount(_CLASS[data], minlength=9) / n
    words = text.split()
    m = max(1, len(words))
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    triples = max(1, len(words) - 2)
    capital = sum(map(str.isupper, words))
    plain = sum(map(str.isalnum, words))
    return [
        float(n), float(len(words)), float(sizes.mean()) if len(words) else 0.0, by[2], by[3], by[4], by[5], by[6], by[7], by[8],
        n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), len(counts) / m,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if len(words) > 2 else 0.0,
        max(counts.values(), default=0) / m, float((sizes <= 2).mean()) if len(words) else 0.0,
        float((sizes >= 12).mean()) if len(words) else 0.0, capital / m, 1 - plain / m,
        float(text.rstrip().endswith((".", "!", "?"))),
    ]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of LEAVES leaves over ordered bins."""
    leaves = [(0, len(slope))]

    def gain(a: int, b: int):
        s, h = np.cumsum(slope[a:b]), np.cumsum(bend[a:b])
        if b - a < 2:
            return 0.0, a
        left = s[:-1] ** 2 / (h[:-1] + PULL)
        right = (s[-1] - s[:-1]) ** 2 / (h[-1] - h[:-1] + PULL)
        both = left + right - s[-1] ** 2 / (h[-1] + PULL)
        k = int(np.argmax(both))
        return float(both[k]), a + k + 1

    for _ in range(LEAVES - 1):
        (best, cut), leaf = max(((gain(*leaf), leaf) for leaf in leaves), key=lambda x: x[0][0])
        if best <= 1e-9:
            break
        leaves.remove(leaf)
        leaves += [(leaf[0], cut), (cut, leaf[1])]
    out = np.zeros(len(slope))
    for a, b in leaves:
        out[a:b] = slope[a:b].sum() / (bend[a:b].sum() + PULL)
    return out


def _pair_tree(slope: np.ndarray, bend: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree that cuts one figure, and then the other on either side; its gain."""
    worth = lambda s, h: s * s / (h + PULL)
    best = (0.0, np.zeros_like(slope))
    for turn in (0, 1):
        s, h = (slope, bend) if not turn else (slope.T, bend.T)
        whole = worth(s.sum(), h.sum())
        for cut in range(1, len(s)):
            made, total = np.zeros_like(s), -whole
            for rows in (slice(0, cut), slice(cut, None)):
                x, y = np.cumsum(s[rows].sum(0)), np.cumsum(h[rows].sum(0))
                split = worth(x[:-1], y[:-1]) + worth(x[-1] - x[:-1], y[-1] - y[:-1])
                k = int(np.argmax(split)) + 1
                total += float(split[k - 1])
                made[rows, :k] = x[k - 1] / (y[k - 1] + PULL)
                made[rows, k:] = (x[-1] - x[k - 1]) / (y[-1] - y[k - 1] + PULL)
            if total > best[0]:
                best = (total, made if not turn else made.T)
    return best


@dataclass
class Model:
    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], 1) if cuts else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(x) and self.cuts:
            fine = self.bins(x, self.cuts)
            for j, t in enumerate(self.tables):
                total += t[fine[:, j]]
            wide = self.bins(x, self.coarse)
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[wide[:, i], wide[:, j]]
        return _sigmoid(total)


def _quantiles(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, every: list[int] | None = None) -> Model:
    """every: how many rows of class 0 and 1 the sample stands for."""
    seen = [float((y == k).sum()) for k in (0, 1)]
    if not len(y):
        return Model()
    if min(seen) == 0:
        return Model(float(np.log((seen[1] + 1) / (seen[0] + 1))))
    every = every if every and all(every) else seen
    weight = np.array([every[0] / seen[0], every[1] / seen[1]])[y.astype(int)]
    weight = weight / weight.mean()
    share = float((weight * y).sum() / weight.sum())
    model = Model(float(np.log(share / (1 - share))))
    model.cuts = [_quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [_quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    fine, wide = model.bins(x, model.cuts), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    total = np.full(len(y), model.base)

    def slopes():
        p = _sigmoid(total)
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            s, h = slopes()
            n = len(table)
            add = STEP * _tree(np.bincount(fine[:, j], s, n), np.bincount(fine[:, j], h, n))
            table += add
            total += add[fine[:, j]]

    def pair_tree(i: int, j: int):
        s, h = slopes()
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        key = wide[:, i] * shape[1] + wide[:, j]
        grids = [np.bincount(key, v, shape[0] * shape[1]).reshape(shape) for v in (s, h)]
        return _pair_tree(*grids) if min(shape) > 1 else (0.0, np.zeros(shape))

    d = x.shape[1]
    ranked = sorted(((pair_tree(i, j)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in ranked[:PAIRS] if gain > 1e-6]
    model.pair_tables = [np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            add = STEP * pair_tree(i, j)[1]
            table += add
            total += add[wide[:, i], wide[:, j]]
    return model


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """id, figures of the whole text, and the columns named in more."""
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (id_col, *more)]

    def make():
        def run(ids, texts, *others):
            return {id_col: ids, **dict(zip(more, others)), "figures": [figures(t) for t in texts]}

        return run

    return map_rows(docs.select(id_col, text_col, *more), ", ".join([*kept, "figures array<double>"]), make)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = measured(training_rows(docs, labels, "quality", sample), more=("label",)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["figures"]))
    x = np.array([r["figures"] for r in rows], float).reshape(len(rows), len(FIGURES))
    return fit(x, np.array([r["label"] for r in rows], float), class_sizes(labels, "quality"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and quality (0 to 1) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(ids, texts):
            x = np.array([figures(t) for t in texts], float).reshape(len(texts), len(FIGURES))
            return {id_col: ids, "quality": model.score(x).tolist()}

        return run

    return map_rows(docs.select(id_col, text_col), f"`{id_col}` {kind}, quality double", make)


def op8(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", "text")
    model = train(plain, labels.select("doc_id", "quality"))
    return score(plain, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"),
        (F.col("quality") >= GOOD).cast("int").alias("predicted"),
    )
