"""Toxicity (operator 2): by the lengths of compressed windows under two dictionaries.

Two zstandard dictionaries are trained on a bounded sample of labelled rows: one on the
windows of ordinary texts, and one that goes on from it with what is trained on toxic
texts. Of these only the words are given to the training that they hold more often than
ordinary texts do, as all their other words are ordinary ones. Texts are lower-cased (A-Z)
and cut at white space into windows of about WINDOW bytes. A window is a hit if the toxic
dictionary saves at least a calibrated number of bytes on it over the ordinary one. A
logistic curve over a text's hits, fitted to the sample, is the score.

Null and empty texts have no windows and get the score of a text without hits. If the
sample has no row of one class, the score is 0.5 (no rows at all) or that of the class
(0 or 1) pulled to the middle. Where the sample is too small for zstandard to train on, a
dictionary is the sample itself. Repeated rows are scored alike, an empty table gives an
empty one, extra columns are not read. Every window of a text is compressed, however
long it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.samples import class_sizes, held_out, training_rows

#: Labelled rows of each class that a model is fitted to at most, and the characters of the
#: longest text that is taken for that.
SAMPLE, LONGEST = 1500, 20_000
#: Bytes of a window, about; it ends at the next white space.
WINDOW = 40
#: A text is toxic from this score on.
TOXIC = 0.7
#: A hit is a strong one if it saves so many bytes more.
STRONGER = 3
ORDINARY_BYTES, TOXIC_BYTES = 12_000, 4_000
#: Bytes of the segments that dictionaries are made of, and of the strings counted for them.
SEGMENT = dict(k=24, d=6)
#: A word is trained as toxic if toxic texts hold it so many times more often than others,
#: with this G statistic (about 1 chance word in 50,000).
LEAST_ODDS, LEAST_G = 4.0, 18.0
LEVEL = 3
#: Every position is searched for matches of six bytes or more.
SEARCH = dict(strategy=zstandard.STRATEGY_GREEDY, min_match=6, window_log=15, hash_log=14, chain_log=14, search_log=2, target_length=8)

WORD = re.compile(rb"[^\s!-/:-@\[-`{-~]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The first START bytes of a word are written in letters of their own, so that a match
#: of the start of a word isn't found inside others.
START = 6
INITIAL = np.arange(256, dtype=np.uint8)
INITIAL[97:123] -= 32
INITIAL[128:] ^= 0x60
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _bytes_of(text: str | None) -> bytes:
    return (text or "").encode().translate(LOWER)


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples; of too few for that, the samples."""
    samples = [marked(np.frombuffer(x, np.uint8)).tobytes() for x in samples]
    try:
        # Its tables stand before the content; in a short dictionary they stay, and match nothing.
        return zstandard.train_dictionary(size + 1024, samples, level=LEVEL, **SEGMENT).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def toxic_words(data: list[bytes], toxic: list[int]) -> set[bytes]:
    """Words that toxic texts hold more often than others do.

    A word counts once for each pair of neighbours, so that copies of a text add nothing.
    """
    number: dict[bytes, int] = {b"": 0}
    found: list[list[np.ndarray]] = [[], []]
    for t, label in zip(data, toxic):
        words = np.array([0, *(number.setdefault(w, len(number)) for w in WORD.findall(t)), 0], np.int64)
        found[label].append(np.stack([words[1:-1], words[:-2], words[2:]], 1))
    v = len(number)
    held = []
    for parts in found:
        w = np.concatenate(parts).astype(object if v >= 1 << 21 else np.int64)
        held.append(np.bincount((np.unique((w[:, 0] * v + w[:, 1]) * v + w[:, 2]) // (v * v)).astype(np.int64), minlength=v))
    k, n = held
    rows = [max(1, h.sum()) for h in held]
    share = rows[1] / sum(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (n * np.log(n / (n + k) / share) + np.where(k > 0, k * np.log(k / (n + k) / (1 - share)), 0))
    more = (n > 0) & (n / rows[1] >= LEAST_ODDS * k / rows[0]) & (g >= LEAST_G)
    return {w for w, i in number.items() if more[i] and len(w) > 2}


def marked(data: np.ndarray) -> np.ndarray:
    """Lower-cased bytes with the starts of words in letters of their own."""
    start = np.zeros(len(data) + START, bool)
    first = np.flatnonzero(~BLANK[data[1:]] & BLANK[data[:-1]]) + 1 if len(data) else np.zeros(0, int)
    first = np.append(first, 0) if len(data) and not BLANK[data[0]] else first
    for k in range(START):
        start[first + k] = True
    return np.where(start[: len(data)], INITIAL[data], data)


def windows(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one string; start and end of each window; the text of each window."""
    joined = b"\n".join(texts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends_of = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts_of = ends_of - [len(t) for t in texts]
    blanks = np.flatnonzero(BLANK[data])
    cuts, owner = [], []
    counts = (ends_of - starts_of + WINDOW - 1) // WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    wanted = starts_of[owner] + nth * WINDOW
    # A window starts after the first blank at or after its due place, the first at once.
    at = blanks[np.searchsorted(blanks, wanted)]
    cuts = np.where(nth == 0, starts_of[owner], np.minimum(at, ends_of[owner]))
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    ends = np.where(last, ends_of[owner], np.append(cuts[1:], 0)[: len(cuts)]) if len(owner) else cuts
    full = ends > cuts
    return marked(data).tobytes(), np.stack([cuts[full], ends[full]], 1), owner[full]


def _sizes(compressor, joined: bytes, spans: np.ndarray) -> np.ndarray:
    """Compressed bytes of each span."""
    if not len(spans):
        return np.zeros(0, np.int64)
    segments = np.ascontiguousarray(np.stack([spans[:, 0], spans[:, 1] - spans[:, 0]], 1), np.uint64)
    made = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(joined, segments.tobytes()), threads=1)
    if isinstance(made, zstandard.BufferWithSegments):
        return np.frombuffer(bytes(made.segments()), np.uint64).reshape(-1, 2)[:, 1].astype(np.int64)
    return np.fromiter(map(len, made), np.int64, len(made))


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    least_gain: int = 1 << 30
    weights: list[float] = field(default_factory=lambda: [0.0] * 4)

    def compressors(self):
        out = []
        how = zstandard.ZstdCompressionParameters(**SEARCH, write_checksum=False, write_content_size=False, write_dict_id=False)
        for content in (self.ordinary, self.toxic):
            trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            trained.precompute_compress(compression_params=how)
            out.append(zstandard.ZstdCompressor(dict_data=trained, compression_params=how))
        return out

    def gains(self, compressors, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the toxic dictionary saves on each window; the text of each window."""
        joined, spans, owner = windows(texts)
        return _sizes(compressors[0], joined, spans) - _sizes(compressors[1], joined, spans), owner

    def features(self, gains: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        hit = gains >= self.least_gain
        hits = np.bincount(owner[hit], minlength=n)
        strong = np.bincount(owner[gains >= self.least_gain + STRONGER], minlength=n)
        every = np.bincount(owner, minlength=n)
        return np.stack([np.ones(n), np.log1p(hits), np.sqrt(hits / np.maximum(every, 1)), np.log1p(strong)], 1)

    def score(self, compressors, texts: list[bytes]) -> np.ndarray:
        if not self.toxic:
            return np.full(len(texts), _sigmoid(self.weights[0]))
        gains, owner = self.gains(compressors, texts)
        return _sigmoid(self.features(gains, owner, len(texts)) @ np.array(self.weights))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.05) -> list[float]:
    """Newton steps for weights with a ridge; those of hits are kept at 0 or more."""
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3] + [pull] * (x.shape[1] - 1))
    for _ in range(50):
        p = _sigmoid(x @ w)
        slope = x.T @ (y - p) - ridge @ w
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(len(w)), slope)
        w[1:] = np.maximum(w[1:], 0)
    return [float(v) for v in w]


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    data = [_bytes_of(t) for t in texts]
    y = np.array(toxic, float)
    if len(set(toxic)) < 2:
        return Model(weights=[float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0, 0.0, 0.0])
    own = toxic_words(data, toxic)
    ordinary_windows, toxic_windows = [], []
    for t, label in zip(data, toxic):
        found = WORD.findall(t)
        if label:
            toxic_windows.append(b"".join(b" " + w + b" " for w in found if w in own))
        else:
            ordinary_windows += [b" ".join(found[i : i + 8]) for i in range(0, len(found), 8)]
    ordinary = _trained(ordinary_windows, ORDINARY_BYTES)
    model = Model(ordinary, ordinary + _trained([x for x in toxic_windows if x], TOXIC_BYTES))
    gains, owner = model.gains(model.compressors(), data)
    best = None
    for least in range(1, 9):
        model.least_gain = least
        x = model.features(gains, owner, len(data))
        weights = _logistic(x, y)
        p = np.clip(_sigmoid(x @ np.array(weights)), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0] - 1e-9:
            best = (loss, least, weights)
    _, model.least_gain, model.weights = best
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    some = training_rows(docs, labels, "toxic", sample)
    begin = F.pmod(F.xxhash64("doc_id"), F.length("text") - LONGEST + 1).cast("int") + 1
    window = F.when(F.length("text") > LONGEST, F.substring("text", begin, F.lit(LONGEST))).otherwise(F.col("text"))
    rows = some.select(window.alias("text"), "label", "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["text"] or ""))
    model = fit([r["text"] for r in rows], [r["label"] for r in rows])
    # The sample may hold more of one class than the corpus does.
    every = class_sizes(labels, "toxic")
    taken = [sum(r["label"] == k for r in rows) for k in (0, 1)]
    if all(every) and all(taken):
        model.weights[0] += float(np.log(every[1] / every[0] * taken[0] / taken[1]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """The columns of docs and, last, out_col (0 to 1) of every whole text; one of that name is replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name != out_col]
    schema = StructType([*fields, StructField(out_col, DoubleType())])
    out = to_arrow_schema(schema)
    names = [f.name for f in fields]

    def run(batches):
        compressors = model.compressors() if model.toxic else None
        for batch in batches:
            for part in slices(batch, 2 << 20):
                texts = [_bytes_of(t) for t in part.column(names.index(text_col)).to_pylist()]
                made = pa.array(model.score(compressors, texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(part.columns, out.types)), made], schema=out)

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def op2(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    plain = docs.select("doc_id", "text")
    model = train(plain, labels.select("doc_id", "toxic"))
    return score(plain, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC).cast("int").alias("predicted"),
    )
