"""Suffix-array dedup (operator 5): long repeats, by a run-length compressed index.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else,
in the same or another text; strings are judged on the input. Texts are UTF-8 bytes.

1. Every window of LENGTH bytes has a minimizer, the place inside it with the smallest
   hash of GRAM bytes. Windows in a row with one minimizer form a segment. Equal windows
   have equal minimizers, so that only segments with the same minimizer can share one.
   A segment whose minimizer stands nowhere else is done with.
2. Segments with the same content are one class. The windows of a class of two or more
   are repeated. What is left are groups of different segments around one minimizer.
3. For the segments of such groups a Burrows-Wheeler transform is built, run-length
   compressed, with the suffix at both ends of each run sampled and the common prefix at
   each border of runs. The statistics of where a suffix matches another are streamed in
   the order of the text: they fall by one a byte but for the samples. Windows that match
   for LENGTH bytes or more are repeated. A task takes whole groups, INDEX_BYTES at a time.
4. A group of more than HOT different segments is not held by one task: its windows are
   hashed and counted by hash, with the same result.

Where asked, strings of so many words that another row holds too are told as well, with any
white space between them. They take steps 1 and 2 along with the bytes, as windows of words;
those of a group that is left are then counted by hash, in a task or, if it is hot, by Spark.
The minimizer's hash reads eight bytes of a word at most, the other one all.

Null and empty texts have no bytes. Repeated rows repeat each other's strings, whatever
their ids, and get equal results. An empty table gives an empty one; extra columns are
not read. A text of any length is cut into pieces for the hashing, which overlap so that
no window is lost. Contents are compared by two 64-bit hashes of which one is that of the
minimizer, rows by MD5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_rows, slices, staged

LENGTH = 400
GRAM = 32
#: Bytes that are hashed at a time, and bytes of an index.
PIECE_BYTES = 1 << 20
INDEX_BYTES = 1 << 20
HOT = 4096
#: Words of a passage, so many or more of which are "over 50", and of a long text at a time.
PASSAGE = 51
PIECE_WORDS = 1 << 17
GRAM_WORDS = 8
#: Windows of words that a task counts at a time.
COUNTED = 1 << 18
#: Bytes of a text whose spans are merged first.
STRETCH = 1 << 16
PLACE_BITS = 22
#: Columns that are added to a table for a while.
ROW, SPANS, PASSAGES = "__row__", "__spans__", "__passages__"

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The first 0 to 8 of eight bytes.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BYTE = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on."""
    return mixed(rolled(_BYTE[data], GRAM))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` items from each place on, a power of two."""
    size, factor = 1, int(_MIX)
    while size < width:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor, size = factor * factor & (1 << 64) - 1, size * 2
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _MIX
    h ^= h >> np.uint64(32)
    return h


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash among width hashes from each place on; the first if equal."""
    place = np.uint64((1 << PLACE_BITS) - 1)
    best = hashes & ~place
    best |= np.arange(len(best), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & place).astype(np.int64)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Joined text, and (text, offset in it, start, windows) for each part of it."""
    joined, parts, size = [], [], 0
    for i, t in enumerate(texts):
        windows = len(t) - length + 1
        at = 0
        while at < windows:
            take = min(windows - at, PIECE_BYTES)
            if size and size + take + length > PIECE_BYTES + length:
                yield b"".join(joined), parts
                joined, parts, size = [], [], 0
            joined.append(t[at : at + take + length - 1])
            parts.append((i, at, size, take))
            size += take + length - 1
            at += take
    if parts:
        yield b"".join(joined), parts


def stretches(where: np.ndarray, base: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """part, start, windows and minimizer's place of each run of windows with one minimizer.

    The parts have `count` windows each, from `base` on.
    """
    part = np.repeat(np.arange(len(base)), count)
    starts = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count) + base[part]
    at = where[starts]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (part[1:] != part[:-1])))
    return part[first], starts[first], np.diff(np.append(first, len(at))), at[first]


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, start, bytes, minimizer's hash and content's hash of every segment."""
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for joined, parts in pieces(texts, length):
        data = np.frombuffer(joined, np.uint8)
        hashes = gram_hashes(data)
        where = minimizers(hashes, length - GRAM + 1)
        owner, offset, base, count = np.array(parts, np.int64).T
        p, begin, n, at = stretches(where, base, count)
        n += length - 1
        key = digests(joined, begin, begin + n)
        for to, x in zip(out, (owner[p], begin - base[p] + offset[p], n, hashes[at].view(np.int64), key)):
            to.append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def digests(data: bytes, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[begin:end]."""
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin)).view(np.int64)


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of a text that has one blank between two."""
    blank = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return np.append(0, blank + 1), np.append(blank, len(joined))


def word_segments(texts: list[bytes], words: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """The same of windows of words: start and size are in words, the white space is one blank.

    The hash of a place is that of the lengths and first bytes of GRAM_WORDS words.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    parts: list[tuple[int, int, int]] = []
    joined: list[bytes] = []
    size = 0

    def solve():
        data = b" ".join(joined)
        begin, end = word_bounds(data)
        eights = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
        n = (end - begin).astype(np.uint64)
        h = (eights[begin] & _FIRST[np.minimum(n, 8)] ^ n) * _MIX
        h ^= h >> np.uint64(29)
        h = mixed(rolled(h, GRAM_WORDS))
        owner, offset, held = np.array(parts, np.int64).T
        base = np.cumsum(held) - held
        p, first, n, at = stretches(minimizers(h, words - GRAM_WORDS + 1), base, held - words + 1)
        n += words - 1
        key = digests(data, begin[first], end[first + n - 1])
        for to, x in zip(out, (owner[p], first - base[p] + offset[p], n, h[at].view(np.int64), key)):
            to.append(x)

    for i, t in enumerate(texts):
        found = t.split()
        for at in range(0, len(found) - words + 1, PIECE_WORDS):
            some = found[at : at + PIECE_WORDS + words - 1]
            parts.append((i, at, len(some)))
            joined.append(b" ".join(some))
            size += len(joined[-1])
            if size > PIECE_BYTES:
                solve()
                parts, joined, size = [], [], 0
    if parts:
        solve()
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def word_windows(found: list[bytes], words: int) -> bytes:
    """64-bit hash of each `words` words in a row, one behind the other."""
    joined = b" ".join(found)
    begin, end = word_bounds(joined)
    return digests(joined, begin[: len(begin) - words + 1], end[words - 1 :]).tobytes()


class RunLengthIndex:
    """Run-length compressed Burrows-Wheeler transform of strings, each ended on its own.

    run_char, run_size: the runs. head_at, tail_at: the suffix at the first and the last
    row of each run. border: the common prefix of the suffixes on both sides of the border
    before each run (0 before the first).
    """

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        ends = np.cumsum(self.sizes + 1) - 1
        data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        symbols = data.astype(np.int64) + 1
        symbols[ends] = 0
        order, levels = self._sorted(symbols, ends)
        before = symbols[order - 1]
        # Each string's end is a letter of its own.
        before = np.where(before == 0, 257 + (order - 1) % len(symbols), before)
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.length = len(symbols)
        self.run_char = before[head]
        self.run_size = np.diff(np.append(head, len(before)))
        self.head_at = order[head]
        self.tail_at = order[head + self.run_size - 1]
        self.border = np.append(0, self._common(symbols, levels, self.tail_at[:-1], self.head_at[1:]))

    @staticmethod
    def _sorted(symbols: np.ndarray, ends: np.ndarray):
        """Suffixes in order, and by length the classes of equal beginnings of that length."""
        n, first = len(symbols), 7
        packed = np.zeros(n, np.int64)
        open_ = np.ones(n, bool)
        padded = np.append(symbols, np.zeros(first, np.int64))
        for k in range(first):
            x = padded[k : k + n]
            packed = packed * 257 + np.where(open_, x, 0)
            open_ &= x != 0
        # A beginning that holds an end is like no other; open_ tells those without one.
        order = np.argsort(packed, kind="stable")
        sorted_ = packed[order]
        new = np.append(True, (sorted_[1:] != sorted_[:-1]) | ~open_[order][1:])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels = [(first, rank)]
        size = first
        while True:
            lone = new & np.append(new[1:], True)
            rows = np.flatnonzero(~lone)
            if not len(rows):
                return order, levels
            at = order[rows]
            # at + size is inside: a beginning without an end is followed by one.
            key = rank[at].astype(np.int64) * n + rank[at + size]
            again = np.argsort(key, kind="stable")
            order[rows] = at[again]
            key = key[again]
            new = new.copy()
            new[rows] = np.append(True, key[1:] != key[:-1])
            rank = rank.copy()
            rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            size *= 2
            levels.append((size, rank))

    @staticmethod
    def _common(symbols, levels, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at a and at b, up to an end."""
        a, b, n = a.copy(), b.copy(), len(symbols)
        total = np.zeros(len(a), np.int64)
        for size, rank in reversed(levels):
            same = rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
            a[same] += size
            b[same] += size
            total[same] += size
        going = np.ones(len(a), bool)
        for _ in range(levels[0][0]):
            x, y = symbols[np.minimum(a, n - 1)], symbols[np.minimum(b, n - 1)]
            going &= (x == y) & (x != 0)
            total += going
            a, b = a + going, b + going
        return total

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest string from there on that also starts elsewhere."""
        place = np.arange(self.length)
        reach = np.zeros(self.length, np.int64)
        for at, sample in ((self.head_at, self.border), (self.tail_at, np.append(self.border[1:], 0))):
            due = np.zeros(self.length, np.int64)
            due[at] = sample + at
            reach = np.maximum(reach, np.maximum.accumulate(np.maximum(due, place)) - place)
        return reach

    def repeated(self, length: int) -> list[list[tuple[int, int]]]:
        """For each string, the runs [from, to) of starts whose `length` bytes repeat."""
        hit = self.matching_statistics() >= length
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        base = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        owner = np.searchsorted(base, begin, "right") - 1
        out: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        for o, a, b in zip(owner.tolist(), begin.tolist(), end.tolist()):
            out[o].append((a - int(base[o]), b - int(base[o])))
        return out


def row_key(id_: Column, text: Column) -> Column:
    """128 bits that tell a row from others but for those with its id and text; null isn't empty."""
    id_ = id_.cast("string")
    told = F.coalesce(F.concat(F.length(id_).cast("string"), F.lit(":"), id_), F.lit("-"))
    return F.unhex(F.md5(F.concat(told, F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))))


def _bytes(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode() for t in texts]


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def all_segments(keyed: DataFrame, length: int, words: int = 0) -> DataFrame:
    """row, start, size, minimizer, content of the segments of (row, text).

    The lowest bit of a minimizer is 1 for segments of words, which are left out if words is 0.
    """
    schema = pa.schema([("row", pa.binary()), ("start", pa.int64()), ("size", pa.int32()), ("minimizer", pa.int64()), ("content", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, PIECE_BYTES):
                texts = _bytes(part.column(1).to_pylist())
                for bit, made in enumerate([segments(texts, length), word_segments(texts, words)] if words else [segments(texts, length)]):
                    text, start, size, minimizer, content = made
                    yield _batch(schema, [part.column(0).take(pa.array(text)).cast(pa.binary()), start, size.astype(np.int32), minimizer & ~1 | bit, content])

    return keyed.mapInArrow(run, "row binary, start long, size int, minimizer long, content long")


def _indexed(parts: DataFrame, length: int) -> DataFrame:
    """minimizer, content and repeated starts of segments, which come sorted by minimizer."""
    schema = pa.schema([("minimizer", pa.int64()), ("content", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def solve(minimizer: list, content: list, data: list) -> pa.RecordBatch:
        runs = RunLengthIndex(data).repeated(length) if data else []
        flat = [(minimizer[i], content[i], a, b) for i, found in enumerate(runs) for a, b in found]
        return _batch(schema, [list(x) for x in zip(*flat)] if flat else [[], [], [], []])

    def run(batches):
        minimizer, content, data, size = [], [], [], 0
        for batch in batches:
            for m, c, d in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if size > INDEX_BYTES and m != minimizer[-1]:
                    yield solve(minimizer, content, data)
                    minimizer, content, data, size = [], [], [], 0
                minimizer.append(m)
                content.append(c)
                data.append(d)
                size += len(d)
        yield solve(minimizer, content, data)

    return parts.mapInArrow(run, "minimizer long, content long, lo int, hi int")


def _counted(parts: DataFrame, length: int) -> DataFrame:
    """The same for groups that no task should hold: windows counted by their hash."""
    schema = pa.schema([("minimizer", pa.int64()), ("content", pa.int64()), ("at", pa.int32()), ("window", pa.int64()), ("weight", pa.int64())])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in slices(batch, 1 << 16):
                rows = []
                for m, c, d, w in zip(*(part.column(i).to_pylist() for i in range(4))):
                    view = memoryview(d)
                    rows += [(m, c, a, digest(view[a : a + length]) - (1 << 63), min(w, 2)) for a in range(len(d) - length + 1)]
                yield _batch(schema, [list(x) for x in zip(*rows)] if rows else [[]] * 5)

    windows = staged(parts.mapInArrow(run, "minimizer long, content long, at int, window long, weight long"), "hot-windows")
    twice = windows.groupBy("minimizer", "window").agg(F.sum("weight").alias("n")).where("n > 1").drop("n")
    return windows.join(twice, ["minimizer", "window"]).select("minimizer", "content", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi"))


def _unpacked(columns: list[list]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Windows of segments of words, a number for each, and the other columns as often."""
    *others, data = columns
    count = np.array([len(d) // 8 for d in data])
    return np.frombuffer(b"".join(data), np.int64), [np.repeat(np.array(x, np.int64), count) for x in (*others, range(len(data)))]


def _shared(texts: DataFrame) -> DataFrame:
    """minimizer, content and number of the windows that stand in several rows, of segments of one row."""
    schema = pa.schema([(c, pa.int64()) for c in ("minimizer", "content", "n")])

    def solve(columns: list[list]) -> pa.RecordBatch:
        minimizer, content, lo, hi, data = columns
        if not data:
            return _batch(schema, [[]] * 3)
        window, (group, low, high, owner) = _unpacked([minimizer, lo, hi, data])
        order = np.lexsort((window, group))
        w, g = window[order], group[order]
        first = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (g[1:] != g[:-1])))
        several = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
        hit = np.repeat(several, np.diff(np.append(first, len(w))))
        n = np.bincount(owner[order][hit], minlength=len(data))
        keep = np.flatnonzero((n > 0) & (np.array(lo) == np.array(hi)))
        return _batch(schema, [np.array(minimizer)[keep], np.array(content)[keep], n[keep]])

    def run(batches):
        columns, size = [[], [], [], [], []], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > COUNTED and row[0] != columns[0][-1]:
                    yield solve(columns)
                    columns, size = [[], [], [], [], []], 0
                for to, x in zip(columns, row):
                    to.append(x)
                size += len(row[-1]) // 8
        yield solve(columns)

    hot_schema = pa.schema([(c, pa.int64()) for c in ("minimizer", "content", "lo", "hi", "window")])

    def unpack(batches):
        for batch in batches:
            for part in slices(batch, 1 << 20):
                window, others = _unpacked([c.to_pylist() for c in part.columns])
                yield _batch(hot_schema, [*others[:-1], window])

    told = texts.select("minimizer", "content", "lo", "hi", "data", "hot")
    plain = told.where("not hot").drop("hot").repartition("minimizer").sortWithinPartitions("minimizer")
    windows = staged(told.where("hot").drop("hot").mapInArrow(unpack, "minimizer long, content long, lo long, hi long, window long"), "hot-words")
    several = windows.groupBy("minimizer", "window").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").drop("lo", "hi")
    hot = windows.where("lo = hi").join(several, ["minimizer", "window"]).groupBy("minimizer", "content").agg(F.count("*").alias("n"))
    return plain.mapInArrow(run, "minimizer long, content long, n long").unionByName(hot)


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (see row_key) and spans, an array of [lo, hi) bytes to remove, of texts that have any.

    Spans of a row may touch or overlap. They are merged by stretches of STRETCH bytes before
    those of a row come together, so that a row has a few for each stretch at most.
    """
    return repeats(docs, length, 0, id_col, text_col)[0]


def repeats(docs: DataFrame, length: int, words: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """repeated_spans, and row and n, the places where a string of `words` words that another
    row holds too starts, of texts that have any; None if words is 0.

    Rows with the same id and text are one here. words is 0 or GRAM_WORDS at least.
    """
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")).where(
        F.octet_length("text") >= (min(length, 2 * words - 1) if words else length)
    )
    every = staged(all_segments(keyed, length, words), "segments")
    # Written, so that in the join below a minimizer of very many segments can be split.
    again = staged(every.groupBy("minimizer").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "minimizers")
    some = staged(every.join(again, "minimizer"), "repeated-minimizers")
    # Words of one row, however often, are one copy.
    of_words = F.col("minimizer").bitwiseAND(1) == 1
    last = F.when(of_words, F.col("row"))
    classes = staged(
        some.groupBy("minimizer", "content")
        .agg(F.count("*").alias("copies"), F.min(F.struct("row", "start", "size")).alias("one"), F.max(last).alias("last"))
        .withColumn("copies", F.when(F.col("last") == F.col("one.row"), F.lit(1).cast("long")).otherwise(F.col("copies"))),
        "classes",
    )
    groups = classes.groupBy("minimizer").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 and least = 1")
    wanted = classes.join(groups, "minimizer").select(
        "one.row",
        F.struct(
            "one.start", "one.size", "minimizer", "content", "copies", (F.col("kinds") > HOT).alias("hot"),
            F.when(of_words, F.least(F.xxhash64("one.row"), F.xxhash64("last"))).alias("lo"),
            F.when(of_words, F.greatest(F.xxhash64("one.row"), F.xxhash64("last"))).alias("hi"),
        ).alias("part"),
    )
    asked = wanted.groupBy("row").agg(F.collect_list("part").alias("parts"))
    cut = keyed.join(asked, "row").dropDuplicates(["row"])
    schema = pa.schema([
        ("minimizer", pa.int64()), ("content", pa.int64()), ("data", pa.binary()), ("copies", pa.int64()), ("hot", pa.bool_()),
        ("lo", pa.int64()), ("hi", pa.int64()),
    ])

    def run(batches):
        for batch in batches:
            for part in slices(batch, PIECE_BYTES):
                rows = []
                for t, wanted_ in zip(_bytes(part.column(0).to_pylist()), part.column(1).to_pylist()):
                    found = t.split() if words else []
                    for p in wanted_:
                        a, b = p["start"], p["start"] + p["size"]
                        data = word_windows(found[a:b], words) if p["minimizer"] & 1 else t[a:b]
                        rows.append((p["minimizer"], p["content"], data, p["copies"], p["hot"], p["lo"], p["hi"]))
                yield _batch(schema, [list(x) for x in zip(*rows)] if rows else [[]] * 7)

    both = staged(
        cut.select("text", "parts").mapInArrow(
            run, "minimizer long, content long, data binary, copies long, hot boolean, lo long, hi long"
        ),
        "segment-texts",
    )
    texts = both.where(~of_words)
    plain = texts.where("not hot").select("minimizer", "content", "data").repartition("minimizer").sortWithinPartitions("minimizer")
    found = _indexed(plain, length).unionByName(_counted(texts.where("hot").select("minimizer", "content", "data", "copies"), length))
    alone = found.groupBy("minimizer", "content").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    whole = classes.where("copies > 1").where(~of_words).select(
        "minimizer", "content", F.array(F.struct(F.lit(0).alias("lo"), (F.col("one.size") - length + 1).alias("hi"))).alias("starts")
    )
    single = classes.where("copies = 1").where(~of_words).select("minimizer", "content").join(alone, ["minimizer", "content"])
    spans = some.join(whole.unionByName(single), ["minimizer", "content"]).select(
        "row", F.explode(F.transform("starts", lambda s: F.struct((F.col("start") + s["lo"]).alias("lo"), (F.col("start") + s["hi"] + length - 1).alias("hi")))).alias("span")
    )
    near = spans.groupBy("row", F.floor(F.col("span.lo") / STRETCH).alias("stretch")).agg(F.collect_set("span").alias("spans"))
    fewer = map_rows(near.select("row", "spans"), "row binary, spans array<struct<lo long, hi long>>", _merger)
    found = fewer.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    if not words:
        return found, None
    wide = classes.where("copies > 1").where(of_words).select("minimizer", "content", (F.col("one.size") - words + 1).cast("long").alias("n"))
    held = some.join(wide.unionByName(_shared(both.where(of_words))), ["minimizer", "content"]).select("row", "start", "n").distinct()
    return found, held.groupBy("row").agg(F.sum("n").alias("n"))


def _merger():
    def run(rows, spans):
        return {"row": rows, "spans": [[{"lo": a, "hi": b} for a, b in merged(s)] for s in spans]}

    return run


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes in spans."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    return b"".join([*kept, data[at:]])


def with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """docs and, last, SPANS: the array of spans to remove, null for none."""
    spans = staged(repeated_spans(docs, length, id_col, text_col), "spans").withColumnsRenamed({"row": ROW, "spans": SPANS})
    keyed = docs.withColumn(ROW, row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(spans, ROW, "left").select(*[F.col(f"`{c}`") for c in docs.columns], SPANS)


def with_passages(docs: DataFrame, length: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """docs and, last, SPANS as in with_spans and PASSAGES, the number of shared places (see repeats)."""
    spans, passages = repeats(docs, length, words, id_col, text_col)
    told = staged(spans.join(passages, "row", "full"), "spans").withColumnsRenamed({"row": ROW, "spans": SPANS, "n": PASSAGES})
    keyed = docs.withColumn(ROW, row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(told, ROW, "left").select(*[F.col(f"`{c}`") for c in docs.columns], SPANS, PASSAGES)


def op5(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The columns of the contract and, if words isn't 0, n_passages: the places of the text where
    a string of so many words starts that another row holds too. It changes none of the others."""
    plain = docs.select("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def make():
        def run(ids, texts, spans, passages=()):
            data, runs = _bytes(texts), [merged(s) for s in spans]
            return {
                "doc_id": ids,
                "n_bytes": [len(d) for d in data],
                "n_removed": [sum(b - a for a, b in r) for r in runs],
                "n_spans": [len(r) for r in runs],
                "kept_sha256": [hashlib.sha256(without(d, r)).hexdigest() for d, r in zip(data, runs)],
                "n_passages": [n or 0 for n in passages],
            }

        return run

    told = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not words:
        return map_rows(with_spans(plain, length, "doc_id", "text"), told, make)
    return map_rows(with_passages(plain, length, words, "doc_id", "text"), f"{told}, n_passages long", make)


def cut_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated bytes removed from the text; parts of a cut character go with them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    told = docs.schema
    out, place = to_arrow_schema(told), told.names.index(text_col)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                texts, spans = part.column(place).to_pylist(), part.column(len(out)).to_pylist()
                kept = [t if t is None or not s else without(t.encode(), merged(s)).decode("utf-8", "ignore") for t, s in zip(texts, spans)]
                columns = [c.cast(f.type) for c, f in zip(part.columns, out)]
                columns[place] = pa.array(kept, out.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return with_spans(docs, length, id_col, text_col).mapInArrow(run, told)
