"""Periodic runs of words (operator 11): tandem repeats by Gusfield and Stoye, merged into runs.

A run is a stretch of words with a smallest period q, at least LEAST words and EXPONENT
periods long, that no neighbouring word extends. Within a text:

1. Words that no run can hold are left out first. Each four words of a run stand again q
   words on or back, and a run has four periods, so that four words whose nearest equals
   are further off than a quarter of the stretch around them are in none. What stays, cut
   into stretches that a symbol of its own ends, is the string of the steps below.
2. Suffix tree: intervals of common prefixes of the sorted suffixes, with suffix links.
3. Lempel-Ziv blocks. For each block and root length, the longest common extensions from
   its borders tell a square that covers the leftmost occurrences there.
4. Squares are marked in the tree where they start leftmost; from each mark the walk over
   suffix links goes on to the next rotation, until one isn't in the tree or is marked.
5. The squares with primitive roots are located by the leaves below their marks; starts
   that follow one another with one root length are one run.

Null and empty texts have no words and no runs. Rows are independent: repeated rows give
repeated results, and an empty table gives an empty one. A null id is passed on; only the
two named columns are read, so that others may have any name. A text of any length is read
in whole. Memory is linear in it (about 100 bytes a word, and 600 a word of what step 1
leaves), time is linear but for sorting and the names of stretches by doubling, which add
a logarithm. One text is one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, map_rows, words

#: A run has so many words and so many periods at least.
LEAST, EXPONENT = 6, 4
#: Each so many words of a run stand in it again, one period on or back.
GRAM = 4

Run = tuple[int, int, int]


class Extensions:
    """Longest common extensions of many pairs of places at once, by names of stretches.

    ranks[k][i] is the rank of the stretch of 2^k symbols from i, shorter at the end. The
    last symbol stands nowhere else, so that stretches that the end cuts equal no other.
    """

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.ranks = [rank]
        size = 1
        while rank.max() + 1 < n:
            later = np.zeros(n, np.int64)
            later[: max(0, n - size)] = rank[size:] + 1
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            self.ranks.append(rank)
            size *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on."""
        i, j = i.copy(), j.copy()
        begin = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            inside = np.flatnonzero((i < self.n) & (j < self.n))
            same = inside[rank[i[inside]] == rank[j[inside]]]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - begin

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i, itself included, equal those up to j."""
        i, j = i + 1, j + 1
        begin = i.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            inside = np.flatnonzero((i >= size) & (j >= size))
            same = inside[rank[i[inside] - size] == rank[j[inside] - size]]
            i[same] -= size
            j[same] -= size
        return begin - i


class SuffixTree:
    """Nodes 0 to n-1 are the leaves, by the start of their suffix; node n is the root."""

    def __init__(self, symbols: np.ndarray, ext: Extensions):
        n = len(symbols)
        order = ext.order
        common = [0, *ext.right(order[:-1], order[1:]).tolist(), 0]
        self.root = n
        depth, parent = list(range(n, 0, -1)), [n] * (n + 1)
        least, lo, hi = list(range(n)), [0] * n, [0] * n
        depth.append(0)
        least.append(0)
        lo.append(0)
        hi.append(n - 1)
        stack = [n]
        for place, leaf in enumerate([*order.tolist(), None]):
            shared = common[place]
            last = -1
            while depth[stack[-1]] > shared:
                last = stack.pop()
                hi[last] = place - 1
                above = stack[-1]
                if depth[above] < shared:
                    above = len(depth)
                    depth.append(shared)
                    parent.append(stack[-1])
                    least.append(least[last])
                    lo.append(lo[last])
                    hi.append(0)
                    stack.append(above)
                parent[last] = above
                if least[last] < least[above]:
                    least[above] = least[last]
                if depth[above] == shared:
                    break
            if leaf is not None:
                lo[leaf] = place
                stack.append(leaf)
        self.depth, self.parent, self.least, self.lo, self.hi = depth, parent, least, lo, hi
        self.symbols, self.many = symbols.tolist(), int(symbols.max()) + 1
        nodes = np.delete(np.arange(len(depth)), n)
        above = np.array(parent)[nodes]
        first = symbols[np.array(least)[nodes] + np.array(depth)[above]]
        self.child = dict(zip((above * self.many + first).tolist(), nodes.tolist(), strict=True))
        self.link = {n: n}
        inner = np.arange(n + 1, len(depth))
        for v in inner[np.argsort(np.array(depth)[inner], kind="stable")].tolist():
            self.link[v] = self.down(self.link[parent[v]], least[v] + 1, depth[v] - 1)

    def down(self, node: int, start: int, length: int) -> int:
        """The node at or below the end of the `length` symbols from start, whose first ones lead to node."""
        depth, child, symbols, many = self.depth, self.child, self.symbols, self.many
        while depth[node] < length:
            node = child[node * many + symbols[start + depth[node]]]
        return node


def blocks(tree: SuffixTree) -> list[int]:
    """Starts of the Lempel-Ziv blocks, and the end: each is the longest that starts earlier too, or one symbol."""
    n, at = tree.root, 0
    starts = []
    while at < n:
        starts.append(at)
        v = tree.parent[at]
        while tree.least[v] >= at and v != n:
            v = tree.parent[v]
        at += max(1, tree.depth[v])
    return [*starts, n]


def covering_squares(starts: list[int], ext: Extensions, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """start and root length of squares that cover the leftmost occurrence of every square of roots up to longest."""
    start = np.array(starts[:-1], np.int64)
    end = np.array(starts[1:], np.int64)
    after = np.append(end[1:], end[-1])

    def roots(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = np.minimum(most, longest)
        block = np.repeat(np.arange(len(many)), many)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(many) - many, many) + 1

    # The second half crosses the end of the block in which the square's centre lies.
    block, k = roots(end - start)
    h = end[block]
    q = h - k
    onward, back = ext.right(h, q), ext.left(h - 1, q - 1)
    fits = (onward + back >= k) & (onward > 0)
    yield np.maximum(q - back, q - k + 1)[fits], k[fits]
    # The first half crosses the start of the block in which the square's centre lies.
    block, k = roots(after - start)
    h = start[block]
    inside = h + k < ext.n
    block, k, h = block[inside], k[inside], h[inside]
    onward, back = ext.right(h, h + k), ext.left(h - 1, h + k - 1)
    first = np.maximum(h - back, h - k + 1)
    fits = (onward + back >= k) & (onward > 0) & (back > 0) & (first + k <= end[block])
    yield first[fits], k[fits]


def vocabulary(tree: SuffixTree, covering: Iterator[tuple[np.ndarray, np.ndarray]]) -> set[tuple[int, int]]:
    """Every square as (node at or below its end, its length)."""
    depth, parent, least, symbols, child, many = tree.depth, tree.parent, tree.least, tree.symbols, tree.child, tree.many
    by_start: dict[int, set[int]] = {}
    for start, k in covering:
        for i, x in zip(start.tolist(), k.tolist(), strict=True):
            by_start.setdefault(i, set()).add(2 * x)
    marks: set[tuple[int, int]] = set()
    for i, lengths in by_start.items():
        v = i
        for length in sorted(lengths, reverse=True):
            while depth[parent[v]] >= length:
                v = parent[v]
            if least[v] != i:
                break  # it starts earlier, where another square covers it
            marks.add((v, length))
    for v, length in list(marks):
        while True:
            i = least[v]
            s = tree.down(tree.link[parent[v]], i + 1, length - 1)
            if depth[s] == length - 1:
                v = child.get(s * many + symbols[i])
                if v is None:
                    break
            elif symbols[least[s] + length - 1] == symbols[i]:
                v = s
            else:
                break
            if (v, length) in marks:
                break
            marks.add((v, length))
    return marks


def _primitive(start: np.ndarray, k: np.ndarray, ext: Extensions) -> np.ndarray:
    """Whether the k symbols from start aren't a shorter word repeated."""
    factor = np.zeros(int(k.max()) + 1, np.int64)
    for p in range(2, len(factor)):
        if not factor[p]:
            rest = factor[p::p]
            rest[rest == 0] = p
    rest, found = k.copy(), np.ones(len(k), bool)
    while True:
        open_ = np.flatnonzero(rest > 1)
        if not len(open_):
            return found
        p = factor[rest[open_]]
        step = k[open_] // p
        found[open_] &= ext.right(start[open_], start[open_] + step) < k[open_] - step
        rest[open_] //= p


def runs_of(symbols: np.ndarray, longest: int, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of the runs of periods up to longest; the last symbol stands nowhere else."""
    if len(symbols) < 3 or longest < 1:
        return []
    ext = Extensions(symbols)
    tree = SuffixTree(symbols, ext)
    marks = np.array(list(vocabulary(tree, covering_squares(blocks(tree), ext, longest))), np.int64).reshape(-1, 2)
    if not len(marks):
        return []
    node, k = marks[:, 0], marks[:, 1] // 2
    whole = _primitive(np.array(tree.least)[node], k, ext)
    node, k = node[whole], k[whole]
    lo = np.array(tree.lo)[node]
    many = np.array(tree.hi)[node] - lo + 1
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)
    keys = np.sort(np.repeat(k, many) * (len(symbols) + 1) + ext.order[place])
    begins = np.flatnonzero(np.diff(keys, prepend=-2) != 1)
    ends = np.append(begins[1:], len(keys)) - 1
    period, start = np.divmod(keys[begins], len(symbols) + 1)
    length = keys[ends] - keys[begins] + 2 * period
    long_ = length >= np.maximum(least, exponent * period)
    return sorted(zip(start[long_].tolist(), length[long_].tolist(), period[long_].tolist(), strict=True), key=lambda r: (r[0], r[2]))


def repeating_stretches(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that may hold runs, in texts laid one after the other.

    hashes has one number a word, equal for equal words; ends has the place after each text.
    """
    total = len(hashes)
    if total < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)).astype(np.uint64)
    mixed = hashes.astype(np.uint64)
    many = total - GRAM + 1
    gram = text[:many] * np.uint64(0x9E3779B97F4A7C15)
    for i in range(GRAM):
        gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[i : i + many]
    own = np.flatnonzero(text[:many] == text[GRAM - 1 :])
    order = own[np.argsort(gram[own], kind="stable")]
    near = np.full(many, total, np.int64)
    same = np.flatnonzero(gram[order[1:]] == gram[order[:-1]])
    gap = order[same + 1] - order[same]
    near[order[same]] = gap
    near[order[same + 1]] = np.minimum(near[order[same + 1]], gap)
    held = np.flatnonzero(near < total)
    while True:
        if not len(held):
            return held, held
        # Grams that overlap or adjoin within a text are one stretch.
        breaks = np.flatnonzero((np.diff(held) > GRAM) | (text[held[1:]] != text[held[:-1]]))
        begin = np.append(0, breaks + 1)
        end = np.append(breaks, len(held) - 1)
        size = held[end] + GRAM - held[begin]
        keep = EXPONENT * near[held] <= np.repeat(np.where(size >= LEAST, size, 0), end - begin + 1)
        if keep.all():
            return held[begin], held[end] + GRAM
        held = held[keep]


def runs_of_texts(texts: list[list[bytes]]) -> list[list[Run]]:
    """(start, length, period) of the runs of each text, by start and then period."""
    ends = np.cumsum([len(t) for t in texts])
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
    begin, end = repeating_stretches(hashes, ends)
    of = np.searchsorted(ends, begin, "right")
    found: list[list[Run]] = [[] for _ in texts]
    for text in np.unique(of).tolist():
        first = int(ends[text]) - len(texts[text])
        spans = [(int(b) - first, int(e) - first) for b, e in zip(begin[of == text], end[of == text], strict=True)]
        names: dict[bytes, int] = {}
        symbols: list[int] = []
        offset = []
        for k, (b, e) in enumerate(spans):
            offset.append(len(symbols))
            symbols += [names.setdefault(w, len(names)) for w in texts[text][b:e]]
            symbols.append(-k - 1)
        made = runs_of(np.array(symbols, np.int64) + len(spans), max(e - b for b, e in spans) // EXPONENT)
        for start, length, period in made:
            k = int(np.searchsorted(offset, start, "right")) - 1
            found[text].append((spans[k][0] + start - offset[k], length, period))
    return found


def without_repetitions(text: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return text
    change = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [text[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length and period, by start, then period) and collapsed of every text.

    collapsed has the words that no run holds after its first period, with a blank between them.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def run(ids, texts):
            split = [t.split() if t else [] for t in texts]  # of bytes: at \x20 and \x09 to \x0D only
            runs = runs_of_texts(split)
            return {
                id_col: ids,
                "n_words": [len(t) for t in split],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs],
                "collapsed": [b" ".join(without_repetitions(t, r)) for t, r in zip(split, runs, strict=True)],
            }

        return run

    schema = f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    made = map_rows(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")), schema, make)
    return made.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from one of them on, where crc32 of the id ends in 0; else the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))

        def at(v: Column) -> Column:
            place = lambda i: F.when(i < v["a"], i).otherwise(v["a"] + (i - v["a"]) % v["p"]).cast("int")
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i))), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), at)).otherwise(text)

    return F.when(h % 10 == 0, let(words(text), repeated)).otherwise(text)


def op11(docs: DataFrame) -> DataFrame:
    """The contract's columns: the strongest run of every text, and digests of runs and of what is left."""
    made = find_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    stronger = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(stronger(r, best), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return made.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
        "n_words",
    )
