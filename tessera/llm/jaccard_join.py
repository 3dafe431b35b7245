"""N-gram Jaccard join (operator 3): exact links in the metric space of shingle sets.

The distance of two sets is one minus their Jaccard similarity, and sets link within
RADIUS = 1 - threshold of each other.

1. Equal sets are one point. A point is alone if more of its shingles than RADIUS allows
   are in no other point; a sample of the shingles, by their hash, is enough to tell that
   for most points. The points that are not told alone go on.
2. First pivots: the sets of a single shingle. A point is nearest to the pivots it holds,
   and among those to the rarest, in whose Voronoi region it lies. A point within RADIUS
   can have lost its nearest pivots, but only as many as RADIUS allows: the window of a
   point reaches over so many of its rarest pivots, and it is replicated to their regions.
   Two points that link share a region.
3. A region of at most SMALL points is joined as a whole. In a larger one a point becomes
   pivot. The points within RADIUS of it are linked with it, and hence with each other: the
   region's main component. By the triangle inequality, a point at distance d can link only
   with points whose distance is within RADIUS of d; so the region goes on with the points
   of other components and those that are within RADIUS of one by their distances, with a
   pivot that the main component doesn't have, ROUNDS times. Points that links have brought
   together by then aren't compared. What remains is dealt out by distance in shells of
   RADIUS; the points of other components meet all points of their shell and the next one,
   in blocks of BLOCK, by the differences from the pivot's set.
4. Candidates are dropped by their sizes, by the shingles that nobody shares and by the
   number of shingles that each has from the pivot on, and then compared by their whole sets. Links are collapsed to components.

Links within a region that its pivot implies aren't listed, but no link between
different texts is lost to the components.

Null and empty texts have the empty set and are linked with nothing. Texts of fewer words
than a shingle have one shingle. Rows with equal ids stay rows; a null id is never the
smallest. An empty table gives an empty one; extra columns are not read. Shingles are
compared by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, staged
from tessera.llm.repeat_index import row_key

WORDS, PERCENT = 3, 90
SMALL = 24
ROUNDS = 3
BLOCK = 96

_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_FACTOR, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_BACK = pow(_FACTOR, -1, 1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts; A-Z are lower-cased."""

    def __init__(self, words: int):
        self.words = words
        self.power = self.back = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) <= n:
            n = max(n + 1, 1 << 20)
            for name, factor in (("power", _FACTOR), ("back", _BACK)):
                x = np.full(n, factor, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        coded = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
        self._powers(len(data))
        blank = _BLANK[data]
        edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * self.power[: len(data)])])
        word = _mixed((total[end] - total[begin]) * self.back[begin] + (end - begin).astype(np.uint64))
        ends = np.cumsum([len(c) + 1 for c in coded])
        first = np.searchsorted(begin, np.concatenate([[0], ends]))
        k, out = self.words, []
        shingle = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k):
            shingle = shingle * np.uint64(_FACTOR) + word[j : j + len(shingle)]
        shingle = _mixed(shingle)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                out.append(np.unique(shingle[a : b - k + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for w in word[a:b]:
                    h = h * np.uint64(_FACTOR) + w
                out.append(_mixed(np.array([h ^ np.uint64(0x5555)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _spared(n: Column, percent: int) -> Column:
    """How many shingles of n a set can hold that a linked one lacks, and one more."""
    return n - F.expr(f"({percent} * n + 99) div 100") + 1


def point_rows(docs: DataFrame, words: int, share: float) -> DataFrame:
    """(row, id, text) as row, id, point (its set's 128 bits), low (64 of them), n, sample."""
    kind = docs.schema["id"].dataType
    schema = pa.schema([("row", pa.binary()), ("point", pa.binary()), ("low", pa.int64()), ("n", pa.int64()), ("sample", pa.list_(pa.int64()))])
    least = np.uint64(int(share * float(1 << 64))) if share < 1 else np.uint64((1 << 64) - 1)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = schema.insert(1, pa.field("id", to_arrow_type(kind)))

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets = shingler.sets(part.column(2).to_pylist())
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                low = np.array([int.from_bytes(x[:8], "little", signed=True) for x in names], np.int64)
                columns = [
                    part.column(0).cast(pa.binary()), part.column(1).cast(schema.field("id").type), pa.array(names, pa.binary()), pa.array(low),
                    pa.array([len(s) for s in sets], pa.int64()), _lists([s[: np.searchsorted(s, least, "right")] for s in sets]),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.mapInArrow(run, f"row binary, id {kind.simpleString()}, point binary, low long, n long, sample array<long>")


def point_sets(texts: DataFrame, words: int) -> DataFrame:
    """text as point, n and the whole set."""
    schema = pa.schema([("point", pa.binary()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        shingler = Shingler(words)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                sets = shingler.sets(part.column(0).to_pylist())
                names = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], schema=schema)

    return texts.mapInArrow(run, "point binary, n long, shingles array<long>")


def unresolved(rows: DataFrame, percent: int) -> DataFrame:
    """point and one of its ids, of the points that the sample doesn't tell to be alone."""
    owner = rows.select("low", F.explode("sample").alias("shingle")).groupBy("shingle").agg(F.min("low").alias("low"), F.max("low").alias("other"))
    own = owner.where("low = other").groupBy("low").agg(F.count("*").alias("own"))
    points = rows.where("n > 0").groupBy("point", "low", "n").agg(F.min("id").alias("id"))
    return points.join(own, "low", "left").where(F.coalesce("own", F.lit(0)) < _spared(F.col("n"), percent)).select("point", "id")


def regions_of(sets: DataFrame, percent: int) -> DataFrame:
    """pivot (a shingle), point, n, own (shingles that no other point has) and rest of all regions.

    rest is the number of the point's shingles from the pivot on, the rarest first.
    """
    each = sets.select("point", "n", F.explode("shingles").alias("pivot"))
    # Written, so that in the join below a shingle of very many points can be split.
    held = staged(each.groupBy("pivot").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    shared = each.join(held, "pivot").groupBy("point", "n").agg(F.sort_array(F.collect_list(F.struct("df", "pivot"))).alias("shared"))
    window = shared.withColumn("own", F.col("n") - F.size("shared")).withColumn("reach", (_spared(F.col("n"), percent) - F.col("own")).cast("int"))
    near = window.where("reach > 0").select("point", "n", "own", F.posexplode(F.slice("shared", 1, F.col("reach"))).alias("k", "s"))
    return near.select(F.col("s.pivot").alias("pivot"), "point", "n", "own", (F.col("n") - F.col("own") - F.col("k")).alias("rest"))


def _may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes, shingles of their own and those from the pivot on let two points be in RADIUS.

    In the region of the rarest shingle that two points share, they share none before it.
    """
    least, most = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    both = a["n"] + b["n"]
    apart = (100 + percent) * (a["own"] + b["own"]) <= (100 - percent) * both
    return (100 * least >= percent * most) & apart & ((100 + percent) * F.least(a["rest"], b["rest"]) >= percent * both)


def _has_partner(percent: int, smallest: str) -> Column:
    """Whether the shingles from the pivot on are enough for a partner of a size that the region has."""
    least = F.greatest(F.col(smallest), F.expr(f"({percent} * n + 99) div 100"))
    return (100 + percent) * F.col("rest") >= percent * (F.col("n") + least)


def _pairs(members: Column, percent: int) -> Column:
    """array<struct<a, b>> of pairs that may link and aren't in one component yet."""

    def of(x: Column) -> Column:
        fits = F.filter(members, lambda y: (x["point"] < y["point"]) & (x["root"] != y["root"]) & _may_link(x, y, percent))
        return F.transform(fits, lambda y: F.struct(x["point"].alias("a"), y["point"].alias("b")))

    return F.flatten(F.transform(members, of))


def _members() -> Column:
    return F.struct("point", "n", "own", "rest", "root")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, their sizes and how many shingles they share."""
    left = sets.select(F.col("point").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("point").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("both"))
        .distinct()
    )


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _distance() -> Column:
    return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))


def links(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links whose components are those of all links."""
    # Distances are compared with a little room, so that rounding drops no candidate.
    radius = 1 - percent / 100 + 1e-9
    first = staged(regions_of(sets, percent), "all-regions")
    smallest = staged(first.groupBy("pivot").agg(F.min("n").alias("smallest")), "region-least")
    first = first.join(smallest, "pivot").where(_has_partner(percent, "smallest")).drop("smallest")
    rest = staged(first.withColumn("root", F.col("point")).withColumns({"at": F.lit(0.0), "centre": F.lit(None).cast("binary"), "main": F.lit(None).cast("binary")}), "regions")
    found = None
    for turn in range(ROUNDS + 1):
        # Points that earlier rounds have linked needn't be compared; nor do regions of one component.
        # The pivot is one that the first pivots' component doesn't have.
        centre = F.min(F.struct(F.col("root").eqNullSafe(F.col("main")).alias("known"), "own", "point", "root")).alias("centre")
        size = rest.groupBy("pivot").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"), centre)
        size = staged(size.where("lo <> hi"), "region-sizes")
        small = rest.join(size.where(f"size <= {SMALL}").select("pivot"), "pivot").groupBy("pivot").agg(F.collect_list(_members()).alias("m"))
        pairs = small.select(F.explode(_pairs(F.col("m"), percent)).alias("p")).select("p.a", "p.b")
        large = size.where(f"size > {SMALL}")
        last = turn == ROUNDS or large.isEmpty()
        star = None
        asked = pairs
        if not last:
            star = rest.drop("centre").join(large.select("pivot", F.col("centre.point").alias("centre"), F.col("centre.root").alias("centre_root")), "pivot").where("point <> centre")
            star = star.withColumn("main", F.coalesce("main", "centre_root")).drop("centre_root")
            star = star.withColumn("a", F.least("point", "centre")).withColumn("b", F.greatest("point", "centre"))
            asked = pairs.unionByName(star.select("a", "b"))
        told = staged(compared(asked.distinct(), sets).withColumn("linked", _linked(percent)).withColumn("d", _distance()), "compared")
        new = told.where("linked").select("a", "b")
        if turn == ROUNDS and not large.isEmpty():
            new = new.unionByName(_shells(rest.join(large.select("pivot"), "pivot"), sets, radius, percent))
        found = new if found is None else staged(found.unionByName(new), "links")
        if last:
            return found
        # Before the last round all that is linked is told; until then two turns do, as equal
        # roots tell that points are linked, and others only cost comparisons.
        roots = components(found, None if turn + 1 == ROUNDS else 2).withColumnRenamed("root", "new_root")
        # Regions with one centre go on as one: its points are at the same distances in each.
        placed = star.join(told.select("a", "b", "d"), ["a", "b"]).withColumn("pivot", F.xxhash64("centre"))
        placed = placed.groupBy("pivot", "centre", "point", "n", "own", "root", "d").agg(F.max("rest").alias("rest"), F.min("main").alias("main"))
        placed = placed.join(roots, "point", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        # One component a region, as regions with one centre may have come from several.
        one = placed.groupBy("pivot").agg(F.min("main").alias("main"))
        placed = placed.drop("main").join(one, "pivot")
        main = roots.select(F.col("point").alias("main"), "new_root")
        placed = staged(placed.join(main, "main", "left").withColumn("main", F.coalesce("new_root", "main")).drop("new_root"), "placed")
        other = placed.where("root <> main").groupBy("pivot").agg(F.min("d").alias("nearest"), F.max("d").alias("furthest"))
        near = (F.col("root") != F.col("main")) | (F.col("d") >= F.col("nearest") - radius) & (F.col("d") <= F.col("furthest") + radius)
        rest = staged(placed.join(other, "pivot").where(near).select("pivot", "centre", "point", "n", "own", "rest", "root", "main", F.col("d").alias("at")), "regions")
        # Few points go on; the sets of the others would be shuffled again for each comparison.
        open_points = rest.select("point").unionByName(rest.select(F.col("centre").alias("point"))).distinct()
        sets = staged(sets.join(open_points, "point", "left_semi"), "open-sets")
    return found


def _shells(rows: DataFrame, sets: DataFrame, radius: float, percent: int) -> DataFrame:
    """Links of large regions, as pairs of roots: shells by distance from the pivot, in blocks.

    A point is in its shell, and replicated to the one before. The points that aren't in the
    region's main component meet all others, a block of the ones and a block of the others
    in a task of their own. Points come with their differences from the pivot's set: two
    points differ in what one of their differences has and the other lacks, so that they
    are compared without their whole sets, and only links leave the task.
    """
    own_set = sets.select("point", "shingles")
    centre_set = sets.select(F.col("point").alias("centre"), F.col("shingles").alias("middle"))
    with_sets = rows.join(own_set, "point").join(centre_set, "centre", "left")
    middle = F.coalesce("middle", F.expr("cast(array() as array<bigint>)"))
    apart = F.concat(F.array_except("shingles", middle), F.array_except(middle, F.col("shingles")))
    open_ = ~F.col("root").eqNullSafe(F.col("main"))
    rows = with_sets.withColumn("apart", apart).withColumn("open", open_).drop("shingles", "middle", "centre", "main")
    sizes = rows.groupBy("pivot").agg(F.count("*").alias("size"), F.count_if("open").alias("n_open")).where("n_open > 0")
    rows = rows.join(staged(sizes, "shell-sizes"), "pivot")
    shell = F.floor(F.col("at") / radius)
    dealt = rows.withColumn("shell", shell).withColumn("home", F.lit(True)).unionByName(rows.withColumn("shell", shell - 1).withColumn("home", F.lit(False)))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    block = lambda n: F.pmod(F.xxhash64("point"), blocks(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    asking = dealt.where("open").withColumn("i", block("n_open")).withColumn("j", each("size")).withColumn("asks", F.lit(True))
    asked = dealt.withColumn("j", block("size")).withColumn("i", each("n_open")).withColumn("asks", F.lit(False))
    member = F.struct("point", "n", "own", "rest", "root", "home", "open", "asks", "apart")
    met = asking.unionByName(asked).groupBy("pivot", "shell", "i", "j").agg(F.collect_list(member).alias("m"))
    met = met.withColumn("asking", F.filter("m", lambda x: x["asks"])).withColumn("asked", F.filter("m", lambda x: ~x["asks"])).drop("m")

    def of(x: Column) -> Column:
        def linked(y: Column) -> Column:
            both = x["n"] + y["n"]
            far = F.size(x["apart"]) + F.size(y["apart"]) - 2 * F.size(F.array_intersect(x["apart"], y["apart"]))
            return 100 * (both - far) >= percent * (both + far)

        once = lambda y: ~y["open"] | (x["point"] < y["point"])
        due = lambda y: once(y) & (x["root"] != y["root"]) & (x["home"] | y["home"]) & _may_link(x, y, percent)
        fits = F.filter(F.filter("asked", due), linked)
        return F.transform(fits, lambda y: F.struct(F.least(x["root"], y["root"]).alias("a"), F.greatest(x["root"], y["root"]).alias("b")))

    return met.select(F.explode(F.array_distinct(F.flatten(F.transform("asking", of)))).alias("p")).select("p.a", "p.b").distinct()


def components(edges: DataFrame, turns: int | None = None) -> DataFrame:
    """point and root (the smallest point that links reach), of the points with links.

    Each turn a point takes the smallest root among its neighbours, then its root's root.
    After so many turns a root is a point that links reach, but maybe not the smallest.
    """
    both = staged(edges.select(F.col("a").alias("point"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("point"), F.col("a").alias("next"))), "edges")
    roots = staged(both.groupBy("point").agg(F.least(F.col("point"), F.min("next")).alias("root")), "roots")
    done = 0
    while True:
        done += 1
        seen = both.join(roots.select(F.col("point").alias("next"), "root"), "next").groupBy("point").agg(F.min("root").alias("seen"))
        lower = roots.join(seen, "point").select("point", "root", F.least("root", "seen").alias("low"))
        jump = roots.select(F.col("point").alias("low"), F.col("root").alias("top"))
        new = staged(lower.join(jump, "low").select("point", F.least("low", "top").alias("root"), (F.col("root") != F.least("low", "top")).alias("moved")), "roots")
        roots = new.drop("moved")
        if done == turns or new.where("moved").isEmpty():
            return roots


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (see row_key), id, n_shingles, component_id and root of every text.

    root tells components apart, also those with one smallest id; null without shingles.
    """
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = min(1.0, 1.4 * (100 - percent) / 100 + 0.08)
    rows = staged(point_rows(keyed, words, share), "points")
    open_ = staged(unresolved(rows, percent), "unresolved")
    some = keyed.select("id", "text").join(open_.select(F.col("id").alias("open_id")), F.col("id").eqNullSafe(F.col("open_id")), "left_semi")
    sets = staged(point_sets(some.select("text"), words).join(open_.select("point"), "point", "left_semi").dropDuplicates(["point"]), "sets")
    roots = components(links(sets, percent))
    least = rows.where("n > 0").groupBy("point").agg(F.min("id").alias("least"))
    rooted = staged(least.join(roots, "point", "left").withColumn("root", F.coalesce("root", "point")), "classes")
    top = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(top, "root").select("point", "component_id", "root")
    return rows.join(named, "point", "left").select(
        "row", F.col("id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("id"))).alias("component_id"), "root"
    )


def op3(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    return joined(docs, words, percent).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those whose component has a text of a smaller id; of equal ids the smallest row key stays.

    A null id comes last. Rows of one id and text are one row; texts without words stay otherwise,
    a null text beside an empty one of its id too.
    """
    told = staged(joined(docs, words, percent, id_col, text_col), "joined")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first")
    firsts = told.where("n_shingles > 0").groupBy("root").agg(first).select(F.col("first.row").alias("__row__"))
    kept = told.where("n_shingles = 0").select(F.col("row").alias("__row__")).unionByName(firsts).distinct()
    keyed = docs.withColumn("__row__", row_key(F.col(id_col), F.col(text_col))).join(kept, "__row__")
    return keyed.dropDuplicates(["__row__"]).select(*[F.col(f"`{c}`") for c in docs.columns])
