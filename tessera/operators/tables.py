"""Joins with guards, sets in order, sampling, and the cleaning of label and text rows."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    return left.join(right, list(on), "left_anti")


def usable_ids(ids: DataFrame, listed: DataFrame, bad: DataFrame, on: str, expected: int | None = None, limit: int = 0) -> DataFrame:
    """ids that are listed, but for bad ones; a number of listed ids that isn't expected is an error.

    The number is that before bad ids go. With a limit the first so many by id are kept.
    """
    there = ids.select(on).join(listed.select(on).distinct(), on, "left_semi")
    if expected is not None and (n := there.count()) != expected:
        raise ValueError(f"{n} ids are listed, {expected} were expected")
    kept = there.join(bad.select(on), on, "left_anti")
    return kept.orderBy(on).limit(limit) if limit else kept


def require_all(left: DataFrame, right: DataFrame, on: Sequence[str]) -> None:
    """An error that names five of the left keys that the right side lacks."""
    some = missing(left, right, on).select(*on).distinct().orderBy(*on).limit(5).collect()
    if some:
        raise ValueError(f"{', '.join(on)} without a match: {[tuple(r) for r in some]}")


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df, to be broadcast if it was counted and found to have at most so many rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def strict_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    require_all(left, right.select(*on), on)
    return left.join(right, list(on))


def lenient_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and a row with how many left rows it has and lacks."""
    flagged = left.join(right.select(*on).distinct().withColumn("_has", F.lit(True)), list(on), "left")
    counts = flagged.agg(F.count_if("_has").alias("matched"), F.count_if(F.col("_has").isNull()).alias("missing"))
    return left.join(right, list(on)), counts


def label_join(rows: DataFrame, labels: DataFrame, on: str) -> DataFrame:
    """All rows with their labels, and present (false where there is none)."""
    return rows.join(labels.withColumn("present", F.lit(True)), on, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def ordered_semi(rows: DataFrame, wanted: DataFrame, on: str, order: str) -> DataFrame:
    """Rows that are wanted, with the place that the wanted list gives them."""
    return rows.join(wanted.select(on, order), on)


def resume(rows: DataFrame, done: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows still to do; done keys that repeat or aren't expected are an error."""
    if not done.groupBy(*on).count().where("count > 1").isEmpty():
        raise ValueError("done keys repeat")
    require_all(done.select(*on), rows.select(*on), on)
    return rows.join(done.select(*on), list(on), "left_anti")


def deltas(base: DataFrame, other: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    b = base.select(on, *[F.col(c).alias(f"base_{c}") for c in columns])
    return other.join(b, on).select(on, *[(F.col(c) - F.col(f"base_{c}")).alias(f"delta_{c}") for c in columns])


def first_available(rows: DataFrame, by: Sequence[str], priority: str) -> DataFrame:
    """The row of each group with the lowest priority number, by partial aggregation."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), priority).alias("_one")).select("_one.*")


def leaf_lookup(paths: DataFrame, path: str, keep: DataFrame, skip: DataFrame, fallback: str | None = None) -> DataFrame:
    """Each path with the group of its part nearest the leaf that keep or skip knows.

    keep: name, grp. skip: name. status is kept, skipped, fallback or unmapped.
    """
    parts = paths.select(path, F.posexplode(F.reverse(F.split(path, "/"))).alias("depth", "name"))
    told = parts.join(keep, "name", "left").join(skip.withColumn("_skip", F.lit(True)), "name", "left")
    hit = told.where("grp is not null or _skip").groupBy(path).agg(F.min(F.struct("depth", F.col("grp").isNull().alias("no"), "grp")).alias("b"))
    status = F.when(F.col("b").isNull(), F.lit("fallback" if fallback else "unmapped")).when(F.col("b.no"), "skipped").otherwise("kept")
    return paths.select(path).distinct().join(hit, path, "left").select(path, status.alias("status"), F.coalesce("b.grp", F.when(F.col("b").isNull(), F.lit(fallback))).alias("grp"))


def either_member(rows: DataFrame, names: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with matched: whose name is in names or whose grp is in groups."""
    flagged = rows.join(names.distinct().withColumn("_n", F.lit(True)), "name", "left").join(groups.distinct().withColumn("_g", F.lit(True)), "grp", "left")
    return flagged.withColumn("matched", F.coalesce("_n", F.lit(False)) | F.coalesce("_g", F.lit(False))).drop("_n", "_g")


def coverage(requested: DataFrame, available: DataFrame, on: Sequence[str], by: str) -> DataFrame:
    """Requested, matched and missing rows and distinct pairs of each group."""
    rows = requested.join(available.select(*on).distinct().withColumn("_has", F.lit(True)), list(on), "left").withColumn("_has", F.coalesce("_has", F.lit(False)))
    key = F.struct(*on)
    return rows.groupBy(by).agg(
        F.count("*").alias("rows_requested"), F.count_if("_has").alias("rows_matched"), F.count_if(~F.col("_has")).alias("rows_missing"),
        F.countDistinct(key).alias("pairs_requested"), F.countDistinct(F.when(F.col("_has"), key)).alias("pairs_matched"),
    )


def collapse(rows: DataFrame, key: Sequence[Column], order: str) -> DataFrame:
    """The first row of each key, with how many it stands for.

    One partial aggregation: no task holds the rows of a key.
    """
    first = F.min_by(F.struct(*rows.columns), order).alias("_one")
    made = rows.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(key)]).agg(first, F.count("*").alias("duplicate_count"))
    return made.select("_one.*", "duplicate_count")


def stratified_first(rows: DataFrame, by: str, normal: Column, key: Column, most: int) -> DataFrame:
    """At most `most` rows a group: abnormal ones first, each in the order of a SHA-1 key."""
    w = Window.partitionBy(by).orderBy(normal, F.sha1(key))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def shard(rows: DataFrame, order: str, n: int, k: int) -> DataFrame:
    """Every n-th row from the k-th on, in an order.

    Rows are numbered within ranges of the order and offset by the ranges before, so that
    no task has to number all of them.
    """
    numbered = numbered_rows(rows, order)
    return numbered.where(F.pmod(F.col("row"), F.lit(n)) == k)


def ranged(rows: DataFrame, order: str, ranges: int = 0, part_col: str = "_part", spread: DataFrame | None = None) -> DataFrame:
    """rows with the number of their range: about equal ranges of a numeric column, in its order.

    As many as there are shuffle partitions, so that no task has to order all rows. Null
    and NaN have a range of their own, before and after all others. spread: rows of the
    same values that the ranges are made by, where those are at less cost.
    """
    ranges = ranges or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    edges = sorted(set((rows if spread is None else spread).approxQuantile(order, [i / ranges for i in range(1, ranges)], min(0.01, 0.25 / ranges))))
    value = F.col(order).cast("double")
    inf = float("inf")
    if edges:
        split = Bucketizer(splits=[-inf, *edges, inf], inputCol="_order", outputCol=part_col)
        made = split.transform(rows.withColumn("_order", F.when(value.isNull() | F.isnan(value), 0.0).otherwise(value))).drop("_order")
    else:
        made = rows.withColumn(part_col, F.lit(0))
    return made.withColumn(part_col, F.when(value.isNull(), -1).when(F.isnan(value), len(edges) + 1).otherwise(F.col(part_col)).cast("int"))


def running(rows: DataFrame, by: Sequence[str], order: str, sums: Sequence[str], descending: bool = False, spread: DataFrame | None = None) -> DataFrame:
    """rows with before_x and total_x for x in sums: over those of the key that come earlier, and all.

    Order is one within the key. Ranges of it are summed side by side and offset by the
    ranges before, so that a hot key, or none, is not one task's work.
    """
    parted = ranged(rows, order, spread=spread)
    way = F.desc(order) if descending else F.asc(order)
    inside = Window.partitionBy(*by, "_part").orderBy(way).rowsBetween(Window.unboundedPreceding, -1)
    each = parted.withColumns({f"_in_{x}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in sums})
    totals = parted.groupBy(*by, "_part").agg(*[F.sum(x).alias(x) for x in sums])
    # A row for each key and range.
    key = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = key.orderBy(F.desc("_part") if descending else F.asc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*by, "_part"])],
        *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"_off_{x}") for x in sums], *[F.sum(x).over(key).alias(f"total_{x}") for x in sums],
    )
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*by, "_part"])]
    joined = each.join(offsets, same)
    made = joined.withColumns({f"before_{x}": F.col(f"_in_{x}") + F.col(f"_off_{x}") for x in sums})
    return made.select(*rows.columns, *[f"before_{x}" for x in sums], *[f"total_{x}" for x in sums])


def numbered_rows(rows: DataFrame, order: str, ranges: int = 0, row_col: str = "row", tie: str | None = None) -> DataFrame:
    """rows with row: their place from 0 by a numeric column, whose ties a second one settles."""
    parted = ranged(rows, order, ranges)
    inside = parted.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(order, *([tie] if tie else []))) - 1)
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row for each range.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return inside.join(F.broadcast(before), "_part").withColumn(row_col, (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_in", "_before")


def seeded(seed: int, *keys: Column) -> Column:
    """A key that puts rows into an order which a seed decides, the same on every engine."""
    return F.md5(F.concat_ws(":", *[k.cast("string") for k in keys], F.lit(str(seed))))


def hash_holdout(ids: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k ids in the order of a seeded hash, marked as held out; the rest not."""
    held = ids.select(id_col).orderBy(seeded(seed, F.col(id_col)), id_col).limit(k).withColumn("held", F.lit(True))
    return ids.join(held, id_col, "left").withColumn("held", F.coalesce("held", F.lit(False)))


def steps_of_epoch(rows: int, ranks: int, size: int, drop_last: bool = True) -> int:
    """Steps in which every rank takes `size` rows; no whole step is an error."""
    if min(rows, ranks, size) <= 0:
        raise ValueError(f"rows {rows}, ranks {ranks} and size {size} have to be positive")
    steps = rows // (ranks * size) if drop_last else -(-rows // (ranks * size))
    if not steps:
        raise ValueError(f"{ranks} ranks of {size} rows are more than {rows} rows")
    return steps


def batches(
    numbered: DataFrame, rows: int, ranks: int, size: int, first_step: int, last_step: int, drop_last: bool = True, seed: int | None = None, row: str = "row"
) -> DataFrame:
    """numbered (row from 0) with step, epoch, rank and slot: which rank takes a row at which step.

    Steps count from 1 over all epochs, so that work which goes on later repeats nothing.
    With a seed each epoch has an order of its own, by a hash of row, seed and epoch.
    """
    if last_step < first_step or first_step < 1:
        raise ValueError(f"steps {first_step} to {last_step}")
    steps = steps_of_epoch(rows, ranks, size, drop_last)
    epochs = list(range((first_step - 1) // steps, (last_step - 1) // steps + 1))
    each = numbered.withColumn("epoch", F.explode(F.array(*map(F.lit, epochs))))
    if seed is None:
        each = each.withColumn("_at", F.col(row))
    else:
        order = F.conv(F.substring(seeded(seed, F.col(row), F.col("epoch")), 1, 12), 16, 10).cast("long")
        keyed = each.withColumn("_k", order.cast("double") * F.lit(1.0))
        parts = [numbered_rows(keyed.where(F.col("epoch") == e), "_k", row_col="_at", tie=row).drop("_k") for e in epochs]
        each = parts[0]
        for p in parts[1:]:
            each = each.unionByName(p)
    step = F.col("epoch") * steps + F.floor(F.col("_at") / (ranks * size)) + 1
    within = F.pmod(F.col("_at"), F.lit(ranks * size))
    each = each.withColumn("step", step.cast("long")).withColumn("rank", F.floor(within / size).cast("int")).withColumn("slot", F.pmod(within, F.lit(size)).cast("int"))
    kept = each.where(F.col("step").between(first_step, last_step) & (F.col("_at") < steps * ranks * size))
    return kept.drop("_at")


def length_grouped(rows: DataFrame, length: str, order: Column, mega: int) -> DataFrame:
    """rows with place: shuffled by order into runs of `mega` rows, longest first within a run."""
    keyed = rows.withColumn("_k", order.cast("double"))
    at = numbered_rows(keyed, "_k", row_col="_at").withColumn("_run", F.floor(F.col("_at") / mega))
    inside = F.row_number().over(Window.partitionBy("_run").orderBy(F.desc(length), "_at")) - 1
    return at.withColumn("place", (F.col("_run") * mega + inside).cast("long")).drop("_k", "_at", "_run")


def even_ranks(lengths: Sequence[int], ranks: int) -> list[int]:
    """The rank of each row: that of the smallest sum so far, until it has its share; in turns where shares aren't even."""
    if len(lengths) % ranks:
        return [i % ranks for i in range(len(lengths))]
    share = len(lengths) // ranks
    open_ = [(0, r) for r in range(ranks)]
    taken, made = [0] * ranks, []
    for length in lengths:
        total, rank = heapq.heappop(open_)
        made.append(rank)
        taken[rank] += 1
        if taken[rank] < share:
            heapq.heappush(open_, (total + length, rank))
    return made


def length_grouped_ranks(rows: DataFrame, row: str, length: str, ranks: int, size: int, seed: int) -> DataFrame:
    """rows dealt to ranks in runs of ranks * size rows of one modality: run, rank, slot, and place among all.

    row is a whole number that orders and tells rows apart; a positive length is of one modality, a
    negative one of the other, and 0 or null an error. Each modality is shuffled by the seed
    and cut into runs. Within a run the longest rows come first and go to the rank with the
    smallest sum that has room, so that ranks have equally many rows of about equal length.
    Runs of both modalities are shuffled; the last of each are the last run, in order of row,
    dealt in turns. One modality alone keeps its runs in order, the last one maybe short.
    A run is one group, of ranks * size rows at most.
    """
    mega = ranks * size
    if min(ranks, size) < 1:
        raise ValueError(f"ranks {ranks} and size {size} have to be positive")
    number = lambda *keys: F.conv(F.substring(seeded(seed, *keys), 1, 12), 16, 10).cast("long").cast("double")
    good = F.when(F.coalesce(F.col(length), F.lit(0)) == 0, F.raise_error(F.lit("a row has no length")).cast("boolean")).otherwise(F.col(length) > 0)
    keyed = rows.withColumn("_one", good).withColumn("_k", number(F.col(row)))
    counts = {r["_one"]: r["n"] for r in keyed.groupBy("_one").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return rows.select("*", *[F.lit(0).cast(k).alias(c) for c, k in (("run", "long"), ("rank", "int"), ("slot", "int"), ("place", "long"))])
    parts = [numbered_rows(keyed.where(F.col("_one") == one), "_k", row_col="_at", tie=row) for one in counts]
    numbered = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    numbered = numbered.withColumn("_run", F.floor(F.col("_at") / mega))
    last = F.lit(False)
    if len(counts) == 2:
        ends = {one: -(-n // mega) - 1 for one, n in counts.items()}
        last = F.col("_run") == F.when(F.col("_one"), ends[True]).otherwise(ends[False])
        each = rows.sparkSession.range(ends[True]).select(F.lit(True).alias("_one"), F.col("id").alias("_run"))
        each = each.unionByName(rows.sparkSession.range(ends[False]).select(F.lit(False).alias("_one"), F.col("id").alias("_run")))
        shuffled = numbered_rows(each.withColumn("_m", number(F.col("_one").cast("int"), F.col("_run"))).withColumn("_tie", F.col("_run") * 2 + F.col("_one").cast("int")), "_m", row_col="run", tie="_tie")
        numbered = numbered.join(shuffled.select("_one", "_run", "run"), ["_one", "_run"], "left").withColumn("run", F.coalesce("run", F.lit(ends[True] + ends[False]).cast("long")))
    else:
        numbered = numbered.withColumn("run", F.col("_run").cast("long"))
    numbered = numbered.withColumn("_last", last)

    def deal(table: pa.Table) -> pa.Table:
        rows_, sizes, at = (table.column(c).to_pylist() for c in ("_row", "_length", "_at"))
        if table.column("_last")[0].as_py():
            order = sorted(range(len(rows_)), key=lambda i: rows_[i])
            dealt = [i % ranks for i in range(len(order))]
        else:
            order = sorted(range(len(rows_)), key=lambda i: (-sizes[i], at[i]))
            dealt = even_ranks([sizes[i] for i in order], ranks)
        slots, n = [], [0] * ranks
        for rank in dealt:
            slots.append(n[rank])
            n[rank] += 1
        before = [sum(n[:k]) for k in range(ranks)]
        inside = list(range(len(order))) if table.column("_last")[0].as_py() else [before[k] + s for k, s in zip(dealt, slots, strict=True)]
        return pa.table({"_row": [rows_[i] for i in order], "rank": pa.array(dealt, pa.int32()), "slot": pa.array(slots, pa.int32()), "_in": pa.array(inside, pa.int64())})

    # Only what dealing needs goes to the groups; the last run of two modalities holds at most 2 * mega rows.
    asked = numbered.select("run", F.col(row).cast("long").alias("_row"), F.abs(F.col(length)).cast("long").alias("_length"), "_at", "_last")
    made = asked.groupBy("run").applyInArrow(deal, "_row long, rank int, slot int, _in long")
    told = numbered.join(made, F.col(row).cast("long") == F.col("_row"))
    return told.withColumn("place", (F.col("run") * mega + F.col("_in")).cast("long")).select(*rows.columns, "run", "rank", "slot", "place")


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order in which they are first seen, the first table before."""
    both = first.select(key, F.col(order), F.lit(0).alias("src")).unionByName(second.select(key, F.col(order), F.lit(1).alias("src")))
    return both.groupBy(key).agg(F.min(F.struct("src", F.col(order).alias("seq"))).alias("s")).select(key, "s.src", "s.seq")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order, by partial aggregation."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_one")).select("_one.*")


def patched(base: DataFrame, patch: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """base with columns from patch where it has them."""
    p = patch.select(on, *[F.col(c).alias(f"_{c}") for c in columns])
    return base.join(p, on, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def alias_closure(aliases: dict[str, list[str]], name: str) -> set[str]:
    """All names that an alias stands for; a cycle is an error. The map is configuration."""
    out: set[str] = set()
    stack: list[tuple[str, tuple[str, ...]]] = [(name, ())]
    while stack:
        at, path = stack.pop()
        if at in path:
            raise ValueError(f"aliases run in a circle: {' > '.join([*path, at])}")
        if at not in aliases:
            out.add(at)
        stack += [(x, (*path, at)) for x in aliases.get(at, [])]
    return out


def normalised_pairs(rows: DataFrame, volume: str, region: str, finding: str) -> DataFrame:
    return rows.withColumn("volume", S.volume_id(F.col(volume))).withColumn("target", S.target_text(F.col(region), F.col(finding)))
