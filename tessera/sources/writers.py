"""Sinks. Files appear whole or not at all, by the commit protocol of Spark's writers."""

from __future__ import annotations

import html
import io
import json
import os
import uuid
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files

POLICIES = {"error": "errorifexists", "skip": "ignore", "overwrite": "overwrite", "append": "append"}


def write(df: DataFrame, path: str, policy: str = "error", by: Sequence[str] = ()) -> None:
    """Parquet; the policy says what becomes of a table that is there."""
    df.write.mode(POLICIES[policy]).partitionBy(*by).parquet(path)


def append_epoch(df: DataFrame, path: str, anew: bool = False) -> None:
    """Metric rows, by seed and epoch: those of a seed and epoch take the place of what a former run wrote there.

    anew, for the first epoch of the first seed, starts the log from nothing; otherwise what
    other seeds and epochs wrote stays. A write that fails leaves the log as it was.
    """
    if anew:
        # Computed before anything is deleted.
        first = f"{path.rstrip('/')}.first"
        df.write.mode("overwrite").parquet(first)
        df.sparkSession.read.schema(df.schema).parquet(first).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("seed", "epoch").parquet(path)
        return
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seed", "epoch").parquet(path)


def matrix(rows: DataFrame, cells: int) -> DataFrame:
    """(vid, pos, v) as (vid, features); a volume of another length is an error."""
    made = rows.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s"))
    values = F.transform("s", lambda x: x["v"])
    return made.select("vid", F.when(F.size("s") != cells, F.raise_error(F.lit("a volume has another length"))).otherwise(values).alias("features"))


def jsonl(df: DataFrame, path: str, policy: str = "error") -> None:
    df.write.mode(POLICIES[policy]).json(path)


def npy_files(grids: DataFrame, folder: str) -> DataFrame:
    """Writes (vid, shape, features) as folder/vid.npy, a float32 array a volume; gives (vid, path).

    The table is lazy: files are written when it is read, and a task that is tried again
    writes the same ones. A task writes in a folder of its own and moves whole files from there,
    as tasks that make their files in one folder wait for each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, own = files.located(folder.rstrip("/"))
        part = f"{own}/.part-{uuid.uuid4().hex}"
        system.create_dir(part, recursive=True)
        try:
            for batch in batches:
                paths = []
                for vid, shape, features in zip(batch.column("vid").to_pylist(), batch.column("shape").to_pylist(), batch.column("features"), strict=True):
                    if not vid or "/" in vid:
                        raise ValueError(f"{vid!r} can't name a file")
                    buffer = io.BytesIO()
                    np.save(buffer, features.values.to_numpy(zero_copy_only=False).astype(np.float32).reshape(shape))
                    with system.open_output_stream(f"{part}/{vid}.npy") as file:
                        file.write(buffer.getvalue())
                    system.move(f"{part}/{vid}.npy", f"{own}/{vid}.npy")
                    paths.append(f"{folder.rstrip('/')}/{vid}.npy")
                yield pa.RecordBatch.from_arrays([batch.column("vid"), pa.array(paths, pa.string())], ["vid", "path"])
        finally:
            system.delete_dir(part)

    return grids.select("vid", "shape", F.col("features").cast("array<float>").alias("features")).mapInArrow(run, "vid string, path string")


def enriched(df: DataFrame, **constants: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in constants.items()})


def manifest(spark: SparkSession, path: str, facts: Mapping[str, object], policy: str = "overwrite") -> None:
    """One row of facts as JSON."""
    row = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in facts.items()}
    spark.createDataFrame([row], ", ".join(f"`{k}` string" for k in row)).coalesce(1).write.mode(POLICIES[policy]).json(path)


def arm_manifests(arms: DataFrame, available: DataFrame) -> DataFrame:
    """A row for each arm with its splits; an arm without one of its splits is an error."""
    lacking = arms.join(available, ["arm", "split"], "left_anti").limit(5).collect()
    if lacking:
        raise ValueError(f"splits are absent: {[(r['arm'], r['split']) for r in lacking]}")
    return arms.join(available, ["arm", "split"]).groupBy("arm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "path")))).alias("splits"))


def is_fresh(spark: SparkSession, path: str, facts: Mapping[str, object]) -> bool:
    """Whether the manifest at path has just these facts."""
    try:
        rows = spark.read.json(path).limit(2).collect()
    except Exception as error:  # no such table
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise
    want = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in facts.items()}
    return len(rows) == 1 and {k: v for k, v in rows[0].asDict().items() if v is not None} == want


def subset(rows: DataFrame, wanted: DataFrame, on: str, order: str, path: str, policy: str = "error") -> None:
    """Rows in the order of the wanted list."""
    rows.join(wanted.select(on, order), on).orderBy(order).drop(order).write.mode(POLICIES[policy]).json(path)


def dashboard(tables: Mapping[str, DataFrame], path: str, most: int = 5000) -> None:
    """Summary tables as one page with a tab each; number cells are shaded by their range.

    A dashboard is for reading: a table of more than `most` rows is an error.
    """
    parts = []
    for name, df in tables.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{name} has more than {most} rows")
        head = "".join(f"<th onclick='order(this)'>{html.escape(c)}</th>" for c in df.columns)
        spans = {c: (min(v), max(v)) for c in df.columns if (v := [r[c] for r in rows if isinstance(r[c], (int, float))])}

        def shade(c: str, v: object) -> str:
            if c not in spans or not isinstance(v, (int, float)) or spans[c][0] == spans[c][1]:
                return ""
            part = (v - spans[c][0]) / (spans[c][1] - spans[c][0])
            return f" style='background:hsl({120 * part:.0f},60%,85%)'"

        body = "".join("<tr>" + "".join(f"<td{shade(c, r[c])}>{html.escape(str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows)
        parts.append(f"<details open><summary>{html.escape(name)}</summary><table><tr>{head}</tr>{body}</table></details>")
    script = (
        "function order(h){const t=h.closest('table'),i=[...h.parentNode.children].indexOf(h),r=[...t.rows].slice(1);"
        "r.sort((a,b)=>a.cells[i].innerText.localeCompare(b.cells[i].innerText,undefined,{numeric:true}));r.forEach(x=>t.append(x))}"
    )
    _replace(path, f"<!doctype html><meta charset='utf-8'><script>{script}</script>{''.join(parts)}")


def latex_rows(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    return "".join(" & ".join("--" if v is None else str(v).replace("_", r"\_") for v in r) + r" \\" + "\n" for r in rows)


def splice(path: str, name: str, text: str) -> None:
    """Replaces what stands between the marks of name in a local file."""
    first, last = f"% BEGIN {name}\n", f"% END {name}"
    with open(path, encoding="utf-8") as file:
        whole = file.read()
    if whole.count(first) != 1 or whole.count(last) != 1:
        raise ValueError(f"{path} has no single pair of marks for {name}")
    _replace(path, whole[: whole.index(first) + len(first)] + text + whole[whole.index(last) :])


def _replace(path: str, text: str) -> None:
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(f"{path}.part", path)
