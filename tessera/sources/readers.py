"""Scans of the file layouts that volumes, labels, texts and runs come in.

All of them are lazy DataFrames over Spark's own readers, so that columns and filters
reach the files. Array files are decoded by Arrow-batched functions, a file at a time.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import scalars as S
from tessera.sources.files import located

#: Texts that stand for a missing number.
NO_NUMBER = ("", "nan", "NaN", "NA")


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df by a key, in tasks for all cores: a small table, or one in few row groups, is else read in one or two."""
    session = df.sparkSession
    return df.repartition(max(int(session.conf.get("spark.sql.shuffle.partitions", "200")), 2 * session.sparkContext.defaultParallelism), by)


def _npy_array(content: bytes, transpose: Sequence[int] | None, member: str | None) -> np.ndarray:
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    grid = loaded[member or loaded.files[0]] if hasattr(loaded, "files") else loaded
    return (grid.transpose(transpose) if transpose else grid).astype(np.float32)


def npy_grids(spark: SparkSession, folder: str, transpose: Sequence[int] | None = None, member: str | None = None) -> DataFrame:
    """(vid, shape, features) of one .npy, or one member of an .npz, for each volume."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.np[yz]").load(folder)

    def run(frames):
        for frame in frames:
            rows = []
            for vid, content in zip(frame["vid"], frame["content"]):
                grid = _npy_array(content, transpose, member)
                rows.append((vid, list(grid.shape), grid.ravel()))
            yield pd.DataFrame(rows, columns=["vid", "shape", "features"])

    named = files.select(S.volume_id(F.col("path")).alias("vid"), "content")
    return named.mapInPandas(run, "vid string, shape array<int>, features array<float>")


def named_npy_grids(volumes: DataFrame, folder: str, transpose: Sequence[int] | None = None, most: int = 8 << 20) -> DataFrame:
    """(vid, shape, features) of folder/vid.npy for each vid of volumes, once; a volume without its file is an error.

    The folder isn't listed: tasks open the files of their volumes, so that neither the driver
    nor a number of tasks grows with the files. About `most` bytes of arrays are held at a time.
    """
    # Dealt out before equal ones are left out, as that keeps the number of tasks whatever the size.
    named = dealt(volumes.select(F.col("vid").cast("string").alias("vid")), "vid").distinct()

    schema = pa.schema([("vid", pa.string()), ("shape", pa.list_(pa.int32())), ("features", pa.list_(pa.float32()))])

    def made(rows):
        names, grids = [vid for vid, _ in rows], [grid for _, grid in rows]
        ends = np.cumsum([0, *(grid.size for grid in grids)]).astype(np.int32)
        flat = np.concatenate([grid.ravel() for grid in grids]) if grids else np.zeros(0, np.float32)
        features = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([grid.shape for grid in grids], pa.list_(pa.int32())), features], schema=schema)

    def run(batches):
        system, own = located(folder.rstrip("/"))
        for batch in batches:
            rows, held = [], 0
            for vid in batch.column("vid").to_pylist():
                with system.open_input_stream(f"{own}/{vid}.npy") as file:
                    rows.append((vid, _npy_array(file.read(), transpose, None)))
                held += rows[-1][1].nbytes
                if held >= most:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    return named.mapInArrow(run, "vid string, shape array<int>, features array<float>")


# NIfTI-1 data types by their code.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def nifti_array(content: bytes) -> np.ndarray:
    """The array of a single-file NIfTI-1 image, gzipped or not, as float32 by its own slope and intercept."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if int.from_bytes(data[:4], "little") == 348 else ">"
    field = lambda kind, at, n=1: np.frombuffer(data, order + kind, n, at)
    if int(field("i4", 0)[0]) != 348 or data[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 image")
    dims = field("i2", 40, 8).tolist()
    shape = [max(1, n) for n in dims[1 : 1 + dims[0]]]
    code = int(field("i2", 70)[0])
    if code not in NIFTI_TYPES:
        raise ValueError(f"NIfTI data type {code} isn't read")
    start, slope, shift = (float(field("f4", at)[0]) for at in (108, 112, 116))
    made = field(NIFTI_TYPES[code], int(start) or 352, int(np.prod(shape))).astype(np.float32)
    if slope and np.isfinite(slope) and (slope != 1 or shift):
        made = made * np.float32(slope) + np.float32(shift)
    return made.reshape(shape, order="F")


def nifti_grids(spark: SparkSession, folder: str) -> DataFrame:
    """(vid, shape, features) of the .nii and .nii.gz images of a folder, row-major."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{nii,nii.gz}").load(folder)

    def run(frames):
        for frame in frames:
            for vid, content in zip(frame["vid"], frame["content"]):
                grid = nifti_array(bytes(content))
                yield pd.DataFrame({"vid": [vid], "shape": [list(grid.shape)], "features": [grid.ravel()]})

    return files.select(S.volume_id(F.col("path")).alias("vid"), "content").mapInPandas(run, "vid string, shape array<int>, features array<float>")


def codebook_grids(codes: DataFrame, codebook: DataFrame) -> DataFrame:
    """(vid, pos, code) with the codebook's (code, entry)."""
    return codes.join(codebook, "code")


def stacked_grids(rows: DataFrame, ids: DataFrame, cells: int, channels: int) -> DataFrame:
    """(row, features) joined to (row, vid); counts and sizes that differ are errors."""
    n, m = rows.count(), ids.count()
    if n != m:
        raise ValueError(f"{n} rows for {m} ids")
    size = F.when(F.size("features") != cells * channels, F.raise_error(F.lit("a row has another size"))).otherwise(F.col("features"))
    return ids.join(rows, "row").select("vid", size.alias("features"))


def token_shards(index: DataFrame, payload: DataFrame) -> DataFrame:
    """An index of (vid, shard, key) with the payload's (shard, key, tokens)."""
    return index.join(payload, ["shard", "key"]).select("vid", "tokens")


def label_csv(spark: SparkSession, path: str, id_col: str = "VolumeName") -> DataFrame:
    """vid and double columns; blank and NaN are null. Columns are named by the header."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.when(F.trim(F.col(f"`{c}`")).isin(*NO_NUMBER), None).otherwise(F.trim(F.col(f"`{c}`")).cast("double")).alias(c)
    return raw.select(S.strip_suffix(F.col(id_col)).alias("vid"), *[number(c) for c in raw.columns if c != id_col])


def id_list(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(F.trim("value").alias("vid"))
    return lines.where("vid <> ''")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A line that isn't JSON of the schema's form is an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    rows = jsonl(spark, path, "volume_id string, generated_text string, reference_text string")
    if rows.isEmpty():
        raise ValueError(f"no predictions in {path}")
    return rows


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows of all runs below path, with the run and family that the path tells.

    Older files have no seed; their column is null.
    """
    schema = "epoch int, seed int, family string, target string, metric string, score double"
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("enforceSchema", False)
    text = raw.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    head = text.where(F.col("value").startswith("epoch,")).select("path", F.split("value", ",").alias("names")).dropDuplicates(["path"])
    cells = text.where(~F.col("value").startswith("epoch,") & (F.trim("value") != "")).join(head, "path").withColumn("cells", F.split("value", ","))
    kinds = {f.name: f.dataType for f in T._parse_datatype_string(schema)}
    pick = [F.nullif(F.get("cells", (F.array_position("names", n) - 1).cast("int")), F.lit("")).try_cast(k).alias(n) for n, k in kinds.items()]
    pick = [F.when(F.array_contains("names", n), p).alias(n) for n, p in zip(kinds, pick)]
    return cells.select(F.regexp_extract("path", r"(exp_[^/]+)/", 1).alias("run"), *pick)


def step_files(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON of evaluations/step_N folders, with the number of the step."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(path)
    return rows.select("*", S.step_number(F.col("_metadata.file_path")).alias("step"))


def shard_stats(spark: SparkSession, path: str) -> DataFrame:
    """shard_*.csv of a folder, with the file that each row is from."""
    rows = spark.read.option("pathGlobFilter", "shard_*.csv").csv(path, header=True)
    return rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0).alias("source_file"))


def csv_with(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    if lacking := sorted(set(required) - set(rows.columns)):
        raise ValueError(f"{path} lacks {lacking}")
    return rows


def bundle_files(files: DataFrame, budgets: Sequence[int] = (), encoders: Sequence[str] = ()) -> DataFrame:
    """(path) of a bundle narrowed to budgets and encoders that its folders name."""
    out = files.withColumn("budget", F.regexp_extract("path", r"_b(\d+)", 1).try_cast("int")).withColumn("encoder", F.regexp_extract("path", r"^([^/]+)/", 1))
    out = out.where(F.col("budget").isin(*budgets)) if budgets else out
    return out.where(F.col("encoder").isin(*encoders)) if encoders else out
