"""Stacked arrays: one row a volume in large .npy files, with id lists of the same order.

A data source, "stacked_npy". A task reads a range of rows by their bytes; a filter on vid
by equality or a list is pushed down to the rows asked for. A manifest names the arrays
and id lists of each split; writers add files first and replace the manifest last, so that
a failed write leaves what was there.

    stacked(spark, "store/manifest.json", "train").where(F.col("vid").isin("a", "b"))
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from tessera.sources import files

ARTIFACT = "npy_stacked"
#: Bytes of a task's rows, of rows read at a time, and of a written file.
TASK_BYTES, READ_BYTES, FILE_BYTES = 64 << 20, 8 << 20, 64 << 20
KINDS = {"features": ("float", pa.float32()), "codes": ("long", pa.int64())}


@dataclass(frozen=True)
class Layout:
    """What the head of a .npy file says, and where its rows begin."""

    path: str
    shape: tuple[int, ...]
    dtype: str
    begin: int

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def layout(path: str) -> Layout:
    system, own = files.located(path)
    size = system.get_file_info(own).size
    if size is None:
        raise FileNotFoundError(path)
    with system.open_input_file(own) as file:
        version = np.lib.format.read_magic(file)
        head = np.lib.format.read_array_header_1_0 if version[0] == 1 else np.lib.format.read_array_header_2_0
        shape, fortran, dtype = head(file)
        begin = file.tell()
    if not shape or dtype.hasobject or fortran and len(shape) > 1:
        raise ValueError(f"{path}: rows have to be row-major numbers")
    made = Layout(path, tuple(int(n) for n in shape), dtype.str, begin)
    if size != begin + made.row_bytes * made.shape[0]:
        raise ValueError(f"{path} has {size} bytes, {begin + made.row_bytes * made.shape[0]} by its head")
    return made


@dataclass(frozen=True)
class Rows(InputPartition):
    """Rows start to stop of an array, whose ids begin at an offset of their list; or single rows with their ids."""

    layout: Layout
    start: int = 0
    stop: int = 0
    ids: str = ""
    offset: int = 0
    single: tuple[tuple[int, str], ...] | None = None


def split_parts(manifest: dict[str, Any], path: str, split: str) -> list[dict[str, str]]:
    """The (array, ids) pairs of a split, as whole paths."""
    if manifest.get("artifact_type") != ARTIFACT:
        raise ValueError(f"{path} is no manifest of {ARTIFACT}")
    splits = manifest.get("splits") or {}
    if split not in splits:
        raise KeyError(f"{path} has no split {split!r}; it has {sorted(splits)}")
    found = splits[split].get("parts", [splits[split]])
    return [{k: files.joined(files.parent(path), p[k]) for k in ("array", "ids")} for p in found]


class StackedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], kind: str):
        options = {k.lower(): v for k, v in options.items()}
        self.kind, self.wanted = kind, None
        self.most = int(options.get("taskbytes", TASK_BYTES))
        self.row: tuple[int, ...] | None = None
        if "ids" in options:
            self.parts = [{"array": options["path"], "ids": options["ids"]}]
            if "row" in options:
                self.row = tuple(int(n) for n in options["row"].split(","))
        else:
            manifest = json.loads(files.read_text(options["path"]))
            self.parts = split_parts(manifest, options["path"], options.get("split", "train"))
            if "grid_shape" in manifest:
                cells = math.prod(int(n) for n in manifest["grid_shape"])
                self.row = (cells, int(manifest["visual_dim"])) if "visual_dim" in manifest else (cells,)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("vid",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = asked if self.wanted is None else self.wanted & asked
            else:
                yield f

    def partitions(self) -> list[Rows]:
        made: list[Rows] = []
        for part in self.parts:
            told = layout(part["array"])
            if self.row is not None and told.shape[1:] != self.row:
                raise ValueError(f"{part['array']} has rows of {told.shape[1:]}, the manifest of {self.row}")
            step = max(1, self.most // max(1, told.row_bytes))
            offsets, single, n = [], [], 0
            for offset, vid in files.filled_lines(part["ids"]):
                if n % step == 0:
                    offsets.append(offset)
                if self.wanted is not None and vid in self.wanted:
                    single.append((n, vid))
                n += 1
            if n != told.shape[0]:
                raise ValueError(f"{part['ids']} has {n} ids, {part['array']} {told.shape[0]} rows")
            if self.wanted is None:
                made += [Rows(told, k * step, min(n, (k + 1) * step), part["ids"], at) for k, at in enumerate(offsets)]
            else:
                made += [Rows(told, single=tuple(single[k : k + step])) for k in range(0, len(single), step)]
        return made or [Rows(Layout("", (0,), "<f4", 0))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        told = partition.layout
        if not told.path:
            return
        system, own = files.located(told.path)
        step = max(1, READ_BYTES // max(1, told.row_bytes))
        with system.open_input_file(own) as file:
            if partition.single is not None:
                for k in range(0, len(partition.single), step):
                    some = partition.single[k : k + step]
                    raw = b"".join(file.read_at(told.row_bytes, told.begin + row * told.row_bytes) for row, _ in some)
                    yield self._batch([vid for _, vid in some], raw, told)
                return
            ids = files.filled_lines(partition.ids, partition.offset)
            for row in range(partition.start, partition.stop, step):
                many = min(step, partition.stop - row)
                raw = file.read_at(many * told.row_bytes, told.begin + row * told.row_bytes)
                yield self._batch([next(ids)[1] for _ in range(many)], raw, told)

    def _batch(self, ids: list[str], raw: bytes, told: Layout) -> pa.RecordBatch:
        values = np.frombuffer(raw, told.dtype)
        width = len(values) // len(ids)
        kind = KINDS[self.kind][1]
        # Lists hold their values' offsets, so that no row becomes an object.
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(values.astype(kind.to_pandas_dtype())))
        return pa.RecordBatch.from_arrays([pa.array(ids), rows], ["vid", self.kind])


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict[str, str]]


class StackedWriter(DataSourceArrowWriter):
    """Files of at most FILE_BYTES a task, each an array with its id list."""

    def __init__(self, options: dict[str, str], kind: str, overwrite: bool):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.split, self.kind, self.overwrite = options["path"], options.get("split", "train"), kind, overwrite
        self.row = tuple(int(n) for n in options["row"].split(","))
        self.dtype = np.dtype(options.get("dtype", "float32" if kind == "features" else "uint32"))
        self.shape = {"grid_shape": [int(n) for n in options["gridshape"].split(",")]} if "gridshape" in options else {}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        made: list[dict[str, str]] = []
        ids: list[str] = []
        arrays: list[np.ndarray] = []
        width = math.prod(self.row)
        most = max(1, FILE_BYTES // max(1, width * self.dtype.itemsize))

        def put() -> None:
            if not ids:
                return
            name = f"{self.split}/{uuid.uuid4().hex}"
            buffer = io.BytesIO()
            np.save(buffer, np.concatenate(arrays).reshape(len(ids), *self.row))
            folder = files.parent(self.path)
            files.write_bytes(f"{folder}/{name}.npy", buffer.getvalue())
            files.write_bytes(f"{folder}/{name}.txt", ("\n".join(ids) + "\n").encode())
            made.append({"array": f"{name}.npy", "ids": f"{name}.txt"})
            ids.clear()
            arrays.clear()

        for whole in iterator:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                lists = batch.column(self.kind)
                if lists.null_count or lists.flatten().null_count or (np.diff(lists.offsets.to_numpy()) != width).any():
                    raise ValueError(f"every row has to have {width} numbers")
                named = batch.column("vid").to_pylist()
                if any(v is None or v != v.strip() or not v or "\n" in v for v in named):
                    raise ValueError("ids have to be texts of one line, without blanks around them")
                ids.extend(named)
                arrays.append(lists.flatten().to_numpy(zero_copy_only=False).astype(self.dtype))
                if len(ids) >= most:
                    put()
        put()
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        parts = [p for m in messages if m for p in m.parts]
        old: dict[str, Any] = json.loads(files.read_text(self.path)) if files.exists(self.path) else {}
        splits = dict(old.get("splits") or {})
        gone = splits.get(self.split, {}).get("parts", []) if self.overwrite else []
        kept = [] if self.overwrite else splits.get(self.split, {}).get("parts", [])
        splits[self.split] = {"parts": kept + parts}
        facts = {"artifact_type": ARTIFACT, "splits": splits} | self.shape
        if len(self.row) == 2 and self.shape:
            facts["visual_dim"] = self.row[1]
        files.write_bytes(self.path, json.dumps(old | facts).encode())
        for part in gone:
            for name in part.values():
                files.remove(files.joined(files.parent(self.path), name))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for part in m.parts if m else ():
                for name in part.values():
                    files.remove(files.joined(files.parent(self.path), name))


class StackedArrays(DataSource):
    """Options: path (a manifest, or an array with option ids), split, kind, row ("cells,channels"), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "stacked_npy"

    @property
    def kind(self) -> str:
        kind = self.options.get("kind", "features")
        if kind not in KINDS:
            raise ValueError(f"kind {kind}; known are {sorted(KINDS)}")
        return kind

    def schema(self) -> str:
        return f"vid string, {self.kind} array<{KINDS[self.kind][0]}>"

    def reader(self, schema: Any) -> StackedReader:
        return StackedReader(dict(self.options), self.kind)

    def writer(self, schema: Any, overwrite: bool) -> StackedWriter:
        if "row" not in self.options:
            raise ValueError('option row has to say what a row is, as "cells,channels"')
        return StackedWriter(dict(self.options), self.kind, overwrite)


def _registered(spark: SparkSession) -> None:
    # Filters reach a Python source only with this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StackedArrays)


def stacked(spark: SparkSession, manifest: str, split: str = "train", kind: str = "features", **options: Any) -> DataFrame:
    """(vid, features) of a split, or (vid, codes). Counts and row sizes that differ from the manifest's are errors."""
    _registered(spark)
    return spark.read.format("stacked_npy").options(split=split, kind=kind, **options).load(manifest)


def stacked_file(spark: SparkSession, array: str, ids: str, kind: str = "features", **options: Any) -> DataFrame:
    """The same of one array and its id list."""
    _registered(spark)
    return spark.read.format("stacked_npy").options(ids=ids, kind=kind, **options).load(array)


def write_stacked(df: DataFrame, manifest: str, row: tuple[int, ...], split: str = "train", kind: str = "features", mode: str = "append", **options: Any) -> None:
    """(vid, features) as a split of the manifest; row is the shape of a volume's row, as (cells, channels)."""
    _registered(df.sparkSession)
    written = df.select("vid", kind).write.format("stacked_npy").mode(mode)
    written.options(split=split, kind=kind, row=",".join(map(str, row)), **options).save(manifest)
