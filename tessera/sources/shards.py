"""Token shards: many tensors in one file, behind a head that tells where each one lies.

A shard begins with eight bytes, the length of its head; the head is JSON of kind, shape
and byte range by key; ranges count from its end. Only the heads and the ranges of keys
that are asked for are read. An index has a row for each volume: volume_id, split, shard
(the file below the split's folder) and key.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import files

# The kinds of numbers of the format, by their names.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1", "U64": "<u8", "U32": "<u4", "U16": "<u2", "U8": "|u1", "BOOL": "|b1"}
#: BF16 is the upper half of F32.
HALF = "BF16"
#: Longest head, by the format; bytes of a written shard.
HEAD_BYTES, SHARD_BYTES = 100_000_000, 64 << 20
#: Groups that the keys of one shard are dealt to, so that a large shard isn't one task's work.
SPREAD = 4
INDEX = "volume_id string, split string, shard string, z_quantized_key string"


def shard_head(file: pa.NativeFile, path: str, size: int) -> tuple[int, dict[str, Any]]:
    """Where the tensors begin, and the head; ranges that don't fit shape or file are errors."""
    if size < 8:
        raise ValueError(f"{path} is no shard: {size} bytes")
    (length,) = struct.unpack("<Q", file.read_at(8, 0))
    if length > min(HEAD_BYTES, size - 8):
        raise ValueError(f"{path} has a head of {length} bytes in {size}")
    head = json.loads(file.read_at(length, 8))
    head.pop("__metadata__", None)
    return 8 + length, head


def tensor(file: pa.NativeFile, path: str, size: int, begin: int, head: dict[str, Any], key: str) -> np.ndarray:
    if key not in head:
        raise KeyError(f"{path} has no key {key}")
    told = head[key]
    kind, shape, (start, stop) = told["dtype"], [int(n) for n in told["shape"]], told["data_offsets"]
    width = 2 if kind == HALF else np.dtype(KINDS[kind]).itemsize if kind in KINDS else None
    if width is None:
        raise ValueError(f"{path}: {key} is of kind {kind}, which isn't read")
    if not 0 <= start <= stop <= size - begin or stop - start != width * math.prod(shape):
        raise ValueError(f"{path}: {key} lies at {start} to {stop} of {size - begin} bytes, for shape {shape} of {kind}")
    raw = file.read_at(stop - start, begin + start)
    if kind == HALF:
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32).reshape(shape)
    return np.frombuffer(raw, KINDS[kind]).reshape(shape)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """The index's lines as volume_id, split, shard and key; a line of another form is an error."""
    return spark.read.schema(INDEX).json(path, mode="FAILFAST").withColumnRenamed("z_quantized_key", "key")


def token_shards(index: DataFrame, folder: str, channels: int | None = None) -> DataFrame:
    """(vid, shape, features) of the index's rows: tensors [C, D, H, W] as [D, H, W, C], row-major.

    Rows of a shard are dealt to SPREAD groups, each of which reads the head once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, Any, int, int, dict[str, Any]] | None = None
        try:
            for batch in batches:
                for vid, split, shard, key in zip(*(batch.column(c).to_pylist() for c in ("volume_id", "split", "shard", "key")), strict=True):
                    path = f"{folder.rstrip('/')}/{split}/{shard}"
                    if opened is None or opened[0] != path:
                        if opened:
                            opened[1].close()
                        system, own = files.located(path)
                        size = system.get_file_info(own).size
                        if size is None:
                            raise FileNotFoundError(path)
                        file = system.open_input_file(own)
                        opened = (path, file, size, *shard_head(file, path, size))
                    _, file, size, begin, head = opened
                    made = tensor(file, path, size, begin, head, key)
                    if made.ndim != 4:
                        raise ValueError(f"{vid}: tokens have to be [C, D, H, W], not {made.shape}")
                    if channels is not None and made.shape[0] != channels:
                        raise ValueError(f"{vid} has {made.shape[0]} channels instead of {channels}")
                    grid = np.ascontiguousarray(made.transpose(1, 2, 3, 0), np.float32)
                    features = pa.ListArray.from_arrays(pa.array([0, grid.size], pa.int32()), pa.array(grid.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([vid]), pa.array([list(grid.shape)], pa.list_(pa.int32())), features], ["vid", "shape", "features"])
        finally:
            if opened:
                opened[1].close()

    some = F.pmod(F.xxhash64("key"), F.lit(SPREAD))
    dealt = index.select("volume_id", "split", "shard", "key").repartition("split", "shard", some).sortWithinPartitions("split", "shard")
    return dealt.mapInArrow(run, "vid string, shape array<int>, features array<float>")


def shard_bytes(tensors: dict[str, np.ndarray]) -> bytes:
    """A shard of float32 tensors."""
    head, at, parts = {}, 0, []
    for key, value in tensors.items():
        raw = np.ascontiguousarray(value, "<f4").tobytes()
        head[key] = {"dtype": "F32", "shape": list(value.shape), "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        parts.append(raw)
    told = json.dumps(head).encode()
    told += b" " * (-len(told) % 8)
    return struct.pack("<Q", len(told)) + told + b"".join(parts)


def write_token_shards(tokens: DataFrame, folder: str, split: str, shape: tuple[int, int, int, int]) -> DataFrame:
    """Writes (vid, features), features as [C, D, H, W] row-major, to shards; gives the index.

    The index is lazy: the shards are written when it is, once, so write it as JSON lines.
    A task that is tried again writes files of other names, and only those of the try
    that succeeded are in the index.
    """
    width = math.prod(shape)
    most = max(1, SHARD_BYTES // (4 * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                lists, ids = batch.column("features"), batch.column("vid").to_pylist()
                if lists.null_count or (np.diff(lists.offsets.to_numpy()) != width).any():
                    raise ValueError(f"every volume has to have {width} numbers")
                values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, *shape)
                name = f"{uuid.uuid4().hex}.safetensors"
                keys = [f"{k}_{v}" for k, v in enumerate(ids)]
                files.write_bytes(f"{folder.rstrip('/')}/{split}/{name}", shard_bytes(dict(zip(keys, values, strict=True))))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([split] * len(ids)), pa.array([name] * len(ids)), pa.array(keys)], ["volume_id", "split", "shard", "z_quantized_key"])

    return tokens.select("vid", F.col("features").cast("array<float>").alias("features")).mapInArrow(run, INDEX)
