"""Helpers that the operators of this subpackage share: tables, staged results, batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in every operator here.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and all tasks run on this machine, as in tests, a folder of this
    process is made and set, and removed when the process ends. On a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, computed once and written as Parquet in the shared folder, then read again.

    This cuts the lineage: a lost executor costs its running tasks, not what was staged.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACE, in order; null for null."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Arrow batches of df through a function of Python lists, one list for each column.

    make() runs once for each task and returns the function, which gives lists by name
    in the order of schema. Rows are handed over in slices of bounded bytes.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for part in slices(batch):
                made = function(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], f.type) for f in out], schema=out
                )

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows of at most `most` bytes, by the length of each row's texts; a row at least."""
    rows = batch.num_rows
    sizes = np.ones(rows)
    for column in batch.columns if rows else ():
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        else:
            sizes += column.nbytes / rows
    ends = np.cumsum(sizes)
    start = 0
    while start < rows:
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, stop - start)
        start = stop
