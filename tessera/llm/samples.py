"""Labelled rows for the learned operators: a bounded sample, split by a hash of the id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.repeat_index import row_key

def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text and label (0 or 1) of at most `most` labelled rows of each class, none held out.

    The ids of a class with the smallest hashes are taken, each once, however often it is
    labelled. They are the only thing that is broadcast, and `most` bounds them. Of the
    documents of an id the one with the smallest row key is taken, so that `most` bounds
    the rows too.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    taken = None
    for value in (0, 1):
        part = (
            usable.where(F.col(label) == value)
            .select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label"))
            .distinct()
            .orderBy(F.xxhash64("label_id"), "label_id")
            .limit(most)
        )
        taken = part if taken is None else taken.unionByName(part)
    found = docs.join(F.broadcast(taken), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "label")
    one = F.min_by("text", row_key(F.col("doc_id"), F.col("text"))).alias("text")
    return found.groupBy("doc_id", "label").agg(one).select("doc_id", "text", "label")


def class_sizes(labels: DataFrame, label: str) -> list[int]:
    """How many usable labels there are of class 0 and of class 1."""
    usable = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    row = usable.agg(*[F.count_if(F.col(label) == k).alias(f"n{k}") for k in (0, 1)]).first()
    return [row["n0"], row["n1"]]
