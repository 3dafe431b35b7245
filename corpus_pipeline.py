"""A training corpus in five stages: clean, collapse copies, cut repeats, decontaminate, encode.

Each stage works on all that its predecessor kept, and all but the last return the
columns of documents. Nulls, empty and repeated rows, ties and empty tables:

- A null or empty text is scored as one without toxic windows, is no near copy of another,
  has nothing to cut, holds no benchmark item and has no tokens. Null values of other
  columns are passed on. A null doc_id is an id like any other, and the last of a group.
- Repeated rows are scored alike; near_copies keeps one of them, and one of each group.
- Of a group the smallest doc_id stays, of equal ones the smallest hash of id and text.
- Empty documents give an empty table with the same columns. Labels of no class give
  every text a score of 0.5, which is below the limit, those of one class that class's
  score; an empty benchmark has no item to hold.
- Further columns are passed on, whatever their names (but for __row__, __spans__, __score__).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, repeat_index, toxicity
from tessera.llm.common import staged, table


#: A column that a stage adds for a while.
SCORE = "__score__"
#: Passages from so many words on are cut where they stand in several places, and the
#: bytes of a word in prose with the blank behind it (four letters, on the short side).
PASSAGE_WORDS, WORD_BYTES = 50, 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the limit."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model, out_col=SCORE).where(F.col(SCORE) < toxicity.TOXIC).drop(SCORE)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8."""
    return jaccard_join.keep_one(docs)


def cut_long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of PASSAGE_WORDS words that stand elsewhere too.

    A passage is a string of as many bytes as its words have at least. The operator's own
    400 bytes are about 65 words, so that most passages of 50 to 60 words would stay.
    """
    cut = repeat_index.cut_repeats(docs, length=PASSAGE_WORDS * WORD_BYTES)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the token ids and of what they decode to."""
    return bpe.op9(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_copies", keep_one_of_near_copies),
    ("long_repeats", cut_long_repeats),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

#: SQL can't express a stage; the tests compare it with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
