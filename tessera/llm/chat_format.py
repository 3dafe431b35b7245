"""Chat formatting (operator 6): collapse of cumulative snapshots, then rendering.

A chat that is logged after every turn leaves conversations that are prefixes of longer
ones. Each conversation gets a rolling hash after each of its turns. Conversations with
the same last hash are one; anti-joined against the hashes before the last turn of all
conversations, those that no longer conversation continues remain. They are rendered
with a template of role headers. Built-in functions only.

Of equal conversations the smallest conv_id stays. Turns are ordered by (turn, role,
text), nulls first, and repeated rows are turns of their own. A null role or text is
rendered as empty, but differs from an empty one when turns are compared. Rows with a
null conv_id are one conversation. An empty table gives an empty one; extra columns are
not read. Hashes are SHA-256 over the hash before and the turn. The groups that are
joined have one row a key, however often a conversation or a first turn was logged; a
single conversation is held by one task, as its rendering is one string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, staged

RUN = 64
HEAD, MIDDLE, TAIL = "<|", "|>\n", "\n"


def _said(x: Column) -> Column:
    """A turn's role and text as one string, from which both can be told."""
    role, text = x["role"], x["text"]
    return F.concat(
        F.coalesce(F.length(role).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(role, F.lit("")), F.lit(":"),
        F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), text)),
    )


def prefix_hashes(turns: Column) -> Column:
    """The rolling hash after each turn of an array of struct<role, text>, which isn't empty.

    Turns are hashed in runs of RUN, as an array is copied each time it grows.
    """
    said = F.transform(turns, _said)

    def step(done: Column, x: Column) -> Column:
        return F.concat(done, F.array(F.sha2(F.concat(F.get(done, F.size(done) - 1), x), 256)))

    def run(done: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.array(F.get(F.element_at(done, -1), F.size(F.element_at(done, -1)) - 1)), step)
        return F.concat(done, F.array(F.slice(own, F.lit(2), F.size(own) - 1)))

    starts = F.sequence(F.lit(1), F.size(turns), F.lit(RUN))
    runs = let(said, lambda s: F.transform(starts, lambda i: F.slice(s, i, F.lit(RUN))))
    return F.flatten(F.slice(F.aggregate(runs, F.array(F.array(F.lit(""))), run), F.lit(2), F.size(turns)))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, turns in order, and the hashes after each of them."""
    turn = F.struct("turn", "role", "text")
    return (
        rows.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn("hashes", prefix_hashes(F.col("turns")))
    )


def maximal(convs: DataFrame) -> DataFrame:
    """conv_id of the conversations to keep, from conv_id and hashes."""
    last = F.get(F.col("hashes"), F.size("hashes") - 1)
    whole = convs.groupBy(last.alias("h")).agg(F.min("conv_id").alias("conv_id"))
    inner = convs.select(F.explode(F.slice("hashes", 1, F.size("hashes") - 1)).alias("h")).distinct()
    return whole.join(inner, "h", "left_anti").select("conv_id")


def render(turns: Column) -> Column:
    """Turns as one string: a header with the role, the text, a line break."""
    none = F.lit("")
    shown = F.transform(
        turns,
        lambda x: F.concat(F.lit(HEAD), F.coalesce(x["role"], none), F.lit(MIDDLE), F.coalesce(x["text"], none), F.lit(TAIL)),
    )
    return F.array_join(shown, "")


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of the maximal conversations."""
    convs = staged(conversations_of(rows.select("conv_id", "turn", "role", "text")), "chats")
    kept = maximal(convs).withColumnRenamed("conv_id", "kept_id")
    return convs.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), render(F.col("turns")).alias("rendered")
    )


#: DuckDB SQL for format_chats() over conversations.
SQL = f"""
WITH c AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations GROUP BY conv_id),
w AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns),
i AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM c)),
k AS (SELECT * FROM w ANTI JOIN i ON w.turns = i.turns)
SELECT conv_id, len(turns)::BIGINT AS n_turns,
       array_to_string(list_transform(turns, lambda x: '{HEAD}' || coalesce(x.role, '') || '|>' || chr(10) || coalesce(x.text, '') || chr(10)), '') AS rendered
FROM k
"""
