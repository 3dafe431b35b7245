"""Quality rules (operator 1): rules for documents, and verdicts on their hosts.

Each document is measured within its row. Failures of the base rules are counted for
each host; a host's failure rate is shrunk towards the rate of all hosts by a beta prior
fitted to the hosts by moments; hosts whose shrunk rate is at or above HOST_RATE are
rejected, and the verdict is joined back to the documents of the host. Built-in
functions only.

A document with a null host is judged by the base rules alone. Null and empty texts have
no words and fail. Repeated rows count each time; an empty table gives an empty one.
Extra columns are not read. A host with a third of all documents is counted by partial
aggregation, and the join back is one that the engine can split or broadcast by its size.

Three-word windows of one text are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, staged, words

SYMBOLS = r"[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Hosts are rejected at this failure rate, after shrinking.
HOST_RATE = 0.6
#: The prior weighs as many documents at least and at most.
PRIOR_WEIGHT = (2.0, 1000.0)


def repeated_words(found: Column) -> Column:
    """Words in three-word windows that the array has twice or more, the first included."""

    def covered(starts: Column) -> Column:
        def step(total: Column, j: Column) -> Column:
            return total + F.least(F.lit(3), F.get(starts, j) - F.get(starts, j - 1))

        more = F.aggregate(F.sequence(F.lit(1), F.size(starts) - 1), F.lit(3), step)
        return F.when(F.size(starts) == 0, 0).when(F.size(starts) == 1, 3).otherwise(more)

    def twins(ordered: Column) -> Column:
        same = lambda x, j: F.get(ordered, j)["h"] == x["h"]
        twice = F.filter(ordered, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)))
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.sort_array(pairs), twins))

    window = F.transform(
        F.sequence(F.lit(0), F.size(found) - 3),
        lambda i: F.xxhash64(F.get(found, i), F.get(found, i + 1), F.get(found, i + 2)),
    )
    return F.when(F.size(found) < 4, 0).otherwise(let(window, counted))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base figures of every whole text, and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # One evaluation of the words, whichever figures are asked for.
    figures = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(F.size(w) < 4, F.lit(0)).otherwise(repeated_words(w)).cast("long").alias("n_repeat_words"),
        ),
    )
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"{SYMBOLS}+", ""))
    again = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return (
        docs.withColumn("_figures", figures)
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_dup_lines", again.cast("long"))
        .withColumn("n_words", F.col("_figures.n_words"))
        .withColumn("word_chars", F.col("_figures.word_chars"))
        .withColumn("n_repeat_words", F.col("_figures.n_repeat_words"))
        .withColumn("base_failed", base_failed())
        .drop("_figures")
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def host_verdicts(measured: DataFrame, host_col: str = "source") -> DataFrame:
    """A row for each host: documents, failures, shrunk failure rate, host_kept.

    The prior's mean is the mean of the hosts' rates and its weight follows from their
    spread beyond that of chance, by moments.
    """
    counted = measured.where(F.col(host_col).isNotNull()).groupBy(host_col)
    # Written, so that it is counted once, and a host of very many documents can be split in the join back.
    hosts = staged(counted.agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    spread = hosts.agg(
        F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(1 / F.col("host_docs")).alias("c")
    )
    told = spread.first()
    if told["m"] is None:
        prior, weight = 0.0, PRIOR_WEIGHT[0]
    else:
        prior, chance = told["m"], told["m"] * (1 - told["m"])
        weight = min(max(chance / max(told["v"] - chance * told["c"], 1e-9) - 1, PRIOR_WEIGHT[0]), PRIOR_WEIGHT[1])
    shrunk = (F.col("host_failed") + prior * weight) / (F.col("host_docs") + weight)
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", F.col("host_rate") < HOST_RATE)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """id, the base figures, base_failed, kept, and the figures of the host."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    measured = staged(measure(plain).drop("text"), "quality-rules")
    hosts = host_verdicts(measured, "host")
    joined = measured.join(hosts, "host", "left")
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("host_kept"), F.lit(True))).alias("kept"),
        "host_docs", "host_failed",
    )


#: DuckDB SQL for judge() over documents.
SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
g AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
t AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM g) WHERE c > 1),
p AS (
  SELECT r, count(DISTINCT i + k)::BIGINT AS n_repeat_words
  FROM t, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (
  SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
b AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN p USING (r) LEFT JOIN l USING (r)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b),
h AS (
  SELECT source, count(*)::BIGINT AS host_docs, sum(base_failed::INT)::BIGINT AS host_failed
  FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (
  SELECT avg(host_failed / host_docs) AS m, var_pop(host_failed / host_docs) AS v, avg(1 / host_docs) AS c FROM h),
q AS (
  SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * c, 1e-9) - 1, {PRIOR_WEIGHT[0]}), {PRIOR_WEIGHT[1]}) AS k FROM m),
s AS (SELECT h.*, (host_failed + m * k) / (host_docs + k) < {HOST_RATE} AS host_kept FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(host_kept, true) AS kept, host_docs, host_failed
FROM f LEFT JOIN s ON f.source = s.source
"""
