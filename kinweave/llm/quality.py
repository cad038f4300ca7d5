"""Quality rules as a bitmask ledger (operator 8).

``ledger`` measures every document once and has, beside the measurements, one
bit per rule that the document fails.  Policies are versioned masks over those
bits: applying another policy, or asking what each rule costs, reads the ledger
(``store`` writes it as a table; the queries here keep it as a checkpoint) and
never a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kinweave.llm.arrow import slices, texts
from kinweave.llm.rows import packed_row, quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rule by bit: name and the SQL condition, over the measurements, under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("shouting", "n_words >= 20 AND 2 * n_upper_words > n_words"),
    ("exclamations", "n_words >= 20 AND 5 * n_exclamations > n_words"),
    ("duplicate_lines", "n_lines >= 4 AND 2 * n_dup_lines > n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "n_words >= 20 AND word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: Policies by version; a document is kept if it fails no rule of the mask.
POLICIES: dict[str, int] = {
    "base": BASE,
    "v1": BASE | BIT["symbols"] | BIT["shouting"] | BIT["exclamations"],
    "v2": BASE | BIT["symbols"] | BIT["shouting"] | BIT["exclamations"] | BIT["duplicate_lines"] | BIT["long_words"] | BIT["short_words"],
}
CURRENT = "v2"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_exclamations")


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """How many words lie in windows of ``width`` words that occur twice or more.

    Windows are compared exactly: ranks of pairs, then of fours, then of eights
    (``width`` is a power of two) stand for the windows themselves.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(ids) == len(words):
        return 0
    step = 1
    while step < width:
        pairs = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        step *= 2
    times = np.bincount(rank)
    twice = times[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    edge[starts] += 1
    np.subtract.at(edge, starts + width, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    same = compress(words, map(eq, words, text.upper().encode("utf-8", "surrogatepass").split()))
    shouted = sum(len(w) > 1 and w.decode("utf-8", "surrogatepass").isupper() for w in same)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        shouted,
        text.count("!"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, the measurements, failed): ``failed`` has bit k set if rule k fails.

    With ``carry`` there is also ``row``, the whole row as a struct, from which
    ``rows.unpacked_row`` restores the columns, whatever their names.  Words are
    runs without the six ASCII white-space characters.  A null or empty text has
    no words and fails ``few_words``; equal rows are measured alike; an empty
    table gives no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), *([packed_row(docs).alias("row")] if carry else []))
    id_type = rows.schema["doc_id"].dataType
    out = StructType([StructField("doc_id", id_type), *([rows.schema["row"]] if carry else []), *(StructField(m, LongType()) for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns = np.array([measure(t) for t in texts(batch.column(1))], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(np.ascontiguousarray(c)) for c in columns.T)], out.names)

    failed = " | ".join(f"if({rule}, {1 << k}L, 0L)" for k, (_, rule) in enumerate(RULES))
    return rows.mapInArrow(run, out).select("doc_id", *MEASURES, F.expr(failed).alias("failed"), *(["row"] if carry else []))


def store(entries: DataFrame, path: str) -> DataFrame:
    """The ledger written to ``path``, as it is read from there by every policy and ablation."""
    entries.write.parquet(path)
    return entries.sparkSession.read.parquet(path)


def apply_policy(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with ``kept`` under a policy."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """(policy, rule, n_docs, n_failing, n_only, n_kept, n_kept_without): what each rule of each policy costs.

    ``n_only`` documents fail that rule alone.  The ledger is first counted by
    its bit patterns, of which there are at most 2 ** len(RULES).
    """
    patterns = entries.groupBy("failed").count()
    policies = F.explode(F.array(*(F.struct(F.lit(name).alias("policy"), F.lit(mask).cast("long").alias("mask")) for name, mask in POLICIES.items())))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, (name, _) in enumerate(RULES))))
    grid = patterns.select("failed", "count", policies.alias("p")).select("failed", "count", "p.*", rules.alias("r")).select("failed", "count", "policy", "mask", "r.*")
    grid = grid.filter(F.col("mask").bitwiseAND(F.col("bit")) != 0)
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    n = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    return grid.groupBy("policy", "rule").agg(
        F.sum("count").alias("n_docs"),
        n(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failing"),
        n(hit == F.col("bit")).alias("n_only"),
        n(hit == 0).alias("n_kept"),
        n((hit == 0) | (hit == F.col("bit"))).alias("n_kept_without"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apply_policy(cut(ledger(table(spark, sf_dir, "documents"))))
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), (~base_failed & F.col("kept")).alias("kept"), "failed",
    )


def ablation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablation(cut(ledger(table(spark, sf_dir, "documents"))))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 9),
twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+7], ' ')) AS n FROM win),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM twice WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: length(x) > 1 AND upper(x) = x AND lower(x) <> x)) AS n_upper_words,
         len(regexp_extract_all(t, '!')) AS n_exclamations
  FROM w LEFT JOIN rep ON w.doc_id IS NOT DISTINCT FROM rep.doc_id),
n AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
f AS (
  SELECT *,
    CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_words >= 20 AND 2 * n_upper_words > n_words THEN 8 ELSE 0 END
    + CASE WHEN n_words >= 20 AND 5 * n_exclamations > n_words THEN 16 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 32 ELSE 0 END
    + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END
    + CASE WHEN n_words >= 20 AND word_chars < 2 * n_words THEN 128 ELSE 0 END AS failed
  FROM n)
"""

QUERY_SQL = SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 255) = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""

ABLATION_SQL = SQL + ", p(policy, mask) AS (VALUES " + ", ".join(f"('{n}', {m})" for n, m in POLICIES.items()) + """),
r(rule, bit) AS (VALUES """ + ", ".join(f"('{n}', {1 << k})" for k, (n, _) in enumerate(RULES)) + """)
SELECT policy, rule, count(*) AS n_docs,
       count(*) FILTER ((failed & bit) <> 0) AS n_failing,
       count(*) FILTER ((failed & mask) = bit) AS n_only,
       count(*) FILTER ((failed & mask) = 0) AS n_kept,
       count(*) FILTER ((failed & mask) IN (0, bit)) AS n_kept_without
FROM f, p, r WHERE (mask & bit) <> 0 GROUP BY policy, rule
"""
