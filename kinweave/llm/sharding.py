"""Sharding by proportional stratified interleaving (operator 2).

Every source is a stratum.  Its rows are put in a seeded random order, and a
row of rank r among n gets the fraction (r + 1/2) / n.  All rows sorted by that
fraction interleave the strata in proportion, so any contiguous cut of the
order has the mixture of the whole; the order is cut into shards whose row
counts differ by one at most (the law ``rows``).

No window ever holds a stratum: ranks come from the counts of hash buckets
within the stratum plus the rank within a bucket, and global positions from
the counts of fraction buckets plus the rank within one.  A hot source is thus
spread over many groups, whose number follows the number of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.rows import quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table


def stratified_shards(
    docs: DataFrame,
    shards: int = 16,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    source_buckets: int = 512,
    order_buckets: int = 8192,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """(id, source, size, text_crc32, fraction, shard, slot), one row per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus one.  Slots are gapless from 0
    in each shard and follow the interleaved order.  A null text counts as
    empty, null sources are one stratum, equal rows get slots of their own,
    other columns are ignored, an empty table gives no rows.

    There are ``source_buckets`` per source and ``order_buckets`` of the order
    at least, and so many more that one holds about ``bucket_rows`` rows.  The
    one table that is summed up in a single task has a count per bucket of the
    order.
    """
    body = F.coalesce(quoted(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        quoted(id_col).alias("id"),
        quoted(source_col).alias("source"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = rows.withColumns({
        "stratum": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "h": F.xxhash64(F.lit(seed), F.col("id").cast("string"), "text_crc32"),
    })
    rows = cut(rows)  # thin rows, read several times below; the texts are read once
    least = -(-rows.count() // bucket_rows)
    source_buckets, order_buckets = max(source_buckets, least), max(order_buckets, least)
    rows = rows.withColumn("b", F.pmod("h", F.lit(source_buckets)).cast("int"))
    counts = rows.groupBy("stratum", "b").count()
    up_to = W.partitionBy("stratum").orderBy("b")
    starts = counts.select(
        "stratum", "b",
        (F.sum("count").over(up_to) - F.col("count")).alias("before"),
        F.sum("count").over(W.partitionBy("stratum")).alias("total"),
    )
    within = W.partitionBy("stratum", "b").orderBy("h", "id", "size")
    ranked = rows.withColumn("r", F.row_number().over(within) - 1).join(starts, ["stratum", "b"])
    ranked = ranked.withColumn("fraction", (F.col("before") + F.col("r") + F.lit(0.5)) / F.col("total"))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("fraction") * order_buckets), F.lit(order_buckets - 1)).cast("int"))
    ranked = ranked.select("id", "source", "size", "text_crc32", "stratum", "h", "fraction", "g")

    steps = ranked.groupBy("g").count()
    firsts = steps.select(
        "g",
        (F.sum("count").over(W.orderBy("g")) - F.col("count")).alias("first"),
        F.sum("count").over(W.partitionBy()).alias("rows"),
    )
    order = W.partitionBy("g").orderBy("fraction", F.xxhash64("stratum"), "h", "id", "size")
    placed = ranked.withColumn("at", F.row_number().over(order) - 1).join(firsts, "g")
    placed = placed.withColumn("at", F.col("first") + F.col("at"))
    # Shard s starts at floor(s * rows / shards), in whole numbers.
    placed = placed.withColumn("s", F.expr(f"(at * {shards}L + {shards}L - 1L) div rows"))
    placed = placed.withColumn("s", F.expr(f"if((s * rows) div {shards}L > at, s - 1, s)"))
    return placed.select(
        "id", "source", "size", "text_crc32", "fraction",
        F.col("s").cast("int").alias("shard"),
        F.expr(f"at - (s * rows) div {shards}L").alias("slot"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = stratified_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source", "fraction",
    )
