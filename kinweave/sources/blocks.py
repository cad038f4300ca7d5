"""Large CSV and JSON files read in blocks, so that one file is the work of many tasks.

A block is what one task reads of a file: the pieces (lines, or what stands
between closing braces) from one byte on.  Whether a piece begins inside a quoted
value, and how deep it is nested, depends on all that stands before it.
So each block is first worked out for either case, the blocks of a file are then
put together by a window that has one row per block, and what they turn out to
begin with goes back to their pieces.  Results don't depend on where blocks begin.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.text import BLANK, bind

#: What a piece begins with: outside of quotes, inside, after a quote inside, at the beginning of a record.
OUT, IN, CLOSED, NEW = 0, 1, 2, 3
#: Tasks per core that list folders.
LISTERS = 4


def file_uri() -> Column:
    """The URI of the file that a row comes from, with one slash where it names no host."""
    return F.regexp_replace("_metadata.file_path", r"^([^:/]+):///", "$1:/")


@contextmanager
def listed_together(spark: SparkSession) -> Iterator[None]:
    """Within it, a reader lists the folders below its paths by a few tasks per core, and not by one task per folder."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTERS * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def pieces(spark: SparkSession, places: list[str], where: Column | None = None, end: str | None = None) -> DataFrame:
    """(uri, block, id, size, piece) of all files at the places and below: their lines, or what ``end`` ends.

    ``id`` has the order within a block; ``size`` is that of the file.  ``where`` is a
    condition on ``_metadata``, by which files are left out before they are opened.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    with listed_together(spark):
        rows = (reader.option("lineSep", end) if end else reader).text(places)
    rows = rows if where is None else rows.filter(where)
    first = F.col("_metadata.file_block_start") == 0
    rows = rows.select(file_uri().alias("uri"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("_metadata.file_size").alias("size"), first.alias("first"), "value")
    return rows.select("uri", "block", "id", "size", F.when(F.col("first") & F.col("value").startswith("﻿"), F.substr("value", F.lit(2))).otherwise(F.col("value")).alias("piece"))


# --- CSV --------------------------------------------------------------------------------------------------------------


def _after_quote(state: Column, piece: Column) -> Column:
    """The state after a piece and the quote behind it; a quote opens a value only at its beginning."""
    opens = piece.endswith(",") | ((state == NEW) & (piece == ""))
    return F.when(state == IN, CLOSED).when((state == CLOSED) & (piece == ""), IN).when(opens, IN).otherwise(OUT)


def _open_after(line: Column, begins: int) -> Column:
    """Whether a line that begins so ends inside quotes."""
    def walked(parts: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), F.lit(begins), _after_quote) == IN

    return F.when(F.contains(line, F.lit('"')), bind(F.split(line, '"'), walked)).otherwise(F.lit(begins == IN))


def fields_of(record: Column) -> Column:
    """The values of a CSV record."""
    def quoted(parts: Column) -> Column:
        def step(acc: Column, piece: Column, quote: bool) -> Column:
            escaped = (acc["state"] == CLOSED) & (piece == "") if quote else F.lit(False)
            values = F.split(piece, ",")
            several = (acc["state"] != IN) & ~escaped & (F.size(values) > 1)
            state = _after_quote(acc["state"], piece) if quote else acc["state"]
            now = F.when(several, F.element_at(values, -1)).otherwise(F.concat(acc["now"], piece))
            # A quote that neither opens nor closes is a character of the value; so is one of two in a row.
            now = F.concat(now, F.when(escaped | (state == OUT), '"').otherwise("")) if quote else now
            done = F.when(several, F.concat(acc["done"], F.array(F.concat(acc["now"], F.get(values, F.lit(0)))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 2, F.lit(0))))).otherwise(acc["done"])
            return F.struct(state.alias("state"), now.alias("now"), done.alias("done"))

        start = F.struct(F.lit(NEW).alias("state"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))
        walked = F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, lambda a, x: step(a, x, True))
        return bind(step(walked, F.element_at(parts, -1), False), lambda last: F.concat(last["done"], F.array(last["now"])))

    return F.when(F.contains(record, F.lit('"')), bind(F.split(record, '"'), quoted)).otherwise(F.split(record, ","))


def _state(last: Column, flips: Column, begin: Column) -> Column:
    """The state after rows that set it (the last one is known), flip it or leave it."""
    odd = lambda n: F.pmod(n, F.lit(2)) == 1
    return F.when(last.isNull(), begin != odd(flips)).otherwise(last["value"] != odd(flips - last["flips"]))


def _windows() -> tuple:
    """(in a block up to a piece, in a file up to a block)"""
    return W.partitionBy("uri", "block").orderBy("id"), W.partitionBy("uri").orderBy("block")


def csv_rows(lines: DataFrame, head: dict[str, Column]) -> DataFrame:
    """(uri, number, fields, and the columns of ``head``) of CSV lines as ``pieces`` gives them: records after the first, by number from 1.

    Values may be quoted and hold line breaks, wherever blocks begin.  ``head`` has
    expressions over ``header``, the values of a file's first record.  A quote
    that is never closed makes the rest of its file one record.
    """
    in_block, in_file = _windows()
    out, within = _open_after(F.col("piece"), NEW), _open_after(F.col("piece"), IN)
    marked = lines.select("uri", "block", "id", F.col("piece").alias("line"), out.alias("a"), within.alias("b"))
    marked = marked.withColumns({"sets": F.when(F.col("a") == F.col("b"), F.col("a")), "flip": (F.col("a") & ~F.col("b")).cast("long")})
    marked = marked.withColumn("flips", F.sum("flip").over(in_block))
    set_at = F.when(F.col("sets").isNotNull(), F.struct(F.col("sets").alias("value"), "flips"))
    marked = marked.withColumn("last", F.last(set_at, ignorenulls=True).over(in_block))
    for name, begin in (("out", False), ("in", True)):
        marked = marked.withColumn(f"after_{name}", _state(F.col("last"), F.col("flips"), F.lit(begin)))
        marked = marked.withColumn(f"open_{name}", F.lag(f"after_{name}", 1, begin).over(in_block))
        marked = marked.withColumn(f"n_{name}", F.sum((~F.col(f"open_{name}")).cast("long")).over(in_block))
    marked = marked.select("uri", "block", "id", "line", *(f"{k}_{name}" for k in ("after", "open", "n") for name in ("out", "in")))

    ends = F.max_by(F.struct("after_out", "after_in", "n_out", "n_in"), "id")
    first_lines = F.collect_list(F.when((F.col("block") == 0) & (F.col("n_out") == 1), F.struct("id", "line")))
    blocks = marked.groupBy("uri", "block").agg(ends.alias("e"), F.array_join(F.transform(F.sort_array(first_lines), lambda x: x["line"]), "\n").alias("head"))
    blocks = blocks.select("uri", "block", "e.*", "head")
    flip = (F.col("after_out") & ~F.col("after_in")).cast("long")
    blocks = blocks.withColumn("flips", F.sum(flip).over(in_file))
    set_at = F.when(F.col("after_out") == F.col("after_in"), F.struct(F.col("after_out").alias("value"), "flips"))
    blocks = blocks.withColumn("last", F.last(set_at, ignorenulls=True).over(in_file))
    blocks = blocks.withColumn("inside", F.lag(_state(F.col("last"), F.col("flips"), F.lit(False)), 1, False).over(in_file))
    n = F.when(F.col("inside"), F.col("n_in")).otherwise(F.col("n_out"))
    blocks = blocks.withColumns({"before": F.sum(n).over(in_file) - n, "header": fields_of(F.first("head").over(in_file))})
    blocks = blocks.select("uri", "block", "inside", "before", *(c.alias(k) for k, c in head.items()))

    of = lambda k: F.when(F.col("inside"), F.col(f"{k}_in")).otherwise(F.col(f"{k}_out"))
    numbered = marked.join(blocks, ["uri", "block"]).select("uri", "block", "id", "line", (F.col("before") + of("n")).alias("number"), (of("open") | of("after")).alias("part"), *head)
    numbered = numbered.filter("number > 1")
    alone = numbered.filter("not part").select("uri", "number", F.col("line").alias("record"), *head)
    ordered = F.sort_array(F.collect_list(F.struct("block", "id", "line")))
    joined = numbered.filter("part").groupBy("uri", "number").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("record"), *(F.first(k).alias(k) for k in head))
    records = alone.unionByName(joined).filter(F.col("record") != "")
    return records.select("uri", (F.col("number") - 1).alias("number"), fields_of(F.col("record")).alias("fields"), *head)


# --- JSON -------------------------------------------------------------------------------------------------------------


def _count(text: Column, c: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))


def _deeper(text: Column) -> Column:
    """How much deeper a text that begins outside of strings nests."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*+"', ""), '"[^"]*$', "")
    return bind(bare, lambda x: (_count(x, "{") + _count(x, "[") - _count(x, "]")).cast("long"))


def json_objects(parts: DataFrame) -> DataFrame:
    """(uri, pos, value): the objects of JSON files that hold one array, or the object of those that hold one, as texts.

    ``parts`` is what ``pieces`` gives with closing braces as ends.  Other elements
    of an array are skipped.  A file whose brackets or strings don't close, or that holds
    several texts, gives nothing.  One object is one row.
    """
    in_block, in_file = _windows()
    bare = F.regexp_replace("piece", r"(?s)\\.", "")
    marked = parts.withColumn("bare", bare)
    marked = marked.select("uri", "block", "id", "size", "piece", F.pmod(_count(F.col("bare"), '"'), F.lit(2)).alias("odd"), _deeper(F.col("bare")).alias("d_out"),
                           F.when(F.contains("bare", F.lit('"')), _deeper(F.regexp_replace("bare", '^[^"]*+"', ""))).otherwise(F.lit(0)).alias("d_in"))
    marked = marked.withColumn("flips", F.sum("odd").over(in_block))
    flipped = F.pmod(F.col("flips"), F.lit(2)) == 1
    was_flipped = F.pmod(F.col("flips") - F.col("odd"), F.lit(2)) == 1
    for name, begin in (("out", False), ("in", True)):
        inside, within = was_flipped != F.lit(begin), flipped != F.lit(begin)
        by = F.when(inside, F.col("d_in")).otherwise(F.col("d_out")) - (~within).cast("long")
        marked = marked.withColumns({f"closes_{name}": ~within, f"depth_{name}": F.sum(by).over(in_block)})
    marked = marked.select("uri", "block", "id", "size", "piece", "flips", "closes_out", "closes_in", "depth_out", "depth_in")

    said = F.ltrim(F.col("piece"), F.lit(BLANK))
    blocks = marked.groupBy("uri", "block").agg(
        F.max_by(F.struct("flips", "depth_out", "depth_in"), "id").alias("e"), F.min_by(F.left(said, F.lit(1)), "id").alias("begins"), F.max_by(F.trim("piece"), "id").alias("ends"),
        F.sum(F.octet_length("piece") + F.lit(1)).alias("bytes"), F.max("size").alias("size"), F.min_by(F.octet_length("piece"), "id").alias("n_first"))
    blocks = blocks.select("uri", "block", "e.*", "begins", "ends", "bytes", "size")
    open_before = F.pmod(F.sum("flips").over(in_file) - F.col("flips"), F.lit(2)) == 1
    blocks = blocks.withColumn("inside", open_before)
    depth = F.when(F.col("inside"), F.col("depth_in")).otherwise(F.col("depth_out"))
    whole = W.partitionBy("uri")
    blocks = blocks.withColumns({
        "before": F.sum(depth).over(in_file) - depth, "depth_all": F.sum(depth).over(whole), "flips_all": F.sum("flips").over(whole),
        "array": F.first("begins").over(in_file) == "[", "last_piece": F.max_by("ends", "block").over(whole)})
    # Only a file's last piece may lack its closing brace: of an array it is the bracket behind, which counted one too many.
    closed = F.when(F.col("array"), (F.col("depth_all") == -1) & F.col("last_piece").rlike(r"\]\s*$")).otherwise(F.col("depth_all") <= 0)
    blocks = blocks.filter(closed & (F.pmod(F.col("flips_all"), F.lit(2)) == 0)).select("uri", "block", "inside", "before", "array")

    of = lambda k: F.when(F.col("inside"), F.col(f"{k}_in")).otherwise(F.col(f"{k}_out"))
    ends = of("closes") & (F.col("before") + of("depth") == F.col("array").cast("long"))
    placed = marked.join(blocks, ["uri", "block"]).select("uri", "block", "id", "piece", "array", ends.cast("long").alias("ends"))
    placed = placed.withColumn("n", F.sum("ends").over(in_block))
    counts = placed.groupBy("uri", "block").agg(F.max("n").alias("of_block"))
    counts = counts.select("uri", "block", (F.sum("of_block").over(in_file) - F.col("of_block")).alias("earlier"))
    numbered = placed.join(counts, ["uri", "block"]).withColumn("pos", F.col("earlier") + F.col("n") - F.col("ends"))
    ordered = F.sort_array(F.collect_list(F.struct("block", "id", "piece")))
    text = F.concat(F.array_join(F.transform(ordered, lambda x: x["piece"]), "}"), F.lit("}"))
    found = numbered.groupBy("uri", "array", "pos").agg(text.alias("text"), F.max("ends").alias("whole")).filter("whole = 1")
    # What stands before an object of an array: its opening bracket or a comma, and elements that are no objects.
    listed = F.from_json(F.concat(F.lit("["), F.regexp_replace("text", r"^\s*[\[,]", ""), F.lit("]")), "array<string>")
    one = found.filter("array").select("uri", "pos", F.element_at(listed, -1).alias("value"))
    lone = found.filter("not array").groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", "pos").alias("value")).filter("n = 1")
    every = one.union(lone.select("uri", F.lit(0).cast("long"), "value"))
    return every.select("uri", "pos", F.ltrim("value", F.lit(BLANK)).alias("value")).filter(F.startswith("value", F.lit("{")))
