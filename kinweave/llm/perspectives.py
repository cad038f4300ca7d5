"""Multi-party perspective rotation of chats (operator 5), in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.rows import quoted
from kinweave.operators.positions import with_positions
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _plain(c: Column) -> Column:
    """Text in which no control marker can be read."""
    return F.replace(c, F.lit("<|"), F.lit("<\\|"))


def _name(c: Column) -> Column:
    """A name on one line."""
    return F.replace(F.replace(_plain(c), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def _in_parts(said: DataFrame, part_turns: int, part_rows: int) -> DataFrame:
    """``said`` with ``part``, a struct in whose order the parts of a conversation follow each other.

    A part has the rows of ``part_turns`` turn numbers; of more than
    ``part_rows`` rows there it is cut after each ``part_rows`` in their order.  The places of
    rows in so large a block are counted by many tasks (see ``with_positions``).
    """
    said = said.withColumn("block", F.expr(f"(turn - pmod(turn, {int(part_turns)}L)) div {int(part_turns)}L"))
    whole = F.struct("block", F.lit(0).cast("long").alias("piece"))
    in_block = F.struct("c", "block")  # in structs nulls are equal
    large = cut(said.groupBy(in_block.alias("in_block")).count().filter(F.col("count") > part_rows).select("in_block"))
    if large.isEmpty():
        return said.withColumn("part", whole).drop("block")
    said = said.withColumn("in_block", in_block)
    rest = said.join(large, "in_block", "left_anti").withColumn("part", whole)
    crowded = with_positions(said.join(large, "in_block", "left_semi"), ["c", "block", "turn", "who", "text"], "_at")
    firsts = crowded.groupBy("in_block").agg(F.min("_at").alias("_first"))
    piece = F.expr(f"(_at - _first) div {int(part_rows)}L")
    crowded = crowded.join(firsts, "in_block").withColumn("part", F.struct("block", piece.alias("piece"))).drop("_at", "_first")
    return rest.unionByName(crowded).drop("block", "in_block")


def perspectives(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    fixed_roles: tuple[str, ...] = ("system",),
    part_turns: int = 512,
    part_rows: int = 4096,
) -> DataFrame:
    """(conv_id, perspective, part, n_turns, n_own, start, text, mask): every dialogue as each participant sees it.

    A participant is a role of the conversation that is not in ``fixed_roles``.
    In the perspective of p the turns of p are the assistant's, the turns of
    anyone else are a user's who is named after their role, and fixed roles
    keep their own.  ``mask`` lists the spans ``start-end`` (code points, end
    exclusive) of what the assistant says: the text to train on.

    Turns are ordered by (turn, role, text), a null turn first.  The texts of a
    dialogue's parts, joined in the order of ``part`` (from 0), are the whole
    dialogue; ``start`` and the spans count from its beginning, whatever the
    part.  Nearly all dialogues have one part: it takes more than
    ``part_turns`` turn numbers, or more than ``part_rows`` rows in as many, to
    have more, so no row grows with the length of a dialogue.

    A null role is a participant of its own, whose ``perspective`` is null and
    who is named ``unknown``; a null text is empty; repeated rows are kept.
    Turns without a conversation id are one conversation.  A conversation of
    fixed roles alone has no participant and gives no row; an empty table gives
    none; other columns are ignored.  Control markers in texts and names are
    broken up by a backslash, and line breaks in names are written as such.
    """
    role = quoted(role_col)
    said = turns.select(
        F.coalesce(F.concat(F.lit("="), quoted(conv_col).cast("string")), F.lit("")).alias("c"),
        quoted(conv_col).alias("conv_id"),
        quoted(turn_col).cast("long").alias("turn"),
        F.coalesce(F.concat(F.lit("="), role), F.lit("")).alias("who"),
        _plain(F.coalesce(quoted(text_col), F.lit(""))).alias("text"),
    )
    said = _in_parts(said, part_turns, part_rows)
    is_fixed = lambda who: who.isin(*(f"={x}" for x in fixed_roles)) if fixed_roles else F.lit(False)
    name = lambda who: F.when(who == "", F.lit("unknown")).otherwise(_name(F.substr(who, F.lit(2))))
    parts = said.groupBy("c", "conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "who", "text"))).alias("turns"))
    people = said.filter(~is_fixed(F.col("who"))).groupBy("c").agg(F.collect_set("who").alias("people"))
    seen = parts.join(people, "c").withColumn("me", F.explode("people"))

    def head(x: Column) -> Column:
        return (
            F.when(is_fixed(x["who"]), F.concat(F.lit(OPEN), name(x["who"]), F.lit("\n")))
            .when(x["who"] == F.col("me"), F.lit(f"{OPEN}assistant\n"))
            .otherwise(F.concat(F.lit(f"{OPEN}user name="), name(x["who"]), F.lit("\n")))
        )

    said_as = F.transform("turns", lambda x: F.struct(head(x).alias("head"), x["text"].alias("body"), (x["who"] == F.col("me")).alias("own")))
    seen = seen.select("c", "conv_id", "part", "me", said_as.alias("said"))
    # Where parts start: from their lengths alone, without their texts.
    size = F.aggregate("said", F.lit(0).cast("long"), lambda n, x: n + F.length(x["head"]) + F.length(x["body"]) + F.lit(len(CLOSE)))
    sizes = seen.select("c", "part", "me", size.alias("size"))
    order = W.partitionBy("c", "me").orderBy("part")
    starts = sizes.select("c", "part", "me", (F.row_number().over(order) - 1).cast("long").alias("number"), (F.sum("size").over(order) - F.col("size")).alias("start"))
    # Structs are equal if their fields are, nulls too.
    seen = seen.join(starts, ["c", "me", "part"]).select("conv_id", "me", "number", "start", "said")
    rendered = F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat(F.when(state["mask"] == "", "").otherwise(","), start.cast("string"), F.lit("-"), end.cast("string"))
        return F.struct((end + F.lit(len(CLOSE))).alias("at"), F.when(x["own"], F.concat(state["mask"], span)).otherwise(state["mask"]).alias("mask"))

    mask = F.aggregate("said", F.struct(F.col("start").alias("at"), F.lit("").alias("mask")), step)["mask"]
    return seen.select(
        "conv_id", F.when(F.col("me") != "", F.substr("me", F.lit(2))).alias("perspective"), F.col("number").alias("part"),
        F.size("said").cast("long").alias("n_turns"),
        F.size(F.filter("said", lambda x: x["own"])).cast("long").alias("n_own"),
        "start", rendered.alias("text"), mask.alias("mask"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce('=' || role, '') AS who, replace(coalesce(text, ''), '<|', '<\|') AS body,
         (turn - ((turn % 512) + 512) % 512) // 512 AS block,
         replace(replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), chr(10), '\n'), chr(13), '\r') AS name
  FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS me FROM said WHERE who <> '=system'),
parts AS (
  SELECT s.conv_id, p.me, s.block, s.turn, s.who, s.body,
         CASE WHEN s.who = '=system' THEN '<|im_start|>' || s.name || chr(10)
              WHEN s.who = p.me THEN '<|im_start|>assistant' || chr(10)
              ELSE '<|im_start|>user name=' || s.name || chr(10) END AS head
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
cut_up AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, me, block ORDER BY turn NULLS FIRST, who, body) - 1) // 4096 AS piece FROM parts),
placed AS (
  SELECT *, sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, me ORDER BY turn NULLS FIRST, who, body ROWS UNBOUNDED PRECEDING) - 11 AS body_end,
         dense_rank() OVER (PARTITION BY conv_id, me ORDER BY block NULLS FIRST, piece) - 1 AS part
  FROM cut_up)
SELECT conv_id, CASE WHEN me <> '' THEN substr(me, 2) END AS perspective, CAST(part AS BIGINT) AS part,
       count(*) AS n_turns, count(*) FILTER (who = me) AS n_own,
       CAST(min(body_end - length(body) - length(head)) AS BIGINT) AS start,
       string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, who, body) AS text,
       coalesce(string_agg(CAST(body_end - length(body) AS VARCHAR) || '-' || CAST(body_end AS VARCHAR), ',' ORDER BY turn NULLS FIRST, who, body) FILTER (who = me), '') AS mask
FROM placed GROUP BY conv_id, me, part
"""
