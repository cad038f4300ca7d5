"""Conversation structure repair (operator 12).

A conversation is repaired by keeping, deleting and rerolling its rows and by
inserting empty ones, so that the initials of its roles read ``(s?(ua)+)?``.
The edits are paths through a lattice: a node is a place between two rows and a
state of that pattern, an edge is an edit with its cost and its letter.  A
bidirectional Dijkstra search runs from both ends.  It goes on until the two
heaps can't give anything as cheap as the best path that is known, so that all
crossings of least cost are found; of these the path with the least letters is
taken.

Nearly all conversations are short: one task has all rows of many of them.  One
of over ``LONG_ROWS`` rows is never held whole: its rows are sorted by range,
so many tasks share it, and cut into blocks; each block is searched for every
pair of states at its two ends, and the cheapest chain of blocks is the cheapest
path.  What is then left for one task is the digest of the repaired
conversation, which is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.rows import quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States of the pattern: nothing yet, after a system row, after a user row, after an assistant row (a turn pair is whole).
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: What may follow, by initial; a user row follows everything but a user row.
NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: The state after a rerolled or inserted row, and its role: only one of user and assistant can follow.
FILL = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
#: Rows of a conversation that one task takes whole, and of a block of a longer one.
LONG_ROWS = 4096
BLOCK_ROWS = 256
#: Conversations with more than one in so many of all rows are told apart before rows are dealt by conversation: fewer than so many.
MOST_HUBS = 10_000
BLANK = " \t\n\v\f\r"


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, conv_id, turn, role, text, copies): the rows with faults put in by crc32(``conv_id:turn``) % 20; nulls are one space, ``c`` is never null.

    0 drops a row (no copies), 1 empties its text, 2 removes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    rows = turns.select(
        F.coalesce(F.concat(F.lit("="), quoted(conv_col).cast("string")), F.lit("")).alias("c"), quoted(conv_col).alias("conv_id"), quoted(turn_col).cast("long").alias("turn"),
        said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "c", "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def _last(text: Column) -> Column:
    """The last character that is no white space; empty for a blank text."""
    return F.right(F.rtrim(text, F.lit(BLANK)), F.lit(1))


def with_signs(rows: DataFrame) -> DataFrame:
    """``sign`` of each row but for repetition: ``b`` blank, ``t`` truncated, else ``f``."""
    last = _last(F.col("text"))
    return rows.withColumn("sign", F.when(last == "", "b").when(last.isin(".", "!", "?"), "f").otherwise("t"))


#: A step of the lattice: how many rows that must go, or one row with its initial and whether it is truncated.
Step = tuple[int, str, bool]


@lru_cache(maxsize=1 << 15)
def cheapest(steps: tuple[Step, ...], entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest path from state ``entry`` before the first step to one of ``exits`` after the last; of equal cost the least audit.

    Null if no path leads there.
    """
    n = len(steps)

    def onward(i: int, state: int) -> list[tuple[int, str, int, int]]:
        """(cost, letters, place, state) of the edges out of a node."""
        out = [(INSERT, "I", i, FILL[state])]
        if i < n:
            gone, initial, cut_off = steps[i]
            if gone:
                out.append((DELETE * gone, "D" * gone, i + 1, state))
            else:
                more = TRUNCATED if cut_off else 0
                out += [(DELETE, "D", i + 1, state), (REROLE + more, "R", i + 1, FILL[state])]
                if initial in NEXT[state]:
                    out.append((more, "K", i + 1, NEXT[state][initial]))
        return out

    def back(i: int, state: int) -> list[tuple[int, str, int, int]]:
        """(cost, letters, place, state) of the edges into a node."""
        return [(cost, letters, a, s) for a in (i, i - 1) if a >= 0 for s in range(4) for cost, letters, b, t in onward(a, s) if (b, t) == (i, state)]

    # Edges that cost nothing go on by a row, so of equal costs the earlier node (backwards: the later) is settled first, and its letters are final.
    best = [{(0, entry): (0, "")}, {(n, s): (0, "") for s in exits}]
    heaps = [[(0, 0, entry)], [(0, -n, s) for s in exits]]
    settled: list[set[tuple[int, int]]] = [set(), set()]
    known = None  # the least cost of a whole path so far
    if n == 0 and entry in exits:
        known = 0
    while heaps[0] and heaps[1] and (known is None or heaps[0][0][0] + heaps[1][0][0] <= known):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, i, state = heappop(heaps[side])
        node = (abs(i), state)
        if node in settled[side]:
            continue
        settled[side].add(node)
        letters = best[side][node][1]
        for more, own, j, s in (onward if side == 0 else back)(*node):
            told = (cost + more, letters + own if side == 0 else own + letters)
            if (j, s) not in best[side] or told < best[side][j, s]:
                best[side][j, s] = told
                heappush(heaps[side], (told[0], j if side == 0 else -j, s))
            if (j, s) in best[1 - side]:
                whole = told[0] + best[1 - side][j, s][0]
                known = whole if known is None else min(known, whole)
    if known is None:
        return None
    # Every path of least cost has an edge from a node that is final forwards to one that is final backwards; both ends of the lattice are.
    found = [""] if n == 0 and entry in exits else []
    ahead = settled[1] | {(n, s) for s in exits}
    for node in settled[0] | {(0, entry)}:
        cost, letters = best[0][node]
        for more, own, j, s in onward(*node):
            if (j, s) in ahead and cost + more + best[1][j, s][0] == known:
                found.append(letters + own + best[1][j, s][1])
    return known, min(found)


def steps_of(rows: list[tuple[str, str, int]]) -> tuple[Step, ...]:
    """The lattice of (initial, sign, rows) in order; rows that must go side by side are one step, as nothing is best put between them."""
    out: list[Step] = []
    for initial, sign, n in rows:
        if sign in "bd":
            if out and out[-1][0]:
                out[-1] = (out[-1][0] + n, "", False)
            else:
                out.append((n, "", False))
        else:
            out.append((0, initial, sign == "t"))
    return tuple(out)


def repaired(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[str]:
    """The lines ``role:text`` that the edits make of rows (role, text), from a state of the pattern on."""
    for letter in audit:
        if letter == "I":
            state = FILL[state]
            yield f"{ROLE[state]}:"
            continue
        role, text = next(rows)
        if letter == "K":
            state = NEXT[state][role[0]]
            yield f"{role}:{text}"
        elif letter == "R":
            state = FILL[state]
            yield f"{ROLE[state]}:{text}"


def end_state(audit: str, initials: list[str], state: int) -> int:
    """The state after the edits."""
    rows = iter(initials)
    for letter in audit:
        if letter == "I":
            state = FILL[state]
        else:
            initial = next(rows)
            state = state if letter == "D" else FILL[state] if letter == "R" else NEXT[state][initial]
    return state


def initial_of(role: str) -> str:
    return role[:1] or " "  # an empty role fits nowhere


def illegal(initials: Iterator[tuple[str, int]], before: str = "") -> int:
    """Adjacent initials that may not follow each other, among (initial, rows)."""
    found = 0
    for initial, n in initials:
        found += n - 1 + (before != "" and before + initial not in LEGAL)
        before = initial
    return found


_DONE = "c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ROW = "turn long, role string, text string, copies int, sign string"


def _whole(long_rows: int):
    """Short conversations in one go; the rows of a longer one are passed on as they come."""
    def one(c: str, rows: list[tuple]) -> tuple:
        seen, told, lines = set(), [], []
        counts = {"b": 0, "d": 0, "t": 0, "f": 0}
        for _, role, text, copies, sign in rows:
            if sign != "b" and (role, text) in seen:
                sign = "d"
            seen.add((role, text))
            told.append((initial_of(role), sign, 1))
            if copies > 1:
                told.append((initial_of(role), "b" if sign == "b" else "d", copies - 1))
            lines += [(role, text)] * copies
            counts[sign] += 1
            counts["b" if sign == "b" else "d"] += copies - 1
        cost, audit = cheapest(steps_of(told), START, ENDS)
        digest = hashlib.sha256("\n".join(repaired(audit, iter(lines))).encode("utf-8", "surrogatepass")).hexdigest()
        return c, counts["b"], counts["d"], counts["t"], illegal((x, n) for x, _, n in told), cost, audit, digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held, passing = None, [], False  # rows of the conversation that the rows so far end with
        schema = pa.schema([("c", pa.string()), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string()),
                            ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int32()), ("sign", pa.string())])

        def table_of(done: list[tuple], rest: list[tuple]) -> pa.RecordBatch:
            every = [(*x, *(None,) * 5) for x in done] + [(x[0], *(None,) * 7, *x[1:]) for x in rest]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in every], kind.type) for k, kind in enumerate(schema)], schema=schema)

        for batch in batches:
            done, rest = [], []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if row[0] != c:
                    if held:
                        done.append(one(c, held))
                    c, held, passing = row[0], [], False
                if passing:
                    rest.append(row)
                    continue
                held.append(row[1:])
                if len(held) > long_rows:
                    rest += [(c, *x) for x in held]
                    held, passing = [], True
            if done or rest:
                yield table_of(done, rest)
        if held:
            yield table_of([one(c, held)], [])

    return run


def _long(rows: DataFrame, block_rows: int) -> DataFrame:
    """The same results for conversations of any length; ``rows`` is (c, turn, role, text, copies, sign), as often as they occur."""
    key = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    # Rows that are equal in everything are one row with a count, so no row is a hot key; one that says the same as an earlier turn is a repetition.
    counted = cut(rows.groupBy("c", "turn", "role", "text", "sign").agg(F.sum("copies").alias("n")).withColumn("key", key))
    when = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    firsts = counted.groupBy("c", "key").agg(F.min(when).alias("first"))
    again = when > F.col("first")
    signed = counted.join(firsts, ["c", "key"]).select("c", "turn", "role", "text", "n", F.when((F.col("sign") != "b") & again, "d").otherwise(F.col("sign")).alias("sign"))
    order = ["c", "turn", "role", "text"]
    sorted_rows = signed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks within a partition: a new one with each conversation and after ``block_rows`` rows."""
        c, block, k = None, -1, 0
        for batch in batches:
            blocks, places = [], []
            for other in batch.column("c").to_pylist():
                if other != c or k == block_rows:
                    c, block, k = other, block + 1, 0
                blocks.append(block)
                places.append(k)
                k += 1
            names = ["c", "role", "text", "n", "sign", "part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(blocks, pa.int64()), pa.array(places, pa.int32())], [*names, "block", "k"])

    placed = cut(sorted_rows.select("c", "role", "text", "n", "sign", "part").mapInArrow(number, "c string, role string, text string, n long, sign string, part int, block long, k int"))
    initial = F.when(F.col("role") == "", " ").otherwise(F.left("role", F.lit(1)))
    thin = F.sort_array(F.collect_list(F.struct("k", initial.alias("initial"), "sign", "n")))
    blocks = placed.groupBy("c", "part", "block").agg(thin.alias("rows"))

    def told(rows: list[dict]) -> list[tuple[str, str, int]]:
        out = []
        for r in rows:
            out.append((r["initial"], r["sign"], 1))
            if r["n"] > 1:
                out.append((r["initial"], "b" if r["sign"] == "b" else "d", r["n"] - 1))
        return out

    def options(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cheapest path of each block for every state before and after it."""
        for batch in batches:
            for c, part, block, rows in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                each = told(rows)
                steps = steps_of(each)
                found = [(s, t, *best) for s in range(4) for t in range(4) if (best := cheapest(steps, s, (t,)))]
                count = lambda x: sum(n for _, sign, n in each if sign == x)  # noqa: B023, E731
                yield pa.RecordBatch.from_pylist([{
                    "c": c, "part": part, "block": block, "ways": [{"s": s, "t": t, "cost": cost, "audit": audit} for s, t, cost, audit in found],
                    "blank": count("b"), "duplicate": count("d"), "truncated": count("t"), "illegal": illegal((x, n) for x, _, n in each), "left": each[0][0], "right": each[-1][0]}], ways)

    way = pa.struct([("s", pa.int32()), ("t", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    ways = pa.schema([("c", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("ways", pa.list_(way)), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")), ("left", pa.string()), ("right", pa.string())])
    searched = cut(blocks.mapInArrow(options, "c string, part int, block long, ways array<struct<s:int,t:int,cost:long,audit:string>>, blank long, duplicate long, truncated long, illegal long, left string, right string"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cheapest chain of each conversation's blocks: its audit, which edits fall to which block, and the counts.

        What is held is four audits (a character per row) and a state per block.
        """
        schema = pa.schema([("c", pa.string()), *((k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32()), ("edits", pa.string())])
        c, best, counts, last, places, cameby = None, {}, [0] * 4, "", [], []

        def closed() -> Iterator[pa.RecordBatch]:
            cost, audit, state = min((*best[s], s) for s in ENDS if s in best)
            whole = [{"c": c, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "audit": audit}]
            own, end = [], len(audit)
            for (part, block), steps in zip(reversed(places), reversed(cameby), strict=True):
                state, size = steps[state]
                own.append({"c": c, "part": part, "block": block, "entry": state, "edits": audit[end - size : end]})
                end -= size
            yield pa.RecordBatch.from_pylist(whole, schema)
            for k in range(0, len(own), 4096):
                yield pa.RecordBatch.from_pylist(own[k : k + 4096], schema)

        for batch in batches:
            for other, part, block, options, *more, left, right in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if other != c:
                    if c is not None:
                        yield from closed()
                    c, best, counts, last, places, cameby = other, {START: (0, "")}, [0] * 4, "", [], []
                counts = [a + b for a, b in zip(counts, more, strict=True)]
                counts[3] += last != "" and last + left not in LEGAL
                last, now, steps = right, {}, {}
                for x in options:
                    if x["s"] in best:
                        cost, audit = best[x["s"]]
                        one = (cost + x["cost"], audit + x["audit"])
                        if x["t"] not in now or one < now[x["t"]]:
                            now[x["t"]], steps[x["t"]] = one, (x["s"], len(x["audit"]))
                best = now
                places.append((part, block))
                cameby.append(steps)
        if c is not None:
            yield from closed()

    ordered = searched.repartition("c").sortWithinPartitions("c", "part", "block")
    chained = cut(ordered.mapInArrow(chain, "c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, part int, block long, entry int, edits string"))
    edits = chained.filter("edits is not null").select("c", "part", "block", "entry", "edits")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The digest of each conversation, over its rows as they come; a block's rows are held at a time."""
        c, hashed, first, block, held = None, hashlib.sha256(), True, None, []

        def finish() -> None:
            nonlocal first
            if not held:
                return
            entry, letters = held[0][1], held[0][2]
            rows = ((role, text) for role, text, n in (x[3:] for x in held) for _ in range(n))
            for line in repaired(letters, rows, entry):
                hashed.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
                first = False
            held.clear()

        for batch in batches:
            out = []
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (row[0], row[1], row[2]) != (c, *(block or (None, None))):
                    finish()
                    if row[0] != c:
                        if c is not None:
                            out.append({"c": c, "repaired_sha256": hashed.hexdigest()})
                        c, hashed, first = row[0], hashlib.sha256(), True
                    block = (row[1], row[2])
                held.append((None, *row[3:]))
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())]))
        finish()
        if c is not None:
            yield pa.RecordBatch.from_pylist([{"c": c, "repaired_sha256": hashed.hexdigest()}], pa.schema([("c", pa.string()), ("repaired_sha256", pa.string())]))

    lines = placed.join(edits, ["c", "part", "block"]).select("c", "part", "block", "k", "entry", "edits", "role", "text", "n")
    lines = lines.repartition("c").sortWithinPartitions("c", "part", "block", "k").select("c", "part", "block", "entry", "edits", "role", "text", "n")
    digests = lines.mapInArrow(digest, "c string, repaired_sha256 string")
    return chained.filter("edits is null").drop("part", "block", "entry", "edits").join(digests, "c")


def repair(turns: DataFrame, rows: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", long_rows: int = LONG_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row per conversation of ``turns``.

    ``rows`` is what is repaired, as ``damaged`` gives it (its default).  Rows
    go by turn, a null turn first, then by role and text.  ``audit`` has a letter
    per edit: Keep, Rerole, Delete, Insert.  A blank text is a fault, then one
    whose role and text an earlier row has, then one that does not end in a
    full stop, exclamation or question mark.

    Null ids are one conversation; a null role or text is one space, so it fits
    nowhere or is blank; an empty role fits nowhere; repeated rows are
    repetitions.  A conversation none of whose rows are left has zeros, an empty
    audit and the digest of an empty text.  Very long texts are handled like any other; other columns are
    ignored; an empty table gives no rows.
    """
    rows = damaged(turns, conv_col, turn_col) if rows is None else rows
    rows = with_signs(rows.filter("copies > 0")).select("c", "turn", "role", "text", "copies", "sign")
    ids = turns.select(F.coalesce(F.concat(F.lit("="), quoted(conv_col).cast("string")), F.lit("")).alias("c"), quoted(conv_col).alias("conv_id")).distinct()
    per_turn = rows.groupBy("c", "turn").count()
    span = F.max("turn") - F.min("turn") + F.lit(1) - F.count("turn")
    sizes = cut(per_turn.groupBy("c").agg(F.coalesce(span, F.lit(0)).alias("gaps"), F.sum("count").alias("n")))
    bound = max(long_rows, (sizes.agg(F.sum("n")).first()[0] or 0) // MOST_HUBS)
    hubs = sizes.filter(F.col("n") > bound).select("c")  # fewer than MOST_HUBS
    short = rows.join(F.broadcast(hubs), "c", "left_anti").repartition("c").sortWithinPartitions("c", "turn", "role", "text")
    met = cut(short.mapInArrow(_whole(long_rows), f"{_DONE}, {_ROW}"))
    done = met.filter("audit is not null").select(*_names(_DONE))
    rest = met.filter("audit is null").select("c", *_names(_ROW))
    every = rest.union(rows.join(F.broadcast(hubs), "c", "left_semi"))
    if not (rest.isEmpty() and hubs.isEmpty()):
        done = done.union(_long(every, block_rows).select(*_names(_DONE)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256(b"").hexdigest()
    return ids.join(sizes.select("c", "gaps"), "c", "left").join(done, "c", "left").select(
        "conv_id", zero("gaps"), *(zero(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH RECURSIVE
bits AS (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS v FROM range(256) r(i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM named, crc),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) copies(k) WHERE kind <> 0 AND (k = 0 OR kind = 3)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS last
  FROM rows),
signed AS (
  SELECT *, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial,
         CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS sign
  FROM numbered),
beside AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS two FROM signed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (sign = 'b') AS blank, count(*) FILTER (sign = 'd') AS duplicate,
         count(*) FILTER (sign = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM beside GROUP BY conv_id),
-- States: 0 nothing yet, 1 after s, 2 after u, 3 after a; an edit of one row with up to two rows put in before it.
fill AS (SELECT * FROM (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')) f(s, t, role)),
kept AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) f(s, initial, t)),
put_in AS (
  SELECT s, s AS t, 0 AS cost, '' AS letters, []::VARCHAR[] AS lines FROM range(4) r(s)
  UNION ALL SELECT s, t, 3, 'I', [role || ':'] FROM fill
  UNION ALL SELECT a.s, b.t, 6, 'II', [a.role || ':', b.role || ':'] FROM fill a JOIN fill b ON a.t = b.s),
edit AS (
  SELECT conv_id, k, s, s AS t, 4 AS cost, 'D' AS letter, []::VARCHAR[] AS lines FROM signed, range(4) r(s)
  UNION ALL SELECT conv_id, k, s, t, CASE sign WHEN 't' THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM signed JOIN kept USING (initial) WHERE sign IN ('t', 'f')
  UNION ALL SELECT conv_id, k, s, t, CASE sign WHEN 't' THEN 6 ELSE 3 END, 'R', [f.role || ':' || text] FROM signed, fill f WHERE sign IN ('t', 'f')),
step AS (
  SELECT conv_id, k, p.s, e.t, p.cost + e.cost AS cost, p.letters || e.letter AS letters, list_concat(p.lines, e.lines) AS lines
  FROM edit e JOIN put_in p ON p.t = e.s),
path AS (
  SELECT conv_id, 0::BIGINT AS k, 0::BIGINT AS t, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM counts
  UNION ALL
  SELECT conv_id, k, t, b.cost, b.audit, b.lines FROM (
    SELECT p.conv_id, e.k, e.t, min({'cost': p.cost + e.cost, 'audit': p.audit || e.letters, 'lines': list_concat(p.lines, e.lines)}) AS b
    FROM path p JOIN step e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.k = p.k + 1 AND e.s = p.t GROUP BY p.conv_id, e.k, e.t)),
ended AS (
  SELECT p.conv_id, min({'cost': p.cost + i.cost, 'audit': p.audit || i.letters, 'lines': list_concat(p.lines, i.lines)}) AS b
  FROM path p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.k JOIN put_in i ON i.s = p.t WHERE i.t IN (0, 3) GROUP BY p.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
       sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
"""
