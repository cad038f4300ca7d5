"""Line dedup by a log-template tree (operator 4).

A line is parsed down a tree of fixed depth: its token count, then its first
``depth`` tokens, in which a token with a digit is the variable ``<*>``.  In a
leaf, a token is a constant of its position if at least ``min_docs`` documents'
lines of the leaf have it there; anything else is a variable.  A line's template
is its leaf with its constants in place.  A line has a second, wider template, in
which a constant also has to hold a share ``common`` of the leaf's documents: a
field with many values stays variable there however large the input, while the
narrow one finds fixed lines in leaves of many templates.  Templates that
``min_docs`` documents share and of which a share ``constant`` is constant are
recurring; their lines are dropped, but for the first document that has them.
(Lines of one narrow template are lines of one wide template, so the first
document of a wide one is also first in the narrow one.)

Short lines, of fewer than ``min_tokens`` tokens, and long ones, of more than
LONG_TOKENS, also count as they are (long ones with tokens with digits as
variables): short ones are recurring if ``short_docs`` documents have them, long
ones if ``long_docs`` do.

Everything is a count by key (leaf; leaf, position and token; template), which
Spark adds up before it shuffles, so a leaf or template that a third of all
lines share is no burden to a task.  Lines meet the leaves and templates that hold
more than one in FREQUENT_LINES of them by broadcast, tokens the constants that hold more than
one in FREQUENT, so no key that is left to a shuffled join holds more, however
large the input.  Only lines of leaves with enough documents are looked at
closely.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices, texts
from kinweave.llm.rows import packed_row, quoted, unpacked_row
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

MIN_DOCS = 5
MIN_TOKENS = 4
DEPTH = 3
CONSTANT = 0.7
COMMON = 0.1
#: Share of the words of both texts by which the pipeline takes a text as a copy of another.
COPY = 0.8
#: Lines of fewer tokens than a template's are taken as they are, if this many documents have them.
SHORT_DOCS = 25
#: Lines of more than LONG_TOKENS are recurring from LONG_DOCS documents on.
LONG_TOKENS = 50
LONG_DOCS = 2
#: Fewer leaves, or templates, than twice these are broadcast: a hash or two and the first document, 128 bytes at most each.
FREQUENT_LINES = 1 << 15
#: Fewer constants than these are broadcast: a hash and a flag, 32 bytes at most each in a join's table.
FREQUENT = 1 << 17
#: How a line is kept in one number beside its leaf: words of the text, number of the line, how it counts, and whether it is the text's first of its kind.
LINE_BITS, WORD_BITS, KINDS = 31, 28, ("leaf", "short", "long")
_DIGITS = frozenset(b"0123456789")
VARIABLE = b"<*>"


def masked(tokens: list[bytes]) -> list[bytes]:
    """Tokens with a digit as variables."""
    return [t if _DIGITS.isdisjoint(t) else VARIABLE for t in tokens]


def leaf_of(tokens: list[bytes], depth: int) -> int:
    """The leaf of a line: a hash of the token count and the leading tokens."""
    return xxhash.xxh3_64_intdigest(b"%d " % len(tokens) + b" ".join(masked(tokens[:depth]))) - (1 << 63)


def kinds_of(n: int, min_tokens: int, short_docs: int | None, long_docs: int | None) -> tuple[int, ...]:
    """How a line of n tokens counts, as places in KINDS: in its leaf, and as it is if it is short or long."""
    if n >= min_tokens:
        return (0, 2) if long_docs and n > LONG_TOKENS else (0,)
    return (1,) if n and short_docs else ()


def line_hash(tokens: list[bytes], depth: int, kind: int) -> int:
    """The leaf of a line, or the hash of the line as it is (tokens with digits of a long one as variables)."""
    if kind == 0:
        return leaf_of(tokens, depth)
    return xxhash.xxh3_64_intdigest(b"long " + b" ".join(masked(tokens)) if kind == 2 else b"short " + b" ".join(tokens)) - (1 << 63)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, row): a hash of id and text, and all columns of the document."""
    own = F.xxhash64(F.lit(4), quoted(id_col), F.coalesce(quoted(text_col), F.lit("")))
    return docs.select(own.alias("rid"), packed_row(docs).alias("row"))


def _dealt(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents by ``rid``: one exchange, which both joins that need texts read."""
    return _rows(docs, id_col, text_col).repartition("rid")


def _met(many: DataFrame, few: DataFrame, keys: list[str], total: int, frequent: int | None = None) -> DataFrame:
    """``many`` joined with the rows of ``few`` (keys, rows, ...), each of which stands for its number of ``rows`` in ``many``.

    Those of more than one in ``frequent`` of ``total`` rows are broadcast;
    a key that is left to the shuffle has no more than that.
    """
    often = F.col("rows") * F.lit(frequent or FREQUENT_LINES) > F.lit(total)
    top, rest = few.filter(often).drop("rows"), few.filter(~often).drop("rows")
    left = many.join(F.broadcast(top.select(keys)), keys, "left_anti")
    return many.join(F.broadcast(top), keys).unionByName(left.join(rest, keys))


def _constants_of(each: DataFrame, constants: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(rid, own, token, wide): the rows of ``each`` (rid, own, token) whose token is a constant.

    A constant is broadcast if it counts for more than one in ``frequent`` of
    all that constants count, so fewer than ``frequent`` are.
    """
    total = constants.agg(F.sum("count")).first()[0] or 0
    often = F.col("count") * F.lit(frequent) > F.lit(total)
    top, rest = constants.filter(often).select("token", "wide"), constants.filter(~often).select("token", "wide")
    columns = ["rid", "own", "token", "wide"]
    found = each.join(F.broadcast(top), "token").select(columns)
    return found.union(each.join(F.broadcast(top.select("token")), "token", "left_anti").join(rest, "token").select(columns))


def recurring_lines(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    min_tokens: int = MIN_TOKENS,
    depth: int = DEPTH,
    constant: float = CONSTANT,
    common: float = COMMON,
    short_docs: int | None = None,
    long_docs: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(rid, found): numbers of the lines of recurring templates, without each template's first document.

    ``rid`` is a hash of id and text; rows equal in both are one document.
    ``found`` has an entry (head, words, lines, leaf, kind) for each first
    document, by its rid, with the number of its words; ``leaf`` is the hash of
    what the lines share (see ``line_hash``), by which a clash of two rids is told.
    Without ``short_docs`` or ``long_docs`` such lines are not counted as they are.
    """
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _rows(docs, id_col, text_col).select("rid", F.col("row")[f"c{text_at}"].alias("text"), F.col("row")[f"c{id_at}"].alias("doc_id"))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            at, leaf, told = [], [], []
            for k, text in enumerate(texts(batch.column(1))):
                met = set()
                lines = [line.split() for line in text.encode("utf-8", "surrogatepass").split(b"\n")]
                words = min(sum(map(len, lines)), (1 << WORD_BITS) - 1) << LINE_BITS
                for n, tokens in enumerate(lines):
                    for kind in kinds_of(len(tokens), min_tokens, short_docs, long_docs):
                        x = line_hash(tokens, depth, kind)
                        at.append(k)
                        leaf.append(x)
                        told.append(((words | n) << 3) | kind << 1 | ((kind, x) not in met))
                        met.add((kind, x))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(leaf, pa.int64()), pa.array(told, pa.int64())], ["rid", "doc_id", "leaf", "told"])

    both = cut(rows.mapInArrow(leaves, f"rid long, doc_id {id_type}, leaf long, told long"))
    kind, first = F.expr("cast((told >> 1) & 3 as int)"), F.expr("cast(told & 1 as int)")
    line, words = F.expr(f"cast((told >> 3) & {(1 << LINE_BITS) - 1}L as int)"), F.expr(f"cast(told >> {LINE_BITS + 3} as int)")
    placed = both.filter(kind == 0).select("rid", line.alias("line"), "leaf", first.alias("first"))
    total = both.count()
    shared = cut(placed.groupBy("leaf").agg(F.sum("first").alias("n"), F.count(F.lit(1)).alias("rows")).filter(F.col("n") >= min_docs))
    wanted = _met(placed, shared.select("leaf", "rows"), ["leaf"], total).groupBy("rid").agg(F.collect_set("line").alias("wanted"))

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(1).flatten()
            at, lines, leaf, tokens, words_of = [], [], [], [], []
            for k, (text, numbers) in enumerate(zip(fields[text_at], batch.column(2), strict=True)):
                text, numbers = text.as_py() or "", numbers.as_py()
                raw = text.encode("utf-8", "surrogatepass")
                all_lines, n_words = raw.split(b"\n"), len(raw.split())
                met: dict[tuple[bytes, ...], list[int]] = {}
                for n in sorted(numbers):
                    met.setdefault(tuple(masked(all_lines[n].split())), []).append(n)
                for words, where in met.items():
                    at.append(k)
                    lines.append(where)
                    leaf.append(leaf_of(list(words), depth))
                    words_of.append(n_words)
                    tokens.append([xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), fields[id_at].take(take), pa.array(lines, pa.list_(pa.int32())), pa.array(leaf, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(words_of, pa.int32())], ["rid", "doc_id", "lines", "leaf", "tokens", "words"])

    close = _dealt(docs, id_col, text_col).join(wanted.hint("shuffle_hash"), "rid").select("rid", "row", "wanted")
    # Rows that are equal in id and text are one document here.
    close = close.mapInArrow(tokens_of, f"rid long, doc_id {id_type}, lines array<int>, leaf long, tokens array<long>, words int").distinct()
    close = cut(close.withColumn("own", F.xxhash64("tokens")))
    tokens = close.select("rid", "own", "leaf", F.posexplode("tokens").alias("place", "token"))
    each = tokens.select("rid", "own", "leaf", F.xxhash64("leaf", "place", "token").alias("token"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.first("leaf").alias("leaf")).filter(F.col("count") >= min_docs)
    constants = cut(counts.join(shared.select("leaf", "n"), "leaf").select("token", "count", (F.col("count") >= F.lit(common) * F.col("n")).cast("int").alias("wide")))
    # The token's hash has its leaf and place in it, so the constants of a line make its template.
    fixed = _constants_of(each.select("rid", "own", "token"), constants).groupBy("rid", "own").agg(
        F.bit_xor("token").alias("template"), F.count(F.lit(1)).alias("fixed"),
        F.bit_xor(F.when(F.col("wide") == 1, F.col("token")).otherwise(0)).alias("wide_template"), F.sum("wide").alias("wide_fixed"),
    )
    enough = lambda c: F.col(c) >= F.lit(constant) * F.size("tokens")
    lines = close.join(fixed, ["rid", "own"]).filter(enough("fixed"))
    wide = F.when(enough("wide_fixed"), F.col("wide_template")).otherwise(F.col("template"))
    lines = lines.select("rid", "doc_id", "leaf", "lines", "words", F.explode(F.array_distinct(F.array("template", wide))).alias("template"))
    # The order in which a template's documents come: by id, null last.
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "rid", "words")
    per_doc = cut(lines.groupBy("leaf", "template", "rid").agg(F.min(order).alias("o"), F.flatten(F.collect_list("lines")).alias("lines")))
    recurring = per_doc.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("rows"), F.min("o").alias("head")).filter(F.col("rows") >= min_docs)
    gone = _met(per_doc, recurring, ["leaf", "template"], total).filter(F.col("rid") != F.col("head.rid")).select("rid", "head", "lines", "leaf", F.lit(0).alias("kind"))
    if short_docs or long_docs:
        alike = both.filter(kind > 0).select("rid", "doc_id", line.alias("line"), "leaf", first.alias("first"), kind.alias("kind"), words.alias("words"))
        need = F.when(F.col("kind") == 1, short_docs or 0).otherwise(long_docs or 0)
        repeated = alike.groupBy("leaf", "kind").agg(F.sum("first").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(order).alias("head"))
        exact = _met(alike, repeated.filter(F.col("n") >= need).select("leaf", "kind", "rows", "head"), ["leaf", "kind"], total).filter(F.col("rid") != F.col("head.rid"))
        gone = gone.union(exact.select("rid", "head", F.array("line").alias("lines"), "leaf", "kind"))
    return gone.groupBy("rid").agg(F.collect_list(F.struct(F.col("head.rid").alias("head"), F.col("head.words").alias("words"), "lines", "leaf", "kind")).alias("found"))


def _is_copy(found: list, words: list[int], share: float) -> bool:
    """Whether lines that a text has in common with one first document hold the share of the words of both."""
    common: dict[int, set[int]] = {}
    size: dict[int, int] = {}
    for x in found:
        common.setdefault(x["head"], set()).update(x["lines"])
        size[x["head"]] = x["words"]
    total = sum(words)
    return any(sum(words[n] for n in lines) >= share * max(total, size[head]) for head, lines in common.items())


def without_recurring_lines(
    docs: DataFrame,
    whole: float | None = None,
    copy: float | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    packed: bool = False,
    **how,
) -> DataFrame:
    """The rows of ``docs`` with their recurring lines dropped, and n_lines, n_dropped.

    With ``packed`` a row stays one struct, ``row``, from which
    ``rows.unpacked_row`` restores the columns, so that none clashes with the
    two.

    A text is left as it is for near-duplicate removal if it is a copy by
    comparison with one other document: lines that are recurring and first in
    that document hold a share ``copy`` of the words of each of the two.  With
    ``whole``, so is a text of which recurring lines of any documents hold more
    than that share of the words.  By default all texts are cut.  Null
    and empty texts have one empty line and stay as they are; rows equal in id
    and text are treated alike; the other columns stay, whatever their names.
    """
    gone = recurring_lines(docs, id_col=id_col, text_col=text_col, **how)
    joined = _dealt(docs, id_col, text_col).join(gone.hint("shuffle_hash"), "rid", "left").select("row", "found")

    text_at, depth = docs.columns.index(text_col), how.get("depth", DEPTH)

    def mine(found: list, all_lines: list[str]) -> list:
        """The entries whose lines are those that were hashed."""
        def same(x) -> bool:
            tokens = all_lines[x["lines"][0]].encode("utf-8", "surrogatepass").split() if x["lines"][0] < len(all_lines) else []
            return max(x["lines"]) < len(all_lines) and line_hash(tokens, depth, x["kind"]) == x["leaf"]

        return [x for x in found if same(x)]

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(0).flatten()
            for k in range(0, batch.num_rows, 512):
                part = [f.slice(k, 512) for f in fields]
                kept, n_lines, n_dropped = [], [], []
                for text, found in zip(part[text_at].to_pylist(), batch.column(1).slice(k, 512).to_pylist(), strict=True):
                    all_lines = (text or "").split("\n")
                    n_lines.append(len(all_lines))
                    found = mine(found or [], all_lines)
                    off = {n for x in found for n in x["lines"]}
                    if off and (whole is not None or copy is not None):
                        words = [len(x.encode("utf-8", "surrogatepass").split()) for x in all_lines]
                        if whole is not None and sum(words[n] for n in off) > whole * sum(words):
                            off = set()
                        elif copy is not None and _is_copy(found, words, copy):
                            off = set()
                    kept.append("\n".join(x for n, x in enumerate(all_lines) if n not in off) if off else text)
                    n_dropped.append(len(off))
                part[text_at] = pa.array(kept, part[text_at].type)
                yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(part, fields=list(batch.schema.field(0).type)), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "n_lines", "n_dropped"])

    done = joined.mapInArrow(drop, f"row {joined.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long")
    return done if packed else done.select(*unpacked_row(docs), "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = without_recurring_lines(docs, short_docs=SHORT_DOCS, long_docs=LONG_DOCS)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
