"""Benchmark decontamination by Wu-Manber multi-pattern search (operator 1).

Texts and items are brought to one canonical form: lower-cased words, each
between single spaces.  A pattern is a window of ten consecutive words of an
item (the whole item if it is shorter), its outer spaces included, so that an
occurrence is always on word boundaries.

Patterns are searched in classes of similar length.  A class has the classical
tables over the first m bytes of its patterns, m being the shortest length: a
shift table of hashed blocks, and buckets of patterns by the hash of the last
block.  The scan runs many stretches of the text abreast in numpy: each round
looks up the block under every stretch's cursor, moves the cursors by their
shifts, and where a shift is zero compares the text with the patterns of the
bucket, byte for byte.

Items are cut into pieces of whole windows, and pieces are taken in blocks of at
most ``BLOCK_BYTES`` of text, filled one after another; each block is one pass over
the documents, and a Python worker builds its tables once.  A benchmark of one
block needs no shuffle of documents.  With more, each pass but the last leaves
the hits of its block in a checkpoint before the next block is broadcast, so
what is broadcast or on the driver at once is bounded whatever the size of the
benchmark; the last pass adds them up by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from kinweave.llm.arrow import flat, slices
from kinweave.llm.rows import packed_row, quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

WINDOW = 10
#: Bytes of pieces per pass over the documents; their tables take some 220 bytes each in a Python worker.
BLOCK_BYTES = 2 << 20
#: Windows of an item in a piece.
PIECE_WINDOWS = 1024
STRETCH = 512
#: Lower bounds, in bytes, of the classes of pattern lengths, with the bytes of a block in each.
CLASSES = ((0, 2), (8, 4), (24, 8))
_WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE, EDGE = 32, 1
_CANON = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else SPACE for b in range(256)], np.uint8)


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    """The windows of an item in canonical form; null or an item without words has none."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    return [b" " + b" ".join(words[k : k + window]) + b" " for k in range(max(1, len(words) - window + 1))] if words else []


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The canonical bytes of many texts, with an edge byte between any two, and where each text starts."""
    n = len(offsets) - 1
    wide = np.full(len(data) + 3 * n + 3, SPACE, np.uint8)
    gaps = offsets[:-1] + 3 * np.arange(n) + 1
    wide[gaps] = EDGE
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        np.take(_CANON, data[a:b], out=wide[a + 3 * k + 3 : b + 3 * k + 3])
    keep = wide != SPACE
    keep[1:] |= wide[:-1] != SPACE
    keep[0] = True
    edges = np.concatenate([[0], gaps])
    kept = [np.count_nonzero(keep[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    return wide[keep], np.cumsum(kept, dtype=np.int64)


def _blocks(data: np.ndarray, width: int) -> np.ndarray:
    """The block of ``width`` bytes at every place, as an unaligned view."""
    return np.ndarray((len(data) - width + 1,), f"<u{width}", data, strides=(1,))


class PatternClass:
    """The Wu-Manber tables of patterns of similar length."""

    def __init__(self, patterns: list[bytes], block: int):
        self.block = block
        self.m = m = min(map(len, patterns))
        self.bits = int(np.clip(np.ceil(np.log2(len(patterns) * (m - block + 1))) + 3, 10, 22))
        self.length = np.fromiter(map(len, patterns), np.int64, len(patterns))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns), np.uint8).reshape(-1, m)
        self.shift = np.full(1 << self.bits, m - block + 1, np.int32)
        for j in range(m - block + 1):
            h = self.hash(np.ascontiguousarray(heads[:, j : j + block]).view(f"<u{block}")[:, 0])
            self.shift[h] = np.minimum(self.shift[h], m - block - j)
        suffix = self.hash(np.ascontiguousarray(heads[:, m - block : m]).view(f"<u{block}")[:, 0])
        self.order = np.argsort(suffix, kind="stable")
        self.starts = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))
        words = (int(self.length.max()) + 7) // 8
        padded = np.zeros((len(patterns), 8 * words), np.uint8)
        mask = np.arange(8 * words) < self.length[:, None]
        padded[mask] = np.frombuffer(b"".join(patterns), np.uint8)
        self.words, self.masks = padded.view("<u8"), (mask * np.uint8(255)).astype(np.uint8).view("<u8")

    def hash(self, block: np.ndarray) -> np.ndarray:
        return ((block.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of all occurrences in the first ``size`` bytes; ``text`` has room behind them."""
        back = self.m - self.block
        blocks, eights = _blocks(text, self.block), _blocks(text, 8)
        last = size - self.m + 1
        at = np.arange(0, max(0, last), STRETCH)
        stop = np.minimum(at + STRETCH, last)
        found = []
        while len(at):
            h = self.hash(blocks[at + back])
            move = self.shift[h]
            zero = move == 0
            if zero.any():
                found.append(self._compare(eights, at[zero], h[zero], size))
            at = at + np.where(zero, 1, move)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _compare(self, eights: np.ndarray, at: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        first, many = self.starts[h], self.starts[h + 1] - self.starts[h]
        begin = np.repeat(at, many)
        pattern = self.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)]
        fits = begin + self.length[pattern] <= size
        begin, pattern = begin[fits], pattern[fits]
        for k in range(self.words.shape[1]):
            if not len(begin):
                break
            want = self.words[pattern, k]
            mask = self.masks[pattern, k]
            there = eights[np.minimum(begin + 8 * k, len(eights) - 1)]
            same = (there & mask) == want
            begin, pattern = begin[same], pattern[same]
        return begin, pattern


class Patterns:
    """All windows of a block of items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in item_windows(text, window):
                owners.setdefault(w, set()).add(item)
        patterns = list(owners)
        self.classes: list[tuple[PatternClass, np.ndarray]] = []
        for k, (least, block) in enumerate(CLASSES):
            most = CLASSES[k + 1][0] if k + 1 < len(CLASSES) else 1 << 62
            at = [i for i, p in enumerate(patterns) if least <= len(p) < most]
            if at:
                self.classes.append((PatternClass([patterns[i] for i in at], block), np.array(at)))
        self.words = np.array([p.count(b" ") - 1 for p in patterns], np.int64)
        self.longest = max(map(len, patterns), default=0)
        self.items = sorted(set().union(*owners.values())) if owners else []
        place = {x: k for k, x in enumerate(self.items)}
        of = [sorted(place[x] for x in owners[p]) for p in patterns]
        self.item_starts = np.concatenate([[0], np.cumsum([len(x) for x in of])]).astype(np.int64)
        self.item_of = np.array([y for x in of for y in x], np.int64)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
        """Per text: the number of words, the maximal runs of hit words, and the items that occur."""
        n = len(offsets) - 1
        text, starts = canonical(data, offsets)
        size = len(text)
        first = np.zeros(size, bool)
        first[:-1] = (text[:-1] == SPACE) & (text[1:] != SPACE) & (text[1:] != EDGE)
        places = np.flatnonzero(first)  # a place has the number of words that start before it
        bounds = np.searchsorted(places, np.append(starts, size))
        text = np.concatenate([text, np.zeros(self.longest + 16, np.uint8)])
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[list[str]] = [[] for _ in range(n)]
        begin, pattern = [], []
        for one, at in self.classes:
            b, p = one.search(text, size)
            begin.append(b)
            pattern.append(at[p])
        begin = np.concatenate(begin) if begin else np.zeros(0, np.int64)
        if len(begin):
            pattern = np.concatenate(pattern)
            edge = np.zeros(len(places) + 1, np.int64)
            w = np.searchsorted(places, begin)
            np.add.at(edge, w, 1)
            np.subtract.at(edge, w + self.words[pattern], 1)
            hit = np.cumsum(edge[:-1]) > 0
            doc = np.searchsorted(bounds, w, "right") - 1
            turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            cut = np.unique(np.concatenate([bounds[:-1], [len(hit)]]))
            lo, hi = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                inner = cut[(cut > a) & (cut < b)].tolist() if np.searchsorted(cut, a, "right") < np.searchsorted(cut, b, "left") else []
                for x, y in zip([a, *inner], [*inner, b], strict=True):
                    d = int(np.searchsorted(bounds, x, "right") - 1)
                    spans[d].append((x - int(bounds[d]), y - int(bounds[d])))
            many = self.item_starts[pattern + 1] - self.item_starts[pattern]
            which = self.item_of[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.item_starts[pattern], many)]
            for key in np.unique(np.repeat(doc, many) * len(self.items) + which).tolist():
                items[key // len(self.items)].append(self.items[key % len(self.items)])
        return np.diff(bounds), spans, items


def pieces(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, most: int = PIECE_WINDOWS) -> DataFrame:
    """(item, text): items in canonical words, long ones in pieces of ``most`` windows; each window is in one piece."""
    rows = benchmark.select(F.coalesce(quoted(item_col).cast("string"), F.lit("null")).alias("item"), quoted(text_col).alias("text")).filter("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w.decode("utf-8", "surrogatepass") for w in _WORD.findall(text.encode("utf-8", "surrogatepass").lower())]
                parts = [" ".join(words[k : k + most + window - 1]) for k in range(0, max(1, len(words) - window + 1), most)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], ["item", "text"])

    return rows.mapInArrow(run, "item string, text string")


def _blocks_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Pieces in order, in blocks filled up to ``most`` bytes of text, or of one piece; one block (at least) comes to the driver at a time."""
    block, held = [], 0
    for r in cut(pieces(benchmark, item_col, text_col, window).sort("item", "text")).toLocalIterator():
        own = len(r["text"].encode("utf-8", "surrogatepass"))
        if block and held + own > most:
            yield block
            block, held = [], 0
        block.append((r["item"], r["text"]))
        held += own
    yield block


#: The tables of the block that this Python worker searched last.
_TABLES: dict[str, Patterns] = {}


def _tables(name: str, given, window: int) -> Patterns:
    """The tables of a block, built once per worker and block."""
    if name not in _TABLES:
        _TABLES.clear()
        _TABLES[name] = Patterns(given.value, window)
    return _TABLES[name]


SPANS = "array<struct<start:int,end:int>>"
_SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
_SPAN_TYPE = pa.list_(pa.struct([pa.field("start", pa.int32()), pa.field("end", pa.int32())]))


def _scan(rows: DataFrame, block: list[tuple[str, str]], window: int) -> tuple[DataFrame, object]:
    """``rows`` (whose first column is ``text``) with n_words, spans, items for one block, and its broadcast."""
    given = rows.sparkSession.sparkContext.broadcast(block)
    kept, name = rows.columns[1:], str(uuid4())
    out = StructType([*(rows.schema[c] for c in kept), StructField("n_words", LongType()), StructField("spans", _SPANS), StructField("items", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _tables(name, given, window)
        for batch in slices(batches, 0):
            n_words, spans, items = patterns.scan(*flat(batch.column(0)))
            found = [[{"start": a, "end": b} for a, b in x] for x in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n_words, pa.int64()), pa.array(found, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))], out.names)

    return rows.mapInArrow(run, out), given


def _merged(spans: Column) -> Column:
    """Intervals as maximal intervals in order."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items): where windows of items occur in each text.

    ``spans`` are the maximal runs of hit words, end exclusive; ``items`` the
    ids, as strings in order, of the items with an occurring window.  With
    ``carry`` there is also ``row``, the whole row as a struct, from which
    ``rows.unpacked_row`` restores the columns, whatever their names.  A null
    or empty text has no words; an item without words is never found; a null
    item id is the string ``null``; equal rows are searched alike; an empty
    table of documents gives no rows, an empty benchmark hits nothing.
    """
    carried = [packed_row(docs).alias("row")] if carry else []
    shown = ["doc_id", "n_words", "spans", "items", *(["row"] if carry else [])]
    rows = docs.select(quoted(text_col).alias("text"), quoted(id_col).alias("doc_id"), *carried)
    blocks = _blocks_of(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scan(rows, first, window)[0].select(shown)
    # Rows are told apart by two hashes of id and text; those equal in both have equal hits.
    own = lambda seed: F.xxhash64(F.lit(seed), F.col("doc_id"), F.coalesce("text", F.lit("")))
    keyed = docs.select(quoted(text_col).alias("text"), quoted(id_col).alias("doc_id")).select("text", own(1).alias("h1"), own(2).alias("h2"))
    hits, last = [], first
    for block in chain((second,), blocks):
        found, given = _scan(keyed, last, window)
        hits.append(cut(found.filter(F.size("spans") > 0).select("h1", "h2", "spans", "items")))
        given.destroy()
        last = block
    # The last block is searched where rows and counts are read, so there are as many scans as blocks.
    every, _ = _scan(rows.withColumns({"h1": own(1), "h2": own(2)}), last, window)
    before = reduce(DataFrame.union, hits).groupBy("h1", "h2").agg(F.flatten(F.collect_list("spans")).alias("spans_before"), F.flatten(F.collect_list("items")).alias("items_before"))
    both = lambda c, kind: F.concat(c, F.coalesce(f"{c}_before", F.array().cast(kind)))
    joined = every.join(before, ["h1", "h2"], "left").withColumns({"spans": _merged(both("spans", SPANS)), "items": F.array_sort(F.array_distinct(both("items", "array<string>")))})
    return joined.select(shown)


def hit_words(spans: str = "spans"):
    """The number of words in the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
pat AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i+9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM pat),
win AS (
  SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, i, win.k AS k, item_id FROM win JOIN pat ON win.k = pat.k AND win.s = pat.s),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, coalesce(CAST(item_id AS VARCHAR), 'null') AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""
