"""Near-duplicates by exact Jaccard similarity of word shingles (stage 7 of the pipeline).

Equal shingle sets are collapsed first.  Two sets of similarity t or more share
one of their first n - ceil(t * n) + 1 shingles in any common order (prefix
filtering), so meeting under these shingles loses no pair.  The order is that of
hashes, but shingles that many texts hold come last, by how many: a passage that
very many texts quote is then in no prefix but those of texts that consist of
such passages.  (Which shingles count as frequent changes the order, never the
result.)  Sets whose prefix nobody shares leave before anything else is sent.

In a bucket, pairs are left out only by bounds that hold for every pair of
similarity t: the ratio of the sizes, and the number of differing bits of two
parity bitmaps, which is never more than the number of shingles that only one of
the sets has.  Bitmaps are compared as fingerprints of operator 7 are: a
pigeonring filter over their words, then all bits.  What is left connects sets
into *candidate* components, a superset of the answer; the sets of each are then
compared exactly, and only the verified links make the result.

Majority bits, as SimHash has them, give no bound on the similarity of texts,
parity bits do.  So the groups of operator 7 may come first (``alike``): their
sets are compared exactly, what is linked is a class, and the search by prefixes
only adds what the fingerprints' bound cannot see: the links between different
classes.  Shingles that one class has to itself are no keys then.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.arrow import flat, run_starts, slices
from kinweave.llm.rows import packed_row, unpacked_row
from kinweave.llm.simhash import HEAVY, SEED, forest, keyed_links
from kinweave.operators.components import connected_components
from kinweave.plans.lineage import cut

#: Words of 64 bits in a bitmap, and the longest chain of them that the pigeonring filter looks at.
BITMAP = 4
CHAIN = 4
#: Sets and shingles of a candidate component that one task compares with as many others.
CHUNK_SETS = 512
CHUNK_SHINGLES = 1 << 20
#: (least size, largest size, words of bitmap): sets meet within these, as a bitmap tells little about sets of over twice its bits.
#: At the borders they overlap by more than 5 / 4.
CLASSES = [(1, 400, 4), (300, 2000, 16), (1500, None, 64)]
#: Frequent shingles that are broadcast are fewer than these (8 bytes each); the texts of one task that must hold one, and those of all.
FREQUENT = 1 << 20
FREQUENT_HERE = 3
FREQUENT_DOCS = 64
#: Words of 64 bits in the table that tells which rows may have one of some ids: it is broadcast (16 bytes a word).
MARKS = 1 << 18
#: Bytes of text over which a task counts shingles at once.
COUNT_BYTES = 24 << 20
#: Bytes of words that are hashed at once.
WORD_BYTES = 2 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BYTES = np.random.default_rng(SEED).integers(0, 1 << 64, 256, np.uint64)
_BYTES[65:91] = _BYTES[97:123]  # A-Z are as a-z
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of _BASE and of its inverse, modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the sorted distinct hashes of each text's word shingles, back to back.

    ``data`` is the UTF-8 bytes of all texts, cut at ``offsets``.  A text of
    fewer words than ``width`` is one shingle, a text without words has none.
    """
    n_texts = len(offsets) - 1
    inside = ~_SPACE[data]
    at_start = np.zeros(len(data) + 1, bool)
    at_start[offsets[:-1]] = True
    begin = np.flatnonzero(inside & (at_start[:-1] | np.concatenate([[True], ~inside[:-1]])) if len(data) else inside)
    at_end = np.zeros(len(data) + 1, bool)
    at_end[offsets[1:]] = True
    end = np.flatnonzero(inside & (at_end[1:] | np.concatenate([~inside[1:], [True]])) if len(data) else inside) + 1
    words = np.empty(len(begin), np.uint64)
    a = 0
    while a < len(begin):  # words of about WORD_BYTES at once, so that a long text needs no long arrays of powers
        b = max(a + 1, int(np.searchsorted(end, begin[a] + WORD_BYTES, "right")))
        low, high = int(begin[a]), int(end[b - 1])
        up, down = _powers(1 << max(21, (high - low).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data[low:high]] * up[: high - low], dtype=np.uint64)])
        words[a:b] = (sums[end[a:b] - low] - sums[begin[a:b] - low]) * down[begin[a:b] - low]
        a = b
    words = _mixed(words, (end - begin).astype(np.uint64))
    bounds = np.searchsorted(begin, offsets)  # words before each text
    text = np.repeat(np.arange(n_texts), np.diff(bounds))
    place, last = np.arange(len(words)), np.repeat(bounds[1:], np.diff(bounds))
    first = np.repeat(bounds[:-1], np.diff(bounds))
    use = (place + width <= last) | ((place == first) & (last - first < width))
    place, last, text = place[use], last[use], text[use]
    h = np.full(len(place), width, np.uint64)
    for k in range(width):
        there = place + k < last
        h = np.where(there, _mixed(h, words[np.minimum(place + k, len(words) - 1)]), h) if len(words) else h
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.searchsorted(text[new], np.arange(n_texts + 1))


def sets_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """The shingles of each text of a column."""
    h, bounds = shingles(*flat(column), width)
    return [h[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def frequent_shingles(rows: DataFrame, width: int, most: int = FREQUENT) -> np.ndarray:
    """The hashes of the shingles that most texts hold, least frequent first: fewer than ``most``.

    Those that count for more than one in ``most`` of all counts.  Tasks tell of what FREQUENT_HERE of their own texts hold, so counts are not
    exact; they only decide an order.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= FREQUENT_HERE
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], ["h", "n"])

        for batch in slices(batches, 0):
            held.append(shingles(*flat(batch.column(0)), width)[0])
            size += batch.column(0).nbytes
            if size >= COUNT_BYTES:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    counts = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("n") >= FREQUENT_DOCS))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * F.lit(most) > F.lit(total)).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    return h[np.lexsort((h, n))].view(np.uint64)


def by_frequency(own: np.ndarray, frequent: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A set with its frequent shingles last; ``order`` sorts ``frequent``."""
    if not len(frequent) or not len(own):
        return own
    at = np.minimum(np.searchsorted(frequent, own, sorter=order), len(frequent) - 1)
    rank = np.where(frequent[order[at]] == own, order[at] + 1, 0)
    return own[np.argsort(rank, kind="stable")] if rank.any() else own


def prefix_length(n: int, t: Fraction) -> int:
    """How many first shingles of a set of n hold one of every set of similarity t or more."""
    return n + (-n * t.numerator) // t.denominator + 1 if n else 0


class Bounds:
    """A bitmap and the size of a set, and the pairs that these do not rule out."""

    def __init__(self, t: Fraction, bitmap: int = BITMAP):
        self.t, self.bitmap, self.words = t, bitmap, bitmap + 1

    def cell(self, own: np.ndarray) -> bytes:
        bits = np.bincount((own % np.uint64(64 * self.bitmap)).astype(np.int64), minlength=64 * self.bitmap) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8").astype(">u8").tobytes() + len(own).to_bytes(8, "big")

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = self.t.numerator, self.t.denominator
        x, y = a[:, self.bitmap].astype(np.int64), b[:, self.bitmap].astype(np.int64)
        out = np.minimum(x, y) * q >= np.maximum(x, y) * p
        at = np.flatnonzero(out)
        most = (x + y)[at] * (q - p) // (p + q)  # bits that may differ
        parts = np.bitwise_count(a[at, : self.bitmap] ^ b[at, : self.bitmap])
        # Pigeonring: from some word on, every chain of l words differs in l / words of the bits that may differ.
        m = self.bitmap
        ring = np.concatenate([parts, parts[:, : CHAIN - 1]], 1).astype(np.int64)
        total, ok = np.zeros((len(at), m), np.int64), np.ones((len(at), m), bool)
        for length in range(1, CHAIN + 1):
            total += ring[:, length - 1 : length - 1 + m]
            ok &= total * m <= length * most[:, None]
        left = ok.any(1)
        out[at] = left
        out[at[left]] = parts[left].sum(1, dtype=np.int64) <= most[left]
        return out


def verified(reps: np.ndarray, sets: list[np.ndarray], t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs of similarity t or more connect; each set is compared with those not yet reached."""
    p, q = t.numerator, t.denominator
    order = np.argsort([len(s) for s in sets], kind="stable")
    reps, sets = reps[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), bool)
    unmet = np.ones(len(sets), bool)
    a, b = [], []
    for seed in range(len(sets)):
        if not unmet[seed]:
            continue
        unmet[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            low, high = np.searchsorted(size * q, size[x] * p), np.searchsorted(size * p, size[x] * q, "right")
            others = low + np.flatnonzero(unmet[low:high])
            if not len(others):
                continue
            own = flat[start[x] : start[x] + size[x]]
            mark[own] = True
            n = size[others]
            first = np.cumsum(n) - n
            at = np.arange(int(n.sum())) + np.repeat(start[others] - first, n)
            common = np.add.reduceat(mark[flat[at]], first, dtype=np.int64)
            mark[own] = False
            near = others[common * q >= p * (size[x] + n - common)]
            unmet[near] = False
            queue.extend(near.tolist())
            a.append(np.full(len(near), reps[x]))
            b.append(reps[near])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *a]), np.concatenate([nothing, *b])


def classes_of(t: Fraction) -> list[tuple[int, int | None, int]]:
    """CLASSES if every pair of similarity t lies in one of them, else one class of all sizes."""
    fits = all(high * t >= low for (_, high, _), (low, _, _) in zip(CLASSES, CLASSES[1:], strict=False))
    return CLASSES if fits else [(1, None, 16)]


def shared_keys(keyed: DataFrame, most: int = HEAVY) -> DataFrame:
    """(key, rep): the rows whose key a row of another class has too.  ``keyed`` is (key, rep, class).

    A task holds back ``most`` rows of a key until it meets another class; if a
    class has more, they are kept as well.
    """
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last key so far, if they are all of one class
        last, only, shared = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, classes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            batch = batch.select(["key", "rep"])
            starts = run_starts(keys)
            low, high = np.minimum.reduceat(classes, starts), np.maximum.reduceat(classes, starts)
            several = low != high
            if keys[0] == last:
                several[0] |= shared or low[0] != only
                if several[0]:
                    yield from held
            if several[0] or len(starts) > 1 or keys[0] != last:
                held = []
            last, only, shared = keys[-1], low[-1], several[-1]
            yield batch.filter(pa.array(np.repeat(several, np.diff(np.append(starts, len(keys))))))
            if not shared:
                held.append(batch.slice(starts[-1]))
                if sum(b.num_rows for b in held) > most:
                    yield from held
                    held, shared = [], True

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(keep, "key long, rep long")


def keys_of(sets: DataFrame) -> DataFrame:
    """(key, rep, class): a row per shingle of each prefix.  ``sets`` is (rep long, class long, prefix)."""
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            prefixes = batch.column(2).to_pylist()
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in prefixes]))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), "<i8")), batch.column(0).take(take), batch.column(1).take(take)], ["key", "rep", "class"])

    return sets.select("rep", "class", "prefix").mapInArrow(key, "key long, rep long, class long")


def told_apart(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: whether ``rep`` is one of ``ids``, or, rarely, has the same bit as one in a table of MARKS words.

    The table is broadcast, so rows can leave by it before an exchange.
    """
    place = F.pmod(F.xxhash64("rep"), F.lit(64 * MARKS))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    marks = ids.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    met = rows.withColumn("word", word).join(F.broadcast(marks), "word", "left")
    return met.withColumn("maybe", F.coalesce(F.bit_get("bits", bit) == 1, F.lit(False))).drop("word", "bits")


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is no ``rep`` of ``gone``; only rows that may be among these are sent."""
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), packed_row(docs).alias("row"))
    return rows_without(rows, gone).select(*unpacked_row(docs))


def rows_without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """(row): the rows (rep, row) whose ``rep`` is none of ``gone``; only those that may be among these are sent."""
    told = told_apart(rows, gone)
    kept = told.filter("maybe").join(gone, "rep", "left_anti")
    return told.filter("not maybe").select("row").union(kept.select("row"))


def links_within(rows: DataFrame, members: DataFrame, shingle: int, t: Fraction, chunk_sets: int) -> DataFrame:
    """(a, b): edges that connect what pairs of similarity t or more connect within a part.

    ``members`` is (rep, own, n, part).  Only texts of parts of several sets are
    sent.  Large parts are dealt into chunks, and each pair of chunks is compared
    by a task of its own.  Within one chunk or pair of chunks each edge leads to
    the least ``rep`` of its tree.
    """
    parts = members.groupBy("part").agg(F.count(F.lit(1)).alias("sets"), F.greatest(F.ceil(F.count(F.lit(1)) / chunk_sets), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("chunks"))
    members = cut(members.join(parts.filter("sets > 1").select("part", "chunks"), "part"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = sets_of(batch.column(1), shingle)
            same = pa.array([xxhash.xxh3_128_digest(s) == own for s, own in zip(found, batch.column(2).to_pylist(), strict=True)])
            packed = pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), packed, batch.column(3), batch.column(4)], ["rep", "shingles", "part", "chunks"]).filter(same)

    named = told_apart(rows.select(F.col("doc_id").cast("long").alias("rep"), "text"), members).filter("maybe").join(members, "rep").select("rep", "text", "own", "part", "chunks")
    dealt = named.mapInArrow(sets, "rep long, shingles binary, part long, chunks int")
    i = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    dealt = dealt.withColumn("i", i).withColumn("j", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: j != F.col("i")))))

    def compare(key: tuple, found: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in found.column("shingles").to_pylist()]
        a, b = forest(*verified(found.column("rep").to_numpy(), own, t))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    dealt = dealt.select("rep", "shingles", "part", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    return dealt.groupBy("part", "lo", "hi").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", heavy_rows: int = HEAVY, chunk_sets: int = CHUNK_SETS, alike: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id): the least id reachable over links of Jaccard similarity ``similarity`` or more, per row.

    Ids are whole numbers.  Texts without words are alike; null texts have no
    words.  Rows that share an id are one document.  A row whose id is null gets
    the least id of the texts with its shingles (null if there is none).

    ``alike`` is (doc_id, component_id), what ``simhash.near_duplicates`` found:
    the texts of its components are compared first, and the rest of the search
    is for links between the classes that this gives.  The result is the same
    for any ``alike``.
    """
    t = Fraction(str(similarity))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    by_size = [(low, high or 1 << 62, Bounds(t, words)) for low, high, words in classes_of(t)]
    cells = [f"cell{k}" for k in range(len(by_size))]

    # Which shingles are frequent is at most FREQUENT hashes of 8 bytes.
    common = docs.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = common.value
        order = np.argsort(frequent, kind="stable")
        for batch in slices(batches, 1):
            own = sets_of(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array([len(s) for s in own], pa.int64()),
                *(pa.array([bounds.cell(s) if low <= len(s) <= high else None for s in own], pa.binary()) for low, high, bounds in by_size),
                pa.array([by_frequency(s, frequent, order)[: prefix_length(len(s), t)].tobytes() for s in own], pa.binary())], ["doc_id", "own", "n", *cells, "prefix"])

    every = cut(rows.mapInArrow(prints, f"doc_id {id_type}, own binary, n long, {', '.join(f'{c} binary' for c in cells)}, prefix binary"))
    least = every.groupBy("own").agg(F.min("doc_id").cast("long").alias("rep"), F.first("n").alias("n"))
    least = least.withColumn("class", F.col("rep"))
    if alike is not None:
        groups = alike.select(F.col("doc_id").cast("long").alias("rep"), F.col("component_id").cast("long").alias("part")).distinct()
        sure = cut(links_within(rows, least.filter("n > 0").select("rep", "own", "n").join(groups, "rep"), shingle, t, chunk_sets))
        # The sets of a class are linked with one set; what chunks or parts find apart may stay several classes.
        classes = sure.groupBy(F.col("a").alias("rep")).agg(F.min("b").alias("least"))
        least = cut(least.join(classes, "rep", "left").withColumn("class", F.coalesce("least", "rep")).drop("least"))
    firsts = every.select(F.col("doc_id").cast("long").alias("rep"), "own", *cells, "prefix").join(least.select("rep", "own", "class"), ["own", "rep"])
    # Only the sets that share a key with another class meet with their bitmaps.
    met = cut(shared_keys(keys_of(firsts), heavy_rows).join(firsts.select("rep", *cells), "rep").select("key", *cells, "rep"))
    found = [keyed_links(met.filter(F.col(c).isNotNull()).select("key", F.col(c).alias("fp"), "rep"), bounds, heavy_rows) for c, (_, _, bounds) in zip(cells, by_size, strict=True)]
    maybe = connected_components(reduce(DataFrame.union, found))
    members = cut(least.filter("rep is not null").join(maybe, F.col("rep") == F.col("vertex")).select("rep", "own", "n", F.col("component").alias("part")))
    linked = links_within(rows, members, shingle, t, chunk_sets)
    roots = connected_components(linked if alike is None else linked.union(sure))
    roots_of = least.join(roots, F.col("rep") == F.col("vertex"), "left").select("own", F.coalesce("component", "rep").alias("component_id"))
    return every.select("doc_id", "own").join(roots_of, "own").select("doc_id", "component_id")
