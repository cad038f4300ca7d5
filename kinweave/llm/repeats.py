"""Repeated passages by a suffix array with a common-prefix interval tree (operator 6).

A suffix array of a whole corpus would shuffle every suffix.  Here suffixes are
binned so that suffixes with equal first ``least`` bytes always share a bin: the
bin of a window of ``least`` bytes is that of its minimiser, the k-gram of
least hash in it, which depends on the window's bytes alone.

1. *Scan*: every task lists, per k-gram that is the minimiser of a window, one
   document.  K-grams listed by more than one task, or met in more than one
   document of a task, are candidates; the others cannot hold a repeat.
2. *Passages*: the documents with candidates are read again.  Consecutive
   windows with one candidate minimiser make a passage: its bytes, from the
   first window's start to the last one's end.
3. *Bins*: all passages of a k-gram meet.  Their window starts are sorted as
   suffixes (bytes up to the passage's end), neighbours give common prefixes,
   and a stack scan of these gives the interval tree.  An interval whose
   suffixes are preceded by different bytes (or start a passage) is a maximal
   repeat of the bin; all its suffixes are its occurrences.  Suffixes whose
   first ``least`` bytes nobody shares, or that everybody who shares them can
   extend to the left by one byte, are in no such interval and leave before the
   sort.  Equal passages are one leaf; a leaf of several places is an interval.
4. Long repeats run through several bins; their spans meet again per document
   (``maximal`` finds their groups).

A passage that is repeated in very many documents does not grow a bin: a task
hands on each distinct passage once, for its least document, and knows by
itself that the other documents of that passage repeat a smaller one.  A k-gram
with very many *different* passages (a common phrase) is dealt window by window
instead, each to the bin of its own bytes; what such k-grams can number is
bounded (HEAVY_GRAMS).  The number of bins follows the bytes of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import binary_flat, flat, run_starts, slices
from kinweave.llm.rows import quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

LEAST = 50
GRAM = 20
#: Bytes of text after which a task hands on what it has listed, and what it has cut out; bytes that numpy takes at once.
FLUSH_BYTES = 12 << 20
PASS_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
#: Bytes of text per bin.
BIN_BYTES = 1 << 20
#: Different passages from which a k-gram is dealt window by window, and the most such k-grams (their list is broadcast).
HEAVY = 4096
HEAVY_GRAMS = 1 << 20
#: Occurrences of a k-gram in what a task hands on from which its different surroundings are counted.
COUNTED = 4
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at every place that has so many."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * _A
    h ^= h >> np.uint64(29)
    h += np.ndarray((n,), "<u8", data, 8, (1,))
    h *= _B
    h ^= h >> np.uint64(32)
    h += np.ndarray((n,), "<u4", data, 16, (1,))
    h *= _C
    h ^= h >> np.uint64(29)
    h *= _D
    return h


def passages(data: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, gram hash) of the runs of windows with one minimiser, in order.

    Of equal hashes in a window the leftmost counts, so the choice depends on
    the window's bytes alone.  Starts are places in ``data``.
    """
    nothing = np.zeros(0, np.int64)
    n = len(data) - least + 1
    if n <= 0:
        return nothing, nothing, nothing, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    packed = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
    width, have = least - GRAM + 1, 1
    while 2 * have <= width:
        packed = np.minimum(packed[:-have], packed[have:])
        have *= 2
    if width > have:
        packed = np.minimum(packed[: n], packed[width - have : width - have + n])
    place = (packed[:n] & ~_HIGH).astype(np.int64)
    inside = np.zeros(n, bool)
    first, end = offsets[:-1], offsets[1:] - least + 1
    edge = np.zeros(len(data) + 2, np.int8)
    long = end > first
    edge[first[long]] += 1
    edge[end[long]] -= 1
    inside[:] = np.cumsum(edge[:n], dtype=np.int8) > 0
    change = np.ones(n, bool)
    change[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n) - 1
    use = inside[starts]
    starts, ends = starts[use], ends[use]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends, h[place[starts]]


def _key(h: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each hash in the high 32 bits, and 32 more bits that tell those of a bin apart."""
    mixed = h * _B
    mixed ^= mixed >> np.uint64(31)
    b = (mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)
    return (b << np.uint64(32)) | (mixed & np.uint64(0xFFFFFFFF))


def _pack(*columns: np.ndarray) -> bytes:
    """Arrays as one cell, byte plane by byte plane, compressed if that pays, after their sizes."""
    raw = b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() if len(c) else b"" for c in columns)
    sizes = np.array([len(c) for c in columns] + [len(raw)], "<u4").tobytes()
    return sizes + (pa.compress(raw, codec="zstd", asbytes=True) if len(raw) > 256 else raw)


def _unpack(cell: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    *sizes, size = np.frombuffer(cell[: 4 * len(kinds) + 4], "<u4").tolist()
    raw = cell[4 * len(kinds) + 4 :]
    if size > 256:
        raw = pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at)
        out.append(planes.view(kind) if width == 1 else np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(-1))
        at += n * width
    return out


def _cells(column: pa.ChunkedArray, kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The arrays of all cells, back to back."""
    parts = [_unpack(x, kinds) for x in column.to_pylist()]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def _text_key(raw: np.ndarray) -> int:
    """Tells texts with the same id apart."""
    return xxhash.xxh3_64_intdigest(raw) & 0xFFFFFFFF


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes at every place, as an unaligned view."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _B
    return h ^ (h >> np.uint64(29))


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, size) with each text compressed."""
    codec = pa.Codec("zstd", compression_level=3)
    for batch in batches:
        raw = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
        cells = [codec.compress(x.as_buffer(), asbytes=True) for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.binary()), pc.binary_length(raw).cast(pa.int64())], ["doc_id", "text", "size"])


def _opened(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text, size, ...) with the texts as they were, in slices of ``most`` bytes of text or one row."""
    codec = pa.Codec("zstd")
    for batch in batches:
        sizes = batch.column(2).to_numpy()
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            part = batch.slice(at, to - at)
            texts = [codec.decompress(x.as_buffer(), decompressed_size=n, asbytes=True) if n else b"" for x, n in zip(part.column(1), sizes[at:to].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.large_binary()), *part.columns[3:]], [x for k, x in enumerate(batch.schema.names) if k != 2])
            at = to


def _flushes(parts: Iterator[pa.RecordBatch], text_at: int, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices in groups of about ``most`` bytes of text."""
    group, size = [], 0
    for batch in parts:
        group.append(batch)
        size += batch.column(text_at).nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


LISTED = ("<u4", "<i8", "<u2")


def candidates(docs: DataFrame, bins: int, least: int = LEAST, within: bool = False) -> DataFrame:
    """(doc_id, grams): the grams of a document, by 32 bits each, that may begin a repeat across documents,
    or with ``within`` any repeat.

    Rows without a document hold, as 64 bits and a count of 64 bits each, the
    grams with HEAVY different passages or more.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _flushes(slices(batches, 1, SLICE_BYTES), 1, FLUSH_BYTES):
            keys, ids, around = [], [], []
            for batch in group:
                data, offsets = flat(batch.column(1))
                text, first, last, h = passages(data, offsets, least)
                keys.append(_key(h, bins))
                ids.append(batch.column(0).to_numpy()[text])
                eights = _eights(data)
                around.append(_mixed(eights[first], eights[last + (least - 8)]) if len(first) else np.zeros(0, np.uint64))
            key, doc, around = np.concatenate(keys), np.concatenate(ids), np.concatenate(around)
            del keys, ids
            order = np.lexsort((doc, key))
            key, doc, around = key[order], doc[order], around[order]
            n_around = _different(key, around)
            if not within:
                once = np.ones(len(key), bool)
                once[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                key, doc = key[once], doc[once]
            starts = run_starts(key)
            sizes = np.diff(np.append(starts, len(key)))
            many = np.repeat(sizes > 1, sizes)
            yield from _grams_of(doc[many], key[many])
            # One document of each gram stands for the task; grams of several documents are known candidates but still tell other tasks.
            key, doc = key[starts], doc[starts]
            told = np.maximum(n_around, (sizes > 1).astype(np.uint16)) if len(starts) else n_around
            b = (key >> np.uint64(32)).astype(np.int64)
            low = (key & np.uint64(0xFFFFFFFF)).astype("<u4")
            cuts = run_starts(b)
            cells = [_pack(low[s:e], doc[s:e].astype("<i8"), told[s:e].astype("<u2")) for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(b)).tolist() if len(b) else [], strict=True)]
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts], pa.int64()), pa.nulls(n, pa.int64()), pa.array(cells, pa.binary())], ["bin", "doc_id", "grams"])

    def _different(key: np.ndarray, around: np.ndarray) -> np.ndarray:
        """For each run of keys how many different surroundings it has; 0 for runs of fewer than COUNTED."""
        starts = run_starts(key)
        sizes = np.diff(np.append(starts, len(key)))
        large = sizes >= COUNTED
        out = np.zeros(len(starts), np.uint16)
        if large.any():
            use = np.repeat(large, sizes)
            run, x = np.repeat(np.arange(int(large.sum())), sizes[large]), around[use]
            order = np.lexsort((x, run))
            run, x = run[order], x[order]
            new = np.ones(len(x), bool)
            new[1:] = (run[1:] != run[:-1]) | (x[1:] != x[:-1])
            out[large] = np.minimum(np.bincount(run[new]), 65535)
        return out

    def _grams_of(doc: np.ndarray, key: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(doc, kind="stable")
        doc, key = doc[order], key[order]
        cuts = run_starts(doc)
        if len(cuts):
            low = key.astype(np.uint32)  # enough within a document; what is met by chance is compared later on
            blobs = [low[s:e].tobytes() for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(doc)).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[cuts] % bins, pa.int64()), pa.array(doc[cuts], pa.int64()), pa.array(blobs, pa.binary())], ["bin", "doc_id", "grams"])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_valid(t.column("doc_id"))).select(["doc_id", "grams"])
        t = t.filter(pc.is_null(t.column("doc_id")))
        if not t.num_rows:
            return known
        low, doc, told = _cells(t.column("grams"), LISTED)
        order = np.argsort(low, kind="stable")
        low, doc, told = low[order], doc[order], told[order].astype(np.int64)
        starts = run_starts(low)
        sizes = np.diff(np.append(starts, len(low)))
        wanted = np.repeat((sizes > 1) | (np.maximum.reduceat(told, starts) > 0), sizes)
        gram = (np.uint64(key[0].as_py()) << np.uint64(32)) | low.astype(np.uint64)
        found = [x.select(["doc_id", "grams"]) for x in _grams_of(doc[wanted], gram[wanted])]
        total = np.add.reduceat(np.maximum(told, 1), starts)
        heavy = np.flatnonzero(total >= HEAVY)
        if len(heavy):
            cell = np.stack([gram[starts[heavy]].view(np.int64), total[heavy]]).astype("<i8").tobytes()
            found.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([cell], pa.binary())], ["doc_id", "grams"]))
        return pa.concat_tables([known, pa.Table.from_batches(found)]) if found else known

    # Known candidates pass through the bins as well, so one shuffle carries all.
    listed = docs.mapInArrow(scan, "bin long, doc_id long, grams binary")
    return listed.groupBy("bin").applyInArrow(meet, "doc_id long, grams binary")


def _heavy_grams(found: DataFrame, most: int = HEAVY_GRAMS) -> np.ndarray:
    """The grams with the most different passages, sorted; ``most`` at most, so a lesser one has at most (all passages) / ``most``."""
    counted, kept = found.filter("doc_id is null").select("grams"), np.zeros((2, 0), np.int64)
    for r in counted.toLocalIterator():
        kept = np.concatenate([kept, np.frombuffer(bytes(r["grams"]), "<i8").reshape(2, -1)], 1)
        if kept.shape[1] > 2 * most:
            kept = kept[:, np.argsort(-kept[1], kind="stable")[:most]]
    kept = kept[:, np.argsort(-kept[1], kind="stable")[:most]]
    return np.sort(kept[0].view(np.uint64))


def maximal_intervals(prefix: np.ndarray, before: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, length) of the intervals that are maximal repeats, by a stack scan.

    Of the sorted suffixes, ``prefix`` is what each has in common with the one
    before it, and ``before`` the byte that precedes it.
    """
    out: list[tuple[int, int, int]] = []
    prefix = prefix.tolist()
    prefix.append(0)
    n = len(prefix)
    # Places where the byte before a suffix is not that of its neighbour: an interval is diverse if it holds one.
    diverse = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])]).tolist() if len(before) else []
    stack: list[tuple[int, int]] = []
    for i in range(1, n):
        p = prefix[i]
        if p < least:
            if not stack:
                continue
            p = 0
        left = i - 1
        while stack and stack[-1][0] > p:
            length, left = stack.pop()
            if diverse[i - 1] > diverse[left]:
                out.append((left, i - 1, length))
        if p and (not stack or stack[-1][0] < p):
            stack.append((p, left))
    found = np.array(out, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


class Bin:
    """Passages of one bin: the suffix array of their window starts and its interval tree."""

    def __init__(self, data: np.ndarray, base: np.ndarray, lengths: np.ndarray, starts: np.ndarray, least: int):
        """Distinct passages at ``base`` of ``data`` (which has room behind them), of which the first ``starts`` places are windows."""
        self.least = least
        longest = int(lengths.max())
        words = (longest + 7) // 8
        of = np.repeat(np.arange(len(base)), starts)
        offset = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
        at = base[of] + offset
        little = _eights(data)
        # Suffixes meet by the hash of their first bytes; those that cannot be in a maximal interval go.
        h = np.zeros(len(at), np.uint64)
        for k in [*range(0, least - 7, 8), least - 8]:
            h = _mixed(h, little[at + k])
        order = np.argsort(h, kind="stable")
        h, of, offset, at = h[order], of[order], offset[order], at[order]
        before = np.where(offset == 0, -1 - np.arange(len(at)), data[np.maximum(at - 1, 0)].astype(np.int64))  # the start of a passage differs from all
        runs = run_starts(h)
        sizes = np.diff(np.append(runs, len(h)))
        differs = before != np.repeat(before[runs], sizes)
        use = np.repeat(np.logical_or.reduceat(differs, runs), sizes)
        of, offset, at, before = of[use], offset[use], at[use], before[use]
        size = lengths[of] - offset
        eights = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))
        keys = []
        for w in range(words):
            left = np.clip(size - 8 * w, 0, 8).astype(np.uint64)
            x = eights[np.minimum(at + 8 * w, len(eights) - 1)].astype(np.uint64)
            mask = np.where(left > 0, ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(left, np.uint64(1)))), np.uint64(0))
            keys.append(x & mask)
        order = np.lexsort([size, *keys[::-1]])
        self.of, self.offset, size = of[order], offset[order], size[order]
        common = np.zeros(len(order), np.int64)
        open_ = np.ones(max(0, len(order) - 1), bool)
        for w in range(words):
            k = keys[w][order]
            x = k[1:] ^ k[:-1]
            same = x == 0
            lead = np.zeros(len(x), np.int64)
            if (~same).any():
                high = x[~same]
                bits = np.zeros(len(high), np.int64)
                for s in (32, 16, 8):
                    top = high >> np.uint64(64 - s)
                    none = top == 0
                    bits[none] += s
                    high = np.where(none, high << np.uint64(s), high)
                lead[~same] = bits // 8
            common[1:] += np.where(open_, np.where(same, 8, lead), 0)
            open_ &= same
        self.prefix = np.minimum(common, np.concatenate([[0], np.minimum(size[1:], size[:-1])])) if len(order) else common
        self.before = before[order]


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each, ``count`` long."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


SPANS = "doc_id long, text_key long, start int, length int"
_SPAN_NAMES = ["doc_id", "text_key", "start", "length"]
_SPAN_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
#: Of the distinct passages of a cell: bytes, 24 of the gram's bits, places; of their places: document, text and start; the bytes.
PASSED = ("<u2", "<u4", "<u4", "<i8", "<u4", "<u4", "u1")
_GRAM_BITS = np.uint64(0xFFFFFF)


def _span_rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
    """Spans, those of a text that touch as one, in order."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], (start + length)[order]
    if len(doc):
        text = np.ones(len(doc), np.int64)
        text[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
        # Ends as far as they have come: texts are kept apart by a number larger than any end.
        room = int(end.max()) + 1
        reach = np.maximum.accumulate(end + np.cumsum(text) * room)
        opens = np.ones(len(doc), bool)
        opens[1:] = (text[1:] == 1) | (start[1:] + np.cumsum(text)[1:] * room > reach[:-1])
        at = np.flatnonzero(opens)
        last = np.append(at[1:], len(doc)) - 1
        doc, key, start, end = doc[at], key[at], start[at], reach[last] - np.cumsum(text)[last] * room
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))], _SPAN_NAMES)


#: What is left of eight bytes of which so many count.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _padded(data: np.ndarray, base: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The passages at ``base`` as rows of ``width`` bytes, zero behind their ends, in words of eight; ``data`` has room behind it."""
    eights = _eights(data)
    rows = np.empty((len(base), width // 8), np.uint64)
    for w in range(width // 8):
        rows[:, w] = eights[base + 8 * w] & _HEADS[np.clip(sizes - 8 * w, 0, 8)]
    return rows


def _row_hash(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    h = sizes.astype(np.uint64)
    for w in range(rows.shape[1]):
        h = _mixed(h, rows[:, w])
    return h


def _width(least: int) -> int:
    """Bytes of a row that holds any passage."""
    return (2 * least - GRAM + 7) // 8 * 8


def _flat_rows(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of padded passages back to back."""
    raw = rows.view(np.uint8).reshape(len(rows), -1)
    return raw[np.arange(raw.shape[1]) < sizes[:, None]]


class Met:
    """The passages of a bin, equal ones as one, with their places, and the tree's maximal repeats."""

    def __init__(self, cells: pa.ChunkedArray, least: int):
        sizes, low, places, doc, key, at, content = _cells(cells, PASSED)
        sizes, places = sizes.astype(np.int64), places.astype(np.int64)
        data = np.concatenate([content, np.zeros(_width(least) + 8, np.uint8)])
        base = np.cumsum(sizes) - sizes
        rows = _padded(data, base, sizes, _width(least))
        h = _row_hash(rows, sizes)
        order = np.lexsort((h, low))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (low[a] != low[b]) | (h[a] != h[b]) | (sizes[a] != sizes[b]) | (rows[a] != rows[b]).any(1)
        owner = np.empty(len(order), np.int64)
        owner[order] = np.cumsum(new) - 1
        del rows
        heads = order[new]
        self.sizes, base, low = sizes[heads], base[heads], low[heads]
        owner = np.repeat(owner, places)
        order = np.argsort(owner, kind="stable")
        owner, self.doc, self.key, self.at = owner[order], doc[order], key[order].astype(np.int64), at[order].astype(np.int64)
        self.first = np.searchsorted(owner, np.arange(len(heads)))
        self.count = np.diff(np.append(self.first, len(owner)))
        self.smallest, self.largest = np.minimum.reduceat(self.doc, self.first), np.maximum.reduceat(self.doc, self.first)
        # A gram with one passage is one leaf; others are sorted as suffixes.
        grams = run_starts(low)
        n = np.diff(np.append(grams, len(low)))
        self.several = np.flatnonzero(np.repeat(n > 1, n))
        self.tree = Bin(data, base[self.several], self.sizes[self.several], self.sizes[self.several] - least + 1, least) if len(self.several) else None

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, offset in it, length): occurrences of the maximal repeats.

        Those of a document larger than the repeat's least one.
        """
        out: list[tuple[np.ndarray, ...]] = []
        leaf = np.flatnonzero(self.smallest < self.largest)
        if len(leaf):
            n = self.count[leaf]
            which = _expand(self.first[leaf], n)
            out.append((which, np.zeros(len(which), np.int64), np.repeat(self.sizes[leaf], n), np.repeat(self.smallest[leaf], n)))
        if self.tree is not None:
            lo, hi, length = maximal_intervals(self.tree.prefix, self.tree.before, self.tree.least)
            if len(lo):
                n = hi - lo + 1
                suffix = _expand(lo, n)
                of = self.several[self.tree.of[suffix]]
                low = np.minimum.reduceat(self.smallest[of], np.cumsum(n) - n)
                m = self.count[of]
                which = _expand(self.first[of], m)
                spread = lambda v: np.repeat(v, m)
                out.append((which, spread(self.tree.offset[suffix]), spread(np.repeat(length, n)), spread(np.repeat(low, n))))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        which, offset, length, low = (np.concatenate(x) for x in zip(*out, strict=True))
        use = self.doc[which] > low
        return which[use], offset[use], length[use]


def _cut_out(bins: int, least: int, heavy):
    """The function that turns (doc_id, text, grams) into cells of passages by bin, and sure spans by document."""
    names = ["bin", "passages", *_SPAN_NAMES]
    width = _width(least)

    def of_slice(batch: pa.RecordBatch, common: np.ndarray) -> tuple[np.ndarray, ...] | None:
        data, offsets = flat(batch.column(1))
        text, first, last, h = passages(data, offsets, least)
        g = _key(h, bins)
        lists = batch.column(2)
        grams, n = binary_flat(lists.flatten())
        per_doc = np.add.reduceat(np.append(n, 0), lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()) * (np.diff(lists.offsets.to_numpy()) > 0)
        own = (np.repeat(np.arange(len(lists), dtype=np.uint64), per_doc // 4) << np.uint64(32)) | grams.view("<u4")
        use = np.isin((text.astype(np.uint64) << np.uint64(32)) | (g & np.uint64(0xFFFFFFFF)), own)
        text, first, last, g = text[use], first[use], last[use], g[use]
        if not len(text):
            return None
        room = np.concatenate([data, np.zeros(width, np.uint8)])
        split = np.isin(g, common) if len(common) else np.zeros(len(g), bool)
        if split.any():  # each window of a heavy gram is a passage of its own, keyed by its own bytes
            n = (last - first + 1)[split]
            starts = _expand(first[split], n)
            eights, h = _eights(room), np.zeros(len(starts), np.uint64)
            for k in [*range(0, least - 7, 8), least - 8]:
                h = _mixed(h, eights[starts + k])
            text, g = np.concatenate([text[~split], np.repeat(text[split], n)]), np.concatenate([g[~split], _key(h, bins)])
            first, last = np.concatenate([first[~split], starts]), np.concatenate([last[~split], starts])
        sizes = last - first + least
        keys = np.zeros(batch.num_rows, np.int64)
        for k in np.unique(text).tolist():
            keys[k] = _text_key(data[offsets[k] : offsets[k + 1]])
        return g, sizes, _padded(room, first, sizes, width), batch.column(0).to_numpy()[text], keys[text], first - offsets[text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = heavy.value
        for group in _flushes(_opened(batches), 1, PASS_BYTES):
            parts = [x for batch in group if (x := of_slice(batch, common)) is not None]
            if not parts:
                continue
            g, sizes, rows, doc, key, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            h = _row_hash(rows, sizes)
            order = np.lexsort((at, doc, h, g))
            g, sizes, doc, key, at, h = (x[order] for x in (g, sizes, doc, key, at, h))
            rows = rows[order]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (sizes[1:] != sizes[:-1]) | (rows[1:] != rows[:-1]).any(1)
            heads = np.flatnonzero(new)
            # The places of a passage beyond its least document here repeat that document.
            kept = doc == doc[heads][np.cumsum(new) - 1]
            if not kept.all():
                sure = _span_rows(*(x[~kept] for x in (doc, key, at, sizes)))
                n = sure.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(sure.column(0).to_numpy() % bins, pa.int64()), pa.nulls(n, pa.binary()), *sure.columns], names)
            places = np.add.reduceat(kept.astype(np.int64), heads)
            ends = np.cumsum(places)
            b = (g[heads] >> np.uint64(32)).astype(np.int64)
            # Within a bin passages go by text and place: that compresses well.
            order = np.lexsort((at[heads], doc[heads], b))
            which = np.flatnonzero(kept)[_expand((ends - places)[order], places[order])]
            heads, places, b = heads[order], places[order], b[order]
            ends = np.cumsum(places)
            doc, key, at = doc[which].astype("<i8"), key[which].astype("<u4"), at[which].astype("<u4")
            low, sizes, rows = (g[heads] & _GRAM_BITS).astype("<u4"), sizes[heads], rows[heads]
            content, to = _flat_rows(rows, sizes), np.cumsum(sizes)
            cuts = run_starts(b)
            cells = []
            for s, e in zip(cuts.tolist(), np.append(cuts[1:], len(b)).tolist(), strict=True):
                p, q = int(ends[s] - places[s]), int(ends[e - 1])
                cells.append(_pack(sizes[s:e].astype("<u2"), low[s:e], places[s:e].astype("<u4"), doc[p:q], key[p:q], at[p:q], content[int(to[s] - sizes[s]) : int(to[e - 1])]))
            n = len(cells)
            yield pa.RecordBatch.from_arrays([pa.array(b[cuts], pa.int64()), pa.array(cells, pa.binary()), *(pa.nulls(n, t) for t in _SPAN_TYPES)], names)

    return run


def _dealt(docs: DataFrame) -> DataFrame:
    """Texts by id, compressed: written once, read by both joins that need texts."""
    squeezed = docs.select("doc_id", "text").mapInArrow(_squeezed, "doc_id long, text binary, size long")
    # An inner join asks for this filter; with it here, both uses have one plan and Spark one exchange.
    return squeezed.filter("doc_id is not null").repartition("doc_id")


def _bins(docs: DataFrame) -> int:
    """The number of bins: as many as the bytes of all texts ask for."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BIN_BYTES))


def _met(docs: DataFrame, least: int, bins: int | None) -> DataFrame:
    """Passages of all documents with candidates, in cells by bin, beside the spans that are sure."""
    bins = bins or _bins(docs)
    found = cut(candidates(docs, bins, least))
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy_grams(found))
    wanted = found.filter("doc_id is not null").groupBy("doc_id").agg(F.collect_list("grams").alias("grams"))
    texts = _dealt(docs).join(wanted, "doc_id").select("doc_id", "text", "size", "grams")
    return texts.mapInArrow(_cut_out(bins, least, heavy), f"bin long, passages binary, {SPANS}")


def spans(docs: DataFrame, least: int = LEAST, bins: int | None = None) -> DataFrame:
    """(doc_id, text_key, start, length): what occurrences of maximal repeats of a document of smaller id cover, in bytes.

    ``docs`` is (doc_id long, text), ids not null.
    """
    def meet(key: tuple, t: pa.Table) -> pa.Table:
        known = t.filter(pc.is_valid(t.column("doc_id"))).select(_SPAN_NAMES)
        t = t.filter(pc.is_valid(t.column("passages")))
        if not t.num_rows:
            return known
        met = Met(t.column("passages"), least)
        which, offset, length = met.spans()
        rows = _span_rows(met.doc[which], met.key[which], met.at[which] + offset, length)
        return pa.concat_tables([known, pa.Table.from_batches([rows])])

    return _met(docs, least, bins).groupBy("bin").applyInArrow(meet, SPANS)


def without_repeats(docs: DataFrame, least: int = LEAST, bins: int | None = None, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): texts without the bytes that repeat a document of smaller id.

    A byte goes if a string of ``least`` bytes that covers it also starts in a
    document of smaller id; strings are judged on the input.  ``kept`` is the
    remaining bytes, or their SHA-256 in lower-case hex with ``digest``.  Ids
    are whole numbers (others fail in a cast).  A null text is empty; a row
    whose id is null is neither cut nor compared; rows that share an id do not
    cut each other; other columns are ignored; an empty table gives no rows.
    """
    # An id that needs no cast gets no alias either: the two uses of the dealt texts are then one exchange to Spark.
    plain = id_col == "doc_id" and docs.schema[id_col].dataType.typeName() == "long"
    own = F.col(id_col) if plain else quoted(id_col).cast("long").alias("doc_id")
    rows = docs.select(own, F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    named = rows.filter("doc_id is not null")
    found = spans(named, least, bins)
    per_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("text_key", "start", "length")).alias("spans"))

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _opened(batches):
            data, offsets = flat(batch.column(1))
            lists = batch.column(2)
            cells = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            if lists.null_count:
                sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
            row = np.repeat(np.arange(len(sizes)), sizes)
            gone = np.zeros(len(data), bool)
            if len(row):
                keys = np.zeros(len(sizes), np.int64)
                for k in np.flatnonzero(sizes).tolist():
                    keys[k] = _text_key(data[offsets[k] : offsets[k + 1]])
                mine = cells.field(0).to_numpy() == keys[row]
                begin = (cells.field(1).to_numpy() + offsets[row])[mine]
                stop = begin + cells.field(2).to_numpy()[mine]
                edge = np.bincount(begin, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
                gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = np.diff(total[offsets])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            opens[inner] = gone[inner]
            n_spans = np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets])
            left, at = data[~gone] if len(row) else data, offsets - total[offsets]
            kept = [left[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            kept = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()) if digest else pa.array([x.tobytes() for x in kept], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (np.diff(offsets), removed, n_spans)), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    # Rows without an id need no Python: a second Python step in a task would be a second worker's memory.
    raw = F.col("text").cast("binary")
    whole = F.sha2(raw, 256) if digest else raw
    unnamed = rows.filter("doc_id is null").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), whole.alias("kept"))
    joined = _dealt(named).join(per_doc, "doc_id", "left").select("doc_id", "text", "size", "spans")
    return joined.mapInArrow(drop, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if digest else 'binary'}").union(unnamed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")
