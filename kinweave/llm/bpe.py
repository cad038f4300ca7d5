"""Byte-level BPE encoding and decoding (operator 9) on padded numpy matrices.

The pieces of a batch that are not in the worker's cache are put in buckets by
length.  A bucket is one matrix, a row per piece, padded at the right; in each
round every row that still can merges its leftmost pair of least rank, and the
row is compacted.  Ranks of pairs come from an open-addressing hash table of
(left id, right id).  Pieces longer than the widest bucket keep the same merge
order with a heap, so that a very long piece costs n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices, texts
from kinweave.plans.tables import table

#: Widths of the buckets; a longer piece is merged by a heap.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
#: Pieces that a worker remembers at most.
CACHE = 400_000
NONE = np.int32(2**31 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of byte strings, with the pair table."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {r: b for b, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs))))) + 2)
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        key = (left << 32) | right
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            self.keys[slot[free]] = key[free]  # of several, the last stays
            won = free[self.keys[slot[free]] == key[free]]
            self.values[slot[won]] = merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, which is its rank; NONE where it doesn't."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        key = key.ravel()
        flat = out.ravel()
        slot = self._slot(key[todo])
        while len(todo):
            found = self.keys[slot]
            hit = found == key[todo]
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(out.shape)

    def merge_bucket(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """The ids of pieces of at most ``width`` bytes."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids[np.arange(width) < lengths[:, None]] = self.single[raw]
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        rows = np.arange(n)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            at = ranks.argmin(1)
            least = ranks[np.arange(len(rows)), at]
            going = least != NONE
            if not going.all():
                done.append((rows[~going], ids[~going]))
                rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
            if not len(rows):
                break
            k = np.arange(len(rows))
            # Compact: what stands right of the pair moves one place left.
            move = np.arange(ids.shape[1]) > at[:, None]
            shifted = np.c_[ids[:, 1:], np.full(len(k), -1, np.int32)]
            ids = np.where(move, shifted, ids)
            ids[k, at] = least
            if ids.shape[1] > 1:
                shifted = np.c_[ranks[:, 1:], np.full(len(k), NONE, np.int32)]
                ranks = np.where(move[:, :-1], shifted, ranks)
                has = at + 1 < ids.shape[1]
                ranks[k[has], at[has]] = self.pair_ranks(ids[k[has], at[has]], ids[k[has], at[has] + 1])
                has = at > 0
                ranks[k[has], at[has] - 1] = self.pair_ranks(ids[k[has], at[has] - 1], ids[k[has], at[has]])
            width_now = int((ids >= 0).sum(1).max())
            ids, ranks = ids[:, :max(2, width_now)], ranks[:, : max(1, width_now - 1)]
        out: list[list[int]] = [[]] * n
        for which, matrix in done:
            counts = (matrix >= 0).sum(1).tolist()
            for i, row, c in zip(which.tolist(), matrix.tolist(), counts, strict=True):
                out[i] = row[:c]
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length, by a heap of (rank, place)."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        ranks, texts_of = self.ranks, self.bytes
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := ranks.get(texts_of[ids[x]] + texts_of[ids[y]])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; a piece that is in the vocabulary is one token."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[k] = [r]
            elif len(p) > WIDTHS[-1]:
                out[k] = self.merge_long(p)
            else:
                buckets.setdefault(next(w for w in WIDTHS if len(p) <= w), []).append(k)
        for width, at in buckets.items():
            step = max(256, (1 << 19) // width)
            for s in range(0, len(at), step):
                part = at[s : s + step]
                for k, ids in zip(part, self.merge_bucket([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file of base64 strings and ranks; read once per worker."""
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())})


class Encoder:
    """Splits texts by a pattern and encodes the pieces, remembering what it has met."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[int, str, bytes]] = {}

    def pieces(self, rows: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards each is in ``known`` as (tokens, joined ids, decoded bytes)."""
        split = [self.split(t) for t in rows]
        new = list(set().union(*split) - self.known.keys())
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(set().union(*split))
        voc = self.vocabulary
        for p, ids in zip(new, voc.encode_pieces([p.encode("utf-8", "surrogatepass") for p in new]), strict=True):
            self.known[p] = (len(ids), ",".join(map(str, ids)), voc.decode(ids))
        return split


def default_file() -> tuple[str, str]:
    """The rank file of the installed public vocabularies, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the tokens of every whole text.

    A null or empty text has no tokens.  Equal rows are encoded alike, other
    columns are ignored, an empty table gives no rows.  ``path`` is a rank file
    that every worker can read; ``pattern`` splits texts before the merges.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        for batch in slices(batches, 1):
            ids = []
            for pieces in encoder.pieces(texts(batch.column(1))):
                joined = ",".join(encoder.known[p][1] for p in pieces)
                ids.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {id_type}, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes): the decoded bytes of arrays of ids; null ids decode to nothing."""
    rows = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for batch in batches:
            out = [voc.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return rows.mapInArrow(run, f"doc_id {id_type}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip) of every whole text, encoded and decoded in one pass.

    The rules for nulls, repeats and other columns are those of ``encode``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
        for batch in slices(batches, 1):
            rows_of = texts(batch.column(1))
            columns: tuple[list, ...] = ([], [], [], [])
            for text, pieces in zip(rows_of, encoder.pieces(rows_of), strict=True):
                found = [encoder.known[p] for p in pieces]
                decoded = b"".join([x[2] for x in found])
                columns[0].append(sum([x[0] for x in found]))
                columns[1].append(hashlib.sha256(",".join([x[1] for x in found]).encode()).hexdigest())
                columns[2].append(hashlib.sha256(decoded).hexdigest())
                columns[3].append(decoded == text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *map(pa.array, columns[1:3]), pa.array(columns[3], pa.bool_())], names)

    return rows.mapInArrow(run, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_file())
