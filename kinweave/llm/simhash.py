"""SimHash near-duplicates with pigeonring filtering (operator 7).

Fingerprints of equal bits are collapsed first.  The distinct ones meet in
buckets of exactly equal key bits; the pairs of a bucket pass the pigeonring
filter and then the full Hamming check; each task turns the links that it finds
into a spanning forest, so what it emits is linear in what it reads; components
are found over those edges.

Pigeonring: cut a fingerprint into m segments on a ring.  If two fingerprints
differ in at most t bits, there is a segment from which every chain of l
consecutive segments has at most l * t / m differing bits.  For the contract's
64 bits, t = 3 and m = 8 the first two segments of such a chain are equal and the
next three have one differing bit at most, hence two of these three are equal
too: 8 starts times 3 choices give 24 keys of 32 equal bits that lose no pair.

Buckets of more than ``HEAVY`` fingerprints are not compared in the task that
meets them: their members are passed on, dealt into chunks, and every pair of
chunks is compared by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import run_starts, slices, texts
from kinweave.operators.components import connected_components
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

SEED = 42
HEAVY = 4096
SMALL = 24
#: Shingles whose bits are added up at once.
STEP = 1 << 16


def _second(h: np.ndarray) -> np.ndarray:
    """64 more bits from each hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str, shingle: int, words_of_bits: int = 1) -> bytes:
    """The fingerprint of a text, 8 bytes (big-endian) per word of bits; zero without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8 * words_of_bits)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    width = min(shingle, len(words))
    hash_of = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    counts = np.zeros(64 * words_of_bits, np.int64)
    for k in range(0, n, STEP):
        h = np.array([hash_of(joined[a : b - 1], SEED) for a, b in zip(starts[k : min(k + STEP, n)], ends[k + width - 1 :], strict=False)], np.uint64)
        for w in range(words_of_bits):
            if w:
                h = _second(h)
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts[64 * w : 64 * w + 64] += bits.sum(0, dtype=np.int64)
    packed = np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")
    return packed.astype(">u8").tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3, words_of_bits: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp binary) of every whole text; a null text has no words."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = [fingerprint(t, shingle, words_of_bits) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {id_type}, fp binary")


class Scheme:
    """How fingerprints are keyed, filtered and compared.

    ``keys`` are lists of (first bit, bits) whose values make up a key, of 40
    bits at most together.
    """

    def __init__(self, words_of_bits: int, distance: int, segments: int, keys: list[list[tuple[int, int]]]):
        self.words, self.distance, self.segments, self.keys = words_of_bits, distance, segments, keys

    def key_values(self, fps: np.ndarray) -> np.ndarray:
        """(fingerprints, keys): the keys of each fingerprint, told apart by their number in the high bits."""
        out = np.empty((len(fps), len(self.keys)), np.int64)
        for k, parts in enumerate(self.keys):
            key = np.full(len(fps), k, np.uint64)
            for bit, width in parts:
                piece = (fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64((1 << width) - 1)
                key = (key << np.uint64(width)) | piece
            out[:, k] = key.view(np.int64)
        return out

    def linked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of rows differ in at most ``distance`` bits."""
        if not len(a):
            return np.zeros(0, bool)
        x = a ^ b
        m, t = self.segments, self.distance
        parts = np.bitwise_count(np.ascontiguousarray(x).view(f"<u{64 * self.words // m // 8}")).reshape(len(x), m)
        ring = np.zeros((m + m // 2, len(x)), np.uint8)
        ring[:m], ring[m:] = parts.T, parts.T[: m // 2]
        chain = np.zeros(len(x), bool)
        for s in range(m):
            total = ring[s].copy()
            ok = total <= t // m
            for length in range(2, m // 2 + 1):
                total += ring[s + length - 1]
                ok &= total <= length * t // m
            chain |= ok
        at = np.flatnonzero(chain)
        out = np.zeros(len(x), bool)
        out[at] = parts[at].sum(1, dtype=np.int64) <= t
        return out


def contract_scheme() -> Scheme:
    """64 bits, 3 differing: complete."""
    seg = lambda i: (8 * (i % 8), 8)
    return Scheme(1, 3, 8, [[seg(i), seg(i + 1), *(seg(i + k) for k in pair)] for i in range(8) for pair in ((2, 3), (2, 4), (3, 4))])


def similarity_scheme(similarity: float = 0.8, tables: int = 120, seed: int = 7) -> Scheme:
    """256 bits of which a share ``similarity`` agrees: ``tables`` keys of 18 seeded bits (nine pairs of neighbours).

    This is no bound on the texts: 0.8 of the bits agree at a Jaccard similarity
    of about 0.68 (the pipeline uses ``jaccard`` instead).
    A pair that differs in d bits meets in a table with probability
    (1 - d / 256) ** 18.  With 120 tables that finds 0.99 of the pairs at d = 39,
    where texts with a Jaccard similarity of 0.8 lie on average, and 0.88 of
    those at the bound of 51; groups of copies are linked through any of their
    members.  Unrelated fingerprints meet N * tables / 2 ** 18 times each.
    """
    rng = np.random.default_rng(seed)
    groups = [[(2 * int(g), 2) for g in sorted(rng.choice(128, 9, replace=False))] for _ in range(tables)]
    return Scheme(4, int(256 * (1 - similarity) + 1e-9), 16, groups)


def _as_words(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its tree) that connect what the pairs connect."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[off], nodes[label[off]]


def _spread(scheme, fps: np.ndarray, reps: np.ndarray, far: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links among the rows connect, or with ``far`` the links between its two sides.

    Each row is compared with the rows not yet reached, so a group of rows that
    are all alike costs its size, not its square.
    """
    unmet = np.ones(len(reps), bool)
    sides = [np.arange(len(reps))] * 2 if far is None else [np.flatnonzero(far), np.flatnonzero(~far)]
    a, b = [], []
    for seed in range(len(reps)):
        if not unmet[seed]:
            continue
        unmet[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            k = 0 if far is None else int(far[x])
            others = sides[k] = sides[k][unmet[sides[k]]]  # rows of the other side
            if far is None:
                sides = [others] * 2
            if not len(others):
                continue
            near = others[scheme.linked(np.broadcast_to(fps[x], (len(others), fps.shape[1])), fps[others])]
            if len(near):
                unmet[near] = False
                queue.extend(near.tolist())
                a.append(np.full(len(near), reps[x]))
                b.append(reps[near])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *a]), np.concatenate([nothing, *b])


def _bucket_links(scheme: Scheme, keys: np.ndarray, fps: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within whole buckets; rows are sorted by key."""
    starts = run_starts(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = sizes <= SMALL
    left_in = np.where(np.repeat(small, sizes), np.repeat(starts + sizes, sizes) - np.arange(len(keys)) - 1, 0)
    for s in range(1, SMALL):
        i = np.flatnonzero(left_in >= s)
        if not len(i):
            break
        ok = scheme.linked(fps[i], fps[i + s])
        a.append(reps[i[ok]])
        b.append(reps[i[ok] + s])
    for k in np.flatnonzero(~small):
        rows = slice(starts[k], starts[k] + sizes[k])
        f = _spread(scheme, fps[rows], reps[rows])
        a.append(f[0])
        b.append(f[1])
    return forest(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def links(groups: DataFrame, scheme: Scheme, heavy_rows: int = HEAVY) -> DataFrame:
    """(a, b): edges between representatives that connect all linked fingerprints.

    ``groups`` is (fp, rep) with distinct fingerprints; buckets of more than
    ``heavy_rows`` are compared in pairs of chunks.
    """
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(scheme.keys)
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = scheme.key_values(_as_words(part.column(0), scheme.words)).ravel()
                take = pa.array(np.repeat(np.arange(part.num_rows), n))
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column(0).take(take), part.column(1).take(take)], ["key", "fp", "rep"])

    keyed = groups.filter("rep is not null").select("fp", F.col("rep").cast("long").alias("rep")).mapInArrow(key, "key long, fp binary, rep long")
    return keyed_links(keyed, scheme, heavy_rows)


def keyed_links(keyed: DataFrame, scheme, heavy_rows: int = HEAVY) -> DataFrame:
    """The same for (key, fp, rep); ``scheme`` says how many words of bits a fingerprint has and which pairs are linked."""
    # What has no partner in a bucket and what is passed on share one schema: an edge has no fp.
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that the last batch ended with
        n_held, heavy = 0, None

        def emit(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = rows.column(0).to_numpy()
            starts = run_starts(keys)
            sizes = np.diff(np.append(starts, len(keys)))
            big = np.repeat(sizes > heavy_rows, sizes)
            alone = np.repeat(sizes == 1, sizes)
            use = ~big & ~alone
            if use.any():
                fps = _as_words(rows.column(1).combine_chunks(), scheme.words)
                a, b = _bucket_links(scheme, keys[use], fps[use], rows.column(2).to_numpy()[use])
                yield edge_batch(a, b)
            if big.any():
                yield from passed(rows.filter(pa.array(big)))

        def passed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for part in rows.combine_chunks().to_batches():
                nothing = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([nothing, nothing, part.column(0), part.column(1), part.column(2)], ["a", "b", "key", "fp", "rep"])

        def edge_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            nothing = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nothing, pa.nulls(len(a), pa.binary()), nothing], ["a", "b", "key", "fp", "rep"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            if heavy is not None:  # the rest of a key that is already known to be heavy
                to = int(np.searchsorted(keys, heavy, "right"))
                if to:
                    yield from passed(pa.Table.from_batches([batch.slice(0, to)]))
                if to == batch.num_rows:
                    continue
                heavy, batch, keys = None, batch.slice(to), keys[to:]
            at = int(np.searchsorted(keys, keys[-1], "left"))
            if at:
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held, n_held = [], 0
            elif held and held[-1].column(0)[0].as_py() != keys[-1]:
                yield from emit(pa.Table.from_batches(held))
                held, n_held = [], 0
            held.append(batch.slice(at))
            n_held += batch.num_rows - at
            if n_held > heavy_rows:
                yield from passed(pa.Table.from_batches(held))
                heavy, held, n_held = int(keys[-1]), [], 0
        if held:
            yield from emit(pa.Table.from_batches(held))

    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, key long, fp binary, rep long")
    met = cut(met)
    found = met.filter("fp is null").select("a", "b")

    rest = met.filter("fp is not null").select("key", "fp", "rep")
    if rest.isEmpty():
        return found
    chunks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / heavy_rows).cast("int").alias("n"))
    dealt = rest.join(chunks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("far"), "fp", "rep")

    def across(key: tuple, t: pa.Table) -> pa.Table:
        fps, reps = _as_words(t.column("fp").combine_chunks(), scheme.words), t.column("rep").to_numpy()
        far = t.column("far").to_numpy()
        same = key[1].as_py() == key[2].as_py()
        a, b = _spread(scheme, fps, reps, None if same else far)
        return pa.table({"a": a, "b": b})

    return found.union(dealt.groupBy("key", "lo", "hi").applyInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 3, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text", heavy_rows: int = HEAVY) -> DataFrame:
    """(doc_id, fp, component_id): the fingerprint and the least id reachable over links, per row.

    Ids are whole numbers.  Texts without words have fingerprint zero and are
    linked like any other; null texts have no words.  Rows that share an id are
    one document.  A row whose id is null gets the least id of its fingerprint's
    group (null if there is none).  Other columns are ignored; an empty table
    gives no rows.
    """
    scheme = scheme or contract_scheme()
    prints = cut(fingerprints(docs, shingle, scheme.words, id_col, text_col))
    groups = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(groups, scheme, heavy_rows))
    classes = groups.join(roots, groups["rep"] == roots["vertex"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
