"""Jaccard self-join of documents on word n-grams (operator 11).

Token-combination prefixes.  The shingles of a document are its tokens; all
documents order them alike, rare ones first.  A rare token is a key by itself.
Tokens that many documents hold are dealt into groups by their hash, and the
keys are combinations: two tokens of one group together for frequent tokens,
three for very frequent ones.  A prefix is extended until it can spare what a
pair may differ in: each of its tokens counts one, but of a group of
k-combinations the first k - 1 count nothing.  Take two sets of similarity t or more
and the prefix that ends first: at most n - ceil(t * n) of its tokens are not
in the other set, so if it counts one more than that, some group has k tokens
that both hold, and these are in the other prefix too: the pair meets in a key.

Keys that one document alone has go away by their count.  In what is left, the
sizes and the parity bitmaps of two sets rule a pair out; all that is not
ruled out is compared by the shingles themselves, as pairs.  That is done in
rounds, so that a group of n alike documents costs no n * n pairs: at first each
bucket only gives a forest of links that the bitmaps make likely, which are
verified and joined to components; then documents of different components are
linked likewise; in the last round every pair of different components that
isn't ruled out is verified.  Buckets are dealt into chunks, and pairs of
chunks, by the count of their key.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import run_starts, slices
from kinweave.llm.jaccard import COUNT_BYTES, by_frequency, sets_of, told_apart
from kinweave.llm.rows import quoted
from kinweave.operators.components import connected_components
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

#: Documents of one task, and of all, in which a token is frequent; and very frequent.
FREQUENT_HERE = 3
FREQUENT_DOCS = 64
VERY_FREQUENT_DOCS = 4096
#: Frequent tokens that are broadcast are fewer than these (9 bytes each): those that count for more than one in so many.
MOST_FREQUENT = 1 << 20
#: Rows of a key that are compared in one chunk.
CHUNK = 2048
#: Rows of a bucket that are compared by shifting all of a batch at once.
SMALL = 24
#: Rounds of likely links before the last, complete one; they end early if a round refutes no more pairs than these, in all or for so many links.
ROUNDS = 2
FEW = 1000
FEW_OF = 4000
#: Shingles that a task keeps of texts that it has compared.
HELD = 1 << 20
#: Bits of a parity bitmap for each shingle in which two sets may differ.
BITS_EACH = 3.5
#: Low bits of a key, which name its class of sizes.
CLASS_MASK = 31
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MIX
    return h ^ (h >> np.uint64(29))


class SizeClass:
    """Sets of ``low`` to ``high`` shingles: how their tokens are grouped, and what rules pairs out.

    Classes overlap, so that both sets of any pair lie in one of them.
    """

    def __init__(self, number: int, low: int, high: int, t: Fraction):
        self.number, self.low, self.high, self.t = number, low, high, t
        must = -(-low * t.numerator // t.denominator)  # tokens that a partner shares at least
        # A whole set can spare enough if it shares more tokens than its groups don't count: groups + 2 * groups.
        self.groups = min(max(1, low // 10), (must - 1) // 3)
        # Unlike sets differ in half of the bits: twice as many, or nearly, as two sets that may be similar can.
        most = int(self.may_differ(high, high))
        self.words = 4
        while 64 * self.words < BITS_EACH * most:
            self.words *= 2

    def keys(self, own: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The keys of a set: ``own`` is its tokens in order, ``kind`` how many of a combination each is in (1 to 3)."""
        n = len(own)
        need = n + (-n * self.t.numerator) // self.t.denominator + 1
        if not self.groups:
            kind = np.ones(n, np.int8)
        if (kind[:need] == 1).all():
            return self._marked(_mixed(np.full(need, self.number, np.uint64), own[:need]))
        group = np.where(kind == 1, 0, (own % np.uint64(max(1, self.groups))).astype(np.int64) * 4 + kind)
        order = np.argsort(group, kind="stable")
        starts = run_starts(group[order])
        before = np.empty(n, np.int64)  # tokens of the same group before each
        before[order] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        counts = np.cumsum((kind == 1) | (before >= kind - 1))
        size = int(np.searchsorted(counts, need)) + 1
        own, kind, group = own[:size], kind[:size], group[:size]
        out = [_mixed(np.full(int((kind == 1).sum()), self.number, np.uint64), own[kind == 1])]
        many = np.flatnonzero(kind > 1)
        many = many[np.argsort(group[many], kind="stable")]
        for part in np.split(many, np.flatnonzero(np.diff(group[many])) + 1):
            k = int(kind[part[0]]) if len(part) else 0
            if k and len(part) >= k:
                h = np.full(1, self.number + 64 * k, np.uint64)
                for tokens in np.sort(np.array(list(combinations(own[part].tolist(), k)), np.uint64), axis=1).T:
                    h = _mixed(h, tokens)
                out.append(h)
        return np.unique(self._marked(np.concatenate(out)))

    def _marked(self, keys: np.ndarray) -> np.ndarray:
        """Keys that end in the number of this class."""
        return (keys & ~np.uint64(CLASS_MASK)) | np.uint64(self.number)

    def bitmap(self, own: np.ndarray) -> bytes:
        bits = np.bincount((own % np.uint64(64 * self.words)).astype(np.int64), minlength=64 * self.words) & 1
        return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()

    def may_differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many shingles only one of two sets of these sizes has, at most."""
        p, q = self.t.numerator, self.t.denominator
        return (x + y) * (q - p) // (p + q)


def size_classes(t: Fraction) -> list[SizeClass]:
    """Classes of doubling sizes, from the least size that a different set can be similar to."""
    low = 1
    while (low * t.denominator) // t.numerator == low:  # nothing but an equal set has similarity t
        low += 1
    out = []
    while low < 1 << 31:
        out.append(SizeClass(len(out), low, (2 * low * t.denominator) // t.numerator, t))
        low *= 2
    return out


def frequent_tokens(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the tokens that many documents of ``rows`` (text) hold, least frequent first.

    Tasks tell of what FREQUENT_HERE of a stretch of their texts hold, so counts are
    not exact; they only decide an order and classes, never the result.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= FREQUENT_HERE
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], ["h", "n"])

        for batch in slices(batches, 0):
            held += sets_of(batch.column(0), width)
            size += batch.column(0).nbytes
            if size >= COUNT_BYTES:
                yield told()
                held, size = [], 0
        if held:
            yield told()

    counts = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counts = cut(counts.filter(F.col("n") >= FREQUENT_DOCS))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") * F.lit(MOST_FREQUENT) > F.lit(total)).toArrow()
    h, n = found.column("h").to_numpy(), found.column("n").to_numpy()
    order = np.lexsort((h, n))
    return h[order].view(np.uint64), n[order]


def _first_pairs(bits: np.ndarray, size: np.ndarray, label: np.ndarray, cls: SizeClass, at: np.ndarray, other: np.ndarray, likely: bool) -> np.ndarray:
    """Which pairs of rows (at, other) have different labels and aren't ruled out; ``likely``: nor does the estimate of their bitmaps speak against them."""
    ok = label[at] != label[other]
    x, y = size[at], size[other]
    p, q = cls.t.numerator, cls.t.denominator
    ok &= np.minimum(x, y) * q >= np.maximum(x, y) * p
    i = np.flatnonzero(ok)
    differ = np.bitwise_count(bits[at[i]] ^ bits[other[i]]).sum(1, dtype=np.int64)
    most = cls.may_differ(x[i], y[i])
    if likely:
        # The number of shingles that two sets differ in, from the number of bits that do.
        m = 64.0 * cls.words
        ok[i] = (differ <= most) & (-m / 2 * np.log(np.maximum(1 - 2 * differ / m, 1e-9)) <= most)
    else:
        ok[i] = differ <= most
    return ok


def bucket_pairs(rows: pa.RecordBatch | pa.Table, classes: dict[int, SizeClass], complete: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to verify among whole buckets (part, rep, cls, n, cell, label, side), sorted by part.

    Of an incomplete round so many as connect what likely links connect.
    """
    part, rep, label = (rows.column(k).to_numpy() for k in ("part", "rep", "label"))
    number, size, side = (rows.column(k).to_numpy() for k in ("cls", "n", "side"))
    cells = rows.column("cell")
    found_a, found_b = [], []
    for c in np.unique(number).tolist():
        cls, mine = classes[c], np.flatnonzero(number == c)
        bits = np.frombuffer(b"".join(cells.take(pa.array(mine)).to_pylist()), "<u8").reshape(len(mine), cls.words)
        p, r, lab, n, s = part[mine], rep[mine], label[mine], size[mine], side[mine]
        starts = run_starts(p)
        sizes = np.diff(np.append(starts, len(p)))
        place = np.arange(len(p)) - np.repeat(starts, sizes)
        small = np.repeat(sizes <= SMALL, sizes)
        for shift in range(1, SMALL):
            i = np.flatnonzero(small & (place + shift < np.repeat(sizes, sizes)))
            if not len(i):
                break
            i = i[((s[i] != s[i + shift]) | (s[i] == 2)) & _first_pairs(bits, n, lab, cls, i, i + shift, not complete)]
            found_a.append(r[i])
            found_b.append(r[i + shift])
        for k in np.flatnonzero(sizes > SMALL):
            inside = np.arange(starts[k], starts[k] + sizes[k])
            a, b = _every(bits, n, lab, s, cls, inside) if complete else _spanning(bits, n, lab, cls, inside)
            found_a.append(r[a])
            found_b.append(r[b])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    if complete or not len(pairs):
        return pairs[:, 0], pairs[:, 1]
    return _tree(pairs[:, 0], pairs[:, 1])


def _tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As many of the pairs as it takes to connect what they connect."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    keep = []
    for k, (x, y) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            root[y] = x
            keep.append(k)
    return a[keep], b[keep]


def _spanning(bits, n, label, cls, inside) -> tuple[np.ndarray, np.ndarray]:
    """Likely links that connect what likely links connect: each row is compared with those not reached yet."""
    unmet = np.ones(len(inside), bool)
    a, b = [], []
    for seed in range(len(inside)):
        if not unmet[seed]:
            continue
        unmet[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            others = np.flatnonzero(unmet)
            if not len(others):
                break
            near = others[_first_pairs(bits, n, label, cls, np.full(len(others), inside[x]), inside[others], True)]
            unmet[near] = False
            queue.extend(near.tolist())
            a.append(np.full(len(near), inside[x]))
            b.append(inside[near])
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *a]), np.concatenate([nothing, *b])


def _every(bits, n, label, side, cls, inside) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of different labels that aren't ruled out; rows of the commonest label are compared with the others only."""
    own, count = np.unique(label[inside], return_counts=True)
    few = inside[label[inside] != own[count.argmax()]]
    rest = inside[label[inside] == own[count.argmax()]]
    a, b = [], []
    for k, x in enumerate(few):
        others = np.concatenate([few[k + 1 :], rest])
        others = others[(side[others] != side[x]) | (side[others] == 2)]
        near = others[_first_pairs(bits, n, label, cls, np.full(len(others), x), others, False)]
        a.append(np.full(len(near), x))
        b.append(near)
    nothing = np.zeros(0, np.int64)
    return np.concatenate([nothing, *a]), np.concatenate([nothing, *b])


def _meet(classes: dict[int, SizeClass], complete: bool):
    """Pairs of buckets that come as sorted rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = bucket_pairs(pa.Table.from_batches(rows).combine_chunks(), classes, complete)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0).to_numpy()
            at = int(np.searchsorted(part, part[-1], "left"))
            if at or (held and held[-1].column(0)[0].as_py() != part[-1]):
                yield told([*held, batch.slice(0, at)])
                held = []
            held.append(batch.slice(at))
        if held:
            yield told(held)

    return run


def _shared_keys(keyed: DataFrame, chunk: int) -> DataFrame:
    """(part, rep, cls, side): the documents of keys (key, rep) that several have.

    Keys with the same documents are one bucket; that they are the same is told
    by their number and the sum of their hashes, and at worst two buckets meet in
    one.  A bucket of many is dealt into chunks and pairs of chunks.
    """
    told = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("rep")).alias("those")).filter("rows > 1")
    cls = F.col("key").bitwiseAND(F.lit(CLASS_MASK))
    met = keyed.join(told, "key").select(F.xxhash64("rows", "those", cls).alias("bucket"), "rep", cls.cast("int").alias("cls"), "rows").distinct()
    met = met.withColumn("chunks", F.ceil(F.col("rows") / chunk).cast("int"))
    met = met.withColumn("i", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    met = met.withColumn("j", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int")
    part = F.when(F.col("chunks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")))
    return met.select(part.alias("part"), "rep", "cls", side.alias("side"))


def _bodies(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(rep, own, body): the compressed texts of the sets (rep, own); of a repeated row what a task has of it is one.

    Only texts that may be wanted are sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, last = zstandard.ZstdCompressor(level=3), None
        for batch in slices(batches, 1):
            keep, bodies = [], []
            for rep, text, own in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                now = (rep, own, xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass")))
                keep.append(now != last)
                if now != last:
                    bodies.append(press.compress((text or "").encode("utf-8", "surrogatepass")))
                last = now
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([left.column(0), left.column(2), pa.array(bodies, pa.binary())], ["rep", "own", "body"])

    return told_apart(texts, wanted).filter("maybe").join(wanted, "rep").select("rep", "text", "own").mapInArrow(run, "rep long, own binary, body binary")


def verified(pairs: DataFrame, bodies: DataFrame, width: int, t: Fraction) -> DataFrame:
    """(a, b, near) of the pairs: whether two of their sets are that similar; ``bodies`` is (rep, own, body)."""
    left = bodies.select(F.col("rep").alias("a"), F.struct("own", "body").alias("x"))
    right = bodies.select(F.col("rep").alias("b"), F.struct("own", "body").alias("y"))
    p, q = t.numerator, t.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        sets: dict[tuple, np.ndarray | None] = {}
        held = 0

        def set_of(rep: int, own: bytes, body: bytes) -> np.ndarray | None:
            """The shingles, if the text is one of the set that is asked for."""
            nonlocal held
            key = (rep, own, len(body))
            if key not in sets:
                found = sets_of(pa.array([unpress.decompress(body)], pa.binary()), width)[0]
                held += len(found)
                sets[key] = found if xxhash.xxh3_128_digest(found) == own else None
            return sets[key]

        for batch in batches:
            near = []
            for a, b, x_own, x_body, y_own, y_body in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                x, y = set_of(a, x_own, x_body), set_of(b, y_own, y_body)
                if x is None or y is None:
                    near.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(common * q >= p * (len(x) + len(y) - common))
                if held > HELD:
                    sets, held = {}, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.bool_())], ["a", "b", "near"])

    met = pairs.join(left, "a").join(right, "b").select("a", "b", "x.own", "x.body", F.col("y.own").alias("y_own"), F.col("y.body").alias("y_body"))
    return met.mapInArrow(run, "a long, b long, near boolean").groupBy("a", "b").agg(F.max("near").alias("near"))


def join_near(docs: DataFrame, shingle: int = 3, similarity: float = 0.9, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, combine: bool = True, link_empty: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): the size of each document's set and the least id reachable by links of Jaccard similarity ``similarity`` or more.

    Words are what stands between white space, A to Z as small letters.  A text
    of fewer words than a shingle is one shingle; one without words, or a null
    text, has none and is linked with nothing, not even its like; with
    ``link_empty`` such texts are alike.  Without ``combine`` every token is a key
    by itself, frequent ones last: fewer keys where few tokens are frequent.
    Neither changes which of the other documents are linked.

    Ids are whole numbers.  Rows that share an id are one document: their sets
    are linked.  A row whose id is null gets the least id of the texts with its
    shingles (null if there is none), and links nothing.  Repeated rows are
    kept, very long texts are taken whole, other columns are ignored, an empty
    table gives no rows.
    """
    t = Fraction(str(similarity))
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    classes = {c.number: c for c in size_classes(t)}
    spark = docs.sparkSession
    # Fewer than MOST_FREQUENT tokens of 9 bytes.
    tokens, counts = frequent_tokens(rows, shingle)
    common = spark.sparkContext.broadcast((tokens, np.where(counts >= VERY_FREQUENT_DOCS, 3, 2).astype(np.int8) if combine else np.ones(len(counts), np.int8)))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, kinds = common.value
        order = np.argsort(frequent, kind="stable")
        for batch in slices(batches, 1):
            every = sets_of(batch.column(1), shingle)
            out = []
            for own in every:
                fits = [c for c in classes.values() if c.low <= len(own) <= c.high]
                if not fits:
                    out.append([])
                    continue
                sorted_own = by_frequency(own, frequent, order)
                kind = np.ones(len(own), np.int8)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, sorted_own, sorter=order), len(frequent) - 1)
                    there = frequent[order[at]] == sorted_own
                    kind[there] = kinds[order[at[there]]]
                out.append([{"cls": c.number, "keys": c.keys(sorted_own, kind).tobytes(), "cell": c.bitmap(own)} for c in fits])
            kind_of = pa.list_(pa.struct([("cls", pa.int32()), ("keys", pa.binary()), ("cell", pa.binary())]))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([xxhash.xxh3_128_digest(s) for s in every], pa.binary()), pa.array([len(s) for s in every], pa.int64()), pa.array(out, kind_of)], ["doc_id", "own", "n", "found"])

    every = cut(rows.mapInArrow(prints, f"doc_id {id_type}, own binary, n long, found array<struct<cls:int,keys:binary,cell:binary>>"))
    # Equal sets are one, named by the least id; a document whose rows hold several sets may name them all.
    least = cut(every.filter(F.lit(link_empty) | (F.col("n") > 0)).groupBy("own").agg(F.min("doc_id").cast("long").alias("rep")).filter("rep is not null"))
    named = every.select(F.col("doc_id").cast("long").alias("rep"), "own", "n", "found").join(least, ["rep", "own"], "left_semi")
    named = cut(named.groupBy("rep", "own").agg(F.first("n").alias("n"), F.first("found").alias("found")).select("rep", "own", "n", F.explode("found").alias("f")).select("rep", "own", "n", "f.*"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            keys = batch.column(1).to_pylist()
            take = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in keys]))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), "<i8")), batch.column(0).take(take)], ["key", "rep"])

    dealt = cut(_shared_keys(named.select("rep", "keys").mapInArrow(key, "key long, rep long"), chunk))
    cells = cut(named.select("rep", "cls", "n", "cell").join(dealt.select("rep", "cls").distinct(), ["rep", "cls"], "left_semi"))

    def candidates(labels: DataFrame | None, complete: bool) -> DataFrame:
        own = cells.withColumn("label", F.col("rep")) if labels is None else cells.join(labels, F.col("rep") == F.col("vertex"), "left").withColumn("label", F.coalesce("component", "rep"))
        met = dealt.join(own.select("rep", "cls", "n", "cell", "label"), ["rep", "cls"]).select("part", "rep", "cls", "n", "cell", "label", "side")
        return met.repartition("part").sortWithinPartitions("part").mapInArrow(_meet(classes, complete), "a long, b long").distinct()

    texts = rows.select(F.col("doc_id").cast("long").alias("rep"), "text")

    def verify(pairs: DataFrame) -> DataFrame:
        reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        wanted = least.join(reps, "rep", "left_semi")
        return cut(verified(pairs, cut(_bodies(texts, wanted)), shingle, t))

    labels = None
    complete, k = False, 0
    while True:
        pairs = cut(candidates(labels, complete))
        if not pairs.isEmpty():
            told = verify(pairs)
            linked, refuted = told.agg(F.count_if("near"), F.count_if(~F.col("near"))).first()
            if linked:
                new = told.filter("near").select("a", "b")
                labels = connected_components(new if labels is None else new.union(labels))
        else:
            linked = refuted = 0
        if complete:
            break
        k += 1
        complete = k == ROUNDS or refuted <= FEW * max(1, linked / FEW_OF) or not linked

    # Documents whose rows hold several sets link these.
    of_rows = cut(every.select("doc_id", "own", "n").join(least, "own", "left").select("doc_id", "n", "rep"))
    both = of_rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    if not both.isEmpty():
        more = of_rows.join(both, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()
        labels = connected_components(more if labels is None else more.union(labels))
    if labels is None:
        return of_rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("component_id"))
    found = of_rows.join(labels, F.col("rep") == F.col("vertex"), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_near(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE
said AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tokens AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM said WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 90 * (x.n + y.n - s.n)),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.a = d.doc_id
"""
