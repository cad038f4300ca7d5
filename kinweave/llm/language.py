"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 10).

Counting is one pass over all labelled rows: every task adds up, per language,
a vector of hashed n-gram counts, and hands it on in parts of COLUMNS buckets, a
column each, which Spark sums by (language, part).  The matrix of log
probabilities has a proven size bound: BITS hash bits for each of at most
MOST_LANGUAGES languages; more labels than that are an error.  Scoring adds, for
every n-gram of a text, its row of the matrix.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices, texts
from kinweave.llm.rows import quoted
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table

ORDERS = (1, 2, 3)
BITS = 16
COLUMNS = 64
#: Of 4 bytes per bucket and language the broadcast matrix has 64 MB at most.
MOST_LANGUAGES = 256
#: Languages that a task counts at once; with more labels it hands on what it has.
LANGUAGES_HERE = 64
ALPHA = 0.5
UNKNOWN = "und"
_PRIMES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (32 bits) of the n-grams of each text, the row of each, and whether a row has a letter.

    Letters are lower-cased; any run of other characters is one space, and so
    are the ends of a text.  An n-gram may start or end with a space; a space
    alone is none, nor is a space between two letters.
    """
    codes = np.frombuffer("\0".join(["", *rows, ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    # A text may hold NULs itself: rows are told apart by their lengths.
    sizes = np.array([len(t.lower()) for t in rows], np.int64)
    at = np.concatenate([np.full(1, -1), np.repeat(np.arange(len(rows)), sizes + 1)])[: len(codes)]
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes, at, letter = np.where(letter, codes, 32)[keep], at[keep], letter[keep]
    has = np.zeros(len(rows), bool)
    has[at[letter]] = True
    out, of = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = (h ^ codes[k : k + m].astype(np.uint32)) * _PRIMES[k]
            h ^= h >> np.uint32(15)
        # An n-gram needs a letter in its middle, a pair at either end; its row is that of this letter.
        middle = slice(n // 2, n // 2 + m)
        ok, rows_of = letter[middle], at[middle]
        if n == 2:
            ok, rows_of = ok | letter[:m], np.where(ok, rows_of, at[:m])
        out.append(h[ok])
        of.append(rows_of[ok])
    if not out:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has
    return np.concatenate(out), np.concatenate(of), has


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint32(32 - bits)).astype(np.int64)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", bits: int = BITS, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages in order, matrix of log probabilities (buckets + 1, languages)); the last row holds the priors.

    Rows without a label or text don't count.  Only the summed matrix, whose
    size is bounded, comes to the driver; more than ``most`` labels raise an
    error.
    """
    rows = labelled.select(quoted(label_col).cast("string").alias("lang"), quoted(text_col).alias("text")).dropna()
    size = 1 << bits
    columns = [f"c{k}" for k in range(min(COLUMNS, size))]
    parts = size // len(columns)
    names = ["lang", "part", "docs", *columns]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in sums.items():
                grid = own.reshape(parts, len(columns))
                n = np.zeros(parts, np.int64)
                n[0] = docs[lang]
                use = np.flatnonzero(grid.any(1) | (n > 0))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(use), pa.string()), pa.array(use.astype(np.int32)), pa.array(n[use]), *(pa.array(np.ascontiguousarray(c)) for c in grid[use].T)], names)
            sums.clear()
            docs.clear()

        for batch in slices(batches, 1, 1 << 19):
            langs = batch.column(0).to_pylist()
            here = sorted(set(langs))
            if len(sums.keys() | here) > LANGUAGES_HERE:
                yield from told()
            place = {x: k for k, x in enumerate(here)}
            own = np.array([place[x] for x in langs], np.int64)
            h, of, _ = features(texts(batch.column(1)))
            b, of = _bucket(h, bits), own[of]
            for k, lang in enumerate(here):
                found = np.bincount(b[of == k], minlength=size)
                sums[lang] = sums[lang] + found if lang in sums else found
            docs.update(langs)
        yield from told()

    partial = rows.mapInArrow(count, f"lang string, part int, docs long, {', '.join(f'{c} long' for c in columns)}")
    summed = cut(partial.groupBy("lang", "part").agg(F.sum("docs").alias("docs"), *(F.sum(c).alias(c) for c in columns)))
    langs = sorted(r["lang"] for r in summed.filter("docs > 0").select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"more than {most} languages: the model would be larger than its bound")
    counts, docs = np.zeros((len(langs), size)), np.zeros(len(langs))
    if not langs:
        return [], np.zeros((size + 1, 0), np.float32)
    found = summed.toArrow()
    lang = np.searchsorted(langs, found.column("lang").to_numpy())
    part = found.column("part").to_numpy().astype(np.int64)
    for k, c in enumerate(columns):
        counts[lang, part * len(columns) + k] = found.column(c).to_numpy()
    np.add.at(docs, lang, found.column("docs").to_numpy())
    logs = np.log(counts + ALPHA) - np.log(counts.sum(1, keepdims=True) + ALPHA * size)
    prior = np.log(docs) - np.log(docs.sum())
    return langs, np.concatenate([logs.T, prior[None]]).astype(np.float32)


def predict(docs: DataFrame, names: list[str], matrix: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the most probable language and its posterior.

    A text that is null or has no letter is ``und`` with score 0; so is any
    text if no language was learned.  Of equals, the first by name wins.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    bits = int(np.log2(len(matrix) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, prior = model.value[:-1], model.value[-1].astype(np.float64)
        for batch in slices(batches, 1, 1 << 19):
            h, of, has = features(texts(batch.column(1)))
            b = _bucket(h, bits)
            sums = np.stack([np.bincount(of, logs[:, k][b], minlength=len(has)) for k in range(len(names))], 1) + prior if names else np.zeros((len(has), 0))
            best = sums.argmax(1) if names else np.zeros(len(has), np.int64)
            score = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1) if names else np.zeros(len(has))
            known = has & bool(names)
            found = [names[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 4
    names, matrix = train(docs.filter(F.coalesce(fold("doc_id"), F.lit(0)) != 2))
    return predict(docs, names, matrix).select("doc_id", F.coalesce(fold("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
