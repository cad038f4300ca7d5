"""Token counts with overlap resynchronisation (operator 3).

A text over ``chunk_chars`` is cut into chunks that overlap.  Two neighbouring
chunks are spliced at a *stable common boundary*: a place b in their overlap
where the text has white space and where the tokens that both chunks put between
b and the next white space, and those between the previous white space and b,
have equal offsets and ids.  Such a place is proven for a tokenizer whose pieces
never span white space: it drops white space, so what stands left and right of b
is encoded independently, and the equal tokens on both sides show that neither
chunk's edge reaches b.  If an overlap has no such place it is doubled, in the
worst case up to the whole rest of the text, which is then encoded in one go.

For such a tokenizer shorter texts are counted by distinct words, each encoded
once per worker's cache.  Whether a tokenizer is of this kind is read from its
file (``drops_space``); with any other, every text is encoded in one go.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.arrow import slices, texts
from kinweave.llm.rows import quoted
from kinweave.plans.tables import table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
LIMIT = 2048
#: Words that a worker remembers at most.
CACHE = 400_000
#: White space that separates words for every tokenizer concerned.
BREAKS = " \n\t\r"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation or padding; read once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordCounts:
    """Token counts of words, each encoded once while it is remembered."""

    def __init__(self, path: str):
        self.encode_batch = tokenizer(path).encode_batch_fast
        self.known: dict[bytes, int] = {}

    def totals(self, rows: list[bytes]) -> list[int]:
        """The number of tokens of each text: that of its words, as the tokenizer drops white space."""
        split = [x.split() for x in rows]
        new = set().union(*split)
        if len(self.known) + len(new) > CACHE:
            self.known = {}
        new = list(new - self.known.keys())
        for k in range(0, len(new), 8192):
            part = new[k : k + 8192]
            found = self.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.known.update(zip(part, map(len, found), strict=True))
        return [sum(map(self.known.__getitem__, x)) for x in split]


#: Pre-tokenizers that split at white space and drop it, and normalizers that neither make nor remove any but by a rule of \\s.
_SPLITTERS = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}
_NORMALIZERS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "BertNormalizer"}


def _parts(x: dict | None, inner: str) -> list[dict]:
    return [] if x is None else x[inner] if x["type"] == "Sequence" else [x]


def _splits(step: dict) -> bool:
    """Whether a pre-tokenizer never leaves white space in a piece."""
    if step["type"] in _SPLITTERS:
        return True
    if step["type"] != "Split" or step["behavior"] != "Removed" or "Regex" not in step["pattern"]:
        return False
    pattern = regex.compile(step["pattern"]["Regex"])
    spaces = " \t\n\v\f\r"  # what texts are cut at here
    around = ["", "a", "É", "1", "!", "'", "_", "日", "'s", " "]
    if step["invert"]:  # pieces are the matches
        return not any(s in m[0] for s in spaces for x in around for y in around for m in pattern.finditer(x + s + y))
    return all(pattern.fullmatch(s) for s in spaces)


@lru_cache(maxsize=2)
def drops_space(path: str) -> bool:
    """Whether the tokenizer of a file encodes what stands between white space independently, as far as its kind tells."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    steps = _parts(kind.get("pre_tokenizer"), "pretokenizers")
    plain = all(n["type"] in _NORMALIZERS or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in _parts(kind.get("normalizer"), "normalizers"))
    added = not any(regex.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in kind.get("added_tokens", []))
    return plain and added and bool(steps) and _splits(steps[0]) and kind.get("post_processor") is None


class Chunk:
    """The tokens of a chunk of a text that starts at ``start``."""

    def __init__(self, encoding, start: int):
        self.encoding, self.start = encoding, start

    def __len__(self) -> int:
        return len(self.encoding)

    def until(self, place: int, text: str) -> int:
        """How many tokens end before white space at ``place``."""
        at = place - 1 - self.start
        while at >= 0:
            token = self.encoding.char_to_token(at)
            if token is not None:
                return token + 1
            at -= 1
        return 0

    def near(self, low: int, high: int, text: str) -> list[tuple[int, int, int]]:
        """(start, end, id) of the tokens between white space at ``low`` and at ``high``."""
        a, b = self.until(low, text), self.until(high, text)
        if a == b:
            return []
        ids = self.encoding.ids
        return [(x + self.start, y + self.start, ids[k]) for k in range(a, b) for x, y in [self.encoding.token_to_chars(k)]]


def splice(text: str, left, right, low: int, high: int) -> int | None:
    """A stable common boundary in [low, high), as near to its middle as can be; None if there is none.

    ``left`` and ``right`` give their tokens by ``near``.
    """
    marks = [k for k in range(low + 1, high - 1) if text[k] in BREAKS]
    middle = (low + high) // 2
    for n in sorted(range(1, len(marks) - 1), key=lambda n: abs(marks[n] - middle)):
        before, here, after = marks[n - 1], marks[n], marks[n + 1]
        mine = left.near(before, after, text)
        sides = any(x[1] <= here for x in mine) and any(x[0] >= here for x in mine)
        if sides and not any(x[0] < here < x[1] for x in mine) and mine == right.near(before, after, text):
            return here
    return None


def count_tokens(encode, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """The number of tokens of a whole text.  ``encode`` maps a text to an encoding; its pieces hold no white space."""
    n = len(text)
    if n <= chunk:
        return len(encode(text))
    start, done, total = 0, 0, 0  # the chunk starts at start; tokens before the boundary done are counted
    left = None
    while True:
        if left is None:
            end = min(n, start + chunk)
            left = Chunk(encode(text[start:end]), start)
        before = left.until(done, text) if done else 0
        if end >= n:
            return total + len(left) - before
        wide = overlap
        while True:
            to = max(start, end - wide)
            if to <= max(start, done):  # nothing left to widen into: take the chunk and the next together
                end = min(n, end + (end - start))
                left = Chunk(encode(text[start:end]), start)
                break
            stop = min(n, to + chunk + wide)
            right = Chunk(encode(text[to:stop]), to)
            at = splice(text, left, right, to, end)
            if at is not None:
                total += left.until(at, text) - before
                start, end, done, left = to, stop, at, right
                break
            wide *= 2


def token_counts(docs: DataFrame, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every whole text, without special tokens that the text itself doesn't hold.

    A null or empty text has no bytes and no tokens.  Equal rows are counted
    alike, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, words, by_words = tokenizer(path), WordCounts(path), drops_space(path)
        encode = lambda text: t.encode(text, add_special_tokens=False)
        for batch in slices(batches, 1):
            rows_of = texts(batch.column(1))
            raw = [x.encode("utf-8", "replace") for x in rows_of]
            if not by_words:
                n = [len(encode(x)) for x in rows_of]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
                continue
            huge = [len(x) > chunk_chars for x in rows_of]
            n = words.totals([b"" if big else x for x, big in zip(raw, huge, strict=True)])
            for k, big in enumerate(huge):
                if big:
                    n[k] = count_tokens(encode, rows_of[k], chunk_chars, overlap_chars)
            sizes = list(map(len, raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
