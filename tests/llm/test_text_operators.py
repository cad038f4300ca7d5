"""Operators that look at each text by itself, against plain versions."""

import hashlib
import math
import random
import re

import public_tokenizers
import pytest
import tiktoken
import xxhash  # noqa: F401
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontamination, language, quality, token_counts

RNG = random.Random(5)
WORDS = ["alpha", "beta", "Gamma", "delta", "Über", "naïve", "x1", "the", "of", "and", "日本", "don't", "A-B", "___", "9"]
LONG = " ".join(RNG.choice(WORDS) for _ in range(9000))
TEXTS = [
    "", None, " \n\t ", "one", "Hello, world! It's <|endoftext|> fine.\n\n  Two  spaces", "x" * 3000, "日本語のテキスト" * 40, "a b c d e f g h " * 6, LONG, "# * $ % & | < >\n# * $\nlast\n\nlast",
    *(" ".join(RNG.choice(WORDS) for _ in range(RNG.randrange(1, 60))) for _ in range(40)), "same text here", "same text here", "é à ü " * 10,
]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with ids, repeated rows, a null id, and extra columns whose names clash with the operators' own."""
    rows = [(n, t, "w", 7, "r") for n, t in enumerate(TEXTS)] + [(3, "one", "w", 7, "r"), (None, "no id", "w", 7, "r")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, failed int, ids string").repartition(3)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_token_counts(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = token_counts.tokenizer(path)
    want = {n: len(t.encode(x or "", add_special_tokens=False)) for n, x in enumerate(TEXTS)}
    for chunk, overlap in ((32_768, 256), (400, 16), (64, 4)):
        got = by_id(token_counts.token_counts(docs, path, chunk, overlap))
        assert {n: got[n]["n_tokens"] for n in want} == want
        assert got[8]["n_bytes"] == len(LONG.encode())
    assert token_counts.token_counts(docs.limit(0), path).count() == 0
    assert token_counts.token_counts(docs, path).count() == docs.count()


class Tokens:
    def __init__(self, tokens):
        self.tokens = tokens

    def near(self, low, high, text):
        return [x for x in self.tokens if x[1] > low and x[0] < high]


def test_splice_needs_a_common_boundary():
    assert token_counts.splice("aaaa", Tokens([(0, 4, 1)]), Tokens([(0, 4, 1)]), 0, 4) is None
    tokens = [(0, 1, 5), (2, 3, 5), (4, 5, 5), (6, 7, 5)]
    assert token_counts.splice("a a a a ", Tokens(tokens), Tokens(tokens), 0, 8) == 3
    assert token_counts.splice("a a a a ", Tokens(tokens), Tokens([(0, 1, 6), (2, 3, 6), (4, 5, 6), (6, 7, 6)]), 0, 8) is None


def test_tokenizers_that_keep_white_space_are_not_counted_by_words(spark, docs):
    words, whole = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.drops_space(words) and not token_counts.drops_space(whole)
    t = token_counts.tokenizer(whole)
    got = by_id(token_counts.token_counts(docs, whole, 400, 16))
    assert {n: got[n]["n_tokens"] for n in range(len(TEXTS))} == {n: len(t.encode(x or "", add_special_tokens=False)) for n, x in enumerate(TEXTS)}


def test_bpe(spark, docs):
    path, pattern = bpe.default_file()
    ranks = bpe.vocabulary(path).ranks
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {n: encoding.encode_ordinary(x or "") for n, x in enumerate(TEXTS)}
    got = by_id(bpe.digests(docs, path, pattern))
    for n, ids in want.items():
        assert got[n]["n_tokens"] == len(ids)
        assert got[n]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[n]["decoded_sha256"] == hashlib.sha256((TEXTS[n] or "").encode()).hexdigest() and got[n]["round_trip"]
    encoded = bpe.encode(docs, path, pattern)
    assert {n: by_id(encoded)[n]["ids"] for n in want} == want
    assert {n: bytes(r["bytes"]) for n, r in by_id(bpe.decode(encoded, path)).items() if n is not None} == {n: (x or "").encode() for n, x in enumerate(TEXTS)}
    assert bpe.digests(docs.limit(0), path, pattern).count() == 0


def test_bpe_merges_in_order():
    """A small vocabulary in which the order of merges shows, through matrix and heap alike."""
    parts = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abab", b"aba", b"cab"]
    v = bpe.Vocabulary({p: n for n, p in enumerate(parts)})
    encoding = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=v.ranks, special_tokens={})
    for _ in range(300):
        piece = "".join(RNG.choice("abc") for _ in range(RNG.randrange(2, 40))).encode()
        want = encoding.encode_ordinary(piece.decode())
        assert v.encode_pieces([piece])[0] == want
        if piece not in v.ranks:
            assert v.merge_long(piece) == want


def test_quality(spark, docs):
    got = by_id(quality.ledger(docs))
    for n, text in enumerate(TEXTS):
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 2000 else None
        r = got[n]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", t))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        if twice is not None:
            assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if w in twice for k in range(8)})
        assert bool(r["failed"] & quality.BIT["few_words"]) == (len(words) < 20)
    assert quality.ledger(docs.limit(0)).count() == 0
    kept = quality.ledger(docs, carry=True)
    assert kept.filter("doc_id = 8").count() == 1


def test_quality_policies_and_ablation(spark):
    entries = spark.createDataFrame([(0,), (1,), (4,), (5,), (8,), (32,)], "failed long")
    assert [r.kept for r in quality.apply_policy(entries, "base").collect()] == [True, False, True, False, True, True]
    rows = {(r.policy, r.rule): r for r in quality.ablation(entries).collect()}
    assert tuple(rows["v1", "symbols"])[2:] == (6, 2, 1, 2, 3)
    assert tuple(rows["base", "few_words"])[2:] == (6, 2, 2, 4, 6)
    assert ("base", "symbols") not in rows


def windows(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(30)] + ["Éa", "b9", "the", "a"]
    prose = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(n, prose(rng.choice([1, 2, 5, 9, 10, 11, 25]))) for n in range(4, 40)] + [(1, None), (2, ""), (3, "--!"), (None, prose(14)), (5, prose(12))]
    texts = [prose(rng.randrange(0, 200)) + " " + (rng.choice(items)[1] or "") + ". " + prose(5) for _ in range(60)] + ["", None, "...", items[0][1].upper()]
    docs = spark.createDataFrame([(n, t, "x", 1) for n, t in enumerate(texts)], "doc_id long, text string, items string, spans int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for n, t in enumerate(texts):
        w, _ = windows(t, 10)
        hit, found = set(), set()
        for i, (item, text) in enumerate(items):
            own, ws = windows(text, 10)
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add("null" if item is None else str(item))
        want[n] = (len(w), len(hit), sorted(found))
    for block in (1 << 20, 60):
        plan = decontamination.contamination(docs, bench, block_bytes=block)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1  # however many blocks there are
        got = by_id(decontamination.contamination(docs, bench, block_bytes=block).withColumn("n_hit", decontamination.hit_words()))
        assert {n: (r["n_words"], r["n_hit"], r["items"]) for n, r in got.items()} == want
    assert decontamination.contamination(docs, bench.limit(0)).filter(F.size("spans") > 0).count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_reads_documents_once_per_block(spark, monkeypatch):
    """Blocks are filled, and there is one scan for each and none beside; hits of all blocks are added up."""
    items = [(n, " ".join(f"w{n:02}x{k}" for k in range(30))) for n in range(20)]
    size = len(items[5][1])
    docs = spark.createDataFrame([(n, f"a {t} b {items[0][1]}") for n, t in items], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    scans, scan = [], decontamination._scan
    monkeypatch.setattr(decontamination, "_scan", lambda rows, block, window: (scans.append(len(block)), scan(rows, block, window))[1])
    for most, scanned in ((100 * size, 1), (5 * size, 4), (1, 20)):
        scans.clear()
        got = by_id(decontamination.contamination(docs, bench, block_bytes=most))
        assert sum(scans) == 20 and len(scans) == scanned
        assert {n: r["items"] for n, r in got.items()} == {n: sorted({str(n), "0"}) for n, _ in items}
        assert all(sum(x["end"] - x["start"] for x in r["spans"]) == 60 for r in got.values())


def test_long_texts_and_pieces_of_items(spark):
    """An item of several pieces, all of whose windows are found, at both ends of a long text; runs of other characters don't matter."""
    words = [f"w{n}" for n in range(3000)]
    item = " ".join(words)
    docs = spark.createDataFrame([(1, "~" * 500_000 + item[:60] + " x " * 400_000 + item), (2, " ".join(words[1020:1040])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([("long", item)], "item_id string, text string")
    for block in (1 << 20, 4000):
        got = by_id(decontamination.contamination(docs, bench, block_bytes=block))
        first = len(item[:60].split())
        assert got[1]["n_words"] == first + 400_000 + 3000
        assert [tuple(x) for x in got[1]["spans"]] == [(0, first - 1), (first + 400_000, first + 403_000)] or [tuple(x) for x in got[1]["spans"]] == [(0, first), (first + 400_000, first + 403_000)]
        assert [tuple(x) for x in got[2]["spans"]] == [(0, 20)] and got[2]["items"] == ["long"] and got[3]["spans"] == []


def test_language(spark):
    rng = random.Random(2)
    stems = {"en": "the of and ing tion er", "de": "der die und ung keit sch", "fr": "le la des eau ment tre"}
    make = lambda lang: " ".join("".join(rng.choice(stems[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(40))
    rows = [(n, make(lang), lang) for n, lang in enumerate(["en", "de", "fr"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "", "de"), (902, "123 !?", "fr"), (903, make("en"), None), (None, make("de"), "de")], "doc_id long, text string, lang string").repartition(4)
    names, matrix = language.train(docs.filter("doc_id < 60 or doc_id >= 900"))
    assert names == ["de", "en", "fr"]
    got = by_id(language.predict(docs, names, matrix))
    right = sum(got[n]["lang_pred"] == lang for n, _, lang in rows if n >= 60)
    assert right >= 0.95 * 60
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[n]["lang_pred"] for n in (900, 901, 902)] == ["und"] * 3 and got[903]["lang_pred"] == "en"
    none, empty = language.train(docs.filter("lang = 'xx'"))
    assert none == [] and {r["lang_pred"] for r in language.predict(docs, none, empty).collect()} == {"und"}
    assert language.predict(docs.limit(0), names, matrix).count() == 0


def test_language_counts_are_whole(spark):
    """The summed counts are those of one pass over all texts."""
    docs = spark.createDataFrame([(n, f"word{n} letters abc", "a" if n % 2 else "b") for n in range(30)], "doc_id long, text string, lang string").repartition(5)
    one = language.train(docs.coalesce(1))[1]
    many = language.train(docs)[1]
    assert (one == many).all()


def plain_grams(text):
    """The n-grams of a text, from its letters and single spaces, as (n, codes)."""
    line = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    line = re.sub(" +", " ", line)
    grams = [g for n in (1, 2, 3) for g in (line[i : i + n] for i in range(len(line) - n + 1)) if g.strip() and not (n == 3 and g[1] == " ")]
    return grams, line.strip() != ""


def plain_bucket(gram, bits):
    h = len(gram)
    for k, c in enumerate(gram):
        h = (h ^ ord(c)) * (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[k] & 0xFFFFFFFF
        h ^= h >> 15
    return h >> (32 - bits)


def test_language_against_plain_naive_bayes(spark):
    """Predictions and scores are those of naive Bayes written out text by text."""
    rng = random.Random(21)
    letters = {"a": "abcdeé", "b": "cdefgß", "c": "efghi日"}
    make = lambda lang: " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 9))) + rng.choice(["", "!", " 7", "\0", "İ"])
    rows = [(n, make("abc"[n % 3]), "abc"[n % 3]) for n in range(60)] + [(60, "", "a"), (61, None, "b"), (62, "42", "c"), (63, "\0\0", None), (64, "x" * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    names, matrix = language.train(docs.filter("doc_id % 2 = 0 or doc_id > 60"))
    counts, total, n_docs = {}, {}, {}
    for d, t, lang in rows:
        if (d % 2 == 0 or d > 60) and t is not None and lang is not None:
            n_docs[lang] = n_docs.get(lang, 0) + 1
            for g in plain_grams(t)[0]:
                k = lang, plain_bucket(g, language.BITS)
                counts[k] = counts.get(k, 0) + 1
                total[lang] = total.get(lang, 0) + 1
    got = by_id(language.predict(docs, names, matrix))
    for d, t, _ in rows:
        grams, has = plain_grams(t)
        if not has:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0)
            continue
        logs = {x: math.log(n_docs[x] / sum(n_docs.values())) + sum(math.log((counts.get((x, plain_bucket(g, language.BITS)), 0) + language.ALPHA) / (total[x] + language.ALPHA * 2**language.BITS)) for g in grams) for x in names}
        best = max(names, key=logs.get)
        assert got[d]["lang_pred"] == best
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-3)


def test_language_model_is_bounded(spark):
    docs = spark.createDataFrame([(f"text {n}", f"l{n}") for n in range(9)], "text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.train(docs, most=8)
    assert len(language.train(docs, most=9)[0]) == 9
