"""Operators that compare documents, against plain versions."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.llm import maximal, perspectives, repeats, sharding, simhash, templates
from kinweave.llm.queries import queries

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randrange(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    passage = prose(40)
    out = [prose(RNG.randrange(1, 120)) for _ in range(60)]
    out += [prose(20) + " " + passage + " " + prose(20) for _ in range(6)] + [passage[5:150], "ab" * 200, "ab" * 40 + "q", "x" * 400, "y" + "x" * 300 + "z"]
    out += [out[0]] * 5 + [out[1] + " more"] + ["", None, "short", "é" * 60, "é" * 60 + "!"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(3 * n - 20, t, f"s{n % 3}" if n % 7 else None, 1, b"x") for n, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[0], "s0", 1, b"x")], "doc_id long, text string, source string, bin int, fp binary").repartition(4)


def ids(texts):
    return [3 * n - 20 for n in range(len(texts))]


def removed(rows, least):
    first = {}
    for d, t in sorted(rows):
        for i in range(len(t) - least + 1):
            first.setdefault(t[i : i + least], d)
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < d:
                gone[i : i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        yield d, (len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())


def test_repeats(spark, docs, texts):
    want = dict(removed([(d, (t or "").encode()) for d, t in zip(ids(texts), texts, strict=True)], 50))
    for bins in (None, 3):
        rows = repeats.without_repeats(docs, bins=bins, digest=True).collect()
        assert {r[0]: tuple(r[1:]) for r in rows if r[0] is not None} == want
        assert [tuple(r)[1:3] for r in rows if r[0] is None] == [(len(texts[0]), 0)]
    assert repeats.without_repeats(docs.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in repeats.without_repeats(docs).collect() if r.doc_id is not None}
    assert {d: hashlib.sha256(k).hexdigest() for d, k in kept.items()} == {d: w[3] for d, w in want.items()}


def test_maximal_repeats_hold_all_occurrences(spark):
    a, b = "q" * 10 + "the quick brown fox jumps over the lazy dog and runs off" + "1", "the quick brown fox jumps over the lazy dog and runs off2"
    docs = spark.createDataFrame([(1, "A" + a), (2, "BB" + b), (3, b + "C")], "doc_id long, text string")
    rows = maximal.maximal_repeats(docs).collect()
    longest = max(r.length for r in rows)
    assert longest >= 56
    groups = {}
    for r in rows:
        groups.setdefault((r.repeat, r.length), set()).add((r.doc_id, r.start))
    assert {(1, 11), (2, 2), (3, 0)} in groups.values()
    assert all(len(g) > 1 for g in groups.values())


def plain_maximal_repeats(rows, least):
    """{(string, places)} of all maximal repeats: each pair of equal windows is extended to both sides."""
    at = {}
    for d, t in rows:
        for i in range(len(t) - least + 1):
            at.setdefault(t[i : i + least], []).append((d, i))
    texts_of, found = dict(rows), set()
    for places in at.values():
        for k, (a, i) in enumerate(places):
            for b, j in places[k + 1 :]:
                x, y, n = texts_of[a], texts_of[b], least
                if i and j and x[i - 1] == y[j - 1]:
                    continue
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                found.add(x[i : i + n])
    return {(u, frozenset((d, i) for d, t in rows for i in range(len(t) - len(u) + 1) if t[i : i + len(u)] == u)) for u in found}


def groups_of(found, rows):
    """{(string, places)} of what ``maximal_repeats`` gives; names, lengths and counts must agree."""
    texts_of, groups = dict(rows), {}
    for r in found.collect():
        groups.setdefault((r.repeat, r.length, r.n_places), []).append((r.doc_id, r.start))
    out = set()
    for (name, n, n_places), places in groups.items():
        d, i = places[0]
        u = texts_of[d][i : i + n]
        assert hashlib.sha256(u).hexdigest() == name and n_places == len(places) == len(set(places))
        out.add((u, frozenset(places)))
    assert len(out) == len(groups)
    return out


def test_maximal_repeats_whose_parts_are_elsewhere(spark):
    """200 bytes of two documents, whose first 140 a third has and whose last 140 a fourth: no window has the two places alone."""
    rng = random.Random(41)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    u = word(200)
    texts = ["1" + u + "a", "2" + u + "b", "3" + u[:140] + "c", "4" + u[60:] + "d"]
    rows = [(n, t.encode()) for n, t in enumerate(texts)]
    got = groups_of(maximal.maximal_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), rows)
    assert (u.encode(), frozenset({(0, 1), (1, 1)})) in got
    assert got == plain_maximal_repeats(rows, 50)


@pytest.mark.parametrize("heavy", [False, True])
def test_nested_maximal_repeats(spark, monkeypatch, heavy):
    """Random pieces of one string, whole copies, texts that stand in others, and runs of one byte, against all pairs."""
    rng = random.Random(43)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    source = word(1500)
    texts = []
    for n in range(24):
        a = rng.randrange(0, 1400)
        texts.append(word(rng.randrange(0, 30)) + source[a : a + rng.choice([55, 90, 150, 400, 900])] + word(rng.randrange(0, 30)) + source[20 * n : 20 * n + 70])
    texts += [texts[0], texts[1], texts[1], texts[2] + "!", "x" * 64, "y" + "x" * 58 + "z", "é" * 40, "", "ab" * 30, word(120), "alone " * 20, "alone " * 20]
    rows = [(5 * n - 7, t.encode()) for n, t in enumerate(texts)]
    if heavy:
        monkeypatch.setattr(repeats, "HEAVY", 1)
    docs = spark.createDataFrame([*((5 * n - 7, t, 1, "x") for n, t in enumerate(texts)), (-7, texts[0], 2, "y")], "doc_id long, text string, at int, places string").repartition(3)
    got = groups_of(maximal.maximal_repeats(docs, bins=4), rows)
    assert got == plain_maximal_repeats(rows, 50)
    assert maximal.maximal_repeats(docs.limit(0)).count() == 0


def test_a_passage_of_many_documents_is_one_row_of_a_bin(spark, monkeypatch):
    """What a bin gets does not grow with the documents that hold a passage, and all of them are named."""
    rng = random.Random(47)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    sizes = spark.sparkContext.accumulator(0)
    of = maximal._tree
    monkeypatch.setattr(maximal, "_tree", lambda *a: (lambda run: lambda key, t: (sizes.add(t.num_rows), run(key, t))[1])(of(*a)))
    for n in (40, 4000):
        docs = spark.range(n).selectExpr("id as doc_id", f"concat(char(65 + id % 20), '{passage}', char(65 + id % 19), id % 20) as text")
        before = sizes.value
        found = maximal.maximal_repeats(docs, bins=2)
        assert found.filter("length = 300").select("doc_id").distinct().count() == n
        seen = sizes.value - before
        assert seen < 9000


def test_maximal_repeats_of_any_length(spark):
    """Repeats inside repeats, of several lengths and sets of places, against all pairs; one text repeats itself."""
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long, middle, short = word(700), word(130), word(56)
    texts = [word(40) + long + word(30), long[100:] + word(20), word(10) + long[:400] + middle + word(5), middle + word(70) + middle, word(15) + short + word(60), short + word(9) + middle[20:] + "!", word(200), long[150:320] + word(33) + short]
    rows = [(n, t.encode()) for n, t in enumerate(texts)]
    want = plain_maximal_repeats(rows, 50)
    docs = spark.createDataFrame([*enumerate(texts), (20, None), (None, long)], "doc_id long, text string").repartition(3)
    got = groups_of(maximal.maximal_repeats(docs, bins=3), rows)
    assert got == want
    assert max(len(u) for u, _ in want) > 500 and len(want) > 5


def test_frequent_grams_are_dealt_by_window(spark, monkeypatch):
    """A phrase in ever different surroundings, with so low a bound that every candidate is dealt window by window."""
    rng = random.Random(29)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = "the same forty-four bytes in all of the texts", word(90)
    texts = [word(30) + phrase + word(40) + (passage if n % 4 == 0 else word(60)) for n in range(60)]
    monkeypatch.setattr(repeats, "HEAVY", 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = dict(removed([(d, t.encode()) for d, t in enumerate(texts)], 50))
    assert {r[0]: tuple(r[1:]) for r in repeats.without_repeats(docs, digest=True).collect()} == want
    assert sum(w[1] for w in want.values()) >= 14 * 90


def plain_fingerprint(text, shingle):
    import re

    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(nodes)
    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, texts):
    prints = {d: plain_fingerprint(t, 3) for d, t in zip(ids(texts), texts, strict=True)}
    want = classes(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    for heavy in (simhash.HEAVY, 1):
        rows = simhash.near_duplicates(docs, heavy_rows=heavy).collect()
        assert {r.doc_id: (bytes(r.fp).hex(), r.component_id) for r in rows if r.doc_id is not None} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pigeonring_keys_lose_no_pair():
    """Pairs at distance 3 or less share a key, in small and large buckets."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 4), replace=False)) for _ in range(400)]
    fps = np.unique(np.array([int(base[k % 40]) ^ f for k, f in enumerate(flips)], np.uint64)).reshape(-1, 1)
    scheme = simhash.contract_scheme()
    keys = scheme.key_values(fps)
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i, 0] ^ fps[j, 0]) <= 3
    assert (scheme.linked(fps[i], fps[j]) == near).all()
    assert all(set(keys[a]) & set(keys[b]) for a, b in zip(i[near], j[near], strict=True))


def test_similarity_scheme_finds_near_copies(spark):
    base = [prose(200) for _ in range(30)]
    rows = []
    for n, t in enumerate(base):
        words = t.split()
        for k in range(3):
            edited = list(words)
            for _ in range(k):
                edited[RNG.randrange(len(edited))] = "edited"
            rows.append((10 * n + k, " ".join(edited)))
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, simhash.similarity_scheme(0.8)).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: d - d % 10 for d, _ in rows}


def test_sharding(spark, docs, texts):
    rows = sharding.stratified_shards(docs, shards=4, source_buckets=3, order_buckets=5).collect()
    assert len(rows) == len(texts) + 1
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert sorted(slots) == [0, 1, 2, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts_of = dict(zip(ids(texts), texts, strict=True))
    for r in rows:
        raw = (texts_of[r.id] if r.id is not None else texts[0]) or ""
        assert (r.size, r.text_crc32) == (len(raw.encode()) + 1, zlib.crc32(raw.encode()))
    sources = {r.source for r in rows}
    for s in sources:
        counts = [sum(r.source == s and r.shard == k for r in rows) for k in range(4)]
        assert max(counts) - min(counts) <= 2
    assert sharding.stratified_shards(docs.limit(0)).count() == 0
    again = sharding.stratified_shards(docs.repartition(2), shards=4, source_buckets=3, order_buckets=5)
    assert {(r.id, r.text_crc32): (r.shard, r.slot) for r in again.collect()} == {(r.id, r.text_crc32): (r.shard, r.slot) for r in rows}


def plain_recurring(rows, min_docs, min_tokens, depth, constant):
    """Numbers of the lines to drop, per row."""
    mask = lambda ws: tuple("<*>" if any(c.isdigit() for c in w) else w for w in ws)
    lines = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= min_tokens:
                lines.setdefault((d, mask(line.split())), []).append(n)
    leaf = lambda w: (len(w), w[:depth])
    docs_of, tokens = {}, {}
    for d, w in lines:
        docs_of.setdefault(leaf(w), set()).add(d)
        for p, x in enumerate(w):
            tokens[leaf(w), p, x] = tokens.get((leaf(w), p, x), 0) + 1
    groups = {}
    for (d, w), where in lines.items():
        fixed = tuple(x if tokens[leaf(w), p, x] >= min_docs else None for p, x in enumerate(w))
        if len(docs_of[leaf(w)]) >= min_docs and sum(x is not None for x in fixed) >= constant * len(w):
            groups.setdefault((leaf(w), fixed), {}).setdefault(d, []).extend(where)
    out = {}
    for found in groups.values():
        if len(found) >= min_docs:
            for d in sorted(found)[1:]:
                out.setdefault(d, set()).update(found[d])
    return out


def test_templates(spark):
    rows = []
    for n in range(40):
        lines = [prose(12), f"Posted by user{n} on day {n % 3} of the year", prose(6), "a b"]
        if n % 2:
            lines.append(f"All rights reserved by {RNG.choice(VOCABULARY)} and friends of ours")
        if n % 5 == 0:
            lines.append("\t")
        rows.append((n, "\n".join(lines)))
    rows += [(100 + n, rows[0][1]) for n in range(3)] + [(200, None), (201, ""), (202, "Posted by user1 on day 1 of the year")]
    docs = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], "doc_id long, text string, lines string, rid int").repartition(3)
    how = {"min_docs": 5, "min_tokens": 4, "depth": 3, "constant": 0.7}
    want = plain_recurring(rows, 5, 4, 3, 0.7)
    assert want
    for whole in (None, 0.5):
        got = {r.doc_id: r for r in templates.without_recurring_lines(docs, whole, **how).collect()}
        for d, t in rows:
            all_lines = (t or "").split("\n")
            off = want.get(d, set())
            if whole is not None and sum(len(all_lines[n].split()) for n in off) > whole * sum(len(x.split()) for x in all_lines):
                off = set()
            assert got[d].text == (t if not off else "\n".join(x for n, x in enumerate(all_lines) if n not in off))
            assert (got[d].n_lines, got[d].n_dropped, got[d].lines, got[d].rid) == (len(all_lines), len(off), "x", 5)
    assert templates.without_recurring_lines(docs.limit(0), **how).count() == 0


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_shards_are_those_of_one_sorted_list(spark, docs, shards):
    """The places that counts of buckets give, against ranks and a sort of all rows in one list."""
    hashed = docs.select("doc_id", "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"))
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    hashed = hashed.withColumns({"h": F.xxhash64(F.lit(17), F.col("doc_id").cast("string"), crc), "s": F.xxhash64("stratum")})
    rows = [(r.stratum, r.h, r.s, r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in hashed.collect()]
    by_stratum, order, buckets = {}, [], max(3, -(-len(rows) // 7))
    for r in sorted(rows, key=lambda r: (r[0], r[1] % buckets, r[1], r[3] is not None, r[3] or 0, r[4])):
        by_stratum.setdefault(r[0], []).append(r)
    for own in by_stratum.values():
        order += [((k + 0.5) / len(own), r) for k, r in enumerate(own)]
    order.sort(key=lambda x: (x[0], x[1][2], x[1][1], x[1][3] is not None, x[1][3] or 0, x[1][4]))
    cuts = [k * len(order) // shards for k in range(shards + 1)]
    want = sorted(((r[3], r[4], r[5], k, at - cuts[k]) for k in range(shards) for at, (_, r) in enumerate(order) if cuts[k] <= at < cuts[k + 1]), key=str)
    got = sharding.stratified_shards(docs, shards=shards, source_buckets=3, order_buckets=5, bucket_rows=7).collect()
    assert sorted(((r.id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == want


def test_perspectives(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", "Hey"), (1, 3, "ann", None), (2, 0, "system", "alone"), (3, None, None, ""), (3, 1, "unknown", "x"), (None, 5, "zoe", "é"), (None, 5, "zoe", "é"), (4, -600, "a\nassistant", "q"), (4, -1, "b", "r"), (4, 0, "b", "s")]
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, perspective string, `a.b` string")
    got = {(r.conv_id, r.perspective, r.part): r for r in perspectives.perspectives(turns).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (3, None, 0), (3, "unknown", 0), (3, None, 1), (3, "unknown", 1), (None, "zoe", 0), *((4, p, n) for p in ("a\nassistant", "b") for n in range(3))}
    ann = got[1, "ann", 0]
    assert ann.text == "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi <\\|im_end|><|im_end|>\n<|im_start|>user name=bob\nHey<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in ann.mask.split(",")]
    assert [ann.text[a:b] for a, b in spans] == ["Hi <\\|im_end|>", ""]
    assert [got[1, "bob", 0].text[a:b] for a, b in [tuple(map(int, s.split("-"))) for s in got[1, "bob", 0].mask.split(",")]] == ["Hey"]
    assert got[None, "zoe", 0].n_turns == 2
    assert (got[3, None, 0].n_own, got[3, None, 1].n_own, got[3, "unknown", 1].n_own) == (1, 0, 1)
    assert got[4, "b", 0].text == "<|im_start|>user name=a\\nassistant\nq<|im_end|>\n" and got[4, "b", 1].start == len(got[4, "b", 0].text)
    assert perspectives.perspectives(turns.limit(0)).count() == 0


@pytest.mark.parametrize("how", [{}, {"part_turns": 3}, {"part_turns": 8, "part_rows": 5}])
def test_parts_make_up_the_whole_dialogue(spark, how):
    """Joined parts are the whole dialogue, with spans that count from its beginning; no part is long."""
    rows = [(n % 2, n // 4, f"p{n % 3}", f"text {n}") for n in range(80)] + [(0, None, "p0", f"null {n}") for n in range(40)] + [(1, 7, "p1", "again")] * 30
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {}
    for r in sorted(perspectives.perspectives(turns, **how).collect(), key=lambda r: r.part):
        found.setdefault((r.conv_id, r.perspective), []).append(r)
    assert len(found) == 6
    for (conv, p), parts in found.items():
        text = "".join(r.text for r in parts)
        assert [r.part for r in parts] == list(range(len(parts)))
        assert [r.start for r in parts] == [sum(len(x.text) for x in parts[:k]) for k in range(len(parts))]
        own = [text[int(s.split("-")[0]) : int(s.split("-")[1])] for r in parts if r.mask for s in r.mask.split(",")]
        told = sorted(((t is not None, t or 0, who, x) for c, t, who, x in rows if c == conv))
        assert own == [x for _, _, who, x in told if who == p]
        heads = ["assistant" if who == p else f"user name={who}" for _, _, who, _ in told]
        assert text == "".join(f"<|im_start|>{h}\n{x}<|im_end|>\n" for h, (_, _, _, x) in zip(heads, told, strict=True))
        assert sum(r.n_turns for r in parts) == sum(c == conv for c, *_ in rows)
        if "part_rows" in how:
            assert max(r.n_turns for r in parts) <= how["part_rows"] and len(parts) > 8


def test_one_row_more_changes_no_order(spark):
    for n in (16, 17):
        turns = spark.createDataFrame([(1, 0, "ann", f"{k:05}") for k in range(n)], "conv_id long, turn long, role string, text string").repartition(3)
        found = sorted(perspectives.perspectives(turns, part_rows=16).collect(), key=lambda r: r.part)
        assert [r.n_turns for r in found] == [16, 1][: n - 15] and "".join(r.text for r in found).split("<|im_end|>\n")[:-1] == [f"<|im_start|>assistant\n{k:05}" for k in range(n)]


def test_registered_queries_run(spark):
    """Each numbered operator is registered once."""
    names = [n for n in queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_a_bin_takes_no_more_than_it_says(monkeypatch):
    """Suffixes are sorted a piece at a time, passages hashed a slice at a time, and a bin's members come in batches; each was whole."""
    import tracemalloc

    import numpy as np

    rng = random.Random(53)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(300)) * 40 + b"b" * 500, np.uint8)
    at = np.array([rng.randrange(len(data)) for _ in range(400)])
    size = np.minimum(len(data) - at, rng.randrange(3000, 4000))
    for some in (1, 1 << 20):
        monkeypatch.setattr(maximal, "SORT_BYTES", some)
        want = sorted(range(len(at)), key=lambda i: (data[at[i] : at[i] + size[i]].tobytes(), i))
        assert maximal._sorted(data, at, size).tolist() == want
    tracemalloc.start()
    monkeypatch.setattr(maximal, "SORT_BYTES", 1 << 16)
    maximal._sorted(np.tile(data, 40), np.arange(2000), np.full(2000, 100_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20_000_000

    monkeypatch.setattr(maximal, "MEMBERS", 50)
    texts = [bytes(rng.choice(b"abc") for _ in range(9)) + data[:120].tobytes() + bytes([65 + n]) for n in range(30)]
    bin_of = pa.table({
        "p1": pa.array(range(30), pa.int64()), "p2": pa.array(range(30), pa.int64()), "content": pa.array(texts, pa.binary()), "starts": pa.array([80] * 30, pa.int32()),
        "before": pa.array([maximal.NONE] * 30, pa.int32()), "n_texts": pa.array([1] * 30, pa.int64()), "n_rows": pa.array([1] * 30, pa.int64()),
    })
    whole = list(maximal._tree(50, 200)((), bin_of))
    assert len(whole) > 1 and max(b.num_rows for b in whole) <= 60
    monkeypatch.setattr(maximal, "HASH_BYTES", 1)
    monkeypatch.setattr(maximal, "MEMBERS", 1 << 16)
    assert pa.Table.from_batches(maximal._tree(50, 200)((), bin_of)).to_pylist() == pa.Table.from_batches(whole).to_pylist()
