"""The n-gram join against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from kinweave.llm import ngram_join

RNG = random.Random(11)
WORDS = [f"w{n}" for n in range(3000)]


def plain_sets(text, width=3):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def plain_join(rows, t=Fraction(9, 10)):
    sets = {}
    for d, text in rows:
        if d is not None:
            sets.setdefault(d, []).append(plain_sets(text))
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and any(x and y and len(x & y) >= t * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


def near_rows():
    rows = []
    for _ in range(20):
        base = [RNG.choice(WORDS) for _ in range(RNG.choice([4, 11, 40, 200, 700]))]
        for k in (0, 1, 1, 2, 3, 4, 6):
            own = list(base)
            for at in RNG.sample(range(len(own)), min(len(own), k * len(own) // 200 + (k > 2))):
                own[at] = RNG.choice(WORDS)
            rows.append(" ".join(own))
    rows += [rows[0], rows[0].upper(), "", None, " \n", "one", "One", "two words", "a b c", "c b a", "a b c a b c a b c"]
    return list(enumerate(rows))


def got_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return ngram_join.join_near(docs, **more).collect()


@pytest.mark.parametrize("similarity", [0.9, 0.7])
def test_classes_are_those_of_all_pairs(spark, similarity):
    rows = near_rows()
    want = plain_join(rows, Fraction(str(similarity)))
    got = got_of(spark, rows, similarity=similarity)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.n_shingles for r in got} == {d: len(plain_sets(t)) for d, t in rows}
    assert any(want[d] != d and rows[d][1] != rows[want[d]][1] for d in want)


def test_frequent_tokens_combine_and_large_buckets_are_dealt(spark, monkeypatch):
    """With nearly every token frequent or very frequent, buckets of two and no end to the rounds but the last, the result is the same."""
    passage = [RNG.choice(WORDS) for _ in range(80)]
    rows = near_rows()
    for n in range(60):
        own = list(passage)
        for at in RNG.sample(range(80), n % 4):
            own[at] = RNG.choice(WORDS)
        rows.append((1000 + n, " ".join(own)))
    want = plain_join(rows)
    for name, value in (("FREQUENT_HERE", 1), ("FREQUENT_DOCS", 2), ("VERY_FREQUENT_DOCS", 20), ("SMALL", 3), ("FEW", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    tokens, counts = ngram_join.frequent_tokens(spark.createDataFrame(rows, "doc_id long, text string").select("text"), 3)
    assert (counts >= 20).any() and (counts < 20).any()
    assert {r.doc_id: r.component_id for r in got_of(spark, rows, chunk=4)} == want


def test_combinations_of_a_pair_meet():
    """Whatever the classes of their tokens, two sets of similarity 0.9 have a key in common."""
    rng = np.random.default_rng(4)
    t = Fraction(9, 10)
    classes = ngram_join.size_classes(t)
    assert classes[0].low == 9
    for _ in range(400):
        n = int(rng.integers(9, 300))
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        kinds = dict(zip(x.tolist(), rng.choice([1, 2, 3], n, p=rng.dirichlet([0.5, 0.5, 0.5])), strict=True))
        more = rng.integers(0, 1 << 63, n).astype(np.uint64)
        kinds.update(zip(more.tolist(), rng.choice([1, 2, 3], n), strict=True))
        gone = int(rng.integers(0, n // 19 + 1))
        y = np.concatenate([rng.permutation(x)[: n - gone], more[:gone]])
        common = len(np.intersect1d(x, y))
        if common < t * (2 * n - common):
            continue
        keys = []
        for own in (x, y):
            own = own[np.lexsort((own, [kinds[v] for v in own.tolist()]))]
            keys.append([set(c.keys(own, np.array([kinds[v] for v in own.tolist()], np.int8)).tolist()) for c in classes if c.low <= n <= c.high])
        assert any(a & b for a, b in zip(*keys, strict=True))


def test_ids_and_empty_tables(spark):
    long_text = " ".join(f"x{n}" for n in range(60_000))
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "p q r s"), (2, "a b c d"), (3, "p q r s"), (None, "p q r s"), (None, "only here"), (4, ""), (4, None), (7, long_text), (8, long_text + " tail")]
    got = got_of(spark, rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted([
        (1, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 2, 1), (None, 2, 1), (None, 1, None), (4, 0, 4), (4, 0, 4), (7, 59_998, 7), (8, 59_999, 7)], key=str)
    assert got_of(spark, []) == []
    docs = spark.createDataFrame([(5, "a b c", 1, 2)], "`a.b` long, `t.x` string, rep long, component long")
    assert [tuple(r) for r in ngram_join.join_near(docs, id_col="a.b", text_col="t.x").collect()] == [(5, 1, 5)]


def test_texts_without_candidates_stay_where_they_are(spark):
    """Long texts that nothing is compared with go through no exchange, in no round."""
    rng = random.Random(12)
    rows = [(n, " ".join(rng.randbytes(40).hex() for _ in range(60))) for n in range(200)]
    rows += [(200 + n, rows[n][1] + " more") for n in range(0, 20, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).checkpoint()
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def sent():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = sent()
    got = {r.doc_id: r.component_id for r in ngram_join.join_near(docs).collect()}
    moved = sum(n for k, n in sent().items() if k not in before)
    assert got == {n: n - 200 if n >= 200 else n for n, _ in rows}
    assert moved < sum(len(t) for _, t in rows) / 2
