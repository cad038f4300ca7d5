"""The near-duplicate stage of the pipeline, against brute force."""

import random
from fractions import Fraction

import numpy as np

from kinweave.llm import jaccard, ngram_join
from tests.llm.plain import plain_classes

RNG = random.Random(3)
WORDS = [f"w{n}" for n in range(4000)]


def edited(words, n):
    """The words with n of them replaced, at places of their own: similarity falls from 1 to about 0.4."""
    out = list(words)
    for k in RNG.sample(range(len(out)), n):
        out[k] = RNG.choice(WORDS)
    return out


def near_rows():
    rows = []
    for _ in range(25):
        base = [RNG.choice(WORDS) for _ in range(RNG.choice([6, 30, 150, 600]))]
        rows += [" ".join(edited(base, len(base) * k // 100)) for k in (0, 1, 2, 3, 4, 5, 8)]
    rows += [rows[0], rows[0].upper(), "", None, " \n", "one", "One", "two words", "a b c d e"]
    return list(enumerate(rows))


def test_near_dedup_removes_only_texts_of_exact_similarity(spark):
    """The stage against all pairs; a bound on fingerprint bits also links texts of about 0.68."""
    import corpus_pipeline

    rows = near_rows()
    want = plain_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {d for d, c in want.items() if d == c}
    assert any(want[d] != d for d in want if rows[d][1] and rows[d][1] != rows[want[d]][1])


def test_large_buckets_and_components_are_dealt_whole(spark):
    rows = near_rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, heavy_rows=2, chunk_sets=3).collect()}
    assert got.pop(None) == 0
    assert got == plain_classes(rows)


def test_near_dedup_goes_by_fingerprints_first(spark, monkeypatch):
    """Every row gets its fingerprint group from operator 7, and what is linked there meets as one class; the stage had no fingerprints."""
    import corpus_pipeline
    from kinweave.llm import simhash

    rng, rows = random.Random(5), []
    for _ in range(20):
        base = [rng.choice(WORDS) for _ in range(500)]
        for gap in (0, 0, 400, 300, 60, 12):  # a changed word every so many: the nearest are within three bits, the next are not, the last are not alike
            rows.append(" ".join("changed" if gap and k % gap == gap - 1 else w for k, w in enumerate(base)) + f" last{len(rows)}")
    rows = [*enumerate([*rows, "", None]), (1000, None), (1000, "some text of a repeated id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    grouped, met = [], []

    def groups(docs, found=simhash.near_duplicates):
        out = found(docs)
        grouped.extend(out.collect())
        return out

    def keys(keyed, *more, found=jaccard.shared_keys):
        met.extend(keyed.select("rep", "class").distinct().collect())
        return found(keyed, *more)

    monkeypatch.setattr(simhash, "near_duplicates", groups)
    monkeypatch.setattr(jaccard, "shared_keys", keys)
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(str(r.doc_id) for r in grouped) == sorted(str(d) for d, _ in rows)
    want = plain_classes(rows[:-3])
    group = {r.doc_id: r.component_id for r in grouped}
    joined = [r for r in met if r["class"] != r.rep]
    assert len(joined) > 10 and all(want[r.rep] == want[r["class"]] and group[r.rep] == group[r["class"]] for r in joined)
    # Links that are beyond three bits are found all the same.
    assert any(group[d] != group[c] for d, c in want.items())
    assert set(kept) - {None, 1000} == {d for d, c in want.items() if d == c}


def test_first_groups_change_nothing(spark):
    """Whatever sets are compared first, in whole or in chunks, the classes are those of all pairs."""
    rows = near_rows()
    want = plain_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for of, chunk in ((lambda d: 0, 3), (lambda d: 0, 512), (lambda d: d % 7, 512), (lambda d: -d, 512)):
        alike = spark.createDataFrame([(d, of(d)) for d, _ in rows], "doc_id long, component_id long")
        got = jaccard.near_duplicates(docs, chunk_sets=chunk, alike=alike).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_keys_of_one_class_are_left_out(spark):
    """Keys of one class go and others stay whole, however batches cut them; of a class of many rows, what is beyond the bound may stay."""
    rows = [(k, 10 * k + n, n % c) for k, c, size in ((1, 1, 5), (2, 2, 9), (3, 1, 1), (4, 3, 4), (5, 1, 7), (6, 2, 2)) for n in range(size)]
    rows += [(7, 70 + n, int(n == 8)) for n in range(9)]
    keyed = spark.createDataFrame(rows, "key long, rep long, class long").repartition(2)
    want = sorted(r[:2] for r in rows if r[0] in (2, 4, 6, 7))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 5, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert sorted(tuple(r) for r in jaccard.shared_keys(keyed).collect()) == want
            some = sorted(tuple(r) for r in jaccard.shared_keys(keyed, 6).collect())
            assert set(some) - set(want) <= {r[:2] for r in rows if r[0] == 5} and [r for r in some if r in want] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_single_tokens_as_keys_lose_no_link(spark, monkeypatch):
    """Pairs verified one by one, under keys of one token, with every repeated shingle frequent and buckets of two rows."""
    rows = near_rows()
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "`a.b` long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "FREQUENT_HERE", 2)
    monkeypatch.setattr(ngram_join, "FREQUENT_DOCS", 2)
    for chunk in (2, 2048):
        found = ngram_join.join_near(docs, 5, 0.8, id_col="a.b", chunk=chunk, combine=False, link_empty=True)
        got = {r.doc_id: r.component_id for r in found.collect()}
        assert got.pop(None) == 0
        assert got == plain_classes(rows)


def test_which_shingles_are_frequent_changes_nothing(spark, monkeypatch):
    """With every repeated shingle counted as frequent the classes are the same, and a passage of all texts makes no bucket."""
    passage = " ".join(RNG.choice(WORDS) for _ in range(60))
    rows = near_rows()
    rows += [(1000 + n, passage + " " + " ".join(RNG.choice(WORDS) for _ in range(60))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "FREQUENT_HERE", 2)
    monkeypatch.setattr(jaccard, "FREQUENT_DOCS", 2)
    frequent = jaccard.frequent_shingles(docs.select("text"), 5)
    assert len(frequent) > 56 and len(set(frequent.tolist())) == len(frequent)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == plain_classes(rows)
    own = np.sort(np.concatenate([frequent[:5], np.arange(9, dtype=np.uint64)]))
    assert jaccard.by_frequency(own, frequent, np.argsort(frequent)).tolist() == [*range(9), *frequent[:5].tolist()]


def test_prefixes_and_bounds_lose_no_pair():
    """Pairs of similarity 0.8 or more meet under a prefix shingle and pass the bounds; 120 keys of 18 bits lost 0.11 at their bound."""
    rng = np.random.default_rng(4)
    for t in (Fraction(4, 5), Fraction(1, 2), Fraction(1)):
        bounds, near = jaccard.Bounds(t), 0
        for _ in range(3000):
            n = int(rng.integers(1, 120))
            pool = np.unique(rng.integers(0, 2**64, n + 40, dtype=np.uint64))
            a = pool[np.sort(rng.permutation(len(pool))[:n])]
            gone = int(rng.integers(0, n // 4 + 1))
            b = np.union1d(rng.permutation(a)[gone:], rng.permutation(pool)[: int(rng.integers(0, n // 4 + 1))])
            common = len(np.intersect1d(a, b))
            if not len(b) or Fraction(common, len(np.union1d(a, b))) < t:
                continue
            near += 1
            assert set(a[: jaccard.prefix_length(len(a), t)].tolist()) & set(b[: jaccard.prefix_length(len(b), t)].tolist())
            cells = [np.frombuffer(bounds.cell(x), ">u8").astype(np.uint64).reshape(1, -1) for x in (a, b)]
            assert bounds.linked(*cells).all()
        assert near > 50


def test_texts_that_nothing_is_compared_with_stay_where_they_are(spark):
    """Long texts without near copies go through no exchange, whole rows of the table neither; each went through three."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(n, " ".join(rng.randbytes(40).hex() for _ in range(60)), n) for n in range(200)]
    rows += [(200 + n, rows[n][1] + " more", n) for n in range(0, 20, 2)] + [(None, "no id", 0), (220, None, 0), (220, "a repeated id", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").repartition(3)
    docs = docs.checkpoint()
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)

    def sent():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = sent()
    out = corpus_pipeline.near_dedup(spark, docs, "").collect()
    moved = sum(n for k, n in sent().items() if k not in before)
    assert moved < sum(len(t or "") for _, t, _ in rows) / 2
    assert {(r.doc_id, r.text, r["a.b"]) for r in out} == {r for r in rows if r[0] is None or r[0] < 200 or r[0] == 220}


def test_rows_are_told_apart_by_ids(spark, monkeypatch):
    """Every row of one of the ids may be one, hardly another; with a table of one word the rest is exact as well."""
    rng = random.Random(9)
    ids = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(3000)]
    docs = spark.createDataFrame([(i, k) for k, i in enumerate(ids)] + [(None, -1)], "doc_id long, rep int")
    gone = spark.createDataFrame([(i,) for i in ids[::7]], "rep long")
    for words, most in ((jaccard.MARKS, 20), (1, 3001)):
        monkeypatch.setattr(jaccard, "MARKS", words)
        told = jaccard.told_apart(docs.selectExpr("doc_id AS rep"), gone).collect()
        maybe = {r.rep for r in told if r.maybe}
        assert len(told) == 3001 and set(ids[::7]) <= maybe and len(maybe - set(ids[::7])) <= most
        left = sorted(r.rep for r in jaccard.without(docs, gone).collect())
        assert left == sorted([k for k in range(3000) if k % 7] + [-1])
    assert jaccard.without(docs, gone.limit(0)).count() == 3001
    assert jaccard.without(docs.limit(0), gone).count() == 0
