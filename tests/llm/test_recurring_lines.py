"""Recurring lines that counts of one size, length or document left in place."""

import random

import pytest

from kinweave.llm import templates

RNG = random.Random(8)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(9)) for _ in range(5000)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def dropped(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    return {r.doc_id: r.n_dropped for r in templates.without_recurring_lines(docs, **how).collect()}


@pytest.mark.parametrize("n", [240, 1200])
def test_a_field_of_many_values_is_variable_at_every_size(spark, n):
    """With 1,200 documents each name and city has 60, more than min_docs, and each pair of them 3."""
    rows = [(k, f"{prose(9)}\nThis page was saved by {WORDS[k % 20]} from {WORDS[20 + k // 20 % 20]}") for k in range(n)]
    got = dropped(spark, rows, whole=None, min_docs=25)
    assert got == {k: int(k > 0) for k in range(n)}


def test_lines_of_few_documents_short_lines_and_long_lines(spark):
    """A line in 6 documents, one of 3 words in 30, one of 60 words in 2; below these, and lone numbers that differ, stay."""
    long, other = prose(60), prose(60)
    rows = []
    for k in range(30):
        lines = [prose(9), "All rights reserved.", f"{k}", ""]
        lines += ["Licensed under the Apache License, Version 2.0."] * (k < 6) + ["Seen by only these four documents"] * (k < 4)
        lines += ["Read more"] * (k < 20) + [long] * (k in (3, 7)) + [other] * (k == 5)
        rows.append((k, "\n".join(lines)))
    got = dropped(spark, rows, whole=None, short_docs=templates.SHORT_DOCS, long_docs=templates.LONG_DOCS)
    assert got == {k: (k > 0) + (0 < k < 6) + (k == 7) for k in range(30)}


def test_mostly_recurring_texts_are_cut_unless_they_copy_one_document(spark):
    """Two recurring lines and one of its own are no copy; whole copies are, and only the pipeline leaves them."""
    a, b = "Subscribe to our weekly letter today", "All opinions are those of their authors"
    body = [prose(60) for _ in range(5)]
    rows = [(k, f"{a}\n{b}\n{prose(4)}") for k in range(8)] + [(20 + k, "\n".join(body)) for k in range(3)]
    docs = {d: t for d, t in rows}
    want = {k: 2 * (0 < k) for k in range(8)}
    how = {"long_docs": templates.LONG_DOCS}
    assert dropped(spark, rows, **how) == want | {20: 0, 21: 5, 22: 5}
    # Documents 1 to 7 have 13 of their 17 words in common with document 0.
    assert all(len(docs[k].split()) == 17 for k in range(8))
    assert dropped(spark, rows, copy=templates.COPY, **how) == want | {20: 0, 21: 0, 22: 0}


def test_frequent_and_other_constants_are_all_found(spark):
    """Constants that are broadcast and those that are not, the bound lying among equal counts."""
    each = spark.createDataFrame([(r, r, t) for r in range(40) for t in (r % 2, 10 + r % 4, 100 + r)], "rid long, own long, token long")
    constants = spark.createDataFrame([(0, 20, 1), (1, 20, 1), *((10 + k, 10, 0) for k in range(4))], "token long, count long, wide int")
    want = sorted((r, r, t, w) for r in range(40) for t, w in ((r % 2, 1), (10 + r % 4, 0)))
    for frequent in (1, 2, 3, 4, 6, 7, 100):
        assert sorted(map(tuple, templates._constants_of(each, constants, frequent).collect())) == want


def test_hot_leaves_are_broadcast_and_the_rest_shuffled(spark):
    """Whatever is broadcast, lines meet their leaves once each, and no key left to the shuffle is hot."""
    rows = [(n, 1 if n % 3 == 0 else n % 40) for n in range(300)]
    many = spark.createDataFrame(rows, "rid long, leaf long")
    few = many.groupBy("leaf").count().filter("leaf < 20").selectExpr("leaf", "count as rows", "leaf * 2 as head")
    want = sorted((leaf, rid, leaf * 2) for rid, leaf in rows if leaf < 20)
    for frequent in (1, 5, 1 << 15):
        met = templates._met(many, few, ["leaf"], len(rows), frequent)
        assert sorted(map(tuple, met.select("leaf", "rid", "head").collect())) == want
