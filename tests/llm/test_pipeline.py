"""The corpus pipeline against a version written out in plain loops, and its stages on difficult tables."""

import hashlib
import random
import re
from functools import lru_cache

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from kinweave.llm import bpe, templates
from tests.llm.plain import plain_classes

RNG = random.Random(31)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randrange(3, 9))) for _ in range(900)]
SPACE = r"[^\x20\x09-\x0D]+"


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ITEMS = [(1, prose(14)), (2, prose(6)), (3, None), (4, "")]
LICENSE, LONG = "Licensed under the Open License, Version 2.0.", prose(55)


@lru_cache(maxsize=1)
def corpus():
    rows = []
    for n in range(45):
        lines = [prose(RNG.randrange(15, 40)) for _ in range(RNG.randrange(1, 4))]
        lines += [f"Posted by user{n} on day {n} of the year"] * (n % 2) + [LICENSE] * (n % 3 == 0) + ["Read more"] * (n % 5 != 0) + [LONG] * (n in (4, 9))
        lines += [f"before {ITEMS[0][1].title()}, after"] * (n == 7) + [prose(3) + " " + ITEMS[1][1]] * (n == 8) + ["# $ %" * 20] * (n == 11) + [prose(4)] * (n == 12)
        RNG.shuffle(lines)
        rows.append("\n".join(lines))
    rows += [rows[0], rows[1] + " more", rows[1].upper(), "two words", "", None, ("again and again the very same eight words here " * 9), prose(400), prose(30) + "\n" + prose(30)]
    words = rows[-2].split()
    words[200] = "changed"
    rows.append(" ".join(words))
    return [(3 * n + 1, t) for n, t in enumerate(rows)]


def plain_quality(t):
    t = t or ""
    w, lines = re.findall(SPACE, t), [x for x in t.split("\n") if re.search(SPACE, x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    repeat = len({i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(8)})
    shout = sum(len(x) > 1 and x.upper() == x and x.lower() != x for x in w)
    return not (
        len(w) < 20 or 100 * repeat > 30 * len(w) or 10 * len(re.findall(r"[#*$%&|<>]", t)) > len(w) or 2 * shout > len(w) or 5 * t.count("!") > len(w)
        or (len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines)) or sum(map(len, w)) > 20 * len(w) or sum(map(len, w)) < 2 * len(w)
    )


def plain_lines(rows):
    """Texts without recurring lines: narrow and wide templates, short and long lines, and copies of one first document left."""
    mask = lambda ws: tuple("<*>" if re.search("[0-9]", w) else w for w in ws)
    groups = {}  # what a line counts as: {document: lines}
    leaves = {}
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            w = line.split()
            if len(w) >= templates.MIN_TOKENS:
                leaves.setdefault((len(w), mask(w[: templates.DEPTH])), {}).setdefault((d, mask(w)), []).append(n)
            elif w:
                groups.setdefault(("short", tuple(w)), {}).setdefault(d, []).append(n)
            if len(w) > templates.LONG_TOKENS:
                groups.setdefault(("long", mask(w)), {}).setdefault(d, []).append(n)
    for leaf, lines in leaves.items():
        n_docs = len({d for d, _ in lines})
        if n_docs < templates.MIN_DOCS:
            continue
        count = {}
        for _, w in lines:
            for p, x in enumerate(w):
                count[p, x] = count.get((p, x), 0) + 1
        for (d, w), where in lines.items():
            shapes = []
            for least in (templates.MIN_DOCS, max(templates.MIN_DOCS, templates.COMMON * n_docs)):
                fixed = tuple(x if count[p, x] >= least else None for p, x in enumerate(w))
                if sum(x is not None for x in fixed) >= templates.CONSTANT * len(w):
                    shapes.append(fixed)
            for shape in set(shapes):
                groups.setdefault(("leaf", leaf, shape), {}).setdefault(d, []).extend(where)
    need = {"short": templates.SHORT_DOCS, "long": templates.LONG_DOCS, "leaf": templates.MIN_DOCS}
    off, common = {}, {}
    for key, found in groups.items():
        if len(found) >= need[key[0]]:
            head, *rest = sorted(found)
            for d in rest:
                off.setdefault(d, set()).update(found[d])
                common.setdefault(d, {}).setdefault(head, set()).update(found[d])
    texts = dict(rows)
    for d, t in rows:
        lines = (t or "").split("\n")
        size = lambda ns, lines=lines: sum(len(lines[n].split()) for n in ns)
        copy = any(size(ns) >= templates.COPY * max(size(range(len(lines))), len(texts[h].split())) for h, ns in common.get(d, {}).items())
        yield d, t if copy or d not in off else "\n".join(x for n, x in enumerate(lines) if n not in off[d])


def plain_hit(t):
    low = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
    w = low(t)
    for _, item in ITEMS:
        own = low(item)
        for win in ({tuple(own[i : i + 10]) for i in range(max(1, len(own) - 9))} if own else ()):
            if any(tuple(w[k : k + len(win)]) == win for k in range(len(w) - len(win) + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_run_is_the_stages_written_out(spark, folder):
    rows = [(d, t) for d, t in corpus() if plain_quality(t)]
    good = len(rows)
    rows = list(plain_lines(rows))
    changed = sum(dict(corpus())[d] != t for d, t in rows)
    classes = plain_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d] == d]
    distinct = len(rows)
    rows = [(d, t) for d, t in rows if not plain_hit(t)]
    assert len(corpus()) > good > distinct > len(rows) > 30 and changed > 20
    path, pattern = bpe.default_file()
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.vocabulary(path).ranks, special_tokens={})
    want = {}
    for d, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), True)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.round_trip) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want
    assert path == public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


NAMES = ["n_words", "failed", "_", "kept", "spans", "items", "n_lines", "n_dropped", "row", "found", "rid", "a.b", "x`y", "component_id", "gone", "vertex"]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_difficult_tables(spark, folder, name):
    """Clashing and dotted columns stay as they are; nulls, repeated rows and ids, and empty tables have defined results."""
    stage = dict(corpus_pipeline.STAGES)[name]
    last = name == corpus_pipeline.STAGES[-1][0]
    plain = spark.read.parquet(f"{folder}/documents.parquet")
    docs = plain.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))
    odd = [(2001, None, None, None, None), (None, prose(40), None, None, None), (2002, "", "en", None, 0), *[(2003, f"{LONG} end", None, None, 9)] * 3, (2004, "x" * 200_000, None, None, 0), (2005, prose(60_000), None, None, 0)]
    docs = docs.union(spark.createDataFrame(odd, plain.schema).select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES)))
    out = stage(spark, docs, folder)
    kept = out.collect()
    assert kept
    if not last:
        assert out.columns == docs.columns and [x.dataType for x in out.schema] == [x.dataType for x in docs.schema]
        assert all(r[5 + k] == f"own {n}" for r in kept for k, n in enumerate(NAMES))
    ids = [r.doc_id for r in kept]
    both = [ids.count(x) for x in (None, 2003, 2004, 2005)]
    assert both == {"quality_rules": [1, 3, 0, 1]}.get(name, [1, 3, 1, 1])
    assert {r.doc_id for r in stage(spark, plain, folder).collect()} <= set(ids) | {None}
    assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.parametrize("most", [90, (1 << 63) - 1])
def test_copies_without_id_go(spark, most):
    """A row without id goes if a document with one, or another such row, is near it; also where no greater id is left."""
    a, b, c, d = prose(30), prose(40), prose(25), prose(35)
    near = b.rsplit(" ", 1)[0] + " other"
    rows = [(7, a, "first"), (None, a, "copy"), (None, near, "near"), (most, b, "near"), (None, c, "twice"), (None, c, "twice"), (None, d, "alone"), (12, "", "empty"), (None, None, "no words"), (9, c[: len(c) // 3], "part")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    said = sorted(r.kind for r in kept)
    assert said == ["alone", "empty", "first", "near", "part", "twice"]
    assert {(r.doc_id, r.kind) for r in kept} == {(7, "first"), (12, "empty"), (9, "part"), (most, "near"), (None, "alone"), (None, "twice")}
    nameless = corpus_pipeline.near_dedup(spark, docs.filter("doc_id is null"), "").collect()
    assert sorted(r.kind for r in nameless) == ["alone", "copy", "near", "no words", "twice"]
