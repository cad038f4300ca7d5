"""Files read in blocks, against Python's readers, for blocks of any size; discovery as a table."""

import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators.positions import with_positions
from kinweave.sources import blocks
from kinweave.sources.csv_records import header_places, resolve_headers
from kinweave.sources.files import load

RNG = random.Random(8)


@pytest.fixture(params=[1 << 30, 97])
def block_size(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


VALUES = ["a", "", "x y", 'say "hi"', "two\nlines", "comma, here", '""', '"', "é日", "long " * 20, "\n\n", 'a"b', ' "q"']


def csv_text(n, end="\n"):
    out = io.StringIO()
    rng = random.Random(n)
    csv.writer(out, lineterminator=end).writerows([["h1", "h 2", "h3"], *([rng.choice(VALUES) for _ in range(rng.choice([3, 3, 2, 4]))] for _ in range(60))])
    return out.getvalue()


def by_name(rows, place, value):
    out = {}
    for r in sorted(rows, key=lambda r: (r.uri, r[place])):
        out.setdefault(r.uri.rsplit("/", 1)[-1], []).append((r[place], r[value]))
    return out


def test_csv_is_the_same_for_blocks_of_any_size(spark, tmp_path, block_size):
    texts = {"a.csv": csv_text(1), "b.csv": csv_text(2) + 'plain,5" pipe,"x"tail,"never closed\nto the end,', "c.csv": "only,a,header\n", "d.csv": "", "e.csv": csv_text(3).rstrip("\n")}
    for name, text in texts.items():
        (tmp_path / name).write_text(("﻿" if name == "a.csv" else "") + text, newline="")
    (tmp_path / "w.csv").write_text(csv_text(4, "\r\n"), newline="")
    texts["w.csv"] = csv_text(4, "\r\n").replace("\r\n", "\n")
    got = blocks.csv_rows(blocks.pieces(spark, [str(tmp_path)]), {"head": F.array_join("header", "|")}).collect()
    want = {k: [(n, r) for n, r in enumerate(csv.reader(io.StringIO(t, newline=""))) if n and r] for k, t in texts.items()}
    assert by_name(got, "number", "fields") == {k: v for k, v in want.items() if v}
    assert {r.head for r in got} == {"h1|h 2|h3"}


def nested(deep=0):
    keys = ["a", "b}", "c{", 'd"q', "e\\"]
    values = [1, None, "x}", "{y", "[z]", 'q"}', "back\\", [1, {"in": "}"}], {}, *((nested(deep + 1), [nested(deep + 1), "]"]) if deep < 2 else ())]
    return {RNG.choice(keys): RNG.choice(values) for _ in range(RNG.randrange(4))}


def test_json_is_the_same_for_blocks_of_any_size(spark, tmp_path, block_size):
    want = {}

    def put(name, text, objects):
        (tmp_path / name).write_text(text)
        if objects:
            want[name] = objects

    for n in range(3):
        items = [RNG.choice([nested(), nested(), 5, "s{},[", None, [nested(), 3], {"é日": "}"}]) for _ in range(50)]
        put(f"a{n}.json", ("﻿" if n == 1 else "") + json.dumps(items, indent=n or None, ensure_ascii=n < 2), [x for x in items if isinstance(x, dict)])
    put("one.json", '\n {"a": {"b": 1}} \n', [{"a": {"b": 1}}])
    put("two.json", ' [ {"a":"x"}]  ', [{"a": "x"}])
    for name, text in {"empty.json": "[]", "none.json": "", "cut.json": '[{"a":1},{"b":', "open.json": '[{"a":1}', "lines.json": '{"a":1}\n{"a":2}\n', "number.json": "7", "text.json": '"{}"', "quote.json": '[{"a":"}]'}.items():
        put(name, text, [])
    got = blocks.json_objects(blocks.pieces(spark, [str(tmp_path)], end="}")).collect()
    assert {k: [json.loads(v) for _, v in x] for k, x in by_name(got, "pos", "value").items()} == want


def test_a_file_is_the_work_of_many_tasks(spark, tmp_path, block_size):
    (tmp_path / "people.csv").write_text("name,email\n" + "".join(f'"Pat,\n{n}",p{n}@x.io\n' for n in range(200)))
    (tmp_path / "export.json").write_text(json.dumps([{"name": f"Sam {n}", "email": f"s{n}@x.io"} for n in range(200)]))
    raw, report = load(spark, paths=[str(tmp_path / "people.csv"), str(tmp_path / "export.json")])
    got = [(r.full_name, r.emails[0], r.rec_seq) for r in raw.orderBy("rec_seq").collect()]
    assert got == [(f"Pat,\n{n}", f"p{n}@x.io", n) for n in range(200)] + [(f"Sam {n}", f"s{n}@x.io", (1 << 32) + n) for n in range(200)]
    parts = blocks.pieces(spark, [str(tmp_path / "people.csv")]).rdd.getNumPartitions()
    assert block_size > 10_000 or parts > 5


def test_headers_by_place(spark):
    for header in (["Name", "candidate", " EMAIL "], ["﻿Full Name", "x", "E-mail", "Role", "title"], ["email", "name", "email"], [], ["nothing"]):
        got = spark.range(1).select(header_places(F.array(*map(F.lit, header)) if header else F.array().cast("array<string>")).alias("p")).first().p.asDict()
        want = {f: len(header) - 1 - header[::-1].index(name) for f, name in resolve_headers(header).items()}
        assert {k: v for k, v in got.items() if v is not None} == want


def test_many_files_are_a_table_and_no_list_is_in_the_plan(spark, tmp_path):
    for n in range(120):
        (tmp_path / f"f{n:03}.csv").write_text(f"name,email\nPat {n},p{n}@x.io\n")
    (tmp_path / "told.txt").write_text("  [" + json.dumps({"name": "Told Json"}) + "]")
    (tmp_path / "rows").write_text("name,email\nTold Csv,t@x.io\n")
    (tmp_path / "prose").write_text("Told Prose\nt2@x.io\nSkills\nGo\n")
    raw, report = load(spark, paths=[str(tmp_path)])
    got = [r.full_name for r in raw.orderBy("rec_seq").collect()]
    assert got == [f"Pat {n}" for n in range(120)] + ["Told Prose", "Told Csv", "Told Json"]
    assert [(r.source, r.n_records, r.warning) for r in report.collect()] == [("recruiter_csv", 123, None)]
    assert "f103.csv" not in raw._jdf.queryExecution().toString()


def test_files_that_need_a_codec_give_no_record(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pdf = b"%PDF-1.4\n1 0 obj << /Producer (Maker support@pdfmaker.com) >> endobj\nxref\n0000000015 65535 f\n"
    for name in ("cv.PDF", "cv.docx", "in/other.pdf"):
        (tmp_path / name).write_bytes(pdf)
    (tmp_path / "in" / "cv.md").write_text("Ann Lee\nann@x.io\n")
    raw, report = load(spark, paths=[str(tmp_path / x) for x in ("cv.PDF", "cv.docx", "in")], profiles=[str(tmp_path / "cv.PDF")])
    assert [r.emails for r in raw.collect()] == [["ann@x.io"]]
    assert sorted((r.path.rsplit("/", 1)[-1], r.source, r.n_records, r.warning[:14]) for r in report.collect()) == [
        ("cv.PDF", "linkedin", 0, "no codec for 1"), ("cv.PDF", "resume", 0, "no codec for 1"), ("cv.docx", "resume", 0, "no codec for 1"), ("in", "resume", 1, "no codec for 1")]


def test_inline_profiles_and_saved_tables_have_their_place(spark, tmp_path):
    (tmp_path / "bob.json").write_text(json.dumps({"name": "Bob File", "url": "linkedin.com/in/bob"}))
    users = spark.createDataFrame([("zoe", "Zoe", "z@x.io", None, None, "https://github.com/zoe", None), ("amy", None, None, None, "India", "https://github.com/amy", None)],
                                  "login string, name string, email string, bio string, location string, html_url string, blog string")
    repos = spark.createDataFrame([("amy", 0, "Go")], "login string, repo_rank int, language string")
    raw, report = load(spark, profiles=['{"name": "Inline Json"}', str(tmp_path / "bob.json"), "https://www.linkedin.com/in/just-a-link", "Text Person\ntext@x.io\n"],
                       profile_urls=["linkedin.com/in/last"], users=users, repos=repos)
    got = [(r.source, r.full_name or r.links.linkedin or r.skills[0]) for r in raw.orderBy("rec_seq").collect()]
    assert got == [("linkedin", "Inline Json"), ("linkedin", "Bob File"), ("linkedin", "https://linkedin.com/in/just-a-link"), ("linkedin", "Text Person"), ("linkedin", "https://linkedin.com/in/last"), ("github", "Go"), ("github", "Zoe")]
    assert sorted((r.source, r.n_records) for r in report.collect()) == [("github", 2), *[("linkedin", 1)] * 5]
    assert load(spark)[0].count() == 0 and load(spark, users=users)[0].count() == 2


def test_positions(spark):
    values = [RNG.randrange(50) for _ in range(500)]
    got = with_positions(spark.createDataFrame([(v,) for v in values], "v int").repartition(7), [F.desc("v")]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(500)) and [r.v for r in got] == sorted(values, reverse=True)
    assert with_positions(spark.createDataFrame([], "v int"), ["v"]).collect() == []

def test_files_are_opened_once(spark, tmp_path):
    """A file per person in folders of their own: each is listed by few tasks and opened by one reader, whatever reads the records."""
    from kinweave.sources import files
    from kinweave.sources.blocks import LISTERS

    for kind, text in (("cv", "Some Body\nb{}@x.io\n"), ("talk", "Mail t{}@x.io"), ("profile", '{{"name": "Pat", "email": "p{}@x.io"}}')):
        for n in range(40):
            (tmp_path / kind / f"n={n}").mkdir(parents=True)
            (tmp_path / kind / f"n={n}" / "part.txt").write_text(text.format(n))
    (tmp_path / "people.csv").write_text("name,email\nPat,p1@x.io\n")
    context, at = spark.sparkContext, lambda x: str(tmp_path / x)
    context.setJobGroup("files opened once", "load")
    raw, report = files.load(spark, paths=[at("people.csv"), at("cv")], notes=[at("talk")], profiles=[at("profile")])
    context.setJobGroup("after", "after")
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("files opened once") for s in tracker.getJobInfo(j).stageIds]
    assert {s.numTasks for s in stages if s} and max(s.numTasks for s in stages if s and s.name.startswith(("load at", "text at"))) <= LISTERS * context.defaultParallelism
    assert "FileScan" not in raw._jdf.queryExecution().executedPlan().toString() and "FileScan" not in report._jdf.queryExecution().executedPlan().toString()
    assert raw.count() == 121 and sorted((r.source, r.n_records) for r in report.collect()) == [("linkedin", 40), ("recruiter_csv", 1), ("recruiter_notes", 40), ("resume", 40)]
