"""Readers, projection, validation and the whole job on small files."""

import json

import pytest
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators import projection
from kinweave.plans.job import run_job, write_profiles
from kinweave.sources.csv_records import csv_records, read_csv, resolve_headers
from kinweave.sources.files import load, source_of
from kinweave.sources.json_records import ats_records, canonical_url, linkedin_records, url_records
from kinweave.sources.profile_tables import profile_records
from kinweave.sources.text_records import note_records, resume_records


def rows(df):
    return [r.asDict(recursive=True) for r in df.orderBy("rec_seq").collect()]


def texts(spark, *values):
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n long, value string")


def test_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_bytes('﻿Full Name,E-mail,Phone Number,Employer,Role,Shoe\n"Smith, Ann",A@x.io,(415) 555-0100,Acme,"Lead\nDev",9\n,,,,,7\nBob\n'.encode())
    found = rows(csv_records(read_csv(spark, str(path)).withColumn("_n", F.monotonically_increasing_id()), F.col("_n")))
    assert [(r["full_name"], r["emails"], r["headline"]) for r in found] == [("Smith, Ann", ["A@x.io"], "Lead\nDev"), ("Bob", [], None)]
    assert found[0]["experience"] == [{"company": "Acme", "title": "Lead\nDev", "start": None, "end": None, "summary": None}]
    assert resolve_headers(["Name", "candidate", " EMAIL "]) == {"full_name": "Name", "email": " EMAIL "}


ATS = [
    {"candidate_name": "Ann Lee", "emailAddress": ["A@x.io", "b@x.io"], "phoneNumber": "+1 415 555 0100", "yearsExperience": "7", "address": {"town": "Pune", "country": "India"}, "skill_set": ["py", " "],
     "linkedin_url": "https://linkedin.com/in/ann", "work_history": [{"employer": "Acme", "role": "Dev", "from": "2019-02", "to": "present"}, 5], "education": {"school": "MIT", "year": 2010}},
    {"firstName": "Bob", "lastName": "Ray", "years_experience": "7d", "city": "Rome", "skills": "sql"}, 7, "x", None, {"note": "nobody"}, {"NAME": "", "Full_Name": "Zed"},
]


def test_ats(spark):
    given = texts(spark, json.dumps(ATS), '{"name": "Lone"}', "not json", "", None, "[1, 2]")
    found = rows(ats_records(given, F.col("n") * 100 + F.col("pos")))
    assert [r["full_name"] for r in found] == ["Ann Lee", "Bob Ray", "Zed", "Lone"]
    ann, bob = found[:2]
    assert ann["emails"] == ["A@x.io", "b@x.io"] and ann["years_experience"] == 7.0 and ann["skills"] == ["py"]
    assert ann["location"] == {"city": "Pune", "region": None, "country": "India"}
    assert ann["experience"] == [{"company": "Acme", "title": "Dev", "start": "2019-02", "end": "present", "summary": None}]
    assert ann["education"] == [{"institution": "MIT", "degree": None, "field": None, "end_year": "2010"}]
    assert bob["years_experience"] is None and bob["skills"] == ["sql"] and bob["location"]["city"] == "Rome"
    assert list(found[0]) == list(schemas.RAW)


def test_linkedin(spark):
    given = texts(spark, json.dumps({"name": "Bob", "url": "https://in.linkedin.com/in/Bob-1/", "location": "Berlin", "skills": ["Go"], "positions": [{"companyName": "Acme", "title": "Dev"}], "schools": [{"schoolName": "MIT", "endYear": "2012"}]}))
    r = rows(linkedin_records(given, F.col("n")))[0]
    assert r["links"]["linkedin"] == "https://linkedin.com/in/Bob-1" and r["location"] == {"city": "Berlin", "region": None, "country": "Berlin"}
    assert r["experience"][0]["company"] == "Acme" and r["education"][0]["end_year"] == "2012"
    urls = texts(spark, "linkedin.com/in/a", "http://www.linkedin.com/in/a/", "https://de.linkedin.com/in/a?x=1", "https://example.com")
    assert [r["links"]["linkedin"] for r in rows(url_records(urls, F.col("n")))] == ["https://linkedin.com/in/a"] * 3
    assert spark.range(1).select(canonical_url(F.lit("nothing"))).first()[0] is None


def test_prose(spark):
    resume = "Ann Lee\na@x.io 415-555-0100\nSkills\npy, Go\n"
    assert [(r["full_name"], r["emails"], r["skills"]) for r in rows(resume_records(texts(spark, resume, "nothing to see", ""), F.col("n")))] == [("Ann Lee", ["a@x.io"], ["py", "Go"])]
    note = rows(note_records(texts(spark, "Spoke with Ann Lee.\nKnows  k8s", "nice weather"), F.col("n")))
    assert [(r["full_name"], r["skills"], r["headline"]) for r in note] == [("Ann Lee", ["Kubernetes"], "Spoke with Ann Lee. Knows k8s")]


def test_profile_tables(spark):
    users = spark.createDataFrame([(0, "ann", "Ann", "", "bio", "India", "https://github.com/ann", "ann.dev"), (1, "bob", None, None, None, None, "https://github.com/bob", " ")], "n long, login string, name string, email string, bio string, location string, html_url string, blog string")
    repos = spark.createDataFrame([("ann", 0, "Go"), ("ann", 1, None), ("ann", 2, "C"), ("ann", 3, "Go")], "login string, repo_rank int, language string")
    a, b = rows(profile_records(users, repos, F.col("n")))
    assert a["skills"] == ["Go", "C"] and a["links"]["portfolio"] == "https://ann.dev" and a["emails"] == [] and a["location"]["country"] == "India"
    assert b["skills"] == [] and b["links"]["portfolio"] is None and b["full_name"] is None


def test_source_kinds(spark):
    given = [("a.csv", ""), ("b.JSON", ""), ("c.md", "x"), ("d.txt", "name,email\n"), ("e.txt", "  [1]"), ("f.txt", "Ann, a@x.io"), ("g", "{}")]
    got = spark.createDataFrame(given, "p string, t string").select(source_of(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["recruiter_csv", "ats_json", "resume", "recruiter_csv", "ats_json", "resume", "ats_json"]


CONFIG = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True}, {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "country", "from": "location.country", "normalize": "lower"},
    ],
    "include_confidence": True,
}


def test_job(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,email,phone,current_company,title,location\nRob Smith,bob@x.io,(415) 555-0100,Acme,Engineer,India\n,broken@,,,,\n")
    (tmp_path / "a.json").write_text(json.dumps([{"name": "Robert Smith", "email": "BOB@x.io", "skills": ["python", "COBOL"], "years_experience": 6}]))
    (tmp_path / "notes.txt").write_text("Spoke with Robert Smith. Call +1 415 555 0100. Docker.")
    paths = [str(tmp_path / n) for n in ("r.csv", "a.json", "missing.json")]
    shown, report, wrong = run_job(spark, CONFIG, paths=paths, notes=[str(tmp_path / "notes.txt")], profile_urls=["https://linkedin.com/in/bob"])
    got = [r.asDict(recursive=True) for r in shown.collect()]
    assert len(got) == 1
    assert (got[0]["full_name"], got[0]["primary_email"], got[0]["country"]) == ("Robert Smith", "bob@x.io", "in")
    assert set(got[0]["skills"]) == {"Python", "COBOL", "Docker"} and 0 < got[0]["overall_confidence"] <= 1
    said = {r.path.rsplit("/", 1)[-1]: (r.n_records, r.warning) for r in report.collect()}
    assert said["r.csv"][0] == 2 and said["a.json"] == (1, None) and said["missing.json"][1].startswith("input not found")
    assert wrong.isEmpty()
    write_profiles(shown, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_paths_are_files_of_just_that_name(spark, tmp_path):
    """Names with a space, per cent sign, pattern characters and letters beyond ASCII, equal endings, folders, and files asked for twice."""
    note = "Spoke with Some Body, mail {}@x.io"
    (tmp_path / "a" / "_hidden").mkdir(parents=True)
    names = ["my notes.txt", "100%.txt", "50%20off.txt", "[a]{b}*?.txt", "größe 日.txt", "n.txt", "a/n.txt", "a/.skip.txt", "a/_hidden/x.txt"]
    for n, name in enumerate(names):
        (tmp_path / name).write_text(note.format(f"m{n}"))
    at = lambda *xs: [str(tmp_path / x) for x in xs]
    raw, report = load(spark, notes=at(*names[:7]))
    assert [r.emails for r in raw.orderBy("rec_seq").collect()] == [[f"m{n}@x.io"] for n in range(7)]
    assert all((r.n_records, r.warning) == (1, None) for r in report.collect()) and report.count() == 7
    raw, report = load(spark, notes=at("a", "n.txt", "n.txt", "none"))
    assert [r.emails[0] for r in raw.orderBy("rec_seq").collect()] == ["m6@x.io", "m5@x.io", "m5@x.io"]
    assert sorted((r.path.rsplit("/", 1)[-1], r.n_records, (r.warning or "")[:15]) for r in report.collect()) == [("a", 1, ""), ("n.txt", 1, ""), ("n.txt", 1, ""), ("none", 0, "input not found")]


def test_tables_of_one_header_are_read_together(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"t {n}.csv").write_text(("\ufeff" if n == 1 else "") + "name,email\r\n" + "".join(f'"Pat,\n{n}",p{n}{k}@x.io\r\n' for k in range(3)))
    (tmp_path / "other.csv").write_text("E-mail,Role\nz@x.io,Clerk\n")
    raw, report = load(spark, paths=[str(tmp_path / f"t {n}.csv") for n in range(5)] + [str(tmp_path / "other.csv")])
    got = [(r.full_name, r.emails[0]) for r in raw.orderBy("rec_seq").collect()]
    assert got == [(f"Pat,\n{n}", f"p{n}{k}@x.io") for n in range(5) for k in range(3)] + [(None, "z@x.io")]
    assert [r.n_records for r in report.orderBy("path").collect()] == [1, 3, 3, 3, 3, 3]


DATA = [(1, "cand_1", "Ann", ["a@x.io", "b@x.io"], [("Go", 0.5), ("SQL", 0.4)], ("Pune", None), 3.0, 0.9), (2, "cand_2", "", [], [], (None, None), None, 0.4)]
KIND = "cluster_id long, candidate_id string, full_name string, emails array<string>, skills array<struct<name:string,confidence:double>>, location struct<city:string,country:string>, years_experience double, overall_confidence double"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(DATA, KIND)


@pytest.mark.parametrize(("path", "want"), [
    ("full_name", "Ann"), ("emails[0]", "a@x.io"), ("emails[-1]", "b@x.io"), ("emails[5]", None), ("location.city", "Pune"), ("skills[].name", ["Go", "SQL"]), ("skills[0].name", "Go"), ("emails[]", ["a@x.io", "b@x.io"]),
])
def test_paths(data, path, want):
    shown = projection.project(data.filter("cluster_id = 1"), {"fields": [{"path": "x", "from": path}]})
    assert shown.first()[0] == want


@pytest.mark.parametrize("path", ["nope", "location.planet", "full_name[0]", "emails[x]", "emails[0].name", "full_name.x"])
def test_missing_paths(data, path):
    assert projection.resolve_path(data.schema, path).missing is True
    fields = [{"path": "full_name"}, {"path": "x", "from": path, "required": True}]
    assert projection.project(data, {"fields": fields}).columns == ["full_name", "x"]
    assert projection.project(data, {"fields": fields, "on_missing": "omit"}).columns == ["full_name"]
    with pytest.raises(projection.ProjectionError):
        projection.project(data, {"fields": fields, "on_missing": "error"})


def test_missing_rows(data):
    fields = [{"path": "e", "from": "emails[0]", "required": True}, {"path": "years_experience"}]
    got = [json.loads(r.json) for r in projection.as_json(data, {"fields": fields, "on_missing": "omit"}).collect()]
    assert got == [{"e": "a@x.io", "years_experience": 3.0}, {"years_experience": None}]
    with pytest.raises(Exception, match="required field missing: e"):
        projection.project(data, {"fields": fields, "on_missing": "error"}).collect()


def test_default_and_meta(data):
    assert "cluster_id" not in projection.project(data, {}).columns
    assert "overall_confidence" not in projection.project(data, {"include_confidence": False}).columns
    assert projection.project(data, {"fields": [{"path": "full_name", "normalize": "upper"}], "include_confidence": True}).first().asDict() == {"full_name": "ANN", "overall_confidence": 0.9}


def test_violations(data):
    fields = [
        {"path": "full_name", "type": "number"}, {"path": "e", "from": "emails[0]", "type": "string", "required": True}, {"path": "emails", "type": "string[]"}, {"path": "skills", "type": "object[]"},
        {"path": "location", "type": "object"}, {"path": "years_experience", "type": "number"}, {"path": "y", "from": "years_experience", "type": "boolean"}, {"path": "overall_confidence", "type": "odd"},
    ]
    got = [(r.cluster_id, r.error) for r in projection.violations(data, {"fields": fields}).orderBy("cluster_id", "n").collect()]
    assert got == [
        (1, "field 'full_name': expected number, got str"), (1, "field 'y': expected boolean, got float"), (1, "field 'overall_confidence': unknown type 'odd'"),
        (2, "field 'full_name': expected number, got str"), (2, "required field 'e' is missing or null"), (2, "field 'overall_confidence': unknown type 'odd'"),
    ]
    with pytest.raises(ValueError, match="violate"):
        projection.strict(projection.violations(data, {"fields": fields}))


def test_what_rows_miss(spark, data):
    """Typed objects keep missing and null apart; required fields that are missing are rows of their own, and fail the projection."""
    config = {"fields": [{"path": "mail", "from": "emails[0]", "required": True}, {"path": "years", "from": "years_experience"}, {"path": "planet", "from": "location.planet", "required": True}], "on_missing": "omit"}
    got = projection.as_variant(data, config).select(F.expr("schema_of_variant(profile)"), F.expr("try_variant_get(profile, '$.years', 'double')")).collect()
    assert sorted((r[1] for r in got), key=str) == [3.0, None]
    assert ["mail" in r[0] for r in sorted(got, key=lambda r: r[1] is None)] == [True, False] and all("years" in r[0] and "planet" not in r[0] for r in got)
    strict = {**config, "on_missing": "error"}
    assert sorted((r.cluster_id, r.n, r.error) for r in projection.missing_required(data, strict).collect()) == [
        (1, 0, "required field missing: planet (from location.planet)"), (2, 0, "required field missing: mail (from emails[0])"), (2, 1, "required field missing: planet (from location.planet)")]
    assert projection.missing_required(data, config).count() == 0
