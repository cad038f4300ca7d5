"""Linking, merging and scoring of small sets of records."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators.resolve import owner_edges
from kinweave.operators import resolve
from kinweave.operators.components import connected_components
from kinweave.operators.merge import merge_records, ordered
from kinweave.operators.normalize import normalize_records
from kinweave.operators.scoring import round3

NO_LINKS = {"linkedin": None, "github": None, "portfolio": None, "other": []}


def R(source="resume", **given):
    links = given.pop("links", None)
    return {**dict.fromkeys(schemas.RAW), "source": source, "emails": [], "phones": [], "skills": [], "experience": [], "education": [], **given, "links": {**NO_LINKS, **links} if links else None}


def merged(spark, records, **how):
    rows = [tuple({**r, "rec_seq": n}[c] for c in schemas.RAW) for n, r in enumerate(records)]
    raw = spark.createDataFrame(rows, schemas.RAW_SCHEMA)
    return [r.asDict(recursive=True) for r in ordered(merge_records(normalize_records(raw), **how)).collect()]


def job(company=None, title=None, start=None, end=None, summary=None):
    return {"company": company, "title": title, "start": start, "end": end, "summary": summary}


def study(institution=None, degree=None, field=None, end_year=None):
    return {"institution": institution, "degree": degree, "field": field, "end_year": end_year}


PEOPLE = [
    # one email, two names
    R("recruiter_csv", full_name="Bob Smith", emails=["B@one.io"]), R("ats_json", full_name="Robert Smith", emails=["b@ONE.io"]),
    # a chain by email, then phone
    R(full_name="A", emails=["a@two.io"]), R(emails=["a@two.io"], phones=["4155550102"]), R(phones=["(415) 555-0102"], skills=["py"]), R(full_name="Z", emails=["z@two.io"]),
    # one profile link
    R(full_name="Al", links={"linkedin": "https://www.linkedin.com/in/Al/"}), R("linkedin", emails=["a@three.io"], links={"linkedin": "http://linkedin.com/in/al"}),
    # equal names: with contacts apart, without contacts by company
    R(full_name="Al Lee", emails=["a@four.io"]), R(full_name="Al Lee", emails=["b@four.io"]),
    R(full_name="Cy Lee", experience=[job("Acme")]), R("linkedin", full_name="CY  LEE", experience=[job("acme")]), R(full_name="Cy Lee", experience=[job("Other")]),
    # nobody
    R(emails=["broken@"]), R("linkedin", links={"linkedin": "https://linkedin.com/in/nobody"}),
    # a vote
    R(full_name="Ann B", headline="Dev", emails=["a@six.io"]), R(full_name="ann b", emails=["a@six.io"]), R(full_name="Ann Bee", emails=["a@six.io"]),
    # a country as a city
    R("recruiter_csv", emails=["a@seven.io"], location={"city": "India", "region": None, "country": "India"}),
    R("resume", emails=["b@seven.io"], location={"city": "Pune", "region": "MH", "country": "IN"}), R("github", emails=["b@seven.io"], location={"city": "Rome", "region": None, "country": "Italy"}),
    # skills
    R("resume", emails=["a@eight.io"], skills=["py", "COBOL"]), R("ats_json", emails=["a@eight.io"], skills=["Python"]),
    # entries with gaps
    R("recruiter_csv", emails=["a@nine.io"], experience=[job("Acme", "Dev"), job()], education=[study("MIT", None, None, "2010")]),
    R("ats_json", emails=["a@nine.io"], experience=[job("ACME", "dev", "Jan 2020", "present", "built"), job("Old", "Clerk", "2015", "2016")], education=[study("mit", "BSc", "Math", "class of 2010")]),
    # links
    R("github", emails=["a@ten.io"], links={"github": "https://github.com/a", "other": ["https://o"]}), R("ats_json", emails=["a@ten.io"], links={"portfolio": "https://p", "other": ["https://o"]}),
    # a switchboard
    *(R(full_name=f"P {n}", phones=["4155550111"], emails=[f"p{n}@eleven.io"]) for n in range(30)),
]


@pytest.fixture(scope="module")
def found(spark):
    return merged(spark, PEOPLE)


@pytest.fixture(scope="module")
def of(found):
    return {e: p for p in found for e in p["emails"]}


def test_number_and_order(found):
    assert len(found) == 1 + 2 + 1 + 2 + 2 + 1 + 2 + 1 + 1 + 1 + 1
    assert [p["candidate_id"] for p in found] == sorted(p["candidate_id"] for p in found)


def test_shared_email_conflicting_names(of):
    p = of["b@one.io"]
    assert p["full_name"] == "Robert Smith" and p["emails"] == ["b@one.io"]
    assert p["candidate_id"] == "cand_" + hashlib.sha1(b"email:b@one.io").hexdigest()[:12]
    assert {"field": "emails", "source": "ats_json", "method": "merged"} in p["provenance"]
    assert {"field": "full_name", "source": "ats_json", "method": "direct"} in p["provenance"]


def test_chain_and_links(of):
    assert of["a@two.io"]["phones"] == ["+14155550102"] and len(of["a@two.io"]["skills"]) == 1 and of["z@two.io"]["skills"] == []
    assert of["a@three.io"]["full_name"] == "Al" and of["a@three.io"]["links"]["linkedin"] == "https://www.linkedin.com/in/Al/"


def test_equal_names(found, of):
    assert of["a@four.io"]["cluster_id"] != of["b@four.io"]["cluster_id"]
    assert sorted(len(p["experience"]) for p in found if p["full_name"].lower() == "cy lee") == [1, 1]


def test_vote_and_conflict(of):
    p = of["a@six.io"]
    assert p["full_name"] == "Ann B" and {"field": "full_name", "source": "resume", "method": "merged"} in p["provenance"]
    # name .7 * (1 + .08 - .18), emails .7 * 1.15 (three records, at the bound), headline .7
    assert p["overall_confidence"] == round((1.5 * 0.805 + 1.5 * 0.63 + 0.7) / 4, 3)


def test_location(of):
    assert of["a@seven.io"]["location"] == {"city": None, "region": None, "country": "IN"}
    assert of["b@seven.io"]["location"] == {"city": "Pune", "region": "MH", "country": "IN"}


def test_skills(of):
    assert of["a@eight.io"]["skills"] == [
        {"name": "Python", "confidence": 1.0, "sources": ["ats_json", "resume"]}, {"name": "COBOL", "confidence": 0.56, "sources": ["resume"]},
    ]


def test_experience_and_education_fill_gaps(of):
    assert of["a@nine.io"]["experience"] == [job("Acme", "Dev", "2020-01", None, "built"), job("Old", "Clerk", "2015-01", "2016-01")]
    assert of["a@nine.io"]["education"] == [study("MIT", "BSc", "Math", "2010")]


def test_links_other_and_counts(of):
    assert of["a@ten.io"]["links"] == {"linkedin": None, "github": "https://github.com/a", "portfolio": "https://p", "other": ["https://o"]}
    assert {"field": "links", "source": "ats_json", "method": "merged"} in of["a@ten.io"]["provenance"]


def test_order_of_records_decides_no_winner(spark, of):
    shuffled = [r for r in PEOPLE if not any("eleven" in e for e in r["emails"])]
    random.Random(1).shuffle(shuffled)
    again = {e: p for p in merged(spark, shuffled) for e in p["emails"]}
    again.pop("a@three.io")  # which record's link is kept, and so whose trust counts, is a matter of order
    for e, p in again.items():
        assert {k: p[k] for k in ("candidate_id", "overall_confidence", "location", "years_experience")} == {k: of[e][k] for k in ("candidate_id", "overall_confidence", "location", "years_experience")}


def test_hot_key_and_fanout(spark):
    records = PEOPLE[-30:]
    raw = spark.createDataFrame([tuple({**r, "rec_seq": n}[c] for c in schemas.RAW) for n, r in enumerate(records)], schemas.RAW_SCHEMA)
    keys = resolve.match_keys(normalize_records(raw))
    assert resolve.owner_edges(keys).count() == 29 and resolve.owner_edges(keys, 10).count() == 0
    assert [tuple(r) for r in resolve.excluded_keys(keys, 10).collect()] == [("phone:+14155550111", 30)]


def test_no_records(spark):
    assert merged(spark, []) == []


def test_components(spark):
    rng = random.Random(3)
    edges = [(n, n + 1) for n in range(0, 200)] + [(1000, 1000 + n) for n in range(1, 50)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    rng.shuffle(edges)
    found = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert found == {v: find(v) for e in edges for v in e if e[0] != e[1] or v in {x for y in edges if y[0] != y[1] for x in y}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_round3(spark):
    values = [a * b * c for a, b, c in itertools.product((0.95, 0.9, 0.75, 0.7, 0.6, 0.55, 0.4), (0.6, 0.64, 0.7, 0.82, 0.9, 1.0, 1.08, 1.15), (0.5 + 0.5 / 3, 0.5 + 1 / 3, 1.0, 0.8))] + [0.0005, 0.0015, 0.0025, 0.5]
    got = [r[0] for r in spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, v double").orderBy("n").select(round3(F.col("v"))).collect()]
    assert got == [round(v, 3) for v in values]


def test_components_with_hubs(spark, monkeypatch):
    """Stars, chains and rings against a plain search, with vertices that are hubs and none."""
    import random

    from kinweave.operators import components

    rng = random.Random(4)
    edges = [(900, n) for n in range(60)] + [(n, n + 1) for n in range(100, 140)] + [(200 + n, 200 + (n + 1) % 9) for n in range(9)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (7, 7)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    for hub in (components.HUB, 3):
        monkeypatch.setattr(components, "HUB", hub)
        got = {r.vertex: r.component for r in components.connected_components(df).collect()}
        assert got == {x: find(x) for x in root}
    assert components.connected_components(df.limit(0)).count() == 0


def test_a_round_of_components_is_two_exchanges(spark):
    """One by vertex for each star; what a round leaves isn't sorted out by one more, and stars end the rounds at once."""
    from kinweave.operators import components

    edges = spark.createDataFrame([(n, n + 1) for n in range(20)], "u long, v long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = components._small_star(components._large_star(edges, 20), 20)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2
    stars = spark.createDataFrame([(n, n % 3) for n in range(3, 40)] + [(n, n % 3) for n in range(3, 9)], "a long, b long")
    assert sorted(map(tuple, connected_components(stars, max_rounds=1).collect())) == [(n, n % 3) for n in range(40)]
    with pytest.raises(RuntimeError):
        connected_components(edges, max_rounds=1)


def test_all_fields_are_merged_in_few_exchanges(spark):
    """Facts, jobs and studies are each dealt by what they say and once more by cluster; the joins after that deal nothing."""
    from kinweave import schemas
    from kinweave.operators import merge

    raw = spark.createDataFrame([], schemas.RAW_SCHEMA)
    records = merge.attach_clusters(raw, raw.selectExpr("rec_seq", "rec_seq as cluster_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge.merged_fields(records)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 6


def test_hot_keys_are_joined_by_broadcast(spark):
    """Keys of more than the bound go one way, the rest the other; the edges are those of one join."""
    rows = [(r, f"k{k}") for k in range(12) for r in range(k, 40, k + 1)] + [(r, "switchboard") for r in range(5, 60)] + [(99, "alone")]
    keys = spark.createDataFrame(rows, "rec_seq long, key string").repartition(3)
    first, want = {}, set()
    for r, k in rows:
        first[k] = min(first.get(k, r), r)
    want = {(r, first[k]) for r, k in rows if r != first[k]}
    found = owner_edges(keys, hub=3, most_hubs=20)
    assert {tuple(r) for r in found.collect()} == want and {tuple(r) for r in owner_edges(keys).collect()} == want
    assert {tuple(r) for r in owner_edges(keys, max_fanout=10, hub=3, most_hubs=20).collect()} == {(r, first[k]) for r, k in rows if r != first[k] and sum(x == k for _, x in rows) <= 10}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 2
    assert owner_edges(keys.limit(0)).count() == 0
