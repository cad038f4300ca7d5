"""The registered queries over record linkage, each with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import people as derived
from kinweave.functions import contacts, countries, dates, skills, text
from kinweave.operators import merge, projection, resolve
from kinweave.operators.normalize import normalize_records
from kinweave.operators.scoring import WEIGHTS
from kinweave.plans.lineage import cut
from kinweave.plans.tables import table
from kinweave.sources.csv_records import csv_records
from kinweave.sources.json_records import ats_records

# A config of six fields.
CUSTOM = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True},
        {"path": "primary_email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "phone", "from": "phones[0]", "type": "string", "normalize": "E164"},
        {"path": "country", "from": "location.country", "type": "string"},
        {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"},
        {"path": "linkedin", "from": "links.linkedin", "type": "string"},
    ],
    "include_confidence": True,
    "include_provenance": False,
    "on_missing": "null",
}
STRICT = {
    "fields": [
        {"path": "full_name", "type": "string", "required": True},
        {"path": "email", "from": "emails[0]", "type": "string", "required": True},
        {"path": "years", "from": "years_experience", "type": "string"},
        {"path": "second_phone", "from": "phones[1]", "required": True},
        {"path": "skills", "from": "skills", "type": "string[]"},
        {"path": "headline", "type": "strange"},
        {"path": "nowhere", "from": "location.planet", "required": True},
    ],
}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _joined(c, sep: str = "|"):
    return F.array_join(c, sep)


def extract_emails(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(contacts.extract_emails("text")).alias("emails"))


def extract_phones(spark, sf_dir):
    found = _docs(spark, sf_dir).select("doc_id", text.extract_phones("text").alias("p"))
    return found.select("doc_id", _joined("p").alias("candidates"), _joined(contacts.normalize_phones("p")).alias("phones"))


def scan_skills(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _joined(skills.scan_skills("text")).alias("skills"))


def guess_name(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.guess_name("text").alias("full_name"))


def labelled_name(spark, sf_dir):
    notes = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Call notes. Spoke with "), F.initcap(F.translate("c_name", "#0123456789", " ABCDEFGHIJ")), F.lit(". Name: Nobody Else")).alias("note"))
    return notes.select("c_custkey", text.labelled_name("note").alias("full_name"))


def sections(spark, sf_dir):
    resumes = table(spark, sf_dir, "customer").select("c_custkey", _resume().alias("resume"))
    s = resumes.select("c_custkey", text.sections("resume").alias("s"))
    return s.select(
        "c_custkey", _joined(text.skills_block(F.col("s.skills"))).alias("skills"), text.summary_headline(F.col("s.summary")).alias("headline"),
        _joined(F.transform(text.experience_block(F.col("s.experience")), lambda e: F.concat_ws(";", *(F.coalesce(e[p], F.lit("-")) for p in ("title", "company", "start", "end", "summary"))))).alias("jobs"),
        _joined(F.transform(text.education_block(F.col("s.education")), lambda e: F.concat_ws(";", *(F.coalesce(e[p], F.lit("-")) for p in ("degree", "institution", "end_year"))))).alias("studies"),
    )


def _resume():
    k = F.col("c_custkey").cast("string")
    return F.concat(
        F.lit("Some Body\nSummary:\nWorks on "), F.lower("c_mktsegment"), F.lit(".\nSkills\nPython, sql;  "), F.concat(F.lit("tool"), k),
        F.lit("\nWork Experience:\n"), F.initcap("c_mktsegment"), F.lit(" Lead at Company "), k, F.lit("  Jan 2019 - present\n- built things\n- and more\nidle line\nClerk, Shop  03/2015 – 2018\nEDUCATION\nBSc Physics, University of "), k,
        F.lit(", 2012\nnothing here\n"),
    )


def normalize_email(spark, sf_dir):
    return derived.flat_people(spark, sf_dir).select("rec_seq", contacts.normalize_email("email").alias("email"))


def normalize_phone(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("99887"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0")).alias("bare"))
    return p.select(
        "p_partkey", contacts.normalize_phone("bare", "IN").alias("india"), contacts.normalize_phone("bare", "US").alias("us"),
        contacts.normalize_phone(F.concat(F.lit("+91 "), "bare")).alias("plus"), contacts.normalize_phone(F.concat(F.lit("(415) 555-"), F.substring("bare", 7, 4), F.lit(" x12"))).alias("extension"),
    )


#: Calling codes, what a national number begins with, and how many digits it has.
ABROAD = [
    ("1", "415555", 10), ("7", "9", 10), ("20", "1", 10), ("27", "8", 9), ("30", "6", 10), ("33", "6", 9), ("34", "6", 9), ("36", "7", 9), ("40", "7", 9), ("44", "7", 10), ("48", "5", 9), ("49", "15", 11), ("51", "9", 9), ("55", "119", 11), ("60", "1", 9),
    ("61", "4", 9), ("62", "8", 10), ("63", "9", 10), ("66", "8", 9), ("81", "9", 10), ("84", "9", 9), ("90", "5", 10), ("91", "9", 10), ("234", "8", 10), ("254", "7", 9), ("351", "9", 9), ("380", "5", 9), ("420", "6", 9), ("971", "5", 9), ("998", "9", 9),
]


def phones_abroad(spark, sf_dir):
    """Numbers of thirty plans: with a space, with dashes, too short, and under a code that nobody has."""
    k = F.col("c_custkey")
    of = lambda n: F.get(F.array(*(F.lit(x[n]) for x in ABROAD)), F.expr(f"cast((c_custkey div 4) % {len(ABROAD)} as int)"))
    c = table(spark, sf_dir, "customer").select("c_custkey", of(0).alias("code"), F.concat(of(1), F.lpad((k % 10_000).cast("string"), of(2) - F.length(of(1)), F.lit("1"))).alias("n"))
    ways = F.array(
        F.concat(F.lit("+"), "code", F.lit(" "), "n"), F.concat(F.lit("+"), "code", F.lit("-"), F.substring("n", 1, 3), F.lit("-"), F.substring("n", 4, 99)),
        F.concat(F.lit("+"), "code", F.lit(" "), F.substring("n", 1, 4)), F.concat(F.lit("+999 "), "n"))
    said = c.select("c_custkey", F.get(ways, (k % 4).cast("int")).alias("said"))
    return said.select("c_custkey", "said", contacts.normalize_phone("said").alias("phone"))


#: Ways to write a date: patterns whose month and year are read, and ones of which nothing is, or the year alone.
READ_DATES = ("yyyy-MM-dd", "MMM yyyy", "MMMM yyyy", "MM/yyyy", "yyyy/MM/dd", "d MMMM, yyyy", "EEEE, MMM d yyyy", "dd-MMM-yyyy", "yyyy MMM dd", "yyyyMMdd", "MMMyyyy", "MM/dd/yyyy HH:mm")
YEAR_ONLY = ("'Q1' yyyy", "'spring' yyyy", "MMM d yyyy yyyy")


def normalize_date(spark, sf_dir):
    day = F.col("o_orderdate")
    ways = [F.date_format(day, w) for w in (*READ_DATES, *YEAR_ONLY, "yyyy", "MMM d", "dd.MM")] + [F.concat(F.date_format(day, "d"), F.lit("th of "), F.date_format(day, "MMMM yyyy")), F.lit("present"), F.lit("garbage"), F.lit(""), F.lit(None).cast("string")]
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(F.array(*ways), (F.col("o_orderkey") % len(ways) + 1).cast("int")).alias("said"))
    return o.select("o_orderkey", dates.to_year_month("said").alias("month"), dates.to_year("said").alias("year"))


def normalize_country(spark, sf_dir):
    return derived.flat_people(spark, sf_dir).filter("country is not null").select("rec_seq", countries.normalize_country("country", spark).alias("country"))


#: A country for each nation of the tables.
COUNTRIES = {
    "Germany": "DE", "Brazil": "BR", "Portugal": "PT", "Finland": "FI", "Iceland": "IS", "Australia": "AU", "Bulgaria": "BG", "Cambodia": "KH", "Denmark": "DK",
    "Ethiopia": "ET", "Guatemala": "GT", "Honduras": "HN", "Indonesia": "ID", "Jamaica": "JM", "Kazakhstan": "KZ", "Lithuania": "LT", "Madagascar": "MG", "Namibia": "NA",
    "Pakistan": "PK", "Rwanda": "RW", "Singapore": "SG", "Thailand": "TH", "Uzbekistan": "UZ", "Vietnam": "VN", "Zimbabwe": "ZW",
}


def search_country(spark, sf_dir):
    """Names of countries whole, without their third letter, with their fourth twice, their first five letters, in a sentence, with two letters too many, and with three."""
    name = F.get(F.array(*map(F.lit, COUNTRIES)), (F.col("c_nationkey") % len(COUNTRIES)).cast("int"))
    first = lambda n: F.substring(name, 1, n)
    ways = F.array(name, F.concat(first(2), F.substring(name, 4, 99)), F.concat(first(4), F.substring(name, 4, 99)), first(5), F.concat(F.lit("lives in "), name), F.concat(F.lit("zq"), name), F.concat(F.lit("zqw"), name))
    said = table(spark, sf_dir, "customer").select("c_custkey", F.get(ways, (F.col("c_custkey") % 7).cast("int")).alias("said"))
    return said.select("c_custkey", "said", countries.normalize_country("said", spark).alias("country"))


def canonical_skill(spark, sf_dir):
    long = derived.flat_people(spark, sf_dir).select("rec_seq", F.posexplode(F.array_compact(F.array("skill1", "skill2", "skill3"))).alias("pos", "skill"))
    return long.select("rec_seq", F.col("pos").cast("long").alias("pos"), skills.canonical_skill("skill").alias("skill"), F.coalesce(skills.is_known("skill"), F.lit(False)).alias("known"))


def norm_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.norm_url(F.concat(F.upper("url"), F.lit("//"))).alias("url"))


def header_alias(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias(" Full Name "), F.concat(F.lit("x"), F.col("c_custkey").cast("string"), F.lit("@y.org")).alias("E-mail"), F.lit("").alias("Phone Number"),
        F.col("c_mktsegment").alias("Role"), F.lit("  ").alias("Employer"), F.col("c_custkey").alias("id"),
    )
    found = csv_records(rows, F.col("id"))
    job = F.get("experience", F.lit(0))
    return found.select("rec_seq", "full_name", F.get("emails", F.lit(0)).alias("email"), F.size("phones").cast("long").alias("n_phones"), job["title"].alias("title"), job["company"].alias("company"))


def json_alias(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    blob = F.concat(
        F.lit('[{"candidate_name": "'), F.col("c_name"), F.lit('", "emailAddress": "e'), s("c_custkey"), F.lit('@x.io", "EMAIL": "", "yearsExperience": '), (F.col("c_custkey") % 30).cast("string"),
        F.lit(', "address": {"town": "T'), s("c_nationkey"), F.lit('", "state": null}, "skill_set": ["py", "", "go"], "work_history": [{"employer": "E", "role": "'), F.col("c_mktsegment"),
        F.lit('", "from": "2019"}, 7]}, 5, "x", null, {"note": "no one"}]'),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", blob.alias("value"))
    found = ats_records(rows, F.col("c_custkey") * 10 + F.col("pos"))
    job = F.get("experience", F.lit(0))
    return found.select(
        "rec_seq", "full_name", F.get("emails", F.lit(0)).alias("email"), "years_experience", F.col("location.city").alias("city"), F.col("location.region").alias("region"),
        _joined("skills").alias("skills"), F.size("experience").cast("long").alias("n_jobs"), job["company"].alias("company"), job["title"].alias("title"), job["start"].alias("started"),
    )


def _normalized(spark, sf_dir) -> DataFrame:
    return normalize_records(derived.people(spark, sf_dir))


def normalized_people(spark, sf_dir):
    n = _normalized(spark, sf_dir)
    job, study = F.get("experience", F.lit(0)), F.get("education", F.lit(0))
    return n.select(
        "rec_seq", "source", "full_name", F.get("emails", F.lit(0)).alias("email"), F.get("phones", F.lit(0)).alias("phone"), F.col("location.city").alias("city"), F.col("location.country").alias("country"),
        _joined("skills").alias("skills"), job["start"].alias("started"), job["end"].alias("ended"), study["end_year"].alias("end_year"),
    )


def match_keys(spark, sf_dir):
    n = _normalized(spark, sf_dir)
    return resolve.match_keys(n).union(resolve.weak_keys(n))


def key_owner_edges(spark, sf_dir):
    return resolve.owner_edges(match_keys(spark, sf_dir))


def clusters(spark, sf_dir):
    return resolve.clusters(cut(_normalized(spark, sf_dir)))


def _clustered(spark, sf_dir) -> DataFrame:
    n = cut(_normalized(spark, sf_dir))
    return merge.attach_clusters(n, resolve.clusters(n))


def union_emails(spark, sf_dir):
    return merge.union_values(_clustered(spark, sf_dir), "emails").select("cluster_id", _joined("emails").alias("emails"))


def union_phones(spark, sf_dir):
    return merge.union_values(_clustered(spark, sf_dir), "phones").select("cluster_id", _joined("phones").alias("phones"))


def _scalar(field: str):
    def run(spark, sf_dir):
        return merge.pick_scalar(_clustered(spark, sf_dir), field)

    return run


def pick_location(spark, sf_dir):
    w = merge.pick_location(_clustered(spark, sf_dir))
    return w.select("cluster_id", F.col("location.city").alias("city"), F.col("location.country").alias("country"), "top", F.col("filled").cast("long").alias("filled"))


def merge_links(spark, sf_dir):
    return merge.merge_links(_clustered(spark, sf_dir)).select("cluster_id", "links.linkedin", "links.github", "links.portfolio", "n_links", "top")


def merge_skills(spark, sf_dir):
    long = merge.merge_skills(_clustered(spark, sf_dir)).select("cluster_id", F.posexplode("skills").alias("pos", "s"))
    return long.select("cluster_id", F.col("pos").cast("long").alias("pos"), "s.name", "s.confidence", _joined("s.sources").alias("sources"))


def dedupe_experience(spark, sf_dir):
    long = merge.dedupe_experience(_clustered(spark, sf_dir)).select("cluster_id", F.posexplode("experience").alias("pos", "e"))
    return long.select("cluster_id", F.col("pos").cast("long").alias("pos"), "e.company", "e.title", F.col("e.start").alias("started"), F.col("e.end").alias("ended"))


def dedupe_education(spark, sf_dir):
    long = merge.dedupe_education(_clustered(spark, sf_dir)).select("cluster_id", F.posexplode("education").alias("pos", "e"))
    return long.select("cluster_id", F.col("pos").cast("long").alias("pos"), "e.institution", "e.degree", "e.field", "e.end_year")


def contributors(spark, sf_dir):
    return merge.contributors(_clustered(spark, sf_dir), F.size("emails") > 0)


def field_confidence(spark, sf_dir):
    scored = merge.field_confidences(merge.merged_fields(_clustered(spark, sf_dir)))
    return scored.select("cluster_id", *(F.col("confidence")[f].alias(f) for f in WEIGHTS))


def golden(spark, sf_dir) -> DataFrame:
    """The profiles of the derived people."""
    return merge.profiles(_clustered(spark, sf_dir))


def golden_profiles(spark, sf_dir):
    return golden(spark, sf_dir).select(
        "candidate_id", "cluster_id", "full_name", _joined("emails").alias("emails"), _joined("phones").alias("phones"), F.col("location.city").alias("city"), F.col("location.country").alias("country"),
        F.col("links.linkedin").alias("linkedin"), F.col("links.github").alias("github"), F.col("links.portfolio").alias("portfolio"), "headline", "years_experience",
        _joined(F.transform("skills", lambda s: s["name"])).alias("skills"), F.size("experience").cast("long").alias("n_jobs"), F.size("education").cast("long").alias("n_studies"),
        _joined(F.transform("provenance", lambda p: F.concat_ws(":", p["field"], p["source"], p["method"]))).alias("provenance"), "overall_confidence",
    )


def candidate_id(spark, sf_dir):
    return golden(spark, sf_dir).select("cluster_id", "candidate_id")


def provenance(spark, sf_dir):
    long = golden(spark, sf_dir).select("cluster_id", F.posexplode("provenance").alias("pos", "p"))
    return long.select("cluster_id", F.col("pos").cast("long").alias("pos"), "p.field", "p.source", "p.method")


def overall_confidence(spark, sf_dir):
    return golden(spark, sf_dir).select("cluster_id", "overall_confidence")


def project_custom(spark, sf_dir):
    return projection.project(golden(spark, sf_dir), CUSTOM).withColumn("skills", _joined("skills"))


def project_default(spark, sf_dir):
    shown = projection.project(golden(spark, sf_dir), {"include_provenance": False})
    return shown.select("candidate_id", "full_name", F.size("emails").cast("long").alias("n_emails"), F.size("skills").cast("long").alias("n_skills"), "overall_confidence")


def validate(spark, sf_dir):
    return projection.violations(golden(spark, sf_dir), STRICT)


def contact_groups(spark, sf_dir):
    """Contacts that several documents share."""
    d = _docs(spark, sf_dir)
    found = d.select("doc_id", F.explode(F.concat(
        F.transform(contacts.extract_emails("text"), lambda x: F.struct(F.lit("email").alias("kind"), x.alias("value"))),
        F.transform(skills.scan_skills("text"), lambda x: F.struct(F.lit("skill").alias("kind"), x.alias("value"))),
    )).alias("c")).select("doc_id", "c.*")
    return found.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


# --- SQL ---------------------------------------------------------------------------------------------------------------

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_CODE = {"United States": "US", "uk": "GB", "DEU": "DE", "India": "IN", "fr": "FR", "Germany": "DE", "France": "FR"}


def _code(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODE.items()) + " END"


_SKILL = "CASE {0} WHEN 'py' THEN 'Python' WHEN 'React.js' THEN 'React' WHEN 'k8s' THEN 'Kubernetes' WHEN 'golang' THEN 'Go' ELSE {0} END"
_TRUST = "CASE source WHEN 'ats_json' THEN 0.95 WHEN 'recruiter_csv' THEN 0.9 WHEN 'linkedin' THEN 0.75 WHEN 'resume' THEN 0.7 WHEN 'recruiter_notes' THEN 0.6 WHEN 'github' THEN 0.55 ELSE 0.4 END"
_D = lambda x: f"CAST({x} AS DOUBLE)"

NORM = f"""people AS ({derived.SQL}),
norm AS (
  SELECT rec_seq, source, CAST({_TRUST} AS DOUBLE) AS trust,
    nullif(regexp_replace(trim(full_name), '\\s+', ' ', 'g'), '') AS full_name,
    CASE WHEN regexp_full_match(lower(trim(email)), '{_EMAIL}') THEN lower(trim(email)) END AS email,
    CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 10 THEN '+1' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS phone,
    CASE WHEN {_code('city')} = {_code('country')} THEN NULL ELSE city END AS city, {_code('country')} AS country,
    linkedin, github, portfolio, headline, years,
    list_distinct_ordered AS skills, company, title,
    substr(started, 1, 7) AS started, CASE WHEN ended = 'present' THEN NULL ELSE substr(ended, 1, 7) END AS ended, institution, degree, field, right(end_year, 4) AS end_year
  FROM (SELECT *, CASE WHEN skill1 IS NULL THEN CAST([] AS VARCHAR[]) WHEN {_SKILL.format('skill2')} = {_SKILL.format('skill1')} THEN [{_SKILL.format('skill1')}, {_SKILL.format('skill3')}]
     ELSE [{_SKILL.format('skill1')}, {_SKILL.format('skill2')}, {_SKILL.format('skill3')}] END AS list_distinct_ordered FROM people)),
strong AS (
  SELECT rec_seq, 'email:' || email AS key FROM norm WHERE email IS NOT NULL
  UNION SELECT rec_seq, 'phone:' || phone FROM norm WHERE phone IS NOT NULL
  UNION SELECT rec_seq, 'url:' || regexp_replace(rtrim(lower(u), '/'), '^https?://(www\\.)?', '') FROM (SELECT rec_seq, linkedin AS u FROM norm UNION ALL SELECT rec_seq, github FROM norm) WHERE u IS NOT NULL),
keys AS (
  SELECT * FROM strong UNION ALL
  SELECT rec_seq, 'name:' || lower(full_name) || '|' || coalesce(lower(company), '') FROM norm
  WHERE full_name IS NOT NULL AND rec_seq NOT IN (SELECT rec_seq FROM strong)),
owners AS (SELECT key, min(rec_seq) AS owner FROM keys GROUP BY key),
edges AS (SELECT DISTINCT rec_seq, owner FROM keys JOIN owners USING (key) WHERE rec_seq <> owner)"""
BASE = f"""WITH RECURSIVE {NORM},
both_ways AS (SELECT rec_seq AS u, owner AS v FROM edges UNION SELECT owner, rec_seq FROM edges),
reach(a, b) AS (SELECT rec_seq, rec_seq FROM norm UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
clu AS (SELECT a AS rec_seq, min(b) AS cluster_id FROM reach GROUP BY a),
r AS (SELECT clu.cluster_id, norm.* FROM norm JOIN clu USING (rec_seq))
"""


def _round3(x: str) -> str:
    """Three decimals, halves of the exact binary value to even: DuckDB's decimal cast of a double's shortest digits can't tell, so the exact remainder is followed."""
    k, hi = f"floor(({x}) * {_D(1000)})", f"((({x}) * {_D(134217729)}) - ((({x}) * {_D(134217729)}) - ({x})))"
    d = f"(({hi} * {_D(1000)}) - ({k} + {_D(0.5)})) + ((({x}) - {hi}) * {_D(1000)})"
    return f"((CASE WHEN {d} > 0 OR ({d} = 0 AND {k} % 2 = 1) THEN {k} + 1 ELSE {k} END) / {_D(1000)})"


def _conf(trust: str, n: str, conflict: str = "0", complete: str = "1.0") -> str:
    agree = f"greatest({_D(0.6)}, least({_D(1.15)}, {_D(1)} + {_D(0.08)} * greatest({n} - 1, 0) - {_D(0.18)} * {conflict}))"
    return _round3(f"greatest({_D(0)}, least({_D(1)}, {trust} * {agree} * {_D(complete)}))")


def _pick(field: str) -> str:
    v = f"CAST({field} AS VARCHAR)"
    return f"""(SELECT cluster_id, value, top, n_agree, n_conflict FROM (
      SELECT cluster_id, value, top, n AS n_agree, count(*) OVER (PARTITION BY cluster_id) - 1 AS n_conflict,
        row_number() OVER (PARTITION BY cluster_id ORDER BY t DESC, n DESC, length(value) DESC, value DESC) AS place
      FROM (SELECT cluster_id, lower({v}) AS k, max(trust) AS t, count(*) AS n, arg_min({v}, rec_seq) AS value, first(source ORDER BY trust DESC, rec_seq) AS top
            FROM r WHERE {v} IS NOT NULL AND {v} <> '' GROUP BY cluster_id, lower({v}))) WHERE place = 1)"""


def _union(field: str) -> str:
    return f"(SELECT cluster_id, string_agg(v, '|' ORDER BY o) AS {field}s FROM (SELECT cluster_id, {field} AS v, min(rec_seq) AS o FROM r WHERE {field} IS NOT NULL GROUP BY cluster_id, {field}) GROUP BY cluster_id)"


def _seen(where: str) -> str:
    return f"(SELECT cluster_id, count(*) AS n_sources, first(source ORDER BY trust DESC, rec_seq) AS top FROM r WHERE {where} GROUP BY cluster_id)"


_LOCATION = f"""(SELECT cluster_id, city, country, source AS top, filled FROM (
   SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY trust + {_D(0.1)} * filled DESC, rec_seq) AS place
   FROM (SELECT *, CASE WHEN city IS NULL THEN 0 ELSE 1 END + CASE WHEN country IS NULL THEN 0 ELSE 1 END AS filled FROM r) WHERE filled > 0) WHERE place = 1)"""
_LINKS = """(SELECT cluster_id, max(url) FILTER (kind = 'linkedin') AS linkedin, max(url) FILTER (kind = 'github') AS github, max(url) FILTER (kind = 'portfolio') AS portfolio,
   count(*) AS n_links, first(source ORDER BY trust DESC, rec_seq) AS top
 FROM (SELECT cluster_id, kind, arg_min(url, rec_seq) AS url, arg_min(source, rec_seq) AS source, arg_min(trust, rec_seq) AS trust, min(rec_seq) AS rec_seq
       FROM (SELECT cluster_id, rec_seq, source, trust, 'linkedin' AS kind, linkedin AS url FROM r UNION ALL SELECT cluster_id, rec_seq, source, trust, 'github', github FROM r
             UNION ALL SELECT cluster_id, rec_seq, source, trust, 'portfolio', portfolio FROM r) WHERE url IS NOT NULL GROUP BY cluster_id, kind) GROUP BY cluster_id)"""
_SKILLS = f"""(SELECT cluster_id, name, sources, confidence, row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, lower(name)) - 1 AS pos FROM (
   SELECT cluster_id, name, sources, CASE WHEN lower(name) IN ('cobol', 'rust') THEN {_round3('base * CAST(0.8 AS DOUBLE)')} ELSE base END AS confidence
   FROM (SELECT cluster_id, name, sources, {_conf('t', 'n')} AS base FROM (
     SELECT cluster_id, arg_min(s, rec_seq) AS name, max(trust) AS t, count(DISTINCT source) AS n, string_agg(DISTINCT source, '|' ORDER BY source) AS some,
        (SELECT string_agg(x.source, '|' ORDER BY x.trust DESC, x.source) FROM (SELECT DISTINCT unnest(list({{'source': u.source, 'trust': u.trust}})) AS x)) AS sources
     FROM (SELECT cluster_id, rec_seq, source, trust, unnest(skills) AS s FROM r) u GROUP BY cluster_id, lower(s)))))"""
_JOBS = """(SELECT cluster_id, company, title, started, ended, row_number() OVER (PARTITION BY cluster_id ORDER BY o) - 1 AS pos FROM (
   SELECT cluster_id, min(rec_seq) AS o, arg_min(company, rec_seq) AS company, arg_min(title, rec_seq) AS title, arg_min(started, rec_seq) AS started, arg_min(ended, rec_seq) AS ended
   FROM r WHERE coalesce(company, title, started, ended) IS NOT NULL GROUP BY cluster_id, lower(coalesce(company, '')), lower(coalesce(title, ''))))"""
_STUDIES = """(SELECT cluster_id, institution, degree, field, end_year, row_number() OVER (PARTITION BY cluster_id ORDER BY o) - 1 AS pos FROM (
   SELECT cluster_id, min(rec_seq) AS o, arg_min(institution, rec_seq) AS institution, arg_min(degree, rec_seq) AS degree, arg_min(field, rec_seq) AS field, arg_min(end_year, rec_seq) AS end_year
   FROM r WHERE coalesce(institution, degree, field, end_year) IS NOT NULL GROUP BY cluster_id, lower(coalesce(institution, '')), coalesce(end_year, '')))"""

_T = lambda c: _TRUST.replace("CASE source", f"CASE {c}")
SCORED = BASE + f""", se AS {_seen('email IS NOT NULL')}, sp AS {_seen('phone IS NOT NULL')}, sx AS {_seen('coalesce(company, title) IS NOT NULL')}, sd AS {_seen('institution IS NOT NULL')},
ue AS {_union('email')}, up AS {_union('phone')}, pn AS {_pick('full_name')}, ph AS {_pick('headline')}, py AS {_pick('years')}, lo AS {_LOCATION}, li AS {_LINKS},
sk AS {_SKILLS},
sks AS (SELECT cluster_id, {_round3('total / n')} AS skills_c, skills FROM (SELECT cluster_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(confidence ORDER BY pos)), lambda a, x: a + x) AS total, count(*) AS n, string_agg(name, '|' ORDER BY pos) AS skills FROM sk GROUP BY cluster_id)),
skn AS (SELECT cluster_id, count(DISTINCT source) AS n, first(source ORDER BY trust DESC, source) AS top FROM r WHERE len(skills) > 0 GROUP BY cluster_id),
ex AS (SELECT cluster_id, count(*) AS n FROM {_JOBS} GROUP BY cluster_id), ed AS (SELECT cluster_id, count(*) AS n FROM {_STUDIES} GROUP BY cluster_id),
c AS (
  SELECT b.cluster_id, ue.emails, up.phones, pn.value AS full_name, ph.value AS headline, CAST(py.value AS DOUBLE) AS years_experience, lo.city, lo.country, li.linkedin, li.github, li.portfolio, sks.skills, ex.n AS n_jobs, ed.n AS n_studies,
    CASE WHEN se.top IS NOT NULL THEN {_conf(_T('se.top'), 'se.n_sources')} END AS emails_c, CASE WHEN sp.top IS NOT NULL THEN {_conf(_T('sp.top'), 'sp.n_sources')} END AS phones_c,
    CASE WHEN pn.top IS NOT NULL THEN {_conf(_T('pn.top'), 'pn.n_agree', 'pn.n_conflict')} END AS full_name_c, CASE WHEN ph.top IS NOT NULL THEN {_conf(_T('ph.top'), 'ph.n_agree', 'ph.n_conflict')} END AS headline_c,
    CASE WHEN py.top IS NOT NULL THEN {_conf(_T('py.top'), 'py.n_agree', 'py.n_conflict')} END AS years_experience_c,
    CASE WHEN lo.top IS NOT NULL THEN {_conf(_T('lo.top'), '1', '0', '0.5 + 0.5 * (lo.filled / 3)')} END AS location_c, CASE WHEN li.top IS NOT NULL THEN {_conf(_T('li.top'), 'li.n_links')} END AS links_c,
    skills_c, CASE WHEN sx.top IS NOT NULL THEN {_conf(_T('sx.top'), 'sx.n_sources')} END AS experience_c, CASE WHEN sd.top IS NOT NULL THEN {_conf(_T('sd.top'), 'sd.n_sources')} END AS education_c,
    concat_ws('|', 'emails:' || se.top || CASE WHEN se.n_sources > 1 THEN ':merged' ELSE ':normalized' END, 'phones:' || sp.top || ':normalized', 'full_name:' || pn.top || CASE WHEN pn.n_agree > 1 THEN ':merged' ELSE ':direct' END,
      'headline:' || ph.top || ':direct', 'years_experience:' || py.top || ':direct', 'location:' || lo.top || ':normalized', 'links:' || li.top || CASE WHEN li.n_links > 1 THEN ':merged' ELSE ':direct' END,
      'skills:' || skn.top || CASE WHEN skn.n > 1 THEN ':merged' ELSE ':normalized' END, 'experience:' || sx.top || CASE WHEN sx.n_sources > 1 THEN ':merged' ELSE ':direct' END, 'education:' || sd.top || CASE WHEN sd.n_sources > 1 THEN ':merged' ELSE ':direct' END) AS provenance
  FROM (SELECT DISTINCT cluster_id FROM r) b LEFT JOIN se USING (cluster_id) LEFT JOIN sp USING (cluster_id) LEFT JOIN sx USING (cluster_id) LEFT JOIN sd USING (cluster_id) LEFT JOIN ue USING (cluster_id) LEFT JOIN up USING (cluster_id)
    LEFT JOIN pn USING (cluster_id) LEFT JOIN ph USING (cluster_id) LEFT JOIN py USING (cluster_id) LEFT JOIN lo USING (cluster_id) LEFT JOIN li USING (cluster_id) LEFT JOIN sks USING (cluster_id) LEFT JOIN skn USING (cluster_id)
    LEFT JOIN ex USING (cluster_id) LEFT JOIN ed USING (cluster_id)),
g AS (
  SELECT *, 'cand_' || substr(sha1(CASE WHEN emails IS NOT NULL THEN 'email:' || list_min(string_split(emails, '|')) WHEN phones IS NOT NULL THEN 'phone:' || list_min(string_split(phones, '|')) ELSE 'name:' || lower(full_name) END), 1, 12) AS candidate_id,
    {_round3("(" + " + ".join(f"coalesce({_D(w)} * {f}_c, 0)" for f, w in WEIGHTS.items()) + ") / (" + " + ".join(f"CASE WHEN {f}_c IS NULL THEN {_D(0)} ELSE {_D(w)} END" for f, w in WEIGHTS.items()) + ")")} AS overall_confidence
  FROM c WHERE full_name IS NOT NULL OR emails IS NOT NULL OR phones IS NOT NULL)
"""

_DOC = "SELECT doc_id, coalesce(text, '') AS t FROM documents"
_SKILL_LIST = ", ".join(
    f"CASE WHEN regexp_matches(lower(t), '(^|[^a-z0-9]){re.escape(a)}($|[^a-z0-9])') THEN '{name}' END" for a, name in skills.SKILLS.items()
)

SQL: dict[str, str] = {
    "extract_emails": f"SELECT doc_id, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS emails FROM (SELECT doc_id, regexp_extract_all(lower(t), '{_EMAIL}') AS m FROM ({_DOC}))",
    "extract_phones": f"""SELECT doc_id, candidates, array_to_string(list_filter(m, lambda x, i: list_position(m, x) = i), '|') AS phones FROM (
      SELECT doc_id, array_to_string(p, '|') AS candidates, list_filter(list_transform(p, lambda x: CASE WHEN NOT regexp_full_match(x, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') AND regexp_full_match(
        CASE WHEN starts_with(x, '+') THEN regexp_replace(x, '[^0-9]', '', 'g') ELSE '1' || regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\\1') END, '{contacts.VALID[1:-1]}')
        THEN '+' || CASE WHEN starts_with(x, '+') THEN regexp_replace(x, '[^0-9]', '', 'g') ELSE '1' || regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^1([0-9]{{10}})$', '\\1') END END), lambda x: x IS NOT NULL) AS m
      FROM (SELECT doc_id, list_transform(regexp_extract_all(t, '(\\+?\\d[\\d\\-\\s().]{{7,}}\\d)', 1), lambda x: trim(x)) AS p FROM ({_DOC})))""",
    "scan_skills": f"SELECT doc_id, array_to_string(list_filter([{_SKILL_LIST}], lambda x: x IS NOT NULL), '|') AS skills FROM ({_DOC})",
    "guess_name": f"""SELECT doc_id, list_filter(list_transform(string_split(t, chr(10))[1:8], lambda x: trim(x)),
        lambda x: x <> '' AND NOT regexp_matches(x, '[@0-9]') AND len(regexp_split_to_array(x, '\\s+')) BETWEEN 2 AND 4 AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0)[1] AS full_name FROM ({_DOC})""",
    "labelled_name": "SELECT c_custkey, 'Customer ' || upper(substr(n, 1, 1)) || lower(substr(n, 2)) AS full_name FROM (SELECT c_custkey, translate(split_part(c_name, '#', 2), '0123456789', 'ABCDEFGHIJ') AS n FROM customer)",
    "sections": """SELECT c_custkey, 'Python|sql|tool' || c_custkey AS skills, 'Works on ' || lower(c_mktsegment) || '.' AS headline,
        upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Lead;Company ' || c_custkey || ';Jan 2019;present;built things and more|Clerk;Shop;03/2015;2018;-' AS jobs,
        'BSc Physics;University of ' || c_custkey || ';2012' AS studies FROM customer""",
    "normalize_email": f"WITH {NORM} SELECT rec_seq, email FROM norm",
    "normalize_phone": """SELECT p_partkey, '+9199887' || d AS india, CAST(NULL AS VARCHAR) AS us, '+9199887' || d AS plus, '+1415555' || substr(d, 2) AS extension
      FROM (SELECT p_partkey, lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') AS d FROM part)""",
    "phones_abroad": f"""WITH plans AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{code}', '{first}', {n})" for k, (code, first, n) in enumerate(ABROAD))}) v(k, code, first, digits)),
      c AS (SELECT c_custkey, code, first || lpad(CAST(c_custkey % 10000 AS VARCHAR), CAST(digits - length(first) AS INTEGER), '1') AS n FROM customer JOIN plans ON k = (c_custkey // 4) % {len(ABROAD)})
      SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '+' || code || ' ' || n WHEN 1 THEN '+' || code || '-' || substr(n, 1, 3) || '-' || substr(n, 4) WHEN 2 THEN '+' || code || ' ' || substr(n, 1, 4) ELSE '+999 ' || n END AS said,
        CASE WHEN c_custkey % 4 < 2 THEN '+' || code || n END AS phone FROM c""",
    "normalize_date": """SELECT o_orderkey, CASE WHEN o_orderkey % 23 < 12 OR o_orderkey % 23 = 18 THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 23 = 15 THEN strftime(o_orderdate, '%Y-01') END AS month,
        CASE WHEN o_orderkey % 23 < 16 OR o_orderkey % 23 = 18 THEN strftime(o_orderdate, '%Y') END AS year FROM orders""",
    # The first five letters of one country are those of another as well; three letters too many are no misspelling.
    "search_country": f"""WITH names AS (SELECT * FROM (VALUES {", ".join(f"({k}, '{n}', '{code}')" for k, (n, code) in enumerate(COUNTRIES.items()))}) v(k, name, code))
      SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN name WHEN 1 THEN substr(name, 1, 2) || substr(name, 4) WHEN 2 THEN substr(name, 1, 4) || substr(name, 4) WHEN 3 THEN substr(name, 1, 5)
        WHEN 4 THEN 'lives in ' || name WHEN 5 THEN 'zq' || name ELSE 'zqw' || name END AS said,
        CASE WHEN c_custkey % 7 = 6 OR c_custkey % 7 = 3 AND name = 'Australia' THEN NULL ELSE code END AS country
      FROM customer JOIN names ON k = c_nationkey % {len(COUNTRIES)}""",
    "normalize_country": f"WITH {NORM} SELECT norm.rec_seq, norm.country FROM norm JOIN people USING (rec_seq) WHERE people.country IS NOT NULL",
    "canonical_skill": f"""WITH p AS ({derived.SQL}) SELECT rec_seq, CAST(pos AS BIGINT) AS pos, {_SKILL.format('s')} AS skill, s NOT IN ('COBOL', 'Rust') AS known
      FROM (SELECT rec_seq, 0 AS pos, skill1 AS s FROM p UNION ALL SELECT rec_seq, 1, skill2 FROM p UNION ALL SELECT rec_seq, 2, skill3 FROM p) WHERE s IS NOT NULL""",
    "norm_url": "SELECT page_id, regexp_replace(rtrim(lower(url), '/'), '^https?://(www\\.)?', '') AS url FROM pages",
    "header_alias": "SELECT c_custkey AS rec_seq, c_name AS full_name, 'x' || c_custkey || '@y.org' AS email, CAST(0 AS BIGINT) AS n_phones, c_mktsegment AS title, CAST(NULL AS VARCHAR) AS company FROM customer",
    "json_alias": """SELECT c_custkey * 10 AS rec_seq, c_name AS full_name, 'e' || c_custkey || '@x.io' AS email, CAST(c_custkey % 30 AS DOUBLE) AS years_experience, 'T' || c_nationkey AS city, CAST(NULL AS VARCHAR) AS region,
        'py|go' AS skills, CAST(1 AS BIGINT) AS n_jobs, 'E' AS company, c_mktsegment AS title, '2019' AS started FROM customer""",
    "normalized_people": f"WITH {NORM} SELECT rec_seq, source, full_name, email, phone, city, country, array_to_string(skills, '|') AS skills, started, ended, end_year FROM norm",
    "match_keys": f"WITH {NORM} SELECT rec_seq, key FROM keys",
    "key_owner_edges": f"WITH {NORM} SELECT rec_seq, owner FROM edges",
    "clusters": BASE + "SELECT rec_seq, cluster_id FROM clu",
    "union_emails": BASE + f"SELECT * FROM {_union('email')}",
    "union_phones": BASE + f"SELECT * FROM {_union('phone')}",
    "pick_name": BASE + f"SELECT * FROM {_pick('full_name')}",
    "pick_headline": BASE + f"SELECT * FROM {_pick('headline')}",
    "pick_years": BASE + f"SELECT * FROM {_pick('years')}",
    "pick_location": BASE + f"SELECT cluster_id, city, country, top, CAST(filled AS BIGINT) AS filled FROM {_LOCATION}",
    "merge_links": BASE + f"SELECT * FROM {_LINKS}",
    "merge_skills": BASE + f"SELECT cluster_id, pos, name, confidence, sources FROM {_SKILLS}",
    "dedupe_experience": BASE + f"SELECT * FROM {_JOBS}",
    "dedupe_education": BASE + f"SELECT * FROM {_STUDIES}",
    "contributors": BASE + f"SELECT * FROM {_seen('email IS NOT NULL')}",
    "field_confidence": SCORED + "SELECT cluster_id, " + ", ".join(f"{f}_c AS {f}" for f in WEIGHTS) + " FROM c",
    "candidate_id": SCORED + "SELECT cluster_id, candidate_id FROM g",
    "provenance": SCORED + """SELECT cluster_id, pos, split_part(p, ':', 1) AS field, split_part(p, ':', 2) AS source, split_part(p, ':', 3) AS method
      FROM (SELECT cluster_id, unnest(string_split(provenance, '|')) AS p, generate_subscripts(string_split(provenance, '|'), 1) - 1 AS pos FROM g)""",
    "overall_confidence": SCORED + "SELECT cluster_id, overall_confidence FROM g",
    "golden_profiles": SCORED + """SELECT candidate_id, cluster_id, coalesce(full_name, '') AS full_name, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, city, country, linkedin, github, portfolio, headline, years_experience,
        coalesce(skills, '') AS skills, coalesce(n_jobs, 0) AS n_jobs, coalesce(n_studies, 0) AS n_studies, provenance, overall_confidence FROM g""",
    "project_custom": SCORED + """SELECT coalesce(full_name, '') AS full_name, string_split(emails, '|')[1] AS primary_email, string_split(phones, '|')[1] AS phone, country, coalesce(skills, '') AS skills, linkedin, overall_confidence FROM g""",
    "project_default": SCORED + """SELECT candidate_id, coalesce(full_name, '') AS full_name, coalesce(len(string_split(emails, '|')), 0) AS n_emails, coalesce(len(string_split(skills, '|')), 0) AS n_skills, overall_confidence FROM g""",
    "validate": SCORED + """, v AS (SELECT candidate_id, cluster_id, list_filter([
        CASE WHEN emails IS NULL THEN 'required field ''email'' is missing or null' END,
        CASE WHEN years_experience IS NOT NULL THEN 'field ''years'': expected string, got float' END,
        CASE WHEN phones IS NULL OR len(string_split(phones, '|')) < 2 THEN 'required field ''second_phone'' is missing or null' END,
        'field ''skills'': expected string[], got list',
        CASE WHEN headline IS NOT NULL THEN 'field ''headline'': unknown type ''strange''' END,
        'required field ''nowhere'' is missing or null'], lambda x: x IS NOT NULL) AS errors FROM g)
      SELECT candidate_id, cluster_id, unnest(errors) AS error, generate_subscripts(errors, 1) - 1 AS n FROM v""",
    "contact_groups": f"""WITH f AS (
        SELECT DISTINCT doc_id, 'email' AS kind, unnest(regexp_extract_all(lower(t), '{_EMAIL}')) AS value FROM ({_DOC})
        UNION SELECT DISTINCT doc_id, 'skill', unnest(list_filter([{_SKILL_LIST}], lambda x: x IS NOT NULL)) FROM ({_DOC}))
      SELECT kind, value, count(*) AS n_docs, min(doc_id) AS first_doc FROM f GROUP BY kind, value""",
}
QUERIES = {
    "golden_profiles": golden_profiles, "extract_emails": extract_emails, "extract_phones": extract_phones, "scan_skills": scan_skills, "guess_name": guess_name, "labelled_name": labelled_name,
    "sections": sections, "normalize_email": normalize_email, "normalize_phone": normalize_phone, "phones_abroad": phones_abroad, "normalize_date": normalize_date, "normalize_country": normalize_country, "search_country": search_country, "canonical_skill": canonical_skill,
    "norm_url": norm_url, "header_alias": header_alias, "json_alias": json_alias, "normalized_people": normalized_people, "match_keys": match_keys, "key_owner_edges": key_owner_edges, "clusters": clusters,
    "union_emails": union_emails, "union_phones": union_phones, "pick_name": _scalar("full_name"), "pick_headline": _scalar("headline"), "pick_years": _scalar("years_experience"),
    "pick_location": pick_location, "merge_links": merge_links, "merge_skills": merge_skills, "dedupe_experience": dedupe_experience, "dedupe_education": dedupe_education, "contributors": contributors,
    "field_confidence": field_confidence, "candidate_id": candidate_id, "provenance": provenance, "overall_confidence": overall_confidence, "project_custom": project_custom,
    "project_default": project_default, "validate": validate, "contact_groups": contact_groups,
}
