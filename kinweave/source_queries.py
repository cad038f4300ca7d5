"""The registered queries over sources, output policies and the whole job, each with the SQL that must give the same rows.

What a source would hold is derived from the order tables: texts of several
shapes per customer, and files of them in the shared folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.operators import merge, projection
from kinweave.plans.job import run_job, write_profiles
from kinweave.plans.lineage import checkpoint_folder
from kinweave.plans.tables import table
from kinweave.queries import SCORED, golden
from kinweave.sources.files import load
from kinweave.sources.json_records import linkedin_records, url_records
from kinweave.sources.profile_tables import profile_records
from kinweave.sources.text_records import note_records, resume_records

#: Objects in a derived JSON file.
PER_FILE = 1000
#: One in so many customers has a file of its own of each kind that is a file per person.
PER_KIND = 50


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.col("c_custkey").cast("string").alias("k"))


def _filled(text: Column, **values: Column) -> Column:
    """A text with ``<name>`` replaced by each value."""
    for name, value in values.items():
        text = F.replace(text, F.lit(f"<{name}>"), value)
    return text


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def _first(c: str) -> Column:
    return F.get(c, F.lit(0))


def _shapes(n: int, shapes: dict[int, Column]) -> Column:
    """One of several texts by the customer's number."""
    of = F.col("c_custkey") % n
    out = None
    for k, text in shapes.items():
        out = F.when(of == k, text) if out is None else out.when(of == k, text)
    return out


def linkedin_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = json.dumps({
        "name": "<name>", "headline": "<seg> lead", "url": "https://www.linkedin.com/in/C<k>/", "location": {"city": "Town <k>", "state": "S", "country": "India"},
        "skills": ["py", "", "Welding"], "positions": [{"companyName": "Co <k>", "role": "<seg>", "from": "2019-01", "to": "2020-02", "summary": "s"}, 7], "education": [{"schoolName": "U <k>", "fieldOfStudy": "Physics", "endYear": "2012"}],
    })
    two = '[{"fullName": "<name>", "positions": [], "skills": "none"}, 5, null, {"publicProfileUrl": "linkedin.com/in/second-<k>"}, "text", {"note": "nobody"}]'
    c = _customers(spark, sf_dir)
    value = _shapes(5, {0: F.lit(whole), 1: F.lit(two), 2: F.lit('{"NAME": "", "full_name": "<name>", "title": "<seg>", "geo": "Pune", "emailAddress": "l<k>@x.io"}'), 3: F.lit('{"headline": "alone", "location": {}}'), 4: F.lit("no json <k>")})
    texts = c.select("c_custkey", _filled(value, name=F.col("c_name"), seg=F.col("c_mktsegment"), k=F.col("k")).alias("value"))
    found = linkedin_records(texts, F.col("c_custkey") * 10 + F.col("pos"))
    job, study = _first("experience"), _first("education")
    return found.select(
        "rec_seq", "source", "full_name", "headline", _first("emails").alias("email"), F.col("location.city").alias("city"), F.col("location.region").alias("region"), F.col("location.country").alias("country"),
        F.col("links.linkedin").alias("url"), _joined("skills").alias("skills"), F.size("experience").cast("long").alias("n_jobs"), job["company"].alias("company"), job["title"].alias("title"), job["start"].alias("started"),
        study["institution"].alias("school"), study["field"].alias("field"), study["end_year"].alias("end_year"),
    )


_URLS = {0: "https://www.linkedin.com/in/C<k>/", 1: "de.linkedin.com/in/C<k>?trk=x", 2: "see LINKEDIN.COM/in/C<k> there", 3: "https://example.com/in/C<k>", 4: "http://linkedin.com/in/C<k>"}


def profile_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _filled(_shapes(5, {n: F.lit(x) for n, x in _URLS.items()}), k=F.col("k"))
    found = url_records(_customers(spark, sf_dir).select("c_custkey", value.alias("value")), F.col("c_custkey"))
    return found.select("rec_seq", "source", "full_name", F.col("links.linkedin").alias("url"), F.size("emails").cast("long").alias("n_emails"))


def saved_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    users = _customers(spark, sf_dir).select(
        "c_custkey", F.concat(F.lit("u"), k).alias("login"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).otherwise("").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("u"), k, F.lit("@x.io"))).alias("email"),
        F.col("c_mktsegment").alias("bio"), F.when(F.col("c_custkey") % 2 == 0, "France").alias("location"), F.concat(F.lit("https://github.com/u"), k).alias("html_url"),
        F.element_at(F.array(F.lit(""), F.concat(F.lit(" u"), k, F.lit(".dev ")), F.concat(F.lit("http://u"), k, F.lit(".dev"))), (F.col("c_custkey") % 3 + 1).cast("int")).alias("blog"),
    )
    names = F.element_at(F.array(F.lit("Go"), F.lit("Python"), F.lit(None).cast("string"), F.lit(""), F.lit("Rust")), (F.col("o_orderkey") % 5 + 1).cast("int"))
    repos = table(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("login"), (F.lit(10_000_000_000) - F.col("o_orderkey")).alias("repo_rank"), names.alias("language"))
    return profile_records(users, repos, F.col("c_custkey")).select(
        "rec_seq", "source", "full_name", _first("emails").alias("email"), "headline", F.col("location.city").alias("city"), F.col("location.country").alias("country"),
        F.col("links.github").alias("github"), F.col("links.portfolio").alias("portfolio"), _joined("skills").alias("skills"),
    )


_RESUMES = {
    0: "Ann <k>\nAnn Maria Lee\nann<k>@x.io | (415) 555-0123\n\nSUMMARY:\nBuilds  <seg>\nfor all\nTechnical Skills\nGo, sql; tool<k>  | x\nEmployment\nLead at Co <k>  Jan 2019 - present\n* one\n• two\nEducation:\nMBA, Institute <k>, 2011\n",
    1: "Experience\nClerk, Shop <k>  03/2015 – 2018\nidle\n- did things\nBoss @ Firm 2012 to 2014\nSkills:\n",
    2: "nothing to go by",
    3: "skills\npy\neducation\nlearned a lot 1999\nPhD of Arts - College <k>\n",
}


def resume_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _filled(_shapes(4, {n: F.lit(x) for n, x in _RESUMES.items()}), k=F.col("k"), seg=F.col("c_mktsegment"))
    found = resume_records(_customers(spark, sf_dir).select("c_custkey", value.alias("value")), F.col("c_custkey"))
    show = lambda items, *parts: _joined(F.transform(items, lambda e: F.concat_ws(";", *(F.coalesce(e[p], F.lit("-")) for p in parts))))
    return found.select(
        "rec_seq", "source", "full_name", _joined("emails").alias("emails"), _joined("phones").alias("phones"), "headline", _joined("skills").alias("skills"),
        show("experience", "title", "company", "start", "end", "summary").alias("jobs"), show("education", "degree", "institution", "end_year").alias("studies"),
    )


_NOTES = {
    0: "Spoke  to Mary Ann Poe about <seg>.\nMail mary<k>@x.io; knows Python, k8s and Go",
    1: "candidate - Jon O'Neil\ncall +91 98765 43210",
    2: "met someone at lunch",
    3: "loves react.js <k>",
}


def note_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _filled(_shapes(4, {n: F.lit(x) for n, x in _NOTES.items()}), k=F.col("k"), seg=F.col("c_mktsegment"))
    found = note_records(_customers(spark, sf_dir).select("c_custkey", value.alias("value")), F.col("c_custkey"))
    return found.select("rec_seq", "source", "full_name", _joined("emails").alias("emails"), _joined("phones").alias("phones"), "headline", _joined("skills").alias("skills"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder of source files: tables of people, exports of half of them, notes on every tenth, and names that are hard to read."""
    folder = f"{checkpoint_folder(spark)}/sources-{uuid.uuid4().hex}"
    c = _customers(spark, sf_dir)
    mail = F.concat(F.lit("c"), "k", F.lit("@x.io"))
    c.select(F.col("c_name").alias("Full Name"), mail.alias("E-mail"), F.lit("").alias("Phone"), F.col("c_mktsegment").alias("Role")).write.csv(f"{folder}/people 100%", header=True)
    entry = F.struct(F.concat(F.lit("Cust "), "k").alias("name"), F.upper(mail).alias("email"), F.array(F.lit("py"), F.lit("COBOL")).alias("skills"))
    exported = c.filter("c_custkey % 2 = 0").withColumn("part", F.expr(f"c_custkey div {PER_FILE}"))
    exported.groupBy("part").agg(F.to_json(F.collect_list(entry)).alias("value")).write.partitionBy("part").text(f"{folder}/exports")
    notes = c.filter("c_custkey % 10 = 0").withColumn("part", F.expr(f"c_custkey div {PER_FILE}"))
    said = F.concat_ws(" ", F.collect_list(F.concat(F.lit("n"), "k", F.lit("@x.io"))))
    notes.groupBy("part").agg(F.concat(F.lit("Numbers of the day: "), said).alias("value")).write.partitionBy("part").text(f"{folder}/notes [a]")
    return folder


def _load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = _written(spark, sf_dir)
    return load(spark, paths=[f"{at}/people 100%", f"{at}/exports", f"{at}/missing.json"], notes=[f"{at}/notes [a]"], profile_urls=["linkedin.com/in/some-one", "https://example.com/none"])


def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _load(spark, sf_dir)[1]
    return report.select(F.element_at(F.split("path", "/"), -1).alias("path"), "source", "n_records", F.regexp_extract("warning", "^[a-z ]+", 0).alias("warning"))


def source_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _load(spark, sf_dir)[0]
    first = _first("emails")
    turn = F.min("rec_seq").alias("first_seq")
    found = raw.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rec_seq").alias("n_places"), F.sum(F.size("emails")).alias("n_emails"), F.count_distinct(F.lower(first)).alias("n_first_emails"), F.sum(F.size("skills")).alias("n_skills"), turn)
    before = found.select(F.col("source").alias("other"), F.col("first_seq").alias("seq"))
    return found.join(before, F.col("seq") < F.col("first_seq"), "left").groupBy("source", "n", "n_places", "n_emails", "n_first_emails", "n_skills").agg(F.count("other").alias("sources_before"))


def job_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all six kinds: tables, exports, resumes and notes without a telling name, profile exports, and saved tables of users."""
    at, c = _written(spark, sf_dir), _customers(spark, sf_dir)
    mail, of = F.concat(F.lit("c"), "k", F.lit("@x.io")), lambda r: c.filter(f"c_custkey % {PER_KIND} = {r}")
    # A file per row, written by all cores.
    apart = lambda rows: rows.repartition(spark.sparkContext.defaultParallelism, "c_custkey")
    apart(of(1)).select("c_custkey", F.concat(F.lit("Some Resume\n"), mail, F.lit("\nSkills\nRust\n")).alias("value")).write.partitionBy("c_custkey").text(f"{at}/resumes")
    apart(of(2)).select("c_custkey", F.concat(F.lit("Mail "), mail, F.lit(", knows Docker")).alias("value")).write.partitionBy("c_custkey").text(f"{at}/talks")
    apart(of(3)).select(F.lit("Some Profile").alias("name"), mail.alias("email"), F.array(F.lit("Kafka")).alias("skills")).withColumn("part", F.col("email")).write.partitionBy("part").json(f"{at}/profiles")
    nothing = F.lit(None).cast("string")
    users = c.filter("c_custkey % 3 = 0").select(F.concat(F.lit("u"), "k").alias("login"), nothing.alias("name"), mail.alias("email"), *(nothing.alias(x) for x in ("bio", "location", "html_url", "blog")))
    repos = users.select("login", F.lit(0).alias("repo_rank"), F.lit("Go").alias("language"))
    config = {"fields": [{"path": "full_name", "required": True}, {"path": "email", "from": "emails[0]"}, {"path": "skills", "from": "skills[].name"}, {"path": "headline"}]}
    shown, report, wrong = run_job(spark, config, paths=[f"{at}/people 100%", f"{at}/exports", f"{at}/resumes"], notes=[f"{at}/talks"], profiles=[f"{at}/profiles"], users=users, repos=repos)
    told = report.select(F.lit("report"), "source", F.col("n_records").cast("string"), F.col("warning"))
    return shown.select("full_name", "email", _joined("skills").alias("skills"), "headline").union(wrong.select(F.lit("violation"), "error", F.lit(""), F.lit(""))).union(told)


def _many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with several values each, fifty clusters of them: repeats within a record, across records, and in another order."""
    k, nothing = F.col("c_custkey"), F.lit(None).cast("string")
    text = lambda pre, n: F.concat(F.lit(pre), n.cast("string"))
    emails = F.array(text("a", k % 7), text("b", k % 5), text("a", k % 7), text("a", k % 3))
    other = F.when(k % 4 == 0, F.array(text("https://o", k % 9), nothing, text("https://o", k % 2))).otherwise(F.array().cast("array<string>"))
    links = F.struct(F.when(k % 3 == 0, text("https://linkedin.com/in/l", k % 11)).alias("linkedin"), F.when(k % 8 == 1, text("https://github.com/g", k % 13)).alias("github"), nothing.alias("portfolio"), other.alias("other"))
    source = F.when(k % 2 == 0, "ats_json").when(k % 5 == 1, "github").otherwise("resume")
    raw = _customers(spark, sf_dir).select((k % 50).alias("cluster_id"), k.alias("rec_seq"), source.alias("source"), emails.alias("emails"), links.alias("links"))
    return raw.withColumn("trust", schemas.trust("source"))


def union_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_values(_many_values(spark, sf_dir), "emails").select("cluster_id", _joined("emails").alias("emails"))


def links_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.merge_links(_many_values(spark, sf_dir))
    return found.select("cluster_id", "links.linkedin", "links.github", "links.portfolio", _joined("links.other").alias("other"), "n_links", "top")


# --- Output -----------------------------------------------------------------------------------------------------------

OMIT = {
    "fields": [{"path": "full_name"}, {"path": "mail", "from": "emails[0]", "required": True}, {"path": "second", "from": "emails[1]"}, {"path": "planet", "from": "location.planet"}, {"path": "years", "from": "years_experience"}, {"path": "skills", "from": "skills[].name"}],
    "on_missing": "omit",
}
GATES = {
    "named": {"fields": [{"path": "full_name", "type": "string", "required": True}, {"path": "skills", "from": "skills[].name", "type": "string[]"}]},
    "mailed": {"fields": [{"path": "mail", "from": "emails[0]", "type": "string", "required": True}]},
    "numbers": {"fields": [{"path": "years", "from": "years_experience", "type": "number"}, {"path": "full_name", "type": "number"}]},
}


def project_omit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.as_json(golden(spark, sf_dir), OMIT)


def project_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, cluster_id, n, error, raises): the required fields that profiles miss, and whether the projection itself fails on them."""
    config = {"fields": [{"path": "id", "from": "candidate_id", "required": True}, {"path": "mail", "from": "emails[0]", "required": True}, {"path": "second", "from": "emails[1]", "required": True}, {"path": "third", "from": "emails[2]"}], "on_missing": "error"}
    found = golden(spark, sf_dir)
    try:
        projection.project(found, config).write.format("noop").mode("overwrite").save()
        raises = False
    except Exception as e:  # whatever wraps it, it must be the policy's own message
        if "required field missing: " not in str(e):
            raise
        raises = True
    return projection.missing_required(found, config).withColumn("raises", F.lit(raises))


def project_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a key is absent, null or there in typed objects under ``omit``."""
    shown = projection.as_variant(golden(spark, sf_dir), OMIT).select(F.expr("schema_of_variant(profile)").alias("kind"), "profile")
    key = lambda k: F.when(~F.contains("kind", F.lit(f"{k}:")), "absent").when(F.contains("kind", F.lit(f"{k}: VOID")), "null").otherwise("there").alias(k)
    return shown.groupBy(*(key(k) for k in ("mail", "second", "planet", "years"))).agg(F.count(F.lit(1)).alias("n"), F.max(F.try_variant_get("profile", "$.years", "double")).alias("most_years"))


def strict_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gate, candidate_id, cluster_id, n, error, passes): the violations under three configs, and whether the strict gate lets a config pass."""
    found, out = golden(spark, sf_dir), None
    for name, config in GATES.items():
        wrong = projection.violations(found, config)
        try:
            projection.strict(wrong)
            passes = True
        except ValueError:
            passes = False
        part = wrong.select(F.lit(name).alias("gate"), "candidate_id", "cluster_id", "n", "error", F.lit(passes).alias("passes"))
        out = part if out is None else out.union(part)
    return out


def written_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles in order, written as JSON Lines and as Parquet, and read again."""
    at = f"{checkpoint_folder(spark)}/profiles-{uuid.uuid4().hex}"
    shown = projection.project(merge.ordered(golden(spark, sf_dir)), {"include_provenance": False})
    write_profiles(shown, f"{at}/json")
    write_profiles(spark.read.schema(shown.schema).json(f"{at}/json"), f"{at}/parquet", "parquet")
    back = spark.read.parquet(f"{at}/parquet")
    return back.select("candidate_id", "full_name", _joined("emails").alias("emails"), F.col("location.country").alias("country"), _joined(F.transform("skills", lambda s: s["name"])).alias("skills"), "years_experience", "overall_confidence")


def output_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(candidate_id, cluster_id, position): the place of each profile among all, whatever the partitions."""
    return merge.positioned(golden(spark, sf_dir)).select("candidate_id", "cluster_id", "position")


_MISSING = "CAST(NULL AS VARCHAR)"
SQL: dict[str, str] = {
    "linkedin_export": f"""WITH shape AS (
        SELECT c_custkey, c_name, c_mktsegment, c_custkey % 5 AS s, 0 AS pos FROM customer WHERE c_custkey % 5 < 3
        UNION ALL SELECT c_custkey, c_name, c_mktsegment, 11, 3 FROM customer WHERE c_custkey % 5 = 1)
      SELECT c_custkey * 10 + pos AS rec_seq, 'linkedin' AS source, CASE WHEN s < 11 THEN c_name END AS full_name, CASE s WHEN 0 THEN c_mktsegment || ' lead' WHEN 2 THEN c_mktsegment END AS headline,
        CASE s WHEN 2 THEN 'l' || c_custkey || '@x.io' END AS email, CASE s WHEN 0 THEN 'Town ' || c_custkey WHEN 2 THEN 'Pune' END AS city, CASE s WHEN 0 THEN 'S' END AS region, CASE s WHEN 0 THEN 'India' WHEN 2 THEN 'Pune' END AS country,
        CASE s WHEN 0 THEN 'https://linkedin.com/in/C' || c_custkey WHEN 11 THEN 'https://linkedin.com/in/second-' || c_custkey END AS url, CASE s WHEN 0 THEN 'py|Welding' ELSE '' END AS skills,
        CAST(CASE s WHEN 0 THEN 1 ELSE 0 END AS BIGINT) AS n_jobs, CASE s WHEN 0 THEN 'Co ' || c_custkey END AS company, CASE s WHEN 0 THEN c_mktsegment END AS title, CASE s WHEN 0 THEN '2019-01' END AS started,
        CASE s WHEN 0 THEN 'U ' || c_custkey END AS school, CASE s WHEN 0 THEN 'Physics' END AS field, CASE s WHEN 0 THEN '2012' END AS end_year FROM shape""",
    "profile_links": f"SELECT c_custkey AS rec_seq, 'linkedin' AS source, {_MISSING} AS full_name, 'https://linkedin.com/in/C' || c_custkey AS url, CAST(0 AS BIGINT) AS n_emails FROM customer WHERE c_custkey % 5 <> 3",
    "saved_profiles": """WITH l AS (SELECT o_custkey, name, min(-o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Go' WHEN 1 THEN 'Python' WHEN 4 THEN 'Rust' END AS name FROM orders) WHERE name IS NOT NULL GROUP BY o_custkey, name),
      s AS (SELECT o_custkey, string_agg(name, '|' ORDER BY r, name) AS skills FROM l GROUP BY o_custkey)
      SELECT c_custkey AS rec_seq, 'github' AS source, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS full_name, CASE WHEN c_custkey % 4 = 0 THEN 'u' || c_custkey || '@x.io' END AS email, c_mktsegment AS headline,
        CASE WHEN c_custkey % 2 = 0 THEN 'France' END AS city, CASE WHEN c_custkey % 2 = 0 THEN 'France' END AS country, 'https://github.com/u' || c_custkey AS github,
        CASE c_custkey % 3 WHEN 1 THEN 'https://u' || c_custkey || '.dev' WHEN 2 THEN 'http://u' || c_custkey || '.dev' END AS portfolio, coalesce(skills, '') AS skills FROM customer LEFT JOIN s ON c_custkey = o_custkey""",
    "resume_sources": """SELECT c_custkey AS rec_seq, 'resume' AS source, CASE c_custkey % 4 WHEN 0 THEN 'Ann Maria Lee' END AS full_name, CASE c_custkey % 4 WHEN 0 THEN 'ann' || c_custkey || '@x.io' ELSE '' END AS emails,
        CASE c_custkey % 4 WHEN 0 THEN '415) 555-0123' ELSE '' END AS phones, CASE c_custkey % 4 WHEN 0 THEN 'Builds  ' || c_mktsegment || ' for all' END AS headline,
        CASE c_custkey % 4 WHEN 0 THEN 'Go|sql|tool' || c_custkey || '|x' WHEN 3 THEN 'py' ELSE '' END AS skills,
        CASE c_custkey % 4 WHEN 0 THEN 'Lead;Co ' || c_custkey || ';Jan 2019;present;one two' WHEN 1 THEN 'Clerk;Shop ' || c_custkey || ';03/2015;2018;did things|Boss @;-;Firm 2012;2014;-' ELSE '' END AS jobs,
        CASE c_custkey % 4 WHEN 0 THEN 'MBA;Institute ' || c_custkey || ';2011' WHEN 3 THEN 'PhD of Arts - College ' || c_custkey || ';College ' || c_custkey || ';-' ELSE '' END AS studies
      FROM customer WHERE c_custkey % 4 <> 2""",
    "note_sources": """SELECT c_custkey AS rec_seq, 'recruiter_notes' AS source, CASE c_custkey % 4 WHEN 0 THEN 'Mary Ann Poe' WHEN 1 THEN 'Jon O''Neil' END AS full_name, CASE c_custkey % 4 WHEN 0 THEN 'mary' || c_custkey || '@x.io' ELSE '' END AS emails,
        CASE c_custkey % 4 WHEN 1 THEN '+91 98765 43210' ELSE '' END AS phones,
        CASE c_custkey % 4 WHEN 0 THEN 'Spoke to Mary Ann Poe about ' || c_mktsegment || '. Mail mary' || c_custkey || '@x.io; knows Python, k8s and Go' WHEN 1 THEN 'candidate - Jon O''Neil call +91 98765 43210' ELSE 'loves react.js ' || c_custkey END AS headline,
        CASE c_custkey % 4 WHEN 0 THEN 'Python|Go|Kubernetes' WHEN 3 THEN 'JavaScript|React' ELSE '' END AS skills FROM customer WHERE c_custkey % 4 <> 2""",
    "source_report": f"""SELECT 'people 100%' AS path, 'recruiter_csv' AS source, count(*) AS n_records, {_MISSING} AS warning FROM customer
      UNION ALL SELECT 'exports', 'ats_json', count(*), NULL FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 'missing.json', NULL, 0, 'input not found' UNION ALL SELECT 'some-one', 'linkedin', 1, NULL UNION ALL SELECT 'none', 'linkedin', 0, 'no records extracted from linkedin source'
      UNION ALL SELECT 'notes [a]', 'recruiter_notes', count(DISTINCT c_custkey // {PER_FILE}), NULL FROM customer WHERE c_custkey % 10 = 0""",
    "source_union": f"""SELECT 'recruiter_csv' AS source, count(*) AS n, count(*) AS n_places, CAST(count(*) AS BIGINT) AS n_emails, count(*) AS n_first_emails, CAST(0 AS BIGINT) AS n_skills, CAST(0 AS BIGINT) AS sources_before FROM customer
      UNION ALL SELECT 'ats_json', count(*), count(*), count(*), count(*), 2 * count(*), 1 FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 'recruiter_notes', count(DISTINCT c_custkey // {PER_FILE}), count(DISTINCT c_custkey // {PER_FILE}), count(*), count(DISTINCT c_custkey // {PER_FILE}), 0, 2 FROM customer WHERE c_custkey % 10 = 0
      UNION ALL SELECT 'linkedin', 1, 1, 0, 0, 0, 3""",
    "job_over_files": f"""SELECT CASE WHEN c_custkey % 2 = 0 THEN 'Cust ' || c_custkey ELSE c_name END AS full_name, 'c' || c_custkey || '@x.io' AS email,
        concat_ws('|', CASE WHEN c_custkey % 2 = 0 THEN 'Python|COBOL' END, CASE c_custkey % {PER_KIND} WHEN 1 THEN 'Rust' WHEN 2 THEN 'Docker' WHEN 3 THEN 'Kafka' END, CASE WHEN c_custkey % 3 = 0 THEN 'Go' END) AS skills, c_mktsegment AS headline FROM customer
      UNION ALL SELECT 'report', 'recruiter_csv', CAST(count(*) AS VARCHAR), NULL FROM customer UNION ALL SELECT 'report', 'ats_json', CAST(count(*) AS VARCHAR), NULL FROM customer WHERE c_custkey % 2 = 0
      UNION ALL SELECT 'report', CASE c_custkey % {PER_KIND} WHEN 1 THEN 'resume' WHEN 2 THEN 'recruiter_notes' ELSE 'linkedin' END, CAST(count(*) AS VARCHAR), NULL FROM customer WHERE c_custkey % {PER_KIND} BETWEEN 1 AND 3 GROUP BY c_custkey % {PER_KIND}
      UNION ALL SELECT 'report', 'github', CAST(count(*) AS VARCHAR), NULL FROM customer WHERE c_custkey % 3 = 0""",
    "union_many": """WITH x AS (SELECT c_custkey % 50 AS cluster_id, c_custkey AS r, unnest(['a' || c_custkey % 7, 'b' || c_custkey % 5, 'a' || c_custkey % 7, 'a' || c_custkey % 3]) AS v, unnest([1, 2, 3, 4]) AS p FROM customer),
      f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, v ORDER BY r, p) AS n FROM x) SELECT cluster_id, string_agg(v, '|' ORDER BY r, p) AS emails FROM f WHERE n = 1 GROUP BY cluster_id""",
    "links_many": """WITH c AS (SELECT c_custkey % 50 AS cluster_id, c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'ats_json' WHEN c_custkey % 5 = 1 THEN 'github' ELSE 'resume' END AS source FROM customer),
      x AS (SELECT *, 'linkedin' AS kind, '' AS key, 'https://linkedin.com/in/l' || k % 11 AS url, 0 AS p FROM c WHERE k % 3 = 0 UNION ALL SELECT *, 'github', '', 'https://github.com/g' || k % 13, 1 FROM c WHERE k % 8 = 1
        UNION ALL SELECT *, 'other', 'https://o' || k % 9, 'https://o' || k % 9, 3 FROM c WHERE k % 4 = 0 UNION ALL SELECT *, 'other', 'https://o' || k % 2, 'https://o' || k % 2, 5 FROM c WHERE k % 4 = 0),
      f AS (SELECT *, CASE source WHEN 'ats_json' THEN 0.95 WHEN 'github' THEN 0.55 ELSE 0.7 END AS trust, row_number() OVER (PARTITION BY cluster_id, kind, key ORDER BY k, p) AS n FROM x)
      SELECT cluster_id, max(url) FILTER (kind = 'linkedin') AS linkedin, max(url) FILTER (kind = 'github') AS github, CAST(NULL AS VARCHAR) AS portfolio, coalesce(string_agg(url, '|' ORDER BY k, p) FILTER (kind = 'other'), '') AS other,
        count(*) AS n_links, first(source ORDER BY trust DESC, k) AS top FROM f WHERE n = 1 GROUP BY cluster_id""",
    "project_omit": SCORED + """SELECT '{' || concat_ws(',', '"full_name":"' || coalesce(full_name, '') || '"', '"mail":"' || string_split(emails, '|')[1] || '"', '"second":"' || string_split(emails, '|')[2] || '"',
        '"years":' || coalesce(CAST(years_experience AS VARCHAR), 'null'), '"skills":[' || coalesce('"' || replace(skills, '|', '","') || '"', '') || ']') || '}' AS json FROM g""",
    "project_error": SCORED + """, m AS (SELECT candidate_id, cluster_id, emails IS NULL AS none, len(string_split(coalesce(emails, ''), '|')) < 2 AS single FROM g)
      SELECT candidate_id, cluster_id, CAST(0 AS BIGINT) AS n, 'required field missing: mail (from emails[0])' AS error, true AS raises FROM m WHERE none
      UNION ALL SELECT candidate_id, cluster_id, CAST(CASE WHEN none THEN 1 ELSE 0 END AS BIGINT), 'required field missing: second (from emails[1])', true FROM m WHERE single""",
    "project_variant": SCORED + """SELECT CASE WHEN emails IS NULL THEN 'absent' ELSE 'there' END AS mail, CASE WHEN len(string_split(coalesce(emails, ''), '|')) < 2 THEN 'absent' ELSE 'there' END AS second, 'absent' AS planet,
        CASE WHEN years_experience IS NULL THEN 'null' ELSE 'there' END AS years, count(*) AS n, max(years_experience) AS most_years FROM g GROUP BY 1, 2, 3, 4""",
    "strict_gate": SCORED + """SELECT 'mailed' AS gate, candidate_id, cluster_id, CAST(0 AS BIGINT) AS n, 'required field ''mail'' is missing or null' AS error, false AS passes FROM g WHERE emails IS NULL
      UNION ALL SELECT 'numbers', candidate_id, cluster_id, 0, 'field ''full_name'': expected number, got str', false FROM g""",
    "written_profiles": SCORED + "SELECT candidate_id, coalesce(full_name, '') AS full_name, coalesce(emails, '') AS emails, country, coalesce(skills, '') AS skills, years_experience, overall_confidence FROM g",
    "output_order": SCORED + "SELECT candidate_id, cluster_id, row_number() OVER (ORDER BY candidate_id, cluster_id) - 1 AS position FROM g",
}
QUERIES = {
    "linkedin_export": linkedin_export, "profile_links": profile_links, "saved_profiles": saved_profiles, "resume_sources": resume_sources, "note_sources": note_sources, "source_report": source_report,
    "source_union": source_union, "job_over_files": job_over_files, "union_many": union_many, "links_many": links_many, "project_omit": project_omit, "project_error": project_error, "project_variant": project_variant, "strict_gate": strict_gate, "written_profiles": written_profiles, "output_order": output_order,
}
