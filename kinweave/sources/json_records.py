"""Raw records from JSON texts whose keys go by many names.

A text holds one object or an array; elements that are no objects are skipped,
and a text that is no JSON gives nothing.  A key counts whatever its case; of
several names the first with a value that is not null, empty text, ``[]`` or
``{}`` is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.text import bind, strip

# The names of each field in applicant-tracking exports.
ATS: dict[str, tuple[str, ...]] = {
    "full_name": ("full_name", "name", "candidate_name", "fullName"),
    "first_name": ("first_name", "firstName", "given_name"),
    "last_name": ("last_name", "lastName", "family_name", "surname"),
    "emails": ("email", "email_address", "emailAddress", "primaryEmail", "contact_email"),
    "phones": ("phone", "phone_number", "phoneNumber", "mobile", "contact_number"),
    "headline": ("headline", "summary", "objective", "current_title", "title"),
    "years": ("years_experience", "yearsExperience", "total_experience", "experience_years"),
    "location": ("location", "address", "geo"),
    "city": ("city", "town"),
    "region": ("region", "state", "province"),
    "country": ("country", "country_code", "nation"),
    "skills": ("skills", "skill_set", "skillset", "competencies", "tags"),
    "linkedin": ("linkedin", "linkedin_url", "linkedinUrl"),
    "github": ("github", "github_url", "githubUrl"),
    "portfolio": ("portfolio", "website", "personal_site"),
    "experience": ("experience", "work_history", "employment", "positions"),
    "company": ("company", "employer", "organization", "org"),
    "title": ("title", "role", "position"),
    "start": ("start", "start_date", "from", "startDate"),
    "end": ("end", "end_date", "to", "endDate"),
    "summary": ("summary", "description", "details"),
    "education": ("education", "schools", "academics", "qualifications"),
    "institution": ("institution", "school", "university", "college"),
    "degree": ("degree", "qualification"),
    "field": ("field", "major", "field_of_study", "subject"),
    "end_year": ("end_year", "graduation_year", "year", "end", "graduated"),
}
# The names of each field in profile exports.
LINKEDIN: dict[str, tuple[str, ...]] = {
    "full_name": ("name", "full_name", "fullName"),
    "headline": ("headline", "title", "summary"),
    "emails": ("email", "emailAddress"),
    "location": ("location", "geo"),
    "city": ("city",),
    "region": ("region", "state"),
    "country": ("country",),
    "skills": ("skills", "skill_set"),
    "url": ("url", "profile_url", "linkedin", "publicProfileUrl"),
    "experience": ("experience", "positions", "work_history"),
    "company": ("company", "companyName", "employer"),
    "title": ("title", "role", "position"),
    "start": ("start", "start_date", "from", "startDate"),
    "end": ("end", "end_date", "to", "endDate"),
    "summary": ("summary", "description"),
    "education": ("education", "schools"),
    "institution": ("school", "institution", "schoolName", "university"),
    "degree": ("degree", "degreeName"),
    "field": ("field", "fieldOfStudy", "major"),
    "end_year": ("end_year", "endYear", "graduation_year", "year", "end"),
}
PROFILE_URL = r"(?i)(?:https?://)?(?:[a-z]{2,3}\.)?linkedin\.com/in/([A-Za-z0-9\-_%]+)"
_LIST, _OBJECT = "array<string>", "map<string,string>"


def fields(text: Column) -> Column:
    """The keys of a JSON object, lower-cased, with their raw values; empty values are null, of equal keys the last counts."""
    def lookup(entries: Column) -> Column:
        keys = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
        last = lambda k: F.element_at(F.filter(entries, lambda e: F.lower(e["key"]) == k), -1)["value"]
        return F.map_from_arrays(keys, F.transform(keys, lambda k: bind(last(k), lambda v: F.when(~v.isin("", "[]", "{}"), v))))

    return bind(F.map_entries(F.from_json(text, _OBJECT)), lookup)


def objects(texts: DataFrame, value: str = "value") -> DataFrame:
    """The rows of ``texts``, one per JSON object, with ``pos`` in its text and ``fields``."""
    text = strip(value)
    items = F.when(text.startswith("["), F.from_json(text, _LIST)).otherwise(F.array(text))
    rest = [c for c in texts.columns if c != value]
    each = texts.select(*rest, F.posexplode(items).alias("pos", "item")).filter(F.ltrim("item").startswith("{"))
    return each.select(*rest, "pos", fields(F.col("item")).alias("fields")).filter("fields is not null")


def pick(found: Column, names: tuple[str, ...]) -> Column:
    """The first value that says something under one of the names, as text (nested values as JSON)."""
    return F.coalesce(*(F.element_at(found, n) for n in dict.fromkeys(x.lower() for x in names)))


def as_list(value: Column) -> Column:
    """A JSON array's items, or the one value; empty for null."""
    items = F.when(value.startswith("["), F.filter(F.from_json(value, _LIST), lambda x: x.isNotNull())).when(value.isNotNull(), F.array(value))
    return F.coalesce(items, F.array().cast(_LIST))


def _flag(value: Column) -> Column:
    """Truth values as they are written in the source language of exports."""
    return F.when(value == "true", "True").when(value == "false", "False").otherwise(value)


def _entries(value: Column, names: dict[str, tuple[str, ...]], parts: tuple[str, ...], kind: str) -> Column:
    """Nested objects as structs of the given parts."""
    own = F.filter(as_list(value), lambda x: F.ltrim(x).startswith("{"))
    parsed = F.transform(own, lambda x: fields(x))
    return F.transform(parsed, lambda e: F.struct(*(_flag(pick(e, names[p])).alias(p) for p in parts))).cast(f"array<{kind}>")


_JOB, _STUDY = ("company", "title", "start", "end", "summary"), ("institution", "degree", "field", "end_year")


def _location(e: Column, names: dict, flat: bool) -> Column:
    loc = pick(e, names["location"])
    nested = fields(F.when(loc.startswith("{"), loc))
    if flat:
        parts = [F.when(loc.startswith("{"), pick(nested, names[p])).otherwise(pick(e, names[p])).alias(p) for p in ("city", "region", "country")]
    else:
        text = F.when(~loc.startswith("{") & ~loc.startswith("["), loc)
        parts = [F.coalesce(pick(nested, names[p]), text if p != "region" else F.lit(None)).alias(p) for p in ("city", "region", "country")]
    return F.struct(*parts)


def ats_records(texts: DataFrame, rec_seq: Column, value: str = "value") -> DataFrame:
    """Raw records of applicant-tracking exports; ``rec_seq`` may use ``pos``.  Objects without anything to go by are dropped."""
    e = F.col("fields")
    get = lambda k: pick(e, ATS[k])
    joined = F.nullif(F.concat_ws(" ", get("first_name"), get("last_name")), F.lit(""))
    years = get("years")
    rows = objects(texts, value).select(_record(
        "ats_json", rec_seq,
        full_name=_flag(F.coalesce(get("full_name"), joined)), emails=as_list(get("emails")), phones=as_list(get("phones")), headline=_flag(get("headline")),
        years_experience=F.when(years.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), strip(years).try_cast("double")),
        location=_location(e, ATS, True),
        links=F.struct(get("linkedin").alias("linkedin"), get("github").alias("github"), get("portfolio").alias("portfolio"), F.array().cast(_LIST).alias("other")),
        skills=F.filter(as_list(get("skills")), lambda x: strip(x) != ""),
        experience=_entries(get("experience"), ATS, _JOB, schemas.EXPERIENCE), education=_entries(get("education"), ATS, _STUDY, schemas.EDUCATION),
    )).select("r.*")
    return rows.filter(F.col("full_name").isNotNull() | (F.size("emails") > 0) | (F.size("phones") > 0) | (F.size("skills") > 0) | (F.size("experience") > 0))


def linkedin_records(texts: DataFrame, rec_seq: Column, value: str = "value") -> DataFrame:
    """Raw records of profile exports."""
    e = F.col("fields")
    get = lambda k: pick(e, LINKEDIN[k])
    skills = get("skills")
    url = canonical_url(get("url"))
    rows = objects(texts, value).select(_record(
        "linkedin", rec_seq,
        full_name=_flag(get("full_name")), headline=_flag(get("headline")), emails=F.when(get("emails").isNotNull(), F.array(get("emails"))),
        location=_location(e, LINKEDIN, False),
        links=F.struct(url.alias("linkedin"), F.lit(None).cast("string").alias("github"), F.lit(None).cast("string").alias("portfolio"), F.array().cast(_LIST).alias("other")),
        skills=F.when(skills.startswith("["), F.filter(as_list(skills), lambda x: strip(x) != "")),
        experience=_entries(get("experience"), LINKEDIN, _JOB, schemas.EXPERIENCE), education=_entries(get("education"), LINKEDIN, _STUDY, schemas.EDUCATION),
    )).select("r.*")
    return rows.filter(F.col("full_name").isNotNull() | (F.size("emails") > 0) | (F.size("skills") > 0) | (F.size("experience") > 0) | F.col("links.linkedin").isNotNull())


def _record(source: str, rec_seq: Column, **fields: Column) -> Column:
    return F.struct(*schemas.record(source, rec_seq, **fields)).alias("r")


def canonical_url(c: Column) -> Column:
    """The profile link in a value, in one spelling with the slug as it is; null if there is none."""
    slug = F.nullif(F.regexp_extract(c, PROFILE_URL, 1), F.lit(""))
    return F.concat(F.lit("https://linkedin.com/in/"), slug)


def url_records(urls: DataFrame, rec_seq: Column, value: str = "value") -> DataFrame:
    """Raw records that hold nothing but a profile link."""
    nothing = F.lit(None).cast("string")
    link = canonical_url(F.col(value))
    links = F.struct(link.alias("linkedin"), nothing.alias("github"), nothing.alias("portfolio"), F.array().cast(_LIST).alias("other"))
    return urls.filter(link.isNotNull()).select(*schemas.record("linkedin", rec_seq, links=links))
