"""Schemas of records and profiles, and the trust in sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION = "struct<city:string,region:string,country:string>"
LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
EXPERIENCE = "struct<company:string,title:string,start:string,end:string,summary:string>"
EDUCATION = "struct<institution:string,degree:string,field:string,end_year:string>"
SKILL = "struct<name:string,confidence:double,sources:array<string>>"
PROVENANCE = "struct<field:string,source:string,method:string>"

#: One person as one source saw them.  ``rec_seq`` is the record's place in the input order.
RAW: dict[str, str] = {
    "rec_seq": "bigint",
    "source": "string",
    "full_name": "string",
    "emails": "array<string>",
    "phones": "array<string>",
    "location": LOCATION,
    "links": LINKS,
    "headline": "string",
    "years_experience": "double",
    "skills": "array<string>",
    "experience": f"array<{EXPERIENCE}>",
    "education": f"array<{EDUCATION}>",
}
RAW_SCHEMA = ", ".join(f"{k} {v}" for k, v in RAW.items())

# Trust in a source; any other source has DEFAULT_TRUST.
TRUST: dict[str, float] = {
    "ats_json": 0.95,
    "recruiter_csv": 0.90,
    "linkedin": 0.75,
    "resume": 0.70,
    "recruiter_notes": 0.60,
    "github": 0.55,
}
DEFAULT_TRUST = 0.40


def trust(source: str | Column, table: dict[str, float] | None = None) -> Column:
    """The trust in a source."""
    source = F.col(source) if isinstance(source, str) else source
    known = F.create_map(*(F.lit(x) for kv in (table or TRUST).items() for x in kv))
    return F.coalesce(F.element_at(known, source), F.lit(DEFAULT_TRUST))


def record(source: str, rec_seq: Column, **fields: Column) -> list[Column]:
    """The columns of RAW from the given fields; what isn't given is null or an empty array."""
    given = {"rec_seq": rec_seq, "source": F.lit(source), **fields}
    out = []
    for name, kind in RAW.items():
        value = given.get(name, F.lit(None)).cast(kind)
        out.append((F.coalesce(value, F.array().cast(kind)) if kind.startswith("array") else value).alias(name))
    return out
