"""Raw records from prose: resumes and recruiters' notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions import text as t
from kinweave.functions.contacts import extract_emails
from kinweave.functions.skills import scan_skills


def resume_records(texts: DataFrame, rec_seq: Column, value: str = "value", source: str = "resume") -> DataFrame:
    """Raw records of resumes; a text without name, contact, skill or job is dropped."""
    parts = texts.withColumn("_s", t.sections(value))
    rows = parts.select(*schemas.record(
        source, rec_seq, full_name=t.guess_name(value), emails=extract_emails(value), phones=t.extract_phones(value),
        skills=t.skills_block(F.col("_s.skills")), headline=t.summary_headline(F.col("_s.summary")),
        experience=t.experience_block(F.col("_s.experience")), education=t.education_block(F.col("_s.education")),
    ))
    return rows.filter(F.col("full_name").isNotNull() | (F.size("emails") > 0) | (F.size("phones") > 0) | (F.size("skills") > 0) | (F.size("experience") > 0))


def note_records(texts: DataFrame, rec_seq: Column, value: str = "value") -> DataFrame:
    """Raw records of notes; a text without name, contact or known skill is dropped."""
    rows = texts.select(*schemas.record(
        "recruiter_notes", rec_seq, full_name=t.labelled_name(value), emails=extract_emails(value), phones=t.extract_phones(value),
        skills=scan_skills(value), headline=t.note_headline(value),
    ))
    return rows.filter(F.col("full_name").isNotNull() | (F.size("emails") > 0) | (F.size("phones") > 0) | (F.size("skills") > 0))
