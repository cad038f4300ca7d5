"""Normalization of whole records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.contacts import normalize_emails, normalize_phones
from kinweave.functions.countries import normalize_country
from kinweave.functions.dates import to_year, to_year_month
from kinweave.functions.skills import canonical_skills
from kinweave.functions.text import clean, clean_name


def normalize_records(raw: DataFrame, region: str = "US") -> DataFrame:
    """Records with canonical values; one ``select``, no shuffle.

    Lists are never null.  A city that is the record's country is blanked, and
    so are links that are empty.
    """
    spark = raw.sparkSession
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(raw.schema[c].dataType))
    country = normalize_country("location.country", spark)
    place = normalize_country("location.city", spark)
    link = lambda k: F.nullif(F.col(f"links.{k}"), F.lit("")).alias(k)
    other = F.filter(F.coalesce(F.col("links.other"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    placed = raw.withColumn("_country", country).withColumn("_place", place)
    return placed.select(
        "rec_seq", "source",
        clean_name("full_name").alias("full_name"),
        normalize_emails(empty("emails")).alias("emails"),
        normalize_phones(empty("phones"), region).alias("phones"),
        F.struct(
            F.when(F.col("_place").isNull() | F.col("_country").isNull() | (F.col("_place") != F.col("_country")), clean("location.city")).alias("city"),
            clean("location.region").alias("region"),
            F.col("_country").alias("country"),
        ).alias("location"),
        F.struct(link("linkedin"), link("github"), link("portfolio"), other.alias("other")).alias("links"),
        clean("headline").alias("headline"),
        "years_experience",
        canonical_skills(empty("skills")).alias("skills"),
        F.transform(empty("experience"), lambda e: F.struct(
            clean(e["company"]).alias("company"), clean(e["title"]).alias("title"),
            to_year_month(e["start"]).alias("start"), to_year_month(e["end"]).alias("end"), clean(e["summary"]).alias("summary"),
        )).alias("experience"),
        F.transform(empty("education"), lambda e: F.struct(
            clean(e["institution"]).alias("institution"), clean(e["degree"]).alias("degree"),
            clean(e["field"]).alias("field"), to_year(e["end_year"]).alias("end_year"),
        )).alias("education"),
    )
