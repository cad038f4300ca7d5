"""Raw records from recruiters' tables whose headers go by many names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.text import BLANK, clean

# The names of each field.
HEADERS: dict[str, tuple[str, ...]] = {
    "full_name": ("name", "full name", "full_name", "candidate", "candidate name"),
    "email": ("email", "e-mail", "email address", "emails"),
    "phone": ("phone", "phone number", "mobile", "contact", "phones"),
    "company": ("current_company", "current company", "company", "employer"),
    "title": ("title", "current title", "role", "position", "job title"),
    "location": ("location", "city", "address"),
}


def resolve_headers(columns: list[str]) -> dict[str, str]:
    """The column of each field: the first, in the table's order, that has one of the field's names."""
    out: dict[str, str] = {}
    for actual in columns:
        key = (actual or "").strip(BLANK + "﻿").lower()
        for field, names in HEADERS.items():
            if key in names:
                out.setdefault(field, actual)
    return out


def header_places(header: Column) -> Column:
    """A struct of where each field stands in a header: as ``resolve_headers``, and of columns of equal names the last; null where no column has a name of the field."""
    key = lambda h: F.lower(F.btrim(h, F.lit(BLANK + "﻿")))

    def place(names: tuple[str, ...]) -> Column:
        first = F.get(F.filter(header, lambda h: key(h).isin(*names)), F.lit(0))
        return F.when(first.isNotNull(), F.size(header) - F.array_position(F.reverse(header), first)).cast("int")

    return F.struct(*(place(names).alias(f) for f, names in HEADERS.items()))


def _records(rows: DataFrame, get: dict[str, Column], rec_seq: Column) -> DataFrame:
    entry = F.struct(get["company"].alias("company"), get["title"].alias("title"), *(F.lit(None).cast("string").alias(k) for k in ("start", "end", "summary")))
    place = F.struct(get["location"].alias("city"), F.lit(None).cast("string").alias("region"), get["location"].alias("country"))
    some = reduce(lambda a, b: a | b, (get[f].isNotNull() for f in HEADERS if f != "location"))
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    return rows.filter(some).select(*schemas.record(
        "recruiter_csv", rec_seq, full_name=get["full_name"], emails=one(get["email"]), phones=one(get["phone"]), headline=get["title"],
        location=place, experience=F.when(get["company"].isNotNull() | get["title"].isNotNull(), F.array(entry)),
    ))


def csv_records(rows: DataFrame, rec_seq: Column) -> DataFrame:
    """Raw records of a table of texts; unknown columns are ignored, rows with nothing but a location dropped."""
    found = resolve_headers(rows.columns)
    get = {f: clean(F.col(f"`{found[f]}`")) if f in found else F.lit(None).cast("string") for f in HEADERS}
    return _records(rows, get, rec_seq)


def csv_field_records(rows: DataFrame, rec_seq: Column) -> DataFrame:
    """The same for rows of ``fields``, the values of a CSV record, and ``places`` (see ``header_places``); rows of many headers may be mixed."""
    return _records(rows, {f: clean(F.get("fields", F.col("places")[f])) for f in HEADERS}, rec_seq)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The rows of CSV files with one header, all texts: quoted newlines, ragged rows and a byte-order mark are read through."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, mode="PERMISSIVE")
