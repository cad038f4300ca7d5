"""Raw records from saved tables of public profiles and their repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schemas


def languages(repos: DataFrame) -> DataFrame:
    """(login, skills): the distinct languages of a login's repositories, in their order (``repo_rank``)."""
    first = repos.filter("language is not null and language != ''").groupBy("login", "language").agg(F.min("repo_rank").alias("r"))
    return first.groupBy("login").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "language"))), lambda x: x["language"]).alias("skills"))


def profile_records(users: DataFrame, repos: DataFrame, rec_seq: Column) -> DataFrame:
    """Raw records of ``users`` (login, name, email, bio, location, html_url, blog)."""
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    blog = F.nullif(F.btrim(F.col("blog")), F.lit(""))
    links = F.struct(
        F.lit(None).cast("string").alias("linkedin"), said("html_url").alias("github"),
        F.when(blog.startswith("http"), blog).otherwise(F.concat(F.lit("https://"), blog)).alias("portfolio"), F.array().cast("array<string>").alias("other"),
    )
    email = said("email")
    place = F.struct(said("location").alias("city"), F.lit(None).cast("string").alias("region"), said("location").alias("country"))
    return users.join(languages(repos), "login", "left").select(*schemas.record(
        "github", rec_seq, full_name=said("name"), emails=F.when(email.isNotNull(), F.array(email)), headline=said("bio"),
        location=place, links=links, skills=F.col("skills"),
    ))
