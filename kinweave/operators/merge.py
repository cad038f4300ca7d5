"""Merging of linked records into one profile per cluster.

``records`` here are normalized records with ``cluster_id`` and ``trust``.
Every aggregate is in long form: values are counted by key first, and only
distinct values are collected per cluster.  There is one function per field, and
``merged_fields``, which merges all fields at once: every record becomes facts
(field, key, value), which are added up by (cluster, field, key), before the
shuffle and after it, so that the records of a very large cluster are dealt by
what they say; a second exchange brings the distinct facts of a cluster
together.  Only jobs and studies have aggregates of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.functions.skills import is_known
from kinweave.operators.resolve import clusters
from kinweave.operators.scoring import WEIGHTS, completeness, field_confidence, mean3, overall_confidence, round3
from kinweave.operators.positions import with_positions
from kinweave.plans.lineage import cut

PROFILE = [
    "cluster_id", "candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience",
    "skills", "experience", "education", "provenance", "overall_confidence",
]


def _best(trust: Column | str = "trust") -> Column:
    """Sort value of the most trusted record, the earliest of equals."""
    return F.struct(F.col(trust) if isinstance(trust, str) else trust, -F.col("rec_seq"))


def _in_order(items: Column, field: str) -> Column:
    return F.transform(F.sort_array(items), lambda x: x[field])


def contributors(records: DataFrame, present: Column) -> DataFrame:
    """(cluster_id, n_sources, top): how many records have a field, and the most trusted one's source."""
    return records.filter(present).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_sources"), F.max_by("source", _best()).alias("top"))


def union_values(records: DataFrame, field: str) -> DataFrame:
    """(cluster_id, field): the distinct values of a list field in record order."""
    long = records.select("cluster_id", "rec_seq", F.posexplode(field).alias("pos", "value"))
    first = long.groupBy("cluster_id", "value").agg(F.min(F.struct("rec_seq", "pos")).alias("o"))
    return first.groupBy("cluster_id").agg(_in_order(F.collect_list(F.struct("o", "value")), "value").alias(field))


def pick_scalar(records: DataFrame, field: str) -> DataFrame:
    """(cluster_id, value, top, n_agree, n_conflict): the winner of a vote.

    Values are equal whatever their case.  The winner has the most trusted
    source, then the most records, then the longest and last value as first
    spelled.
    """
    value = F.col(field).cast("string")
    votes = records.filter(value.isNotNull() & (value != "")).groupBy("cluster_id", F.lower(value).alias("key")).agg(
        F.max("trust").alias("t"), F.count(F.lit(1)).alias("n"), F.min_by(value, "rec_seq").alias("value"), F.max_by("source", _best()).alias("top"),
    )
    rank = F.struct("t", "n", F.length("value"), "value")
    won = votes.groupBy("cluster_id").agg(F.max_by(F.struct("value", "top", F.col("n").alias("n_agree")), rank).alias("w"), (F.count(F.lit(1)) - 1).alias("n_conflict"))
    return won.select("cluster_id", "w.*", "n_conflict")


def pick_location(records: DataFrame) -> DataFrame:
    """(cluster_id, location, top, filled): the location of most trust plus a tenth per part; the earliest of equals."""
    filled = sum((F.col(f"location.{p}").isNotNull().cast("int") for p in ("city", "region", "country")), F.lit(0))
    scored = records.withColumn("filled", filled).filter("filled > 0").withColumn("score", F.col("trust") + F.lit(0.1) * F.col("filled"))
    won = scored.groupBy("cluster_id").agg(F.max_by(F.struct("location", F.col("source").alias("top"), "filled"), _best("score")).alias("w"))
    return won.select("cluster_id", "w.*")


def merge_links(records: DataFrame) -> DataFrame:
    """(cluster_id, links, n_links, top): the first link of each kind and all others, with the sources that gave them."""
    kinds = ("linkedin", "github", "portfolio")
    named = [F.struct(F.lit(k).alias("kind"), F.lit(n).alias("pos"), F.col(f"links.{k}").alias("url")) for n, k in enumerate(kinds)]
    other = F.transform("links.other", lambda x, i: F.struct(F.lit("other").alias("kind"), (i + len(kinds)).alias("pos"), x.alias("url")))
    long = records.select("cluster_id", "rec_seq", "source", "trust", F.explode(F.concat(F.array(*named), other)).alias("x")).select("cluster_id", "rec_seq", "source", "trust", "x.*").filter("url is not null")
    key = F.when(F.col("kind") == "other", F.col("url")).otherwise("")
    first = long.groupBy("cluster_id", "kind", key.alias("key")).agg(
        F.min_by(F.struct("url", "source", "trust", "rec_seq", "pos"), F.struct("rec_seq", "pos")).alias("f"),
    ).select("cluster_id", "kind", "f.*")
    one = lambda k: F.max(F.when(F.col("kind") == k, F.col("url"))).alias(k)
    merged = first.groupBy("cluster_id").agg(
        *(one(k) for k in kinds),
        _in_order(F.collect_list(F.when(F.col("kind") == "other", F.struct("rec_seq", "pos", "url"))), "url").alias("other"),
        F.count(F.lit(1)).alias("n_links"), F.max_by("source", _best()).alias("top"),
    )
    return merged.select("cluster_id", F.struct(*kinds, "other").alias("links"), "n_links", "top")


def merge_skills(records: DataFrame) -> DataFrame:
    """(cluster_id, skills, top, n_sources): each skill once, with sources by trust and a confidence.

    A skill that is not in the table has 0.8 of its confidence.
    """
    long = records.select("cluster_id", "rec_seq", "source", "trust", F.posexplode("skills").alias("pos", "name"))
    per_source = long.groupBy("cluster_id", F.lower("name").alias("key"), "source").agg(
        F.first("trust").alias("trust"), F.min(F.struct("rec_seq", "pos")).alias("o"), F.min_by("name", F.struct("rec_seq", "pos")).alias("name"), F.max(is_known("name")).alias("known"),
    )
    each = per_source.groupBy("cluster_id", "key").agg(
        F.min_by("name", "o").alias("name"), F.max("known").alias("known"), F.max("trust").alias("t"), F.count(F.lit(1)).alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("trust")).alias("t"), "source"))), lambda x: x["source"]).alias("sources"),
    )
    base = field_confidence(F.col("t"), F.col("n"))
    each = each.withColumn("confidence", F.when(F.col("known"), base).otherwise(round3(base * F.lit(0.8))))
    sources = per_source.groupBy("cluster_id").agg(F.count_distinct("source").alias("n_sources"), F.min_by("source", F.struct(-F.col("trust"), F.col("source"))).alias("top"))
    entry = F.struct((-F.col("confidence")).alias("c"), F.lower("name").alias("l"), F.struct("name", "confidence", "sources").alias("skill"))
    listed = each.groupBy("cluster_id").agg(_in_order(F.collect_list(entry), "skill").alias("skills"))
    return listed.join(sources, "cluster_id")


def dedupe_entries(records: DataFrame, field: str, keys: tuple[Column, Column], parts: tuple[str, ...]) -> DataFrame:
    """(cluster_id, field): entries with equal keys as one, each part from the first that has it, in order."""
    long = records.select("cluster_id", "rec_seq", F.posexplode(field).alias("pos", "e")).select("cluster_id", F.struct("rec_seq", "pos").alias("o"), "e.*")
    filled = long.filter(F.coalesce(*(F.nullif(F.col(p), F.lit("")) for p in parts)).isNotNull())
    each = filled.groupBy("cluster_id", keys[0].alias("k1"), keys[1].alias("k2")).agg(
        F.min("o").alias("o"), *(F.min_by(p, F.when(F.coalesce(F.col(p), F.lit("")) != "", F.col("o"))).alias(p) for p in parts),
    )
    return each.groupBy("cluster_id").agg(_in_order(F.collect_list(F.struct("o", F.struct(*parts).alias("e"))), "e").alias(field))


def dedupe_experience(records: DataFrame) -> DataFrame:
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return dedupe_entries(records, "experience", (low("company"), low("title")), ("company", "title", "start", "end", "summary"))


def dedupe_education(records: DataFrame) -> DataFrame:
    return dedupe_entries(records, "education", (F.lower(F.coalesce("institution", F.lit(""))), F.coalesce("end_year", F.lit(""))), ("institution", "degree", "field", "end_year"))


def candidate_id(emails: Column, phones: Column, name: Column) -> Column:
    """``cand_`` and twelve hex digits of the SHA-1 of the least email, else the least phone, else the name."""
    seed = F.coalesce(
        F.concat(F.lit("email:"), F.array_min(emails)), F.concat(F.lit("phone:"), F.array_min(phones)),
        F.concat(F.lit("name:"), F.nullif(F.lower(F.btrim(name)), F.lit(""))), F.lit("anon:"),
    )
    return F.concat(F.lit("cand_"), F.substring(F.sha1(seed), 1, 12))


def attach_clusters(records: DataFrame, found: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """Normalized records with cluster_id and trust, cut from their lineage, as several aggregates read them."""
    return cut(records.join(found, "rec_seq").withColumn("trust", schemas.trust("source", trust)))


SCALARS = ("full_name", "headline", "years_experience")
SEEN = ("emails", "phones", "experience", "education")
LINK_KINDS = ("linkedin", "github", "portfolio")


def facts(records: DataFrame) -> DataFrame:
    """(cluster_id, rec_seq, source, trust, f, key, value, pos, place): what each record says, a row per value.

    ``f`` is the field; what counts as one value has one ``key``.  For SEEN
    there is also a row per record that has the field, and each record has one
    of the field ``self``.
    """
    nothing, nowhere = F.lit(None).cast("string"), F.lit(None).cast(schemas.LOCATION)
    fact = lambda f, key, value, pos, place=nowhere: F.struct(F.lit(f).alias("f"), key.alias("key"), value.alias("value"), pos.cast("int").alias("pos"), place.alias("place"))
    blank, zero = F.lit(""), F.lit(0)
    said = [F.array(fact("self", blank, nothing, zero))]
    each = lambda f: F.transform(f, lambda x, i: fact(f, x, x, i))
    said += [each("emails"), each("phones")]
    said.append(F.transform("skills", lambda x, i: fact("skills", F.lower(x), x, i)))
    texts = [F.col(f).cast("string") for f in SCALARS]
    said.append(F.array_compact(F.array(*(F.when(v.isNotNull() & (v != ""), fact(f, F.lower(v), v, zero)) for f, v in zip(SCALARS, texts, strict=True)))))
    links = [F.col(f"links.{k}") for k in LINK_KINDS]
    said.append(F.array_compact(F.array(*(F.when(u.isNotNull(), fact(f"links.{k}", blank, u, F.lit(n))) for n, (k, u) in enumerate(zip(LINK_KINDS, links, strict=True))))))
    said.append(F.transform(F.filter("links.other", lambda x: x.isNotNull()), lambda x, i: fact("links.other", x, x, i + len(LINK_KINDS))))
    there = [F.col(f"location.{p}").isNotNull() for p in ("city", "region", "country")]
    said.append(F.array_compact(F.array(F.when(there[0] | there[1] | there[2], fact("location", blank, nothing, zero, F.col("location").cast(schemas.LOCATION))))))
    said.append(F.array_compact(F.array(*(F.when(F.size(f) > 0, fact(f"seen.{f}", blank, nothing, zero)) for f in SEEN))))
    kind = f"array<struct<f:string,key:string,value:string,pos:int,place:{schemas.LOCATION}>>"
    every = F.concat(*(F.coalesce(x, F.array().cast(kind)).cast(kind) for x in said))
    return records.select("cluster_id", "rec_seq", "source", "trust", F.explode(every).alias("x")).select("cluster_id", "rec_seq", "source", "trust", "x.*")


def _filled() -> Column:
    return sum((F.col(f"place.{p}").isNotNull().cast("int") for p in ("city", "region", "country")), F.lit(0))


def merged_fields(records: DataFrame) -> DataFrame:
    """One row per cluster with every merged field, its best source and counts (columns ``<field>_top``, ``_n``, ``_conflict``)."""
    distinct = facts(records).groupBy("cluster_id", "f", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("trust").alias("t"), F.max(F.struct("trust", (-F.col("rec_seq")).alias("r"), "source")).alias("best"),
        F.min(F.struct("rec_seq", "pos", "value", "source", "trust")).alias("o"), F.collect_set(F.struct((-F.col("trust")).alias("t"), "source")).alias("sources"),
        F.max(F.when(F.col("f") == "location", F.struct((F.col("trust") + F.lit(0.1) * _filled()).alias("score"), (-F.col("rec_seq")).alias("r"), "source", _filled().alias("filled"), "place"))).alias("at"),
    )
    of = lambda *fields: F.col("f").isin(*fields)
    value = F.col("o.value")
    first = F.struct(F.col("o.rec_seq").alias("rec_seq"), F.col("o.pos").alias("pos"), value.alias("value"))
    listed = lambda f: F.transform(F.sort_array(F.collect_list(F.when(of(f), first))), lambda x: x["value"])
    base = field_confidence(F.col("t"), F.size("sources"))
    sure = F.when(is_known("key"), base).otherwise(round3(base * F.lit(0.8)))
    sources = F.transform(F.sort_array("sources"), lambda x: x["source"])
    skill = F.struct((-sure).alias("c"), F.lower(value).alias("l"), F.struct(value.alias("name"), sure.alias("confidence"), sources.alias("sources")).alias("skill"))
    links = of(*(f"links.{k}" for k in LINK_KINDS), "links.other")
    columns = [listed("emails").alias("emails"), listed("phones").alias("phones"), listed("links.other").alias("other")]
    for f in SCALARS:
        columns.append(F.max(F.when(of(f), F.struct("t", "n", F.length(value).alias("l"), value.alias("value"), F.col("best.source").alias("top")))).alias(f))
        columns.append((F.count(F.when(of(f), 1)) - 1).alias(f"{f}_conflict"))
    for f in SEEN:
        columns += [F.max(F.when(of(f"seen.{f}"), F.col("best.source"))).alias(f"{f}_top"), F.max(F.when(of(f"seen.{f}"), F.col("n"))).alias(f"{f}_n")]
    columns += [F.max(F.when(of(f"links.{k}"), value)).alias(f"link_{k}") for k in LINK_KINDS]
    columns += [
        F.count(F.when(links, 1)).alias("links_n"), F.max(F.when(links, F.struct(F.col("o.trust").alias("t"), (-F.col("o.rec_seq")).alias("r"), F.col("o.source").alias("source")))).alias("link_best"),
        F.max("at").alias("at"), F.transform(F.sort_array(F.collect_list(F.when(of("skills"), skill))), lambda x: x["skill"]).alias("skills"),
        F.array_distinct(F.flatten(F.collect_list(F.when(of("skills"), F.col("sources"))))).alias("skill_sources"),
    ]
    many = distinct.groupBy("cluster_id").agg(*columns)
    some = lambda f: F.when(F.size(f) > 0, F.col(f)).alias(f)
    merged = many.select(
        "cluster_id", some("emails"), "emails_top", "emails_n", some("phones"), "phones_top", "phones_n",
        *(c for f in SCALARS for c in (F.col(f)["value"].alias(f), F.col(f)["top"].alias(f"{f}_top"), F.col(f)["n"].alias(f"{f}_n"), F.when(F.col(f).isNotNull(), F.col(f"{f}_conflict")).alias(f"{f}_conflict"))),
        F.col("at.place").alias("location"), F.col("at.source").alias("location_top"), F.col("at.filled").alias("location_n"),
        F.when(F.col("links_n") > 0, F.struct(*(F.col(f"link_{k}").alias(k) for k in LINK_KINDS), "other")).alias("links"), F.col("link_best.source").alias("links_top"), F.when(F.col("links_n") > 0, F.col("links_n")).alias("links_n"),
        some("skills"), F.array_min("skill_sources")["source"].alias("skills_top"), F.when(F.size("skill_sources") > 0, F.size("skill_sources").cast("long")).alias("skills_n"),
        "experience_top", "experience_n", "education_top", "education_n",
    )
    return merged.join(dedupe_experience(records), "cluster_id", "left").join(dedupe_education(records), "cluster_id", "left")


def field_confidences(merged: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """``merged_fields`` with ``confidence``, a struct of one number per field; null where the field is empty."""
    t = lambda f: schemas.trust(f"{f}_top", trust)
    n = lambda f: F.col(f"{f}_n")
    plain = {f: field_confidence(t(f), n(f)) for f in ("emails", "phones", "links", "experience", "education")}
    voted = {f: field_confidence(t(f), n(f), F.col(f"{f}_conflict")) for f in ("full_name", "headline", "years_experience")}
    place = field_confidence(t("location"), F.lit(1), 0, completeness(n("location"), 3))
    skills = mean3(F.transform("skills", lambda s: s["confidence"]))
    each = {**plain, **voted, "location": place, "skills": skills}
    return merged.withColumn("confidence", F.struct(*(F.when(F.col(f"{f}_top").isNotNull(), each[f]).alias(f) for f in WEIGHTS)))


def provenance() -> Column:
    """Which source gave each field that is there, and how, in the order of fields."""
    many = lambda f, yes, no: F.when(F.col(f"{f}_n") > 1, F.lit(yes)).otherwise(F.lit(no))
    method = {
        "emails": many("emails", "merged", "normalized"), "phones": F.lit("normalized"), "full_name": many("full_name", "merged", "direct"),
        "headline": F.lit("direct"), "years_experience": F.lit("direct"), "location": F.lit("normalized"), "links": many("links", "merged", "direct"),
        "skills": many("skills", "merged", "normalized"), "experience": many("experience", "merged", "direct"), "education": many("education", "merged", "direct"),
    }
    entry = lambda f: F.when(F.col(f"{f}_top").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"{f}_top").alias("source"), method[f].alias("method")))
    return F.array_compact(F.array(*(entry(f) for f in WEIGHTS)))


def profiles(records: DataFrame, trust: dict[str, float] | None = None) -> DataFrame:
    """One profile per cluster that has a name, an email or a phone, unordered, with the columns PROFILE."""
    scored = field_confidences(merged_fields(records), trust)
    listed = lambda f: F.coalesce(F.col(f), F.array().cast(scored.schema[f].dataType)).alias(f)
    nothing = F.lit(None).cast("string")
    out = scored.select(
        "cluster_id", candidate_id(F.col("emails"), F.col("phones"), F.col("full_name")).alias("candidate_id"),
        F.coalesce("full_name", F.lit("")).alias("full_name"), listed("emails"), listed("phones"),
        F.coalesce("location", F.struct(nothing.alias("city"), nothing.alias("region"), nothing.alias("country"))).alias("location"),
        F.coalesce("links", F.struct(nothing.alias("linkedin"), nothing.alias("github"), nothing.alias("portfolio"), F.array().cast("array<string>").alias("other"))).alias("links"),
        "headline", F.col("years_experience").cast("double").alias("years_experience"),
        listed("skills"), listed("experience"), listed("education"), provenance().alias("provenance"),
        overall_confidence({f: F.col("confidence")[f] for f in WEIGHTS}).alias("overall_confidence"),
    )
    return out.filter((F.col("full_name") != "") | (F.size("emails") > 0) | (F.size("phones") > 0)).select(*PROFILE)


def merge_records(normalized: DataFrame, trust: dict[str, float] | None = None, max_fanout: int | None = None) -> DataFrame:
    """Normalized records linked, merged and scored: one profile per person."""
    normalized = cut(normalized)
    return profiles(attach_clusters(normalized, clusters(normalized, max_fanout), trust), trust)


def ordered(found: DataFrame) -> DataFrame:
    """Profiles in their order for output."""
    return found.orderBy("candidate_id", "cluster_id")


def positioned(found: DataFrame) -> DataFrame:
    """Profiles with ``position``, their place in the order for output, from 0."""
    return with_positions(found, ["candidate_id", "cluster_id"])
