"""Linking of records that share an identifier, transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.functions.text import norm_url
from kinweave.operators.components import HUB, MOST_HUBS, connected_components
from kinweave.plans.lineage import cut


def match_keys(records: DataFrame) -> DataFrame:
    """(rec_seq, key): the strong keys of normalized records - emails, phones, and profile links in one namespace."""
    urls = F.array_compact(F.array(norm_url("links.github"), norm_url("links.linkedin")))
    prefixed = lambda p, c: F.transform(c, lambda x: F.concat(F.lit(f"{p}:"), x))
    keys = F.array_distinct(F.concat(prefixed("email", F.col("emails")), prefixed("phone", F.col("phones")), prefixed("url", urls)))
    return records.select("rec_seq", F.explode(keys).alias("key"))


def weak_keys(records: DataFrame) -> DataFrame:
    """(rec_seq, key): name and first company, only for records without a strong key."""
    bare = (F.size("emails") == 0) & (F.size("phones") == 0) & F.col("links.github").isNull() & F.col("links.linkedin").isNull()
    company = F.coalesce(F.lower(F.get("experience", F.lit(0))["company"]), F.lit(""))
    return records.filter(bare & F.col("full_name").isNotNull()).select("rec_seq", F.concat(F.lit("name:"), F.lower("full_name"), F.lit("|"), company).alias("key"))


def owner_edges(keys: DataFrame, max_fanout: int | None = None, hub: int = HUB, most_hubs: int = MOST_HUBS) -> DataFrame:
    """(rec_seq, owner): every record of a key linked to the key's first record.

    The edges of a key are as many as its records.  Keys of one record go
    before the join; ``max_fanout`` leaves out keys of more records than that
    (see ``excluded_keys``), by default none.

    A number that very many records share would be one key of the join.  Keys
    of more than ``hub`` records that hold more than one in ``most_hubs`` of all
    are joined by broadcast instead: they are fewer than ``most_hubs``.
    """
    owners = keys.groupBy("key").agg(F.min("rec_seq").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    if max_fanout is not None:
        owners = owners.filter(F.col("n") <= max_fanout)
    owners = cut(owners)
    size = owners.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    bound = max(hub, (size["rows"] or 0) // most_hubs)
    if (size["most"] or 0) <= bound:
        met = keys.join(owners, "key")
    else:
        hubs = owners.filter(F.col("n") > bound)
        rest = keys.join(F.broadcast(hubs.select("key")), "key", "left_anti").join(owners.filter(F.col("n") <= bound), "key")
        met = keys.join(F.broadcast(hubs), "key").unionByName(rest)
    return met.filter(F.col("rec_seq") != F.col("owner")).select("rec_seq", "owner").distinct()


def excluded_keys(keys: DataFrame, max_fanout: int) -> DataFrame:
    """(key, n_records) of the keys that ``max_fanout`` leaves out."""
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("n_records")).filter(F.col("n_records") > max_fanout)


def clusters(records: DataFrame, max_fanout: int | None = None) -> DataFrame:
    """(rec_seq, cluster_id): the least record reachable over shared keys; a record that shares none is its own."""
    keys = match_keys(records).union(weak_keys(records))
    found = connected_components(owner_edges(keys, max_fanout))
    return (
        records.select("rec_seq").join(found, F.col("rec_seq") == F.col("vertex"), "left")
        .select("rec_seq", F.coalesce("component", "rec_seq").alias("cluster_id"))
    )
