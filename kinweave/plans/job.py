"""The whole job: sources to profiles, report and violations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.operators.merge import merge_records, ordered
from kinweave.operators.normalize import normalize_records
from kinweave.operators.projection import project, strict, violations
from kinweave.plans.lineage import cut
from kinweave.sources.files import load


def build_profiles(raw: DataFrame, region: str = "US", trust: dict[str, float] | None = None) -> DataFrame:
    """Profiles of raw records."""
    return merge_records(normalize_records(raw, region), trust)


def run_job(spark: SparkSession, config: dict | None = None, fail_on_violation: bool = False, **sources) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projected profiles in order, source report, violations) of files; see ``load`` for the sources."""
    raw, report = load(spark, **sources)
    found = cut(build_profiles(raw))  # shown, and checked for violations
    wrong = violations(found, config or {})
    if fail_on_violation:
        strict(wrong)
    return project(ordered(found), config or {}), report, wrong


def write_profiles(shown: DataFrame, path: str, form: str = "json") -> None:
    """Profiles as JSON Lines (nulls kept, UTF-8) or Parquet."""
    if form == "json":
        shown.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)
    else:
        shown.write.mode("errorifexists").parquet(path)
