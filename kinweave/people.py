"""People records derived from the order tables, for queries and their checks.

The SQL is read alike by Spark and DuckDB: one flat row per record, of several
sources that spell, omit and contradict each other's values.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave import schemas
from kinweave.plans.tables import table

COLUMNS = (
    "rec_seq", "source", "full_name", "email", "phone", "city", "country", "linkedin", "github", "portfolio", "headline",
    "years", "skill1", "skill2", "skill3", "company", "title", "started", "ended", "institution", "degree", "field", "end_year",
)

_PLACE = """CASE n_nationkey WHEN 0 THEN 'United States' WHEN 1 THEN 'uk' WHEN 2 THEN 'DEU' WHEN 3 THEN 'India' WHEN 4 THEN 'fr'
  WHEN 5 THEN 'Bengaluru' ELSE n_name END"""


def _select(values: dict[str, str], rest: str) -> str:
    return "SELECT " + ", ".join(f"{values.get(c, 'CAST(NULL AS DOUBLE)' if c == 'years' else 'CAST(NULL AS STRING)')} AS {c}" for c in COLUMNS) + " " + rest


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


_K = _s("c_custkey")
_MAIL = f"'c' || {_K} || '@mail' || {_s('c_custkey % 7')} || '.example.com'"

PARTS = {
    "recruiter_csv": _select({
        "rec_seq": "1000000000 + c_custkey", "source": "'recruiter_csv'",
        "full_name": "CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '  ' || upper(c_name) ELSE c_name END",
        "email": f"CASE WHEN c_custkey % 97 = 0 THEN 'broken@' ELSE ' C' || {_K} || '@Mail' || {_s('c_custkey % 7')} || '.Example.com' END",
        "phone": f"CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 50 = 49 THEN '(212) 555-0199' WHEN c_custkey % 4 = 0 THEN '(415) 555-' || lpad({_s('c_custkey % 10000')}, 4, '0') WHEN c_custkey % 9 = 1 THEN '555-0100' ELSE NULL END",
        "city": f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE {_PLACE} END", "country": f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE {_PLACE} END",
        "headline": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_mktsegment END",
        "company": f"CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE 'Company ' || {_s('c_custkey % 50')} END",
        "title": "CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_mktsegment END",
    }, "FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "ats_json": _select({
        "rec_seq": "2000000000 + c_custkey", "source": "'ats_json'",
        "full_name": f"CASE WHEN c_custkey % 6 = 0 THEN c_name ELSE 'Cust   ' || {_K} END",
        "email": f"CASE WHEN c_custkey % 2 = 0 THEN {_MAIL} ELSE 'ats' || {_K} || '@example.org' END",
        "phone": f"CASE WHEN c_custkey % 16 = 0 THEN '+1-415-555-' || lpad({_s('(c_custkey + 4) % 10000')}, 4, '0') ELSE NULL END",
        "country": "CASE WHEN c_custkey % 2 = 0 THEN 'Germany' ELSE NULL END",
        "linkedin": f"CASE WHEN c_custkey % 10 = 0 THEN 'http://linkedin.com/in/c' || {_K} || '/' ELSE NULL END",
        "headline": "'Engineer'", "years": "CAST(n_orders AS DOUBLE) / 2",
        "skill1": "'py'", "skill2": "'React.js'", "skill3": "CASE WHEN c_custkey % 3 = 0 THEN 'COBOL' ELSE 'k8s' END",
        "company": f"'COMPANY ' || {_s('c_custkey % 50')}", "title": "lower(c_mktsegment)",
        "started": "first_day", "ended": "CASE WHEN c_custkey % 4 = 0 THEN 'present' ELSE last_day END",
        "institution": f"'University ' || {_s('c_custkey % 7')}", "degree": "'BSc'", "end_year": f"'class of ' || {_s('2000 + c_custkey % 20')}",
    }, """FROM customer JOIN (
      SELECT o_custkey, count(*) AS n_orders, CAST(CAST(min(o_orderdate) AS DATE) AS STRING) AS first_day, CAST(CAST(max(o_orderdate) AS DATE) AS STRING) AS last_day
      FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey WHERE c_custkey % 3 <> 1"""),
    "linkedin": _select({
        "rec_seq": "3000000000 + c_custkey", "source": "'linkedin'", "linkedin": f"'https://www.linkedin.com/in/C' || {_K}",
        "institution": f"'university ' || {_s('c_custkey % 7')}", "field": "'Physics'", "end_year": _s("2000 + c_custkey % 20"),
    }, "FROM customer WHERE c_custkey % 5 = 0"),
    "github": _select({
        "rec_seq": "4000000000 + c_custkey", "source": "'github'", "full_name": f"'C. ' || {_K}", "email": _MAIL,
        "city": "'Paris'", "country": "'France'", "github": f"'https://github.com/C' || {_K} || '/'", "portfolio": f"'https://c' || {_K} || '.dev'",
        "headline": "'Builds things'", "skill1": "'Go'", "skill2": "'golang'", "skill3": "'Rust'",
    }, "FROM customer WHERE c_custkey % 7 = 0"),
    "names": _select({
        "rec_seq": "5000000000 + s_suppkey", "source": "CASE WHEN s_suppkey % 2 = 0 THEN 'recruiter_notes' ELSE 'other_feed' END",
        "full_name": f"'Supplier ' || {_s('s_suppkey % 20')}", "company": "CASE WHEN s_suppkey % 3 = 0 THEN 'Acme' ELSE NULL END",
    }, "FROM supplier"),
}
SQL = " UNION ALL ".join(PARTS.values())


def flat_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat records of all parts."""
    names = {t: table(spark, sf_dir, t) for t in ("customer", "nation", "orders", "supplier")}
    return spark.sql(_bound(SQL, names), **names)


def _bound(sql: str, names: dict[str, DataFrame]) -> str:
    """The SQL with table names as parameters, so that no view is registered."""
    return re.sub(r"\b(FROM|JOIN) (" + "|".join(names) + r")\b", r"\1 {\2}", sql)


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as raw records."""
    some = lambda *cs: F.array_compact(F.array(*(F.col(c) for c in cs)))
    nothing = F.lit(None).cast("string")
    job = F.struct("company", "title", F.col("started").alias("start"), F.col("ended").alias("end"), nothing.alias("summary"))
    study = F.struct("institution", "degree", "field", "end_year")
    return flat_people(spark, sf_dir).select(*schemas.record(
        "", F.col("rec_seq").cast("long"), full_name=F.col("full_name"), emails=some("email"), phones=some("phone"),
        location=F.struct("city", nothing.alias("region"), "country"),
        links=F.struct("linkedin", "github", "portfolio", F.array().cast("array<string>").alias("other")),
        headline=F.col("headline"), years_experience=F.col("years"), skills=some("skill1", "skill2", "skill3"),
        experience=F.when(F.coalesce("company", "title").isNotNull(), F.array(job)), education=F.when(F.col("institution").isNotNull(), F.array(study)),
    )[2:], "rec_seq", "source").select(*schemas.RAW)
