"""The driver's contract."""

import __spark_entry__


def test_names_match():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known)
    assert "golden_profiles" in known and len(known) >= 35


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "candidate_id" in df.columns


def test_generated_code_gives_the_same(spark):
    """The other tests interpret expressions, which starts faster; here the code that production generates runs."""
    known = __spark_entry__.queries()
    names, sf = ["golden_profiles", "scan_skills", "linkedin_export"], "/root/testdata/sf0.001"
    plain = {n: sorted(map(repr, known[n](spark, sf).collect())) for n in names}
    held = {k: spark.conf.get(k) for k in ("spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode")}
    try:
        spark.conf.set("spark.sql.codegen.wholeStage", "true")
        spark.conf.set("spark.sql.codegen.factoryMode", "FALLBACK")
        assert {n: sorted(map(repr, known[n](spark, sf).collect())) for n in names} == plain
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
