"""Plan-shape checks: what the physical plans must (not) contain."""

import __spark_entry__ as entry
from lakehealth.operators import governance, quality
from lakehealth.plans import dataset
from lakehealth.sources import footers
from lakehealth.sources.tables import load_tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_products_or_python_in_data_checks(spark, sf0001):
    t = load_tables(spark, sf0001)
    for df in (quality.fk_orphans(t, dataset.FOREIGN_KEYS), quality.duplicates(t, dataset.PRIMARY_KEYS),
               quality.key_skew(t, dataset.SKEW_KEYS), governance.sensitive_values(t),
               quality.column_profile(t)):
        p = _plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_findings_plan_has_no_products(spark, sf0001):
    p = _plan(entry.queries()["findings_all"](spark, sf0001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_listing_does_not_read_content(spark, sf0001):
    df = footers.list_files(spark, sf0001)
    scan = [line for line in _plan(df).splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert scan and all("content" not in line for line in scan)
    assert df.columns == ["file_path", "length", "file_name"]


def test_filter_and_columns_reach_the_scan(spark, sf0001):
    o = spark.read.parquet(f"{sf0001}/orders.parquet")
    p = _plan(o.filter("o_orderstatus = 'F'").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in p
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in p


def test_profile_reads_each_table_once_per_pass(spark, sf0001):
    t = {"orders": spark.read.parquet(f"{sf0001}/orders.parquet")}
    p = _plan(quality.column_profile(t, {"nulls", "length", "shape"}))
    assert p.count("FileScan parquet") == 1
