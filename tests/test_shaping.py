"""Truth tables for the finding-shaping operators."""

from pyspark.sql import functions as F

from lakehealth.functions import location as loc
from lakehealth.functions import text as tx


def test_hierarchy_cases(spark):
    rows = [
        # level, schema, table, column -> expected schema, table, column
        ("table", None, "s.t", None, "s", "t", "N/A"),
        ("table", None, "a.b.c", None, "a", "b.c", "N/A"),
        ("schema", None, "sales", None, "sales", "N/A", "N/A"),
        ("column", None, None, "c1", "N/A", "N/A", "c1"),
        ("table", None, "t", None, "dbo", "t", "N/A"),
        ("table", None, None, None, "N/A", "N/A", "N/A"),
        ("table", "None", "N/A", "None", "N/A", "N/A", "N/A"),
        ("table", "x", "s.t", "c", "x", "s.t", "c"),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "level string, schema_name string, table_name string, column_name string")
    out = loc.normalize_hierarchy(df).collect()
    assert [(r.schema_name, r.table_name, r.column_name) for r in out] == [r[4:] for r in rows]


def test_level_masking(spark):
    df = spark.createDataFrame([(lv, "s", "t", "c") for lv in ("lakehouse", "database", "schema", "table", "column")],
                               "level string, schema_name string, table_name string, column_name string")
    got = {r.level: (r.schema_name, r.table_name, r.column_name) for r in loc.mask_by_level(df).collect()}
    assert got == {"lakehouse": ("N/A",) * 3, "database": ("N/A",) * 3, "schema": ("s", "N/A", "N/A"),
                   "table": ("s", "t", "N/A"), "column": ("s", "t", "N/A")}


def test_remediation_cases(spark):
    df = spark.createDataFrame([
        (True, "OPTIMIZE {table_name}", "DYN", "t1"),    # dynamic wins
        (True, "OPTIMIZE {table_name}", None, "t1"),     # template only
        (False, "OPTIMIZE {table_name}", "DYN", "t1"),   # not an anomaly
        (True, "OPTIMIZE {table_name}", None, None),     # NULL name -> empty text, not NULL script
        (True, "", None, "t1"),                          # empty template -> no script
    ], "a boolean, tpl string, dyn string, t string")
    out = df.select(loc.remediation("a", "tpl", {"table_name": F.col("t")}, dynamic=F.col("dyn")).alias("r"))
    assert [r.r for r in out.collect()] == ["DYN", "OPTIMIZE t1", None, "OPTIMIZE ", None]


def test_indicator_and_anomaly(spark):
    df = spark.createDataFrame([("x\n\nIndicator: Anomaly - ERR_1001",), ("plain",), (None,)], "t string")
    out = df.select(tx.with_default_indicator("t").alias("r"), tx.anomaly_flag("t").alias("a")).collect()
    assert out[0].r.endswith("ERR_1001") and out[0].a is True
    assert out[1].r == "plain\n\nIndicator: Optimized - OPT_2001" and out[1].a is False
    assert out[2].a is False
    det = spark.createDataFrame([("d", True), (None, False)], "d string, a boolean")
    res = [r.r for r in det.select(tx.result_text("d", "a").alias("r")).collect()]
    assert res == ["d\n\nIndicator: Anomaly - ERR_1001", "Indicator: Optimized - OPT_2001"]


def test_strip_and_blank(spark):
    df = spark.createDataFrame([(" \t a b \n",), ("\n ",)], "t string")
    out = df.select(tx.strip_ws("t").alias("s"), tx.is_blank("t").alias("b")).collect()
    assert [(r.s, r.b) for r in out] == [("a b", False), ("", True)]


def test_parse_table_path(spark):
    df = spark.createDataFrame([
        ("abfss://ws@host/lh.Lakehouse/Tables/t1/_delta_log/",),
        ("abfss://ws@host/lh.Lakehouse/Tables/dbo/t1/_delta_log/",),
        ("abfss://ws@host/my.lh.Lakehouse/Tables/t1/",),
        ("file:/nowhere",),
    ], "p string")
    out = df.select(*[v.alias(k) for k, v in loc.parse_table_path(F.col("p")).items()]).collect()
    assert tuple(out[0]) == ("ws", "lh", "Lakehouse", "t1")
    assert out[1].table_name == "dbo"          # first segment only, like the reference
    assert out[2].lakehouse_name == "my.lh"    # greedy: split at the last dot
    assert tuple(out[3]) == (None, None, None, None)


def test_scan_date_format(spark):
    out = spark.range(1).select(tx.scan_date("2025-03-04 05:06:07.089").alias("d")).first().d
    assert out == "2025-03-04T05:06:07.089Z"


def test_pct_and_ratio(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (7, 2)], "p long, w long")
    out = df.select(tx.pct_text("p", "w").alias("pct"), tx.ratio_text("p", "w").alias("r")).collect()
    assert out[0].pct == "33.33%" and out[1].pct == "0.00%" and out[2].r == "3.50x" and out[1].r == "0.00x"
