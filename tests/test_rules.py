"""Rule catalog (S7, S8, R1, R2) and rule evaluation."""

import json

from pyspark.sql import functions as F

from lakehealth.plans.evaluate import metadata_rule, standardize_columns, table_rule
from lakehealth.sources import catalog


def _catalog(tmp_path, rules, comments=True):
    text = json.dumps({"rules": rules}, indent=1)
    if comments:
        text = "// leading comment\n" + text.replace('"rules": [', '"rules": [ // inline comment\n', 1)
    p = tmp_path / "rules.json"
    p.write_text(text)
    return str(p)


def test_status_forms_and_defaults(spark, tmp_path):
    rules = [{"id": "A", "status": "true", "recommendation": "see https://example.org/x"},
             {"id": "B", "status": True}, {"id": "C", "status": 1}, {"id": "D", "status": "false"},
             {"id": "E"}]
    df = catalog.read_rules(spark, _catalog(tmp_path, rules))
    wh = {r.id for r in df.filter(catalog.enabled("status", "warehouse")).collect()}
    lh = {r.id for r in df.filter(catalog.enabled("status", "lakehouse")).collect()}
    assert wh == {"A", "B", "C"}
    assert lh == {"A", "B", "E"}
    assert df.filter("id = 'A'").first().recommendation == "see https://example.org/x"   # URL survives comments
    d = {r.rule_id: r for r in catalog.with_defaults(df, "lakehouse").collect()}
    assert d["E"].severity == 3 and d["E"].level == "table" and d["E"].content == "analysis"
    w = {r.rule_id: r for r in catalog.with_defaults(df, "warehouse").collect()}
    assert w["E"].level == "database" and w["E"].content == "" and w["E"].kind == "guidance"


def test_missing_catalog(spark, tmp_path):
    assert catalog.read_rules(spark, str(tmp_path / "none.json"), strict=False).count() == 0


def test_standardize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "tablename int, name int, columnname int")
    assert standardize_columns(df).columns == ["table_name", "name", "column_name"]
    df2 = spark.createDataFrame([(1, 2)], "table_name int, name int")
    assert standardize_columns(df2).columns == ["table_name", "name"]
    df3 = spark.createDataFrame([(1,)], "name int")
    assert standardize_columns(df3).columns == ["table_name"]


def test_table_rule_default_result_and_extras(spark):
    spark.createDataFrame([("t1", 5)], "tablename string, n int").createOrReplaceTempView("rule_src")
    out = table_rule(spark, {"rule_id": "X1", "sql": "SELECT tablename, n FROM rule_src"}).first()
    assert out.table_name == "t1" and out.result == "Found issue with X1" and out.extra == {"n": "5"}
    err = table_rule(spark, {"rule_id": "X2", "sql": "SELECT * FROM no_such_table"}).first()
    assert err.result.startswith("Error executing query: ")


def test_metadata_rule_fanout_and_missing(spark):
    chunks = spark.createDataFrame([("t1", "a", "GZIP"), ("t1", "b", "SNAPPY"), ("t2", "a", "SNAPPY")],
                                   "table_id string, path_in_schema string, compression string")
    chunks.createOrReplaceTempView("chunks")
    tables = spark.createDataFrame([("t1",), ("t2",), ("t3",)], "table_id string")
    rule = {"rule_id": "G", "level": "column",
            "sql": "SELECT table_id, concat('n=', count(*), '\\n\\nIndicator: Optimized - OPT_2001') AS result "
                   "FROM chunks GROUP BY table_id",
            "column_sql": "SELECT table_id, path_in_schema AS column_name, CASE WHEN compression = 'GZIP' "
                          "THEN 'gz\\n\\nIndicator: Anomaly - ERR_1001' ELSE '  ' END AS result FROM chunks"}
    out = {(r.table_id, r.column_name): (r.result, r.is_anomaly) for r in metadata_rule(spark, rule, tables).collect()}
    assert out[("t1", "a")] == ("gz\n\nIndicator: Anomaly - ERR_1001", True)
    assert ("t1", "b") not in out                         # blank column result dropped
    assert out[("t2", None)][0].startswith("n=1")         # no surviving column row -> table text
    assert out[("t3", None)] == ("Parquet metadata not available for this table", False)
    bad = metadata_rule(spark, {"rule_id": "B", "sql": "SELECT nope FROM chunks"}, tables)
    assert bad.count() == 3 and bad.first().result.startswith("Error analyzing rule B")
