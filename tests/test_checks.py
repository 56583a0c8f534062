"""Anomaly branches of the checks on small frames (the test tables hold no NULLs,
orphans or GZIP files), plus footer and log readers on files written here."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lakehealth.operators import delta as delta_ops
from lakehealth.operators import governance as gov
from lakehealth.operators import quality, storage
from lakehealth.sources import footers


def _by(df, *keys):
    return {tuple(getattr(r, k) for k in keys): r for r in df.collect()}


def test_profile_anomalies(spark):
    t = spark.createDataFrame([(1, "x", "12", None), (2, "x", "3.5", None), (2, "x", None, None)],
                              "id int, const string, num_text string, empty string")
    prof = quality.column_profile({"t": t})
    checks = quality.profile_checks(prof, [quality.null_values_entry(), quality.cardinality_entry(),
                                           quality.text_types_entry()])
    got = {(r.rule_id, r.column_name): r.is_anomaly for r in checks.collect()}
    assert got[("Q1", "num_text")] is True and got[("Q1", "id")] is False
    assert got[("L20", "const")] is True and got[("L20", "id")] is False
    assert got[("L6", "num_text")] is True and got[("L6", "const")] is False


def test_duplicates_fk_skew(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)] + [(3,)] * 40, "k int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    tables = {"c": child, "p": parent}
    d = quality.duplicates(tables, {"c": [["k"]]}).first()
    assert d.is_anomaly and d.detail.startswith("2 values of key (k) occur more than once; 40 surplus rows")
    fk = quality.fk_orphans(tables, [("c", ["k"], "p", ["k"])]).first()
    assert fk.is_anomaly and fk.detail.startswith("1 of 45 rows (1 distinct keys)")   # NULL key is no orphan
    sk = quality.key_skew(tables, {"c": ["k"]}, max_ratio=2).first()
    assert sk.is_anomaly


def test_sensitive_and_policy(spark):
    t = spark.createDataFrame([("mail me at a.b@example.com",), ("call 555-123-4567",), ("card 4111 1111 1111 1111",),
                               ("nothing",)], "txt string")
    s = gov.sensitive_values({"t": t})
    r = s.first()
    assert r.is_anomaly and "1 e-mail, 1 phone and 1 card-number" in r.detail
    pol = spark.createDataFrame([], "table_name string, column_name string, policy string")
    assert gov.policy_coverage(s, pol).first().is_anomaly


def test_settings_and_grants(spark):
    actual = spark.createDataFrame([("t1", {"a": "1"}), ("t2", None)], "source string, settings map<string,string>")
    out = _by(gov.settings_compliance(actual, {"a": "1", "b": "x"}), "table_id", "column_name")
    assert out[("t1", "a")].is_anomaly is False and out[("t1", "b")].is_anomaly is True
    assert out[("t2", "a")].is_anomaly is True
    g = spark.createDataFrame([(f"u{i}", "db_owner") for i in range(5)] + [("v", "reader")], "principal string, role string")
    assert gov.privileged_grants(g).first().is_anomaly


def test_footers_gzip_and_row_groups(spark, tmp_path):
    tbl = pa.table({"a": list(range(1000)), "s": [str(i % 7) for i in range(1000)]})
    pq.write_table(tbl, tmp_path / "gz.parquet", compression="gzip", row_group_size=100)
    files = footers.folder_files(spark, str(tmp_path))
    chunks = footers.footer_chunks(files)
    assert chunks.select("row_group_id").distinct().count() == 10
    chunks.createOrReplaceTempView("chunks")
    res = spark.sql(storage.GZIP_RULE_SQL).first()
    assert res.result.startswith("Found 2 columns using GZIP compression.") and "ERR_1001" in res.result
    rg = storage.row_group_sizing(chunks).first()
    assert rg.is_anomaly and rg.detail.startswith("10 row groups in 1 files")
    cols = footers.table_columns(footers.file_schemas(files)).collect()
    assert {(c.column_name, c.data_type) for c in cols} == {("a", "bigint"), ("s", "string")}


def test_offset_gap(spark):
    chunks = spark.createDataFrame([
        ("t", "f", 0, 0, 4, None, 100), ("t", "f", 0, 1, 104, None, 50),   # contiguous
        ("t", "f", 0, 2, 200, None, 10),                                     # gap
    ], "table_id string, file_path string, row_group_id long, column_id long, data_page_offset long, "
       "dictionary_page_offset long, total_compressed_size long")
    r = storage.offset_continuity(chunks).first()
    assert r.is_anomaly and r.detail.startswith("1 gaps")


def test_retention_parsing(spark):
    from lakehealth.operators.delta import _days
    df = spark.createDataFrame([("interval 30 days",), ("168 hours",), ("soon",), (None,)], "v string")
    assert [r.d for r in df.select(_days(F.col("v")).alias("d")).collect()] == [30, 7, None, None]
    assert delta_ops.GIB == 1024 ** 3


def test_text_key_duplicates(spark):
    t = spark.createDataFrame([("a" * 5000,), ("a" * 5000,), ("a" * 4999,), ("b",), ("b",), ("b",), (None,), (None,)],
                              "txt string")
    d = quality.duplicates({"t": t}, {"t": [["txt"]]}).first()
    # groups: long text (2 rows), "b" (3 rows), NULL (2 rows) -> 3 groups, 4 surplus rows
    assert d.detail.startswith("3 values of key (txt) occur more than once; 4 surplus rows")


def test_exact_ndv_edge_cases(spark):
    import datetime as dt
    t = spark.createDataFrame([(0.0, True, None, dt.datetime(2024, 1, 1), "a"), (-0.0, False, None, None, "a"),
                               (1.5, True, None, dt.datetime(2024, 1, 1), "b")],
                              "d double, b boolean, n string, ts timestamp, s string")
    prof = quality.column_profile({"t": t}, {"ndv"})
    got = {r.column_name: r.ndv for r in prof.collect()}
    assert got == {"d": 2, "b": 2, "n": 0, "ts": 1, "s": 2}


def test_sinks_overwrite_append_and_counts(spark, tmp_path):
    from lakehealth.plans import sink
    df = spark.createDataFrame([("a", True, "2025-01-01T00:00:00.000Z"), ("b", False, "2025-01-01T00:00:00.000Z")],
                               "rule_id string, is_anomaly boolean, scan_date string")
    latest, hist = str(tmp_path / "latest"), str(tmp_path / "hist")
    assert sink.write_latest(df, latest) == {"rows": 2, "anomalies": 1}
    sink.write_latest(spark.read.parquet(latest).limit(1), latest)   # derived from the current snapshot
    assert spark.read.parquet(latest).count() == 1
    sink.append_history(df, hist)
    sink.append_history(df, hist)
    assert sink.read_history(spark, hist).count() == 4
