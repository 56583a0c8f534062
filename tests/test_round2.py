"""Identity of paths, common key types, isolation of rules at run time, safe snapshot swaps."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakehealth.operators import quality
from lakehealth.plans import programs, sink
from lakehealth.plans.evaluate import isolated
from lakehealth.sources import delta_log, footers


def test_footers_of_files_with_odd_names(spark, tmp_path):
    folder = tmp_path / "a b%20c#d"
    folder.mkdir()
    for name in ("x%20y.parquet", "p#q.parquet", "s t.parquet"):
        pq.write_table(pa.table({"a": [1, 2]}), folder / name)
    (folder / "broken.parquet").write_text("no parquet")
    files = footers.list_files(spark, str(tmp_path), recursive=True).withColumn("table_id", F.lit("t"))
    chunks = footers.footer_chunks(files)
    assert {r.file_name for r in chunks.collect()} == {"x%20y.parquet", "p#q.parquet", "s t.parquet"}
    assert [r.file_path.rsplit("/", 1)[1] for r in footers.unreadable_files(files, chunks).collect()] == ["broken.parquet"]


def test_log_and_listing_agree_on_paths(spark, tmp_path):
    log = tmp_path / "Sales Team" / "East 50%+1.Lakehouse" / "Tables" / "my table" / "_delta_log"
    log.mkdir(parents=True)
    (log / f"{0:020d}.json").write_text('{"commitInfo":{"timestamp":1,"operation":"WRITE"}}')
    tables = delta_log.discover_tables(spark, str(tmp_path))
    found = delta_log.read_log(spark, str(tmp_path)).join(tables, "table_id")
    assert [r.table_name for r in found.collect()] == ["my table"]


def _fk(spark, child, parent):
    tables = {"c": spark.sql(child), "p": spark.sql(parent)}
    return quality.fk_stats(tables, [("c", ["k"], "p", ["k"])]).first()


@pytest.mark.parametrize("child,parent", [
    ("SELECT CAST(1 AS DOUBLE) AS k", "SELECT 1 AS k"),
    ("SELECT CAST(1 AS DECIMAL(10,1)) AS k", "SELECT CAST(1 AS DECIMAL(10,2)) AS k"),
    ("SELECT DATE'2024-01-01' AS k", "SELECT TIMESTAMP'2024-01-01 00:00:00' AS k"),
    ("SELECT CAST(1 AS TINYINT) AS k", "SELECT CAST(1 AS BIGINT) AS k"),
    ("SELECT X'0102' AS k", "SELECT X'0102' AS k"),
])
def test_foreign_keys_compare_in_their_common_type(spark, child, parent):
    row = _fk(spark, child, parent)
    assert (row.rows, row.orphans, row.matched) == (1, 0, 1)


def test_foreign_key_of_an_empty_child_keeps_its_row(spark):
    row = _fk(spark, "SELECT 1 AS k WHERE false", "SELECT 1 AS k")
    assert (row.rows, row.orphans, row.orphan_keys, row.matched) == (0, 0, 0, 0)
    assert _fk(spark, "SELECT 2 AS k UNION ALL SELECT NULL", "SELECT 1 AS k").orphans == 1


def test_keys_of_a_set_are_not_joined_to_its_foreign_keys(spark):
    tables = {"c": spark.sql("SELECT * FROM VALUES (1, 5), (1, 6), (2, NULL) t(k, m)"), "d": spark.sql("SELECT 1 AS k"),
              "p": spark.sql("SELECT * FROM VALUES (1), (5) t(k)")}
    stats = quality.fk_stats(tables, [("c", ["k"], "p", ["k"]), ("c", ["m"], "p", ["k"]), ("d", ["k"], "p", ["k"])])
    plan = stats._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "set_id" in line]
    got = {(r.child, r.child_cols): (r.rows, r.orphans, r.orphan_keys, r.matched) for r in stats.collect()}
    assert got == {("c", "k"): (3, 1, 1, 2), ("c", "m"): (3, 1, 1, 1), ("d", "k"): (1, 0, 0, 1)}


def test_date_shapes_need_whole_dates(spark):
    df = spark.sql("SELECT '2024-01-01 server restarted' AS a, '2024-13-99' AS b, '2024-02-28 10:11' AS c")
    rows = {r.column_name: r.date_like for r in quality.column_profile({"t": df}, {"shape"}).collect()}
    assert rows == {"a": 0, "b": 0, "c": 1}


def test_rule_that_fails_while_it_runs_is_isolated(spark):
    spark.sql("SELECT 'x' AS v").createOrReplaceTempView("run_time_rule")
    rows = isolated(spark, {"rule_id": "R1", "sql": "SELECT CAST(v AS INT) AS result, 't' AS table_name FROM run_time_rule"})
    (row,) = rows.collect()
    assert row.result.startswith("Error executing query: [CAST_INVALID_INPUT]") and "SQLSTATE" in row.result


def test_unregistered_program_gives_an_error_row(spark):
    tables = spark.createDataFrame([("t",)], "table_id string")
    (row,) = programs.failed("LRX", "no function is registered for it", tables).collect()
    assert row.result == "Error analyzing rule LRX: no function is registered for it" and not row.is_anomaly


class FakeFs:
    def __init__(self, fail):
        self.folders, self.fail, self.deleted = {"target": "old data", "new": "new data"}, fail, []

    def exists(self, p):
        return p in self.folders

    def rename(self, a, b):
        if (a, b) == self.fail or b in self.folders:
            return False
        self.folders[b] = self.folders.pop(a)
        return True

    def delete(self, p, recursive):
        self.deleted.append(self.folders.pop(p))


def test_failing_renames_keep_the_old_snapshot():
    for fail in (("target", "old"), ("new", "target")):
        fs = FakeFs(fail)
        with pytest.raises(OSError):
            sink.swap(fs, "new", "target", "old")
        assert fs.folders["target"] == "old data" and not fs.deleted
    fs = FakeFs(None)
    sink.swap(fs, "new", "target", "old")
    assert fs.folders == {"target": "new data"} and fs.deleted == ["old data"]
