"""Sources on hand-made folders: Delta logs (D5 live files, J5 discovery), S6 top files, X1 JSON flatten."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakehealth.functions import json as js
from lakehealth.operators import delta as delta_ops
from lakehealth.sources import delta_log, footers


def _commit(path, version, actions):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions) + "\n")


@pytest.fixture()
def lake(tmp_path):
    tables = tmp_path / "ws" / "lh.Lakehouse" / "Tables"
    log = tables / "t1" / "_delta_log"
    _commit(log, 0, [{"commitInfo": {"timestamp": 1, "operation": "WRITE"}},
                     {"metaData": {"id": "x", "configuration": {"delta.autoOptimize.autoCompact": "true"}}},
                     {"add": {"path": "a.parquet", "size": 10, "partitionValues": {}, "stats": "{}"}},
                     {"add": {"path": "b.parquet", "size": 20, "partitionValues": {}}}])
    _commit(log, 1, [{"commitInfo": {"timestamp": 2, "operation": "OPTIMIZE",
                                     "operationParameters": {"zOrderBy": "[\"k\"]"}}},
                     {"remove": {"path": "a.parquet"}},
                     {"add": {"path": "c.parquet", "size": 30, "partitionValues": {}, "stats": "{}"}}])
    (log / "00000000000000000001.checkpoint.parquet").write_bytes(b"PAR1")   # listings skip empty files
    _commit(tables / "t1" / "inner" / "_delta_log", 0, [{"commitInfo": {"timestamp": 3}}])   # J5: parent is a table
    _commit(tables / "s" / "t2" / "_delta_log", 0, [{"commitInfo": {"timestamp": 4}}])
    _commit(tables / ".hidden" / "_delta_log", 0, [{"commitInfo": {"timestamp": 5}}])
    return str(tmp_path)


def test_discovery_and_live_files(spark, lake):
    t = delta_log.discover_tables(spark, lake)
    got = {(r.schema_name, r.table_name) for r in t.collect()}
    assert got == {("dbo", "t1"), ("s", "t2")}
    log = delta_log.read_log(spark, lake)
    live = {r.path for r in delta_log.live_files(log).collect()}
    assert live == {"b.parquet", "c.parquet"}
    z = {r.table_id.rsplit("/", 1)[-1]: r.is_anomaly for r in delta_ops.zorder(log, t).collect()}
    assert z == {"t1": False, "t2": True}
    ao = {r.table_id.rsplit("/", 1)[-1]: r.is_anomaly for r in delta_ops.auto_optimize(log, t).collect()}
    assert ao["t1"] is False and ao["t2"] is True
    st = {r.table_id.rsplit("/", 1)[-1]: r.detail for r in delta_ops.file_statistics(log, t).collect()}
    assert st["t1"] == "1 of 2 live files carry statistics"
    ck = {r.table_id.rsplit("/", 1)[-1]: r.detail for r in
          delta_ops.checkpoints(delta_log.log_listing(spark, lake), t).collect()}
    assert ck["t1"] == "Latest version 1, last checkpoint 1"
    assert delta_log.read_log(spark, lake, max_versions=1).filter("version > 0").count() == 0


def test_top_files(spark, tmp_path):
    for i in range(3):
        pq.write_table(pa.table({"a": [i]}), tmp_path / f"part-{i}.parquet")
    files = footers.list_files(spark, str(tmp_path)).withColumn("table_id", F.lit("t"))
    kept = [r.file_name for r in footers.top_files(files, 2).collect()]
    assert sorted(kept) == ["part-0.parquet", "part-1.parquet"]
    assert footers.top_files(files, None).count() == 3


def test_flatten_json_autodetect(spark):
    df = spark.createDataFrame([(1, '{"a": 1, "b": {"c": 2}}', "x"), (2, "not json", "y"), (3, None, "z")],
                               "id int, ext_props string, other string").withColumn("ext_text", F.lit("{broken"))
    assert js.json_columns(df) == ["ext_props"]
    out = js.flatten_json(df, keys={"ext_props": ["a", "b"]})
    rows = {r.id: (r.ext_props_a, r.ext_props_b) for r in out.collect()}
    assert rows[1] == ("1", '{"c":2}') and rows[2] == (None, None)
    assert js.flatten_json(df).filter("id = 1").first().ext_props_map == {"a": "1", "b": '{"c":2}'}
    assert js.json_long(df, ["id"], "ext_props").count() == 2
