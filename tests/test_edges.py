"""Cases around the operators that the registered queries over whole tables do not single out."""

import json

import pytest

from fixtures import edge_queries
from lakehealth import schemas
from lakehealth.operators import quality, sketches, storage
from lakehealth.plans.findings import conform, union_all
from lakehealth.plans.lakehouse import register_log_views
from lakehealth.sources import catalog, delta_log, inventory
from tests.test_oracle import _rows, con  # noqa: F401


def properties(spark, folder, documents, multi_line=True, indent=2):
    folder.mkdir(parents=True, exist_ok=True)
    if multi_line:
        for i, d in enumerate(documents):
            (folder / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=indent))
    else:
        (folder / "all.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))
    docs = inventory.read_documents(spark, str(folder), multi_line)
    rows = inventory.item_properties(docs, "2024-05-01 00:00:00").collect()
    return {(r.workspace_id, r.item_type, r.id, r.property): r.value for r in rows}, inventory.bad_documents(docs).collect()


WORKSPACE = {"id": "w", "name": "W", "state": "Active", "none": None, "empty": [], "Lakehouse": [
    {"id": "1", "name": "a", "size": 1.5, "nothing": None, "on": True, "deep": {"x": [1, {"y": "é"}]},
     "extendedProperties": {"path": "p", "more": {"k": 1}, "id": "inner"}}, {"name": "no id"}, "text", 7]}


@pytest.mark.parametrize("multi_line", [True, False])
def test_no_property_of_an_item_is_lost(spark, tmp_path, multi_line):
    documents = [{"workspaces": [WORKSPACE]}, "{broken", {"workspaces": []}, {"other": 1}, []]
    got, bad = properties(spark, tmp_path / "docs", documents, multi_line)
    assert got == {
        ("w", "Lakehouse", "1", "id"): "1", ("w", "Lakehouse", "1", "name"): "a", ("w", "Lakehouse", "1", "size"): "1.5",
        ("w", "Lakehouse", "1", "nothing"): None, ("w", "Lakehouse", "1", "on"): "true",
        ("w", "Lakehouse", "1", "deep"): '{"x":[1,{"y":"é"}]}', ("w", "Lakehouse", "1", "ext_path"): "p",
        ("w", "Lakehouse", "1", "ext_more"): '{"k":1}', ("w", "Lakehouse", "1", "ext_id"): "inner",
        ("w", "Lakehouse", None, "name"): "no id", ("w", "Lakehouse", None, "value"): got["w", "Lakehouse", None, "value"]}
    assert [r.documents for r in bad] == [1]


def test_lenient_catalog_of_an_invalid_or_missing_file(spark, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"rules": [')
    assert catalog.read_rules(spark, str(bad), strict=False).count() == 0
    assert catalog.read_rules(spark, str(tmp_path / "none.json"), strict=False).count() == 0
    with pytest.raises(Exception):
        catalog.read_rules(spark, str(bad)).count()
    good = tmp_path / "good.json"
    good.write_text('{"rules": [{"id": "A", "status": true} // one\n]}')
    assert [r.id for r in catalog.read_rules(spark, str(good), strict=False).collect()] == ["A"]


def test_union_of_no_frames(spark):
    assert union_all([]).columns == schemas.FINDINGS.fieldNames()
    assert union_all([], schemas.CHECKS).count() == 0


def sweep(spark, chunks):
    """(start, length) of the chunks of one file, a row group each."""
    rows = [("t", "f", i, 0, start, length) for i, (start, length) in enumerate(chunks)]
    frame = spark.createDataFrame(rows, "table_id string, file_path string, row_group_id long, column_id long, "
                                        "data_page_offset long, total_compressed_size long")
    return storage.offset_sweep(conform(frame, schemas.CHUNKS)).first()


@pytest.mark.parametrize("chunks, detail, anomaly", [
    ([(4, 10), (14, 10), (24, 1)], "0 gaps of 0 bytes and 0 overlaps among 3 column chunks", False),
    ([(4, 10), (20, 10)], "1 gaps of 6 bytes and 0 overlaps among 2 column chunks", True),
    ([(4, 100), (14, 10), (24, 80)], "0 gaps of 0 bytes and 2 overlaps among 3 column chunks", True),  # nested, then side by side
    ([(9, 1)], "1 gaps of 5 bytes and 0 overlaps among 1 column chunks", True)])
def test_offset_sweep(spark, chunks, detail, anomaly):
    row = sweep(spark, chunks)
    assert (row.detail, row.is_anomaly) == (detail, anomaly)


@pytest.mark.parametrize("values, kind", [
    (["1", "-2", None], "bigint"), (["1", "1e5", ".5", "2."], "double"), (["1", "x"], "string"), ([None], "none"),
    (["2024-01-01"], "date"), (["2024-01-01", "2024-01-01T01:02:03.5"], "timestamp"), (["2024-01-01 99:99"], "string"),
    (["2024-02-30"], "string"), (["true", "False"], "boolean"), (["1", "true"], "string"), ([""], "string"), ([" 1"], "string"),
    (["1" * 30], "double"), (["1", "2024-01-01"], "string")])
def test_narrowest_type_of_whole_values(spark, values, kind):
    frame = spark.createDataFrame([(v,) for v in values], "c string")
    row = quality.narrowest_types({"t": frame}).first()
    assert row.detail.endswith(f"narrowest type {kind}") and row.is_anomaly == (kind not in ("string", "none"))


def test_sketches_of_runs_add_up(spark):
    frame = spark.range(60_000).selectExpr("CAST(id % 5000 AS BIGINT) AS k", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS t",
                                           "IF(id % 2 = 0, CAST(id AS DOUBLE), NULL) AS d", "CAST(NULL AS STRING) AS e")
    runs = [sketches.sketch({"x": frame.where(f"k % 4 = {i}")}, f"r{i}") for i in range(4)]
    merged = sketches.merge(runs[0].union(runs[1]).union(runs[2]).union(runs[3]))
    rows = {r.column_name: r for r in sketches.estimates(merged).collect()}
    assert {c: (r.rows, r.nonnull) for c, r in rows.items()} == {"k": (60_000, 60_000), "t": (60_000, 60_000), "d": (60_000, 30_000), "e": (60_000, 0)}
    assert abs(rows["k"].distinct - 5000) < 400 and abs(rows["t"].distinct - 40_001) < 3200 and rows["e"].distinct == 0
    assert rows["t"].top_value == "hot" and abs(rows["t"].top_count - 20_000) <= 3.5 / sketches.TOP_ITEMS * 60_000
    assert rows["d"].numbers == 30_000 and all(abs(q / 60_000 - p) < 0.04 for q, p in zip(rows["d"].quantiles, (0.25, 0.5, 0.75)))
    assert rows["e"].top_value is None and rows["t"].quantiles is None and rows["e"].numbers is None


def test_log_views_for_catalog_sql(spark, tmp_path):
    folder = tmp_path / "ws" / "lh.Lakehouse" / "Tables" / "t" / "_delta_log"
    folder.mkdir(parents=True)
    (folder / f"{0:020d}.json").write_text('{"add": {"path": "a", "size": 3, "partitionValues": {}}}\n')
    root = str(tmp_path)
    register_log_views(delta_log.read_log(spark, root), delta_log.discover_tables(spark, root))
    got = spark.sql("SELECT t.table_name, sum(l.add.size) AS n FROM log_actions l JOIN tables t USING (table_id) GROUP BY 1").collect()
    assert [tuple(r) for r in got] == [("t", 3)]


@pytest.mark.parametrize("key", list(edge_queries.QUERIES))
def test_edge_queries_equal_sql(spark, con, sf001, key):  # noqa: F811
    df = edge_queries.QUERIES[key](spark, sf001)
    cur = con.execute(edge_queries.ORACLE[key])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cur.description], cur.fetchall())
