"""Table state from checkpoints and later commits, on small hand-made logs."""

import json

import pytest

from fixtures import state_lake, state_queries
from lakehealth.sources import delta_log, delta_state
from tests.test_oracle import _rows, con  # noqa: F401


def commit(folder, version, *actions):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in actions) + "\n")


def checkpoint(spark, folder, name, rows):
    out = folder.parent / f"{name}.staging"
    spark.createDataFrame(rows, "add struct<path: string, size: bigint, partitionValues: map<string,string>, stats: string>, "
                                "remove struct<path: string>, metaData struct<id: string, schemaString: string>") \
        .coalesce(1).write.parquet(str(out))
    part = next(p for p in out.iterdir() if p.name.startswith("part-"))
    folder.mkdir(parents=True, exist_ok=True)
    part.rename(folder / name)


def add(path, size=1):
    return {"add": {"path": path, "size": size, "partitionValues": {}}}


@pytest.fixture()
def log(tmp_path):
    return tmp_path / "lake" / "ws" / "lh.Lakehouse" / "Tables" / "t" / "_delta_log"


def live(spark, log):
    root = str(log.parents[4])
    return {(r.path, r.size) for r in delta_log.live_files(delta_state.read_state(spark, root)).collect()}


def test_a_checkpoint_replaces_the_commits_up_to_it(spark, log):
    checkpoint(spark, log, f"{4:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None), (("b", 1, {}, None), None, None),
                                                            (None, ("gone",), None)])
    commit(log, 4, add("not-in-the-checkpoint"))
    commit(log, 5, {"remove": {"path": "a"}}, add("c", 3))
    commit(log, 6, add("b", 7))
    assert live(spark, log) == {("b", 7), ("c", 3)}


def test_an_incomplete_checkpoint_does_not_count(spark, log):
    checkpoint(spark, log, f"{2:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None)])
    checkpoint(spark, log, f"{5:020d}.checkpoint.{1:010d}.{2:010d}.parquet", [(("x", 1, {}, None), None, None)])
    for v in range(2, 6):
        commit(log, v, add(f"v{v}"))
    assert live(spark, log) == {("a", 1), ("v3", 1), ("v4", 1), ("v5", 1)}
    checkpoint(spark, log, f"{5:020d}.checkpoint.{2:010d}.{2:010d}.parquet", [(("y", 1, {}, None), None, None)])
    assert live(spark, log) == {("x", 1), ("y", 1)}


def test_a_table_without_checkpoint_is_read_from_its_commits(spark, log):
    commit(log, 0, add("a"))
    commit(log, 1, {"remove": {"path": "a"}}, add("b"))
    assert live(spark, log) == {("b", 1)}


def test_deletion_vectors_are_part_of_a_file(spark, log):
    vector = {"storageType": "u", "pathOrInlineDv": "p", "offset": 1, "sizeInBytes": 2, "cardinality": 3}
    commit(log, 0, add("a"))
    commit(log, 1, {"add": {"path": "a", "size": 9, "partitionValues": {}, "deletionVector": vector}}, {"remove": {"path": "a"}})
    assert live(spark, log) == {("a", 9)}
    commit(log, 2, {"remove": {"path": "a", "deletionVector": vector}})
    assert live(spark, log) == set()


def test_no_lake_gives_an_empty_state(spark, tmp_path):
    state = delta_state.read_state(spark, str(tmp_path / "nothing"))
    assert state.count() == 0 and delta_state.schema_fields(delta_state.metadata_versions(state)).count() == 0


def fields_of(spark, *documents):
    frame = spark.createDataFrame([(f"t{i}", 0, d, ["p"]) for i, d in enumerate(documents)],
                                  "table_id string, version long, schema_string string, partition_columns array<string>")
    return delta_state.schema_fields(frame)


def test_schema_documents_of_any_depth(spark):
    def nested(depth):
        inner = "long" if depth == 0 else {"type": "struct", "fields": [
            {"name": "x", "type": nested(depth - 1), "nullable": False, "metadata": {}}]}
        return inner
    deep = {"type": "struct", "fields": [{"name": "p", "type": "string", "nullable": True, "metadata": {"comment": "part"}},
                                         {"name": "d", "type": nested(7), "nullable": True, "metadata": {}}]}
    rows = fields_of(spark, json.dumps(deep), "no json", None, '{"type":"struct","fields":[]}', '"string"').collect()
    assert {r.table_id for r in rows} == {"t0"} and len(rows) == 9
    assert max(r.depth for r in rows) == 8
    part = next(r for r in rows if r.path == "p")
    assert (part.comment, part.is_partition, part.data_type, part.ordinal) == ("part", True, "string", 1)
    assert next(r for r in rows if r.depth == 8).data_type == "long"


def test_last_value_per_key_of_a_commit(spark, log):
    commit(log, 0, {"metaData": {"id": "1", "name": "a", "createdTime": 5}}, add("f"),
           {"metaData": {"id": "2", "description": "d"}}, {"protocol": {"minReaderVersion": 1}}, {"protocol": {"minWriterVersion": 2}})
    got = {r.key: r.value for r in delta_log.commit_attributes(delta_log.read_log(spark, str(log.parents[4]))).collect()}
    assert got == {"metadata_id": "2", "metadata_name": "a", "metadata_createdTime": "5", "metadata_description": "d",
                   "format_minReaderVersion": "1", "format_minWriterVersion": "2"}


@pytest.mark.parametrize("key", list(state_queries.QUERIES))
def test_state_queries_equal_sql(spark, con, sf001, key):  # noqa: F811
    df = state_queries.QUERIES[key](spark, sf001)
    cur = con.execute(state_queries.ORACLE[key])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in cur.description], cur.fetchall())


def joins_above(plan, scan):
    """The nearest join above each scan of that kind in a plan's text."""
    lines, found = plan.split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if scan not in line:
            continue
        at = depth(line)
        for above in reversed(lines[:k]):
            if depth(above) < at:
                at = depth(above)
                if "Join" in above:
                    found.append(above.strip(" :+-").split(" ")[0])
                    break
    return found


def test_rows_of_checkpoints_and_commits_are_picked_without_a_shuffle(spark, log):
    checkpoint(spark, log, f"{1:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None)])
    commit(log, 2, add("b"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the files are many and their sizes add up
    try:
        plan = delta_state.read_state(spark, str(log.parents[4]))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert joins_above(plan, "FileScan parquet") == ["BroadcastHashJoin"]
    assert joins_above(plan, "FileScan text") == ["BroadcastHashJoin"]


def test_a_large_table_has_checkpoints_of_more_parts_and_the_same_state(spark, sf0001, tmp_path, monkeypatch):
    def files(root):
        state = delta_state.read_state(spark, root)
        return sorted((r.table_id[len(root):], r.path, r.size, r.stats) for r in delta_log.live_files(state).select(
            "table_id", "path", "size", "stats").collect())

    roots = []
    for rows in (500_000, 100):
        monkeypatch.setattr(state_lake, "PART_ROWS", rows)
        roots.append(state_lake.build_state_lake(spark, sf0001, str(tmp_path / f"lake{rows}")))
    parts = [r.parts for root in roots for r in delta_state.newest_checkpoints(delta_log.log_listing(spark, root)).collect()
             if r.table_id.endswith("/lineitem")]
    assert parts[0] == 2 and parts[1] > 2
    assert [x[1:] for x in files(roots[0])] == [x[1:] for x in files(roots[1])]


def test_a_part_without_rows_is_still_written(spark, log):
    rows = spark.createDataFrame([(("a", 1, {}, None),)], "add struct<path: string, size: bigint, partitionValues: "
                                                          "map<string,string>, stats: string>")
    state_lake.write_checkpoint(spark, [rows], str(log.parents[4] / "_staging"), str(log.parents[1]), "t", 3, parts=4)
    commit(log, 3, add("not-in-the-checkpoint"))
    assert len(list(log.glob("*.checkpoint.*.parquet"))) == 4
    assert live(spark, log) == {("a", 1)}


def test_checkpoints_under_odd_folder_names_are_found(spark, tmp_path):
    folder = tmp_path / "Sales Team" / "East 50%+1.Lakehouse" / "Tables" / "my table" / "_delta_log"
    checkpoint(spark, folder, f"{2:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None)])
    commit(folder, 3, add("b", 2))
    files = delta_log.live_files(delta_state.read_state(spark, str(tmp_path))).collect()
    assert {(r.table_id.rsplit("/", 1)[1], r.path) for r in files} == {("my table", "a"), ("my table", "b")}


def test_files_of_checkpoints_that_do_not_count_are_not_opened(spark, log):
    log.mkdir(parents=True)
    (log / f"{1:020d}.checkpoint.parquet").write_text("not Parquet at all")
    checkpoint(spark, log, f"{3:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None)])
    (log / f"{5:020d}.checkpoint.{1:010d}.{2:010d}.parquet").write_text("nor is this")
    commit(log, 4, add("b", 2))
    assert live(spark, log) == {("a", 1), ("b", 2)}


@pytest.fixture()
def small_splits(spark, monkeypatch):
    """Commits over 500 bytes count as large, and files are read in splits of 1,000 bytes."""
    monkeypatch.setattr(delta_log, "WHOLE_COMMIT", 500, raising=False)
    conf = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    held = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def settings(value):
    return {"metaData": {"id": "i", "configuration": {"k": value}}}


def test_a_large_commit_is_read_in_splits_and_its_lines_keep_their_numbers(spark, log, small_splits):
    lines = [json.dumps(add(f"f{i}", i)) for i in range(200)]
    lines[7], lines[8], lines[150], lines[199] = "", '{"add": {"path": ', json.dumps(add("é")) + "\r", json.dumps(settings("z"))
    other = log.parents[1] / "s" / "a b%20+c" / "_delta_log"
    for folder in (log, other):
        commit(folder, 0, add("first"), settings("a"))
        (folder / f"{1:020d}.json").write_bytes("\n".join(lines).encode())
    found = delta_log.read_log(spark, str(log.parents[4])).selectExpr(
        "table_id", "version", "pos", "line", "action", "spark_partition_id() AS task").collect()
    expected = [(1, i, line) for i, line in enumerate(lines) if line]
    for folder in (log, other):
        mine = [r for r in found if r.table_id.endswith(str(folder.parent)) and r.version == 1]
        assert sorted((r.version, r.pos, r.line) for r in mine) == expected
        assert [r.pos for r in mine if r.action is None] == [8]
        assert len({r.task for r in mine}) > 5  # no row and no task holds all of it
    assert len(found) == 2 * (2 + len(expected))
    assert {r.line for r in delta_log.read_log(spark, str(log.parents[4]), max_versions=1).collect()} \
        == {json.dumps(add("first")), json.dumps(settings("a"))}


def test_the_last_action_of_a_large_commit_wins_across_its_splits(spark, log, small_splits):
    checkpoint(spark, log, f"{2:020d}.checkpoint.parquet", [(("a", 1, {}, None), None, None)])
    commit(log, 2, *(add(f"covered{i}") for i in range(100)))
    commit(log, 3, settings("one"), add("b", 2), *(add(f"n{i}", i) for i in range(100)), settings("two"), {"remove": {"path": "a"}},
           *({"remove": {"path": f"n{i}"}} for i in range(100)), add("b", 3), settings("three"), *(add("c", i) for i in range(100)))
    assert live(spark, log) == {("b", 3), ("c", 99)}
    state = delta_state.read_state(spark, str(log.parents[4]))
    assert [(r.key, r.value) for r in delta_log.table_properties(state).collect()] == [("k", "three")]
