"""Registered queries over the lake of ``state_lake.py``, with the SQL that computes the same from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtures import state_lake
from fixtures.state_lake import _columns_oracle as _columns
from lakehealth import schemas
from lakehealth.operators import delta as delta_ops
from lakehealth.operators import schema as schema_ops
from lakehealth.plans.findings import union_all
from lakehealth.plans.oracle_sql import res
from lakehealth.plans.warehouse import check_view
from lakehealth.sources import delta_log, delta_state

_ROOTS: dict[tuple, str] = {}


def _root(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _ROOTS:
        _ROOTS[key] = state_lake.build_state_lake(spark, sf_dir)
    return _ROOTS[key]


def _state(spark, sf_dir) -> DataFrame:
    return delta_state.read_state(spark, _root(spark, sf_dir))


def _table(col: str = "table_id"):
    return F.regexp_extract(F.col(col), r"/Tables/(.*)$", 1).alias("table_name")


def delta_state_files(spark, sf_dir):
    """The live files of every table, from checkpoints and the commits after them."""
    return delta_log.live_files(_state(spark, sf_dir)).select(
        _table(), "path", "size", F.get_json_object("stats", "$.numRecords").cast("long").alias("records"))


def delta_state_properties(spark, sf_dir):
    """The settings in force, one row per key."""
    return delta_log.table_properties(_state(spark, sf_dir)).select(_table(), "key", "value")


def delta_state_fields(spark, sf_dir):
    """Every field of every table's current schema, at every depth."""
    fields = delta_state.schema_fields(delta_state.current_metadata(_state(spark, sf_dir)))
    return fields.select(_table(), "version", "depth", "ordinal", "path", "data_type", "nullable", "comment", "is_partition")


def delta_schema_changes(spark, sf_dir):
    """What each metaData version changes against the one before."""
    fields = delta_state.schema_fields(delta_state.metadata_versions(_state(spark, sf_dir)))
    return delta_state.schema_changes(fields).select(_table(), "version", "path", "change", "before", "after")


def delta_commit_attributes(spark, sf_dir):
    """A4: metadata_* and format_* of every commit, the last value of each key."""
    return delta_log.commit_attributes(_state(spark, sf_dir)).select(_table(), "version", "key", "value")


def delta_payloads(spark, sf_dir):
    """Payloads of the metaData, protocol and remove actions of the tables' state."""
    log = _state(spark, sf_dir).filter(F.col("action").isin("metaData", "protocol", "remove"))
    m, p, r = F.col("meta_data"), F.col("protocol"), F.col("remove")
    return log.select(
        _table(), "version", "action", m["id"].alias("meta_id"), m["name"].alias("meta_name"),
        m["description"].alias("meta_description"), m["format"]["provider"].alias("meta_provider"),
        F.concat_ws(",", m["partitionColumns"]).alias("meta_partitions"),
        F.size(F.map_keys(m["configuration"])).alias("meta_settings"),
        p["minReaderVersion"].alias("min_reader"), p["minWriterVersion"].alias("min_writer"),
        F.concat_ws(",", p["readerFeatures"]).alias("reader_features"), r["path"].alias("remove_path"),
        r["deletionTimestamp"].alias("remove_timestamp"))


def lk_state_log_checks(spark, sf_dir):
    """Log checks where the early commits are gone."""
    root = _root(spark, sf_dir)
    log, tables = delta_state.read_state(spark, root), delta_log.discover_tables(spark, root)
    checks = union_all([delta_ops.partitioning(log, tables, every_table=True), delta_ops.retention(log, tables),
                        delta_ops.auto_optimize(log, tables), delta_ops.file_statistics(log, tables),
                        delta_ops.checkpoints(delta_state.usable_listing(delta_log.log_listing(spark, root)), tables)], schemas.CHECKS)
    return check_view(checks.withColumn("table_name", _table()))


def lk_state_schema_checks(spark, sf_dir):
    """Schema checks on the columns of the log, with partition columns and comments."""
    fields = delta_state.schema_fields(delta_state.current_metadata(_state(spark, sf_dir)))
    columns = delta_state.state_columns(fields)
    checks = union_all([schema_ops.column_naming(columns), schema_ops.nullable_tables(columns), schema_ops.audit_columns(columns),
                        schema_ops.column_docs(columns), schema_ops.wide_tables(columns, 10)], schemas.CHECKS)
    return check_view(checks.withColumn("table_name", _table()))


# -- the same in SQL ----------------------------------------------------------------------------------------

_FILES = """
    li AS (SELECT date_trunc('month', l_shipdate) AS m, l_returnflag AS fl, l_suppkey AS sk, count(*) AS n
           FROM lineitem GROUP BY ALL),
    lv AS (SELECT *, date_diff('month', (SELECT min(m) FROM li), m) AS v FROM li),
    mx AS (SELECT max(v) AS mx, max(v) // 10 * 10 - 10 AS c FROM lv),
    lf AS (SELECT *, 'l_returnflag=' || fl || '/part-' || lpad(CAST(v AS VARCHAR), 5, '0') || '-' || CAST(sk AS VARCHAR)
                     || '.parquet' AS path, fl = 'R' AND v + 6 <= mx AS gone FROM lv, mx),
    oy AS (SELECT year(o_orderdate) AS y, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY ALL),
    orf AS (SELECT *, y - (SELECT min(y) FROM oy) AS v FROM oy),
    ox AS (SELECT max(v) AS ox FROM orf),
    pb AS (SELECT p_brand AS b, count(*) AS n FROM part GROUP BY 1),
    days AS (SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS d),
    live AS (
        SELECT 'lineitem' AS t, path, n * 128 + 4096 AS size, CASE WHEN fl <> 'N' THEN n END AS records, fl AS part
        FROM lf WHERE NOT gone
        UNION ALL SELECT 'sales/orders', 'o_orderstatus=' || st || '/part-' || CAST(v AS VARCHAR) || '.parquet', n * 64 + 1024, n, st
        FROM orf
        UNION ALL SELECT 'parts', b || '.parquet', n, NULL, NULL FROM pb),
    names AS (SELECT unnest(['lineitem', 'sales/orders', 'plain', 'parts']) AS t)"""

_SETTINGS = """
    settings AS (
        SELECT 'lineitem' AS t, 'delta.logRetentionDuration' AS key, 'interval ' || 2 * d || ' days' AS value FROM days
        UNION ALL SELECT 'lineitem', 'delta.deletedFileRetentionDuration', 'interval 9 days'
        UNION ALL SELECT 'sales/orders', 'delta.autoOptimize.optimizeWrite', 'true')"""


_COMMENTED = ", ".join(f"'{c}'" for c in state_lake.COMMENTED)
#: The nested column of the changed schema: depth, ordinal, path, type, nullable.
_NOTE = """(VALUES (2, 1, 'l_note.tags', 'array', true), (3, 1, 'l_note.tags.element', 'struct', false),
    (4, 1, 'l_note.tags.element.k', 'string', false), (4, 2, 'l_note.tags.element.w', 'integer', true),
    (2, 2, 'l_note.scores', 'map', true), (3, 1, 'l_note.scores.key', 'string', false),
    (3, 2, 'l_note.scores.value', 'array', true), (4, 1, 'l_note.scores.value.element', 'double', true))
    x(depth, ordinal, path, kind, nullable)"""

_FIELDS = f"""
    changed AS (
        SELECT row_number() OVER (ORDER BY i) AS i, name, CASE WHEN name = 'l_linenumber' THEN 'long' ELSE kind END AS kind,
               name <> 'l_linenumber' AS nullable, CASE WHEN name IN ({_COMMENTED}) THEN 'Comment on ' || name END AS comment
        FROM (SELECT * FROM {_columns('lineitem')} WHERE name <> 'l_tax')
        UNION ALL SELECT (SELECT count(*) FROM (DESCRIBE lineitem)), 'l_note', 'struct', true, 'Notes'),
    fields AS (
        SELECT 'lineitem' AS t, c + 2 AS version, 1 AS depth, i AS ordinal, name AS path, kind, nullable, comment,
               name = 'l_returnflag' AS part FROM changed, mx
        UNION ALL SELECT 'lineitem', c + 2, depth, ordinal, path, kind, nullable, NULL, false FROM {_NOTE}, mx
        UNION ALL SELECT 'sales/orders', ox, 1, i, name, kind, true, 'Comment on ' || name, name = 'o_orderstatus'
        FROM {_columns('orders')}, ox
        UNION ALL SELECT 'plain', 0, 1, i, name, kind, true, NULL, false FROM {_columns('region')})"""


def _check(rule: str, body: str, column: str = "CAST(NULL AS VARCHAR)") -> str:
    return (f"SELECT '{rule}' AS rule_id, t AS table_name, {column} AS column_name, {res('d', 'a')} AS result, a AS is_anomaly "
            f"FROM ({body})")


def _setting(key: str, otherwise: str = "NULL") -> str:
    return f"coalesce(max(value) FILTER (key = '{key}'), {otherwise})"


_RETENTION = ["delta.logRetentionDuration", "delta.deletedFileRetentionDuration"]
_NUMBER = lambda key: f"CAST(regexp_extract({_setting(key)}, '[0-9]+') AS INTEGER)"


def _json_schema(rows: str) -> str:
    return ("(SELECT '{\"fields\":[' || string_agg('{\"metadata\":' || CASE WHEN comment IS NULL THEN '{}' ELSE "
            "'{\"comment\":\"' || comment || '\"}' END || ',\"name\":\"' || name || '\",\"nullable\":' || nullable || ',\"type\":' || "
            "CASE WHEN name = 'l_note' THEN '{\"fields\":[{\"metadata\":{},\"name\":\"tags\",\"nullable\":true,\"type\":"
            "{\"containsNull\":false,\"elementType\":{\"fields\":[{\"metadata\":{},\"name\":\"k\",\"nullable\":false,\"type\":\"string\"},"
            "{\"metadata\":{},\"name\":\"w\",\"nullable\":true,\"type\":\"integer\"}],\"type\":\"struct\"},\"type\":\"array\"}},"
            "{\"metadata\":{},\"name\":\"scores\",\"nullable\":true,\"type\":{\"keyType\":\"string\",\"type\":\"map\",\"valueContainsNull\":true,"
            "\"valueType\":{\"containsNull\":true,\"elementType\":\"double\",\"type\":\"array\"}}}],\"type\":\"struct\"}' "
            "ELSE '\"' || kind || '\"' END || '}', ',' ORDER BY i) || '],\"type\":\"struct\"}' FROM " + rows + ")")


ORACLE = {
    "delta_state_files": f"""WITH {_FILES} SELECT t AS table_name, path, CAST(size AS BIGINT) AS size,
        CAST(records AS BIGINT) AS records FROM live""",
    "delta_state_properties": f"WITH {_FILES}, {_SETTINGS} SELECT t AS table_name, key, value FROM settings",
    "delta_state_fields": f"""WITH {_FILES}, {_FIELDS}
        SELECT t AS table_name, CAST(version AS BIGINT) AS version, depth, CAST(ordinal AS INTEGER) AS ordinal, path,
               kind AS data_type, nullable, comment, part AS is_partition FROM fields""",
    "delta_schema_changes": f"""WITH {_FILES}, {_FIELDS}
        SELECT 'lineitem' AS table_name, CAST(c + 2 AS BIGINT) AS version, path, change, before, after FROM mx, (
            SELECT path, 'added' AS change, NULL AS before, kind AS after FROM fields
            WHERE t = 'lineitem' AND path NOT IN (SELECT column_name FROM (DESCRIBE lineitem))
            UNION ALL SELECT path, 'comment', '', comment FROM fields
            WHERE t = 'lineitem' AND comment IS NOT NULL AND path IN (SELECT column_name FROM (DESCRIBE lineitem))
            UNION ALL SELECT name, 'dropped', kind, NULL FROM {_columns('lineitem')}
            WHERE name NOT IN (SELECT path FROM fields WHERE t = 'lineitem')
            UNION ALL SELECT name, 'data_type', o.kind, f.kind FROM {_columns('lineitem')} o
            JOIN fields f ON f.t = 'lineitem' AND f.path = o.name AND f.kind <> o.kind
            UNION ALL SELECT path, 'nullable', 'true', 'false' FROM fields
            WHERE t = 'lineitem' AND depth = 1 AND NOT nullable)""",
    "delta_commit_attributes": f"""WITH {_FILES}, {_FIELDS},
        plain AS (SELECT i, name, kind, true AS nullable, NULL AS comment FROM {_columns('region')})
        SELECT 'lineitem' AS table_name, CAST(c + 2 AS BIGINT) AS version, key, value FROM mx, (
            SELECT 'metadata_id' AS key, 'lineitem-id' AS value
            UNION ALL SELECT 'metadata_name', 'renamed' UNION ALL SELECT 'metadata_description', 'first of two'
            UNION ALL SELECT 'metadata_partitionColumns', '["l_returnflag"]'
            UNION ALL SELECT 'metadata_format', '{{"provider":"parquet","options":{{}}}}'
            UNION ALL SELECT 'metadata_configuration', '{{"delta.logRetentionDuration":"interval ' || 2 * d
                || ' days","delta.deletedFileRetentionDuration":"interval 9 days"}}' FROM days
            UNION ALL SELECT 'metadata_schemaString', {_json_schema('changed')})
        UNION ALL SELECT 'plain', 0, key, value FROM (
            SELECT 'metadata_id' AS key, 'plain-id' AS value
            UNION ALL SELECT 'metadata_partitionColumns', '[]' UNION ALL SELECT 'metadata_configuration', '{{}}'
            UNION ALL SELECT 'metadata_format', '{{"provider":"parquet","options":{{}}}}'
            UNION ALL SELECT 'metadata_schemaString', {_json_schema('plain')}
            UNION ALL SELECT 'format_minReaderVersion', '1' UNION ALL SELECT 'format_minWriterVersion', '2')""",
    "delta_payloads": f"""WITH {_FILES},
        p(t, version, action, meta_id, meta_name, meta_description, meta_provider, meta_partitions, meta_settings, min_reader,
          min_writer, reader_features, remove_path, remove_timestamp) AS (
            SELECT 'lineitem', greatest(c, v + 6), 'remove', NULL, NULL, NULL, NULL, '', NULL, NULL, NULL, '', path,
                   CASE WHEN v + 6 <= c THEN 1 ELSE v + 6 END FROM lf WHERE gone
            UNION ALL SELECT 'lineitem', c, 'metaData', 'lineitem-id', 'lineitem', NULL, 'parquet', 'l_returnflag', 2, NULL, NULL, '',
                   NULL, NULL FROM mx
            UNION ALL SELECT 'lineitem', c, 'protocol', NULL, NULL, NULL, NULL, '', NULL, 1, 2, '', NULL, NULL FROM mx
            UNION ALL SELECT 'lineitem', c + 2, 'metaData', 'lineitem-id', 'renamed', 'first of two', 'parquet', 'l_returnflag', 2,
                   NULL, NULL, '', NULL, NULL FROM mx
            UNION ALL SELECT 'lineitem', c + 2, 'metaData', 'lineitem-id', NULL, NULL, 'parquet', 'l_returnflag', 2,
                   NULL, NULL, '', NULL, NULL FROM mx
            UNION ALL SELECT 'sales/orders', ox, 'metaData', 'orders-id', NULL, NULL, 'parquet', 'o_orderstatus', 1, NULL, NULL, '',
                   NULL, NULL FROM ox
            UNION ALL SELECT 'sales/orders', ox, 'protocol', NULL, NULL, NULL, NULL, '', NULL, 3, 7, 'deletionVectors', NULL, NULL
            FROM ox
            UNION ALL SELECT 'plain', 0, 'metaData', 'plain-id', NULL, NULL, 'parquet', '', 0, NULL, NULL, '', NULL, NULL
            UNION ALL SELECT 'plain', 0, 'protocol', NULL, NULL, NULL, NULL, '', NULL, 1, 2, '', NULL, NULL
            UNION ALL SELECT 'parts', 1, 'remove', NULL, NULL, NULL, NULL, '', NULL, NULL, NULL, '', b || '.parquet', NULL FROM pb)
        SELECT t AS table_name, CAST(version AS BIGINT) AS version, action, meta_id, meta_name, meta_description, meta_provider,
               meta_partitions, meta_settings, min_reader, min_writer, reader_features, remove_path,
               CAST(remove_timestamp AS BIGINT) AS remove_timestamp FROM p""",
    "lk_state_log_checks": f"WITH {_FILES}, {_SETTINGS}, " + f"""
        conf AS (SELECT names.t, {_setting(_RETENTION[0])} AS lr, {_setting(_RETENTION[1])} AS fr,
                        {_NUMBER(_RETENTION[0])} AS ln, {_NUMBER(_RETENTION[1])} AS fn,
                        {_setting('delta.autoOptimize.optimizeWrite', "'unset'")} AS ow,
                        {_setting('delta.autoOptimize.autoCompact', "'unset'")} AS ac
                 FROM names LEFT JOIN settings ON settings.t = names.t GROUP BY names.t),
        per AS (SELECT names.t, count(DISTINCT part) AS parts, count(path) AS files, coalesce(sum(size), 0) AS bytes,
                       count(records) AS stats FROM names LEFT JOIN live ON live.t = names.t GROUP BY names.t) """
        + " UNION ALL ".join([
            _check("L2", """SELECT t, CASE WHEN parts > 0 THEN parts || ' partitions over ' || files || ' files; average '
                   || CAST(bytes // parts AS BIGINT) || ' bytes per partition' ELSE 'Not partitioned; ' || files || ' files' END AS d,
                   parts > 1 AND bytes < parts * 1073741824 AS a FROM per"""),
            _check("L8", """SELECT t, 'Log retention ' || coalesce(ln || ' days', 'unset') || ', deleted-file retention '
                   || coalesce(fn || ' days', 'unset') AS d, ln IS NULL OR fn IS NULL OR ln < 7 OR fn < 7 AS a FROM conf"""),
            _check("L18", """SELECT t, 'optimizeWrite=' || ow || ', autoCompact=' || ac AS d,
                   NOT (ow = 'true' OR ac = 'true') AS a FROM conf"""),
            _check("L19L", """SELECT t, stats || ' of ' || files || ' live files carry statistics' AS d, stats < files AS a FROM per"""),
            _check("L17", """SELECT t, 'Latest version ' || latest || ', last checkpoint ' || coalesce(CAST(ckpt AS VARCHAR), 'none') AS d,
                   latest - coalesce(ckpt, -1) > 10 AS a FROM (
                   SELECT 'lineitem' AS t, mx AS latest, c AS ckpt FROM mx
                   UNION ALL SELECT 'sales/orders', ox, ox FROM ox UNION ALL SELECT 'plain', 0, NULL UNION ALL SELECT 'parts', 1, NULL)"""),
        ]),
    "lk_state_schema_checks": f"WITH {_FILES}, {_FIELDS}, " + """
        per AS (SELECT t, count(*) AS n, count(comment) AS docs, count_if(nullable) AS k FROM fields WHERE depth = 1 GROUP BY t) """
        + " UNION ALL ".join([
            _check("L4", "SELECT t, path, 'Column ' || path || ' follows snake_case' AS d, false AS a FROM fields WHERE depth = 1", "path"),
            _check("L5T", "SELECT t, k || ' of ' || n || ' columns are nullable' AS d, k = n AS a FROM per"),
            _check("L7", "SELECT t, 'Table has 0 audit columns among ' || n || ' columns' AS d, true AS a FROM per"),
            _check("L16", "SELECT t, docs || ' of ' || n || ' columns documented' AS d, docs * 100 < n * 50 AS a FROM per"),
            _check("L23", """SELECT t, 'Table has ' || n || ' columns' || CASE WHEN n > 10 THEN chr(10)
                   || 'WARNING: Wide table detected. Consider splitting into multiple tables.' ELSE '' END AS d, n > 10 AS a FROM per"""),
        ]),
}

QUERIES = {fn.__name__: fn for fn in (
    delta_state_files, delta_state_properties, delta_state_fields, delta_schema_changes, delta_commit_attributes,
    delta_payloads, lk_state_log_checks, lk_state_schema_checks)}
