"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame, and the
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import quality
from ..sources.tables import load_tables
from . import dataset, oracle_sql
from ..functions.text import result_text
from .warehouse import check_view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn
    return deco


def _profile(spark: SparkSession, sf_dir: str, metrics) -> DataFrame:
    return quality.column_profile(load_tables(spark, sf_dir), metrics)


# -- data checks over whole tables ----------------------------------------------------------

@register("wh_null_values", oracle_sql.null_values())
def wh_null_values(spark, sf_dir):
    return check_view(quality.null_values(_profile(spark, sf_dir, {"nulls"})))


@register("wh_column_sizing", oracle_sql.column_sizing())
def wh_column_sizing(spark, sf_dir):
    return check_view(quality.column_sizing(_profile(spark, sf_dir, {"length"})))


@register("wh_column_profile", oracle_sql.column_stats())
def wh_column_profile(spark, sf_dir):
    return check_view(quality.column_stats(_profile(spark, sf_dir, {"ndv", "minmax"})))


@register("lk_cardinality", oracle_sql.cardinality())
def lk_cardinality(spark, sf_dir):
    return check_view(quality.cardinality(_profile(spark, sf_dir, {"ndv"})))


@register("lk_data_types", oracle_sql.text_types())
def lk_data_types(spark, sf_dir):
    return check_view(quality.text_types(_profile(spark, sf_dir, {"shape"})))


@register("wh_data_retention", oracle_sql.data_retention())
def wh_data_retention(spark, sf_dir):
    return check_view(quality.data_retention(_profile(spark, sf_dir, {"older"}), "1996-01-01"))


@register("wh_duplicates", oracle_sql.duplicates())
def wh_duplicates(spark, sf_dir):
    return check_view(quality.duplicates(load_tables(spark, sf_dir), dataset.PRIMARY_KEYS))


@register("wh_fk_orphans", oracle_sql.fk_orphans())
def wh_fk_orphans(spark, sf_dir):
    return check_view(quality.fk_orphans(load_tables(spark, sf_dir), dataset.FOREIGN_KEYS))


@register("lk_skew", oracle_sql.key_skew())
def lk_skew(spark, sf_dir):
    return check_view(quality.key_skew(load_tables(spark, sf_dir), dataset.SKEW_KEYS))


# -- footer metadata, storage and schema checks ----------------------------------------------

from ..operators import schema as schema_ops  # noqa: E402
from ..operators import storage  # noqa: E402
from . import lakehouse  # noqa: E402
from .evaluate import metadata_rule  # noqa: E402

CHUNK_COLUMNS = ["table_id", "file_name", "row_group_id", "row_group_num_rows", "row_group_bytes", "column_id",
                 "path_in_schema", "type", "encodings", "compression", "num_values", "total_compressed_size",
                 "total_uncompressed_size", "stats_null_count", "file_offset", "data_page_offset",
                 "dictionary_page_offset"]


def _md(spark, sf_dir, **kw):
    return lakehouse.folder_metadata(spark, sf_dir, **kw)


@register("footer_chunks", oracle_sql.footer_chunks())
def footer_chunks(spark, sf_dir):
    return _md(spark, sf_dir).chunks.select(*CHUNK_COLUMNS)


@register("footer_topn_files", oracle_sql.footer_chunks())
def footer_topn_files(spark, sf_dir):
    """S6 with the reference's cap of 5 files per table (each test table has one file)."""
    return _md(spark, sf_dir, max_files_per_table=5).chunks.select(*CHUNK_COLUMNS)


def _storage(key, fn, oracle):
    register(key, oracle)(lambda spark, sf_dir: check_view(fn(_md(spark, sf_dir))))


_storage("lk_compression_ratio", lambda m: storage.compression_ratio(m.chunks), oracle_sql.compression_ratio())
_storage("lk_encoding", lambda m: storage.dictionary_encoding(m.chunks), oracle_sql.dictionary_encoding())
_storage("lk_row_groups", lambda m: storage.row_group_sizing(m.chunks), oracle_sql.row_group_sizing())
_storage("lk_parallelism", lambda m: storage.read_parallelism(m.chunks), oracle_sql.read_parallelism())
_storage("lk_data_skipping", lambda m: storage.chunk_statistics(m.chunks), oracle_sql.chunk_statistics())
_storage("lk_null_ratio", lambda m: storage.null_ratio(m.chunks), oracle_sql.null_ratio())
_storage("lk_offset_continuity", lambda m: storage.offset_continuity(m.chunks), oracle_sql.offset_continuity())
_storage("lk_file_sizes", lambda m: storage.file_sizes(m.files), oracle_sql.file_sizes())
_storage("lk_naming", lambda m: schema_ops.column_naming(m.columns), oracle_sql.column_naming())
_storage("wh_naming", lambda m: schema_ops.naming_standard(m.columns), oracle_sql.naming_standard())
_storage("wh_sensitive_names", lambda m: schema_ops.sensitive_names(m.columns), oracle_sql.sensitive_names())
_storage("lk_audit_columns", lambda m: schema_ops.audit_columns(m.columns), oracle_sql.audit_columns())
_storage("lk_column_docs", lambda m: schema_ops.column_docs(m.columns), oracle_sql.column_docs())
_storage("rule_wide_table", lambda m: schema_ops.wide_tables(m.columns), oracle_sql.wide_tables())
_storage("lk_nullability", lambda m: schema_ops.nullability(m.columns, m.chunks), oracle_sql.nullability())
_storage("wh_deprecated_types", lambda m: schema_ops.deprecated_types(m.chunks), oracle_sql.deprecated_types())


# -- catalog SQL rules over metadata views (R3, R4, T3) ---------------------------------------

GZIP_RULE = {"rule_id": "L24", "level": "column", "sql": storage.GZIP_RULE_SQL}
CODEC_COLUMN_SQL = """
SELECT table_id, path_in_schema AS column_name,
  concat('Codec ', concat_ws(', ', array_sort(collect_set(compression))), '\\n\\nIndicator: ',
         CASE WHEN max(CASE WHEN compression = 'GZIP' THEN 1 ELSE 0 END) = 1
              THEN 'Anomaly - ERR_1001' ELSE 'Optimized - OPT_2001' END) AS result
FROM chunks GROUP BY table_id, path_in_schema
"""

# A rule that returns one cell over the view ``df``.
CODEC_CELL_SQL = """
SELECT count(DISTINCT CASE WHEN compression = 'GZIP' THEN path_in_schema END) || ' of '
       || count(DISTINCT path_in_schema) || ' columns have GZIP chunks'
       || CASE WHEN max(CASE WHEN compression = 'GZIP' THEN 1 ELSE 0 END) = 1
               THEN ' - Anomaly - ERR_1001' ELSE ' - Optimized - OPT_2001' END AS cell
FROM df"""


def _rule_setup(spark, sf_dir):
    md = _md(spark, sf_dir)
    lakehouse.register_metadata_views(md)
    return md


@register("rule_gzip", oracle_sql.gzip_rule())
def rule_gzip(spark, sf_dir):
    md = _rule_setup(spark, sf_dir)
    return metadata_rule(spark, {**GZIP_RULE, "level": "table"}, lakehouse.tables_of(md))


@register("rule_column_level", oracle_sql.column_codec_rule())
def rule_column_level(spark, sf_dir):
    md = _rule_setup(spark, sf_dir)
    return metadata_rule(spark, {**GZIP_RULE, "column_sql": CODEC_COLUMN_SQL}, lakehouse.tables_of(md))


@register("rule_scalar", oracle_sql.scalar_rule(CODEC_CELL_SQL))
def rule_scalar(spark, sf_dir):
    """First cell of the first row of a rule run over the whole lake's chunks as ``df``."""
    md = _md(spark, sf_dir)
    md.chunks.createOrReplaceTempView("df")
    out = spark.sql(CODEC_CELL_SQL)
    return out.select(out.columns[0]).limit(1)


@register("lk_catalog_scan", oracle_sql.catalog_scan())
def lk_catalog_scan(spark, sf_dir):
    """The sample lakehouse catalog (SQL, registered functions, failing rules)."""
    from ..rules import LAKEHOUSE_RULES
    from .programs import catalog_results
    md = _md(spark, sf_dir)
    rules = cat.read_rules(spark, LAKEHOUSE_RULES)
    return catalog_results(spark, rules, md, lakehouse.tables_of(md))


# -- the whole findings table (flagship) -------------------------------------------------------

from .scan import folder_findings  # noqa: E402

FIXED_SCAN_TS = "2025-01-01 00:00:00.000"
FINDING_COLUMNS = ["rule_id", "level", "workspace_name", "workspace_id", "source_name", "source_id",
                   "schema_name", "table_name", "column_name", "category", "description", "recommendation",
                   "severity", "content", "result", "is_anomaly", "scan_date", "remediation_script", "table_path"]


@register("findings_all", oracle_sql.folder_findings())
def findings_all(spark, sf_dir):
    """Every check over every table, one findings table (fixed scan time)."""
    f = folder_findings(spark, sf_dir, scan_ts=FIXED_SCAN_TS, source_name="testdata")
    return f.select(*FINDING_COLUMNS)


# -- finding shaping operators over rows derived from the test tables --------------------------

from pyspark.sql import functions as F  # noqa: E402

from ..functions import location as loc  # noqa: E402
from ..functions import text as tx  # noqa: E402
from .findings import order_columns as _order_columns  # noqa: E402
from .findings import stringify as _stringify  # noqa: E402


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hierarchy_input(customer):
    seg = F.col("c_mktsegment")
    return customer.select(
        "c_custkey",
        F.when(seg == "BUILDING", "schema").when(seg == "AUTOMOBILE", "column").otherwise("table").alias("level"),
        F.when(seg == "MACHINERY", F.lit("sales")).when(seg == "FURNITURE", F.lit("None")).alias("schema_name"),
        F.when(seg == "HOUSEHOLD", F.concat(F.lit("crm."), F.col("c_name"))).when(seg == "FURNITURE", F.lit(""))
        .when(seg == "AUTOMOBILE", F.lit(None)).otherwise(F.col("c_name")).alias("table_name"),
        F.when(F.col("c_nationkey") < 5, F.lit("c_acctbal")).when(F.col("c_nationkey") < 10, F.lit("None"))
        .alias("column_name"))


@register("finding_hierarchy", oracle_sql.hierarchy())
def finding_hierarchy(spark, sf_dir):
    """F1 over one row per customer."""
    out = loc.normalize_hierarchy(hierarchy_input(_t(spark, sf_dir, "customer")))
    return out.select("c_custkey", "schema_name", "table_name", "column_name")


@register("level_masking", oracle_sql.level_masking())
def level_masking(spark, sf_dir):
    """F2 over one row per customer (segment -> level)."""
    seg = F.col("c_mktsegment")
    level = (F.when(seg == "AUTOMOBILE", "lakehouse").when(seg == "BUILDING", "database")
             .when(seg == "FURNITURE", "schema").when(seg == "HOUSEHOLD", "table").otherwise("column"))
    rows = _t(spark, sf_dir, "customer").select(
        "c_custkey", level.alias("level"), F.concat(F.lit("seg_"), F.lower(seg)).alias("schema_name"),
        F.col("c_name").alias("table_name"), F.lit("c_acctbal").alias("column_name"))
    return loc.mask_by_level(rows).select("c_custkey", "level", "schema_name", "table_name", "column_name")


@register("remediation", oracle_sql.remediation())
def remediation_query(spark, sf_dir):
    """F3 / X5 over one row per order (status F = anomaly, priority picks template / dynamic script)."""
    o = _t(spark, sf_dir, "orders")
    pr = F.col("o_orderpriority")
    tpl = (F.when(pr == "1-URGENT", F.lit("OPTIMIZE {full_table_name}"))
           .when(pr == "2-HIGH", F.lit("ALTER TABLE {table_name} ALTER COLUMN {column_name}"))
           .when(pr == "3-MEDIUM", F.lit("")).when(pr == "4-NOT SPECIFIED", F.lit(None))
           .otherwise(F.lit("VACUUM {lakehouse_name}.{table_name} -- {column_name}")))
    dyn = F.when(pr == "2-HIGH", F.concat(F.lit("DYNAMIC "), F.col("o_orderkey").cast("string")))
    table = F.concat(F.lit("orders_"), F.col("o_custkey").cast("string"))
    column = F.when(pr == "5-LOW", F.lit(None)).otherwise(F.lit("o_totalprice"))
    lh = F.concat(F.lit("lh_"), F.col("o_orderstatus"))
    values = {"table_name": table, "column_name": column, "lakehouse_name": lh,
              "full_table_name": loc.qualified_name(lh, table)}
    script = loc.remediation(F.col("o_orderstatus") == "F", tpl, values, dynamic=dyn)
    return o.select("o_orderkey", script.alias("remediation_script"))


def _raw_result(customer):
    seg = F.col("c_mktsegment")
    return (F.when(seg == "BUILDING", F.concat(F.col("c_name"), F.lit("\n\nIndicator: " + tx.ANOMALY)))
            .when(seg == "AUTOMOBILE", F.concat(F.col("c_name"), F.lit("\n\nIndicator: " + tx.OPTIMIZED)))
            .when(seg == "FURNITURE", F.concat(F.lit("  "), F.col("c_name"), F.lit(" \n")))
            .otherwise(F.col("c_name")))


@register("indicator_default", oracle_sql.indicator_default())
def indicator_default(spark, sf_dir):
    """R7 + X9: stripped rule output gets the Optimized indicator when it has none."""
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.with_default_indicator(tx.strip_ws(_raw_result(c))).alias("result"))


@register("anomaly_flag", oracle_sql.anomaly_flag())
def anomaly_flag_query(spark, sf_dir):
    """Anomaly iff the text carries the anomaly indicator."""
    c = _t(spark, sf_dir, "customer")
    return c.select("c_custkey", tx.anomaly_flag(_raw_result(c)).alias("is_anomaly"))


@register("scan_date", oracle_sql.scan_date())
def scan_date_query(spark, sf_dir):
    """ISO-8601 text with milliseconds and Z, per order date."""
    o = _t(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", tx.SCAN_DATE_FORMAT).alias("scan_date"))


@register("stringify", oracle_sql.stringify())
def stringify_query(spark, sf_dir):
    """every column as text."""
    c = _t(spark, sf_dir, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(15,2)"))
    return _stringify(c)


@register("order_columns", oracle_sql.order_columns())
def order_columns_query(spark, sf_dir):
    """Priority columns first, the rest in their original order."""
    c = _t(spark, sf_dir, "customer").select(
        F.col("c_name").alias("table_name"), "c_custkey", F.lit("Q0").alias("rule_id"), "c_nationkey", "c_acctbal",
        F.lit("dbo").alias("schema_name"))
    return _order_columns(c)


# -- Delta logs over a lake derived from lineitem / orders ----------------------------------------

from ..operators import delta as delta_ops  # noqa: E402
from fixtures import lake as lake_fixture  # noqa: E402

from ..sources import delta_log  # noqa: E402

_LAKES: dict[tuple, str] = {}


def lake_root(spark, sf_dir, with_data: bool = False) -> str:
    """The derived lake of ``sf_dir`` (built once per Spark application)."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), with_data)
    if key not in _LAKES:
        _LAKES[key] = lake_fixture.build_lake(spark, sf_dir, with_data=with_data)
    return _LAKES[key]


def rel_table(col="table_id"):
    """Table path relative to ``Tables/`` (``lineitem``, ``sales/orders``)."""
    return F.regexp_extract(F.col(col), r"/Tables/(.*)$", 1)


def _log(spark, sf_dir):
    root = lake_root(spark, sf_dir)
    return root, delta_log.read_log(spark, root)


@register("delta_log_scan", oracle_sql.delta_log_scan())
def delta_log_scan(spark, sf_dir):
    """Every version file of every table; lines and malformed lines per version."""
    _, log = _log(spark, sf_dir)
    return log.groupBy(rel_table().alias("table_name"), "version").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("action").isNull()).alias("bad_lines"))


@register("delta_actions_long", oracle_sql.delta_actions_long())
def delta_actions_long(spark, sf_dir):
    """One row per action with its position and type (long form)."""
    _, log = _log(spark, sf_dir)
    return log.select(rel_table().alias("table_name"), "version", "pos", "action",
                      F.col("commit_info.operation").alias("operation"), F.col("add.path").alias("add_path"),
                      F.col("add.size").alias("add_size"))


@register("delta_commit_summary", oracle_sql.delta_commit_summary())
def delta_commit_summary(spark, sf_dir):
    """A4: per (table, version) commit attributes and add totals."""
    _, log = _log(spark, sf_dir)
    s = delta_log.commit_summary(log)
    return s.select(rel_table().alias("table_name"), "version", "timestamp", "operation", "actions", "bad_lines",
                    "adds", "bytes_added", "records_added")


@register("delta_properties", oracle_sql.delta_properties())
def delta_properties(spark, sf_dir):
    """Latest table properties, one row per key."""
    _, log = _log(spark, sf_dir)
    return delta_log.table_properties(log).select(rel_table().alias("table_name"), "key", "value")


@register("discover_tables", oracle_sql.discover_tables())
def discover_tables(spark, sf_dir):
    """Delta tables of the lake (flat and schema layouts; hidden and non-table folders skipped)."""
    t = delta_log.discover_tables(spark, lake_root(spark, sf_dir))
    return t.select("workspace_name", "lakehouse_name", "schema_name", "table_name",
                    rel_table("table_path").alias("relative_path"))


def _log_check(key, fn):
    def q(spark, sf_dir):
        root, log = _log(spark, sf_dir)
        tables = delta_log.discover_tables(spark, root)
        c = fn(root, log, tables, spark)
        return check_view(c.withColumn("table_name", rel_table()))
    register(key, getattr(oracle_sql, key)())(q)


_log_check("lk_partitioning", lambda r, lg, t, s: delta_ops.partitioning(lg, t))
_log_check("lk_zorder", lambda r, lg, t, s: delta_ops.zorder(lg, t))
_log_check("lk_retention", lambda r, lg, t, s: delta_ops.retention(lg, t))
_log_check("lk_vacuum", lambda r, lg, t, s: delta_ops.vacuum(lg, t))
_log_check("lk_checkpoints", lambda r, lg, t, s: delta_ops.checkpoints(delta_log.log_listing(s, r), t))
_log_check("lk_auto_optimize", lambda r, lg, t, s: delta_ops.auto_optimize(lg, t))
_log_check("lk_data_skipping_log", lambda r, lg, t, s: delta_ops.file_statistics(lg, t))


# -- inventory, paths, JSON -------------------------------------------------------------------------

from ..functions import json as js  # noqa: E402
from ..sources import inventory as inv  # noqa: E402
from ..sources.footers import folder_files  # noqa: E402

_PAYLOADS: dict[tuple, str] = {}


def payload(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _PAYLOADS:
        _PAYLOADS[key] = lake_fixture.write_payload(spark, sf_dir)
    return inv.read_payload(spark, _PAYLOADS[key])


INV_COLS = ["workspace_id", "workspace_name", "item_type", "connection_type", "id", "name"]


@register("inv_lakehouse", oracle_sql.inv_lakehouse())
def inv_lakehouse(spark, sf_dir):
    """Lakehouse items of every workspace, staging and system items excluded."""
    items = inv.lakehouse_items(payload(spark, sf_dir))
    return items.select(*INV_COLS, F.col("ext")["segment"].alias("segment"))


@register("inv_all_items", oracle_sql.inv_all_items())
def inv_all_items(spark, sf_dir):
    """Every list-valued item kind of every workspace."""
    return inv.all_items(payload(spark, sf_dir)).select("workspace_id", "workspace_name", "item_type", "id", "name")


@register("filter_workspaces", oracle_sql.filter_workspaces())
def filter_workspaces(spark, sf_dir):
    """Wanted workspaces given by name (nations of AMERICA) or id (nations of ASIA)."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region")
    nr = n.join(r, n.n_regionkey == r.r_regionkey)
    wanted = (nr.filter(F.col("r_name") == "AMERICA").select(F.col("n_name").alias("value"))
              .unionByName(nr.filter(F.col("r_name") == "ASIA")
                           .select(F.concat(F.lit("ws-"), F.col("n_nationkey").cast("string")).alias("value"))))
    items = inv.filter_workspaces(inv.lakehouse_items(payload(spark, sf_dir)), wanted)
    return items.select(*INV_COLS)


@register("exclude_staging_eq", oracle_sql.exclude_staging_eq())
def exclude_staging_eq(spark, sf_dir):
    """The items the equality rule drops (staging lakehouse, system workspace)."""
    items = inv.lakehouse_items(payload(spark, sf_dir), exclude_staging=False)
    return items.filter(inv.is_staging_lakehouse()).select("workspace_id", "workspace_name", "id", "name")


@register("exclude_staging_prefix", oracle_sql.exclude_staging_prefix())
def exclude_staging_prefix(spark, sf_dir):
    """Warehouse items kept after the prefix exclusion."""
    return inv.warehouse_items(inv.all_items(payload(spark, sf_dir))).select("workspace_id", "id", "name")


@register("scan_summary", oracle_sql.scan_summary())
def scan_summary(spark, sf_dir):
    """A1/A2: items and distinct workspaces per item kind."""
    return inv.scan_summary(inv.all_items(payload(spark, sf_dir)))


@register("table_paths", oracle_sql.table_paths())
def table_paths(spark, sf_dir):
    """Table path and qualified name per (workspace, lakehouse, table) row."""
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    t = F.lower("c_mktsegment")
    return j.select("c_custkey", loc.table_path(F.col("n_name"), F.col("c_name"), t, lake_fixture.HOST).alias("table_path"),
                    loc.qualified_name(F.col("c_name"), t).alias("full_table_name"))


@register("parse_table_path", oracle_sql.parse_table_path())
def parse_table_path(spark, sf_dir):
    """Container, lakehouse, kind and table parsed from log paths of four shapes."""
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation")
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    seg = F.col("c_mktsegment")
    host = "@" + lake_fixture.HOST + "/"
    t = F.lower(seg)
    path = (F.when(seg == "BUILDING", F.concat(F.lit("abfss://"), F.col("n_name"), F.lit(host), F.col("c_name"),
                                               F.lit(".Lakehouse/Tables/dbo/"), t, F.lit("/_delta_log/")))
            .when(seg == "AUTOMOBILE", F.concat(F.lit("abfss://"), F.col("n_name"), F.lit(host), F.col("c_name"),
                                                F.lit(".v2.Lakehouse/Tables/"), t, F.lit("/_delta_log/")))
            .when(seg == "FURNITURE", F.concat(F.lit("file:/data/"), F.col("c_name")))
            .otherwise(F.concat(F.lit("abfss://"), F.col("n_name"), F.lit(host), F.col("c_name"),
                                F.lit(".Lakehouse/Tables/"), t, F.lit("/_delta_log/"))))
    parts = loc.parse_table_path(path)
    return j.select("c_custkey", *[v.alias(k) for k, v in parts.items()])


@register("lk_layer_naming", oracle_sql.layer_naming())
def lk_layer_naming(spark, sf_dir):
    """L1 over the tables of the folder."""
    t = folder_files(spark, sf_dir).select("table_id", F.col("table_id").alias("table_name")).distinct()
    return check_view(schema_ops.layer_naming(t))


@register("flatten_json", oracle_sql.flatten_json())
def flatten_json(spark, sf_dir):
    """Events.props flattened to one column per key."""
    e = _t(spark, sf_dir, "events").select("event_id", "props")
    return js.flatten_json(e, ["props"], {"props": ["k"]}).drop("props")


@register("flatten_json_keys", oracle_sql.flatten_json_keys())
def flatten_json_keys(spark, sf_dir):
    """A3: union of JSON keys of events.props."""
    return js.json_keys(_t(spark, sf_dir, "events"), ["props"])


# -- security and governance ----------------------------------------------------------------------

from ..operators import governance as gov  # noqa: E402

EXPECTED_SETTINGS = {"delta.logRetentionDuration": "interval 30 days",
                     "delta.deletedFileRetentionDuration": "interval 7 days",
                     "delta.autoOptimize.optimizeWrite": "true"}


@register("wh_sensitive_values", oracle_sql.sensitive_values())
def wh_sensitive_values(spark, sf_dir):
    """Q8 (values): e-mail / phone / card shapes in every text column, whole texts."""
    return check_view(gov.sensitive_values(load_tables(spark, sf_dir)))


def policies_from_regions(region):
    """Policy rows derived from the region table."""
    r = F.col("r_name")
    tbl = F.when(r.isin("EUROPE", "AMERICA"), F.lit("conversations")).when(r == "ASIA", F.lit("pages"))
    col = F.when(r.isin("EUROPE", "AMERICA"), F.lit("text")).when(r == "ASIA", F.lit("html"))
    return region.select(tbl.alias("table_name"), col.alias("column_name"),
                         F.concat(F.lit("mask_"), F.lower(r)).alias("policy")).filter(F.col("table_name").isNotNull())


@register("wh_policy_coverage", oracle_sql.policy_coverage())
def wh_policy_coverage(spark, sf_dir):
    """Q9: sensitive columns without a masking policy."""
    sens = gov.sensitive_values(load_tables(spark, sf_dir))
    return check_view(gov.policy_coverage(sens, policies_from_regions(_t(spark, sf_dir, "region"))))


def grants_from_customers(customer):
    seg = F.col("c_mktsegment")
    role = (F.when(seg == "BUILDING", "db_owner").when(seg == "MACHINERY", "db_datareader")
            .when(seg == "AUTOMOBILE", "db_securityadmin").otherwise("db_datawriter"))
    return customer.select(F.col("c_name").alias("principal"), role.alias("role"))


@register("wh_privileged_grants", oracle_sql.privileged_grants())
def wh_privileged_grants(spark, sf_dir):
    """Q10: members of privileged roles (grants derived from customers)."""
    return check_view(gov.privileged_grants(grants_from_customers(_t(spark, sf_dir, "customer"))))


@register("wh_cross_schema", oracle_sql.cross_schema())
def wh_cross_schema(spark, sf_dir):
    """Q15: dependencies between schemas, weighted by the child rows that reference a parent."""
    s = quality.fk_stats(load_tables(spark, sf_dir), dataset.FOREIGN_KEYS)
    sch = F.create_map(*[F.lit(x) for kv in dataset.SCHEMA_OF.items() for x in kv])
    edges = s.select(sch[F.col("child")].alias("from_schema"), F.col("child").alias("from_object"),
                     sch[F.col("parent")].alias("to_schema"), F.col("parent").alias("to_object"),
                     F.col("matched").alias("weight"))
    return gov.cross_schema(edges).select("rule_id", F.col("schema_name").alias("from_schema"),
                                          F.col("column_name").alias("to_schema"),
                                          result_text("detail", "is_anomaly").alias("result"), "is_anomaly")


@register("wh_settings_compliance", oracle_sql.settings_compliance())
def wh_settings_compliance(spark, sf_dir):
    """Q16: table settings of the lake vs the expected policy."""
    root, log = _log(spark, sf_dir)
    tables = delta_log.discover_tables(spark, root).select("table_id")
    actual = tables.join(delta_log.latest_configuration(log), "table_id", "left") \
        .select(rel_table().alias("source"), "settings")
    return check_view(gov.settings_compliance(actual, EXPECTED_SETTINGS))


# -- catalog-driven table SQL rules ----------------------------------------------------------------

from ..rules import WAREHOUSE_RULES  # noqa: E402
from ..sources import catalog as cat  # noqa: E402
from ..sources.tables import register_views  # noqa: E402
from .rules_scan import scan_warehouses, warehouse_rule_findings  # noqa: E402

RULE_COLUMNS = ["rule_id", "level", "schema_name", "table_name", "column_name", "category", "severity", "result",
                "is_anomaly", "remediation_script"]


@register("rule_table_sql", oracle_sql.rule_table_sql())
def rule_table_sql(spark, sf_dir):
    """The sample catalog against the test tables."""
    register_views(load_tables(spark, sf_dir))
    f = warehouse_rule_findings(spark, cat.read_rules(spark, WAREHOUSE_RULES), source_name="testdata",
                                scan_ts=FIXED_SCAN_TS)
    return f.select(*RULE_COLUMNS, F.to_json("extra").alias("extra"))


@register("source_error_finding", oracle_sql.source_error_finding())
def source_error_finding(spark, sf_dir):
    """Two sources, one unreadable; the readable one still yields its rule findings."""
    f = scan_warehouses(spark, {"testdata": sf_dir, "offline": sf_dir.rstrip("/") + "/offline_warehouse"},
                        WAREHOUSE_RULES, scan_ts=FIXED_SCAN_TS)
    return f.groupBy("source_name", "rule_id", "level", "severity", "category").agg(
        F.count(F.lit(1)).alias("findings"),
        F.min("result").alias("first_result"))


# -- whole lakehouse scan, R9, sinks -------------------------------------------------------------------

from ..session import scratch_path  # noqa: E402
from . import sink  # noqa: E402
from .lakehouse_scan import lake_metadata, lakehouse_findings  # noqa: E402


@register("missing_metadata", oracle_sql.missing_metadata())
def missing_metadata(spark, sf_dir):
    """R9/R3 over the lake: a table without data files gets the fixed 'metadata not available' text."""
    root = lake_root(spark, sf_dir, with_data=True)
    tables = delta_log.discover_tables(spark, root)
    md = lake_metadata(spark, root, tables, persist=False)
    lakehouse.register_metadata_views(md)
    r = metadata_rule(spark, GZIP_RULE | {"level": "table"}, tables)
    return r.select(rel_table().alias("table_name"), "result", "is_anomaly")


@register("findings_lakehouse")
def findings_lakehouse(spark, sf_dir):
    """Every check over every discovered table of the lake, locations joined from ``tables``."""
    root = lake_root(spark, sf_dir, with_data=True)
    n, r = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    inventory = n.join(r, n.n_regionkey == r.r_regionkey).select(   # workspace = region, lakehouse = nation
        F.col("r_name").alias("workspace_name"), F.concat(F.lit("ws-r"), F.col("r_regionkey").cast("string"))
        .alias("workspace_id"), F.col("n_name").alias("name"),
        F.concat(F.lit("lh-n"), F.col("n_nationkey").cast("string")).alias("id"))
    f = lakehouse_findings(spark, root, scan_ts=FIXED_SCAN_TS, inventory=inventory)
    return f.select(*FINDING_COLUMNS)


@register("sink_latest", oracle_sql.folder_findings())
def sink_latest(spark, sf_dir):
    """K1: the findings table written twice with overwrite; the latest snapshot read back."""
    path = scratch_path(spark, "latest")
    f = folder_findings(spark, sf_dir, scan_ts=FIXED_SCAN_TS, source_name="testdata").select(*FINDING_COLUMNS)
    sink.write_latest(f, path)
    sink.write_latest(spark.read.parquet(path), path)   # a snapshot derived from the current one
    return spark.read.parquet(path)


@register("sink_history", oracle_sql.history_two_runs())
def sink_history(spark, sf_dir):
    """K2: two runs appended (second run stamped one day later); all runs read back."""
    latest, hist = scratch_path(spark, "latest"), scratch_path(spark, "history")
    f = folder_findings(spark, sf_dir, scan_ts=FIXED_SCAN_TS, source_name="testdata").select(*FINDING_COLUMNS)
    sink.write_latest(f, latest)
    snap = spark.read.parquet(latest)
    sink.append_history(snap, hist)
    sink.append_history(snap.withColumn("scan_date", F.lit("2025-01-02T00:00:00.000Z")), hist)
    return sink.read_history(spark, hist).drop("scan_day")


# -- catalog views: each runs the sample catalog over the tables and reports one aspect ---------

def _rule_findings(spark, sf_dir):
    register_views(load_tables(spark, sf_dir))
    return warehouse_rule_findings(spark, cat.read_rules(spark, WAREHOUSE_RULES), source_name="testdata",
                                   scan_ts=FIXED_SCAN_TS)


def _per_rule(f):
    return f.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"),
                                    F.count_if("is_anomaly").alias("anomalies"))


@register("rule_catalog", oracle_sql.rule_catalog())
def rule_catalog(spark, sf_dir):
    """Every catalog rule with its raw status, both enabled readings and its findings."""
    rules = cat.read_rules(spark, WAREHOUSE_RULES)
    r = rules.select(F.col("id").alias("rule_id"), "status",
                     cat.enabled("status", "warehouse").alias("enabled"),
                     cat.enabled("status", "lakehouse").alias("enabled_lakehouse"))
    return (r.join(_per_rule(_rule_findings(spark, sf_dir)), "rule_id", "left")
            .fillna(0, ["findings", "anomalies"]))


@register("active_rules", oracle_sql.active_rules())
def active_rules(spark, sf_dir):
    """The enabled rules, their kind and what they found."""
    a = cat.active_rules(cat.read_rules(spark, WAREHOUSE_RULES)).select("rule_id", "kind", "level", "severity")
    return a.join(_per_rule(_rule_findings(spark, sf_dir)), "rule_id", "left").fillna(0, ["findings", "anomalies"])


@register("rule_defaults", oracle_sql.rule_defaults())
def rule_defaults(spark, sf_dir):
    """Catalog attributes after warehouse defaults, with the findings of each rule."""
    d = cat.with_defaults(cat.read_rules(spark, WAREHOUSE_RULES)).select("rule_id", "level", "content", "severity")
    return d.join(_per_rule(_rule_findings(spark, sf_dir)), "rule_id", "left").fillna(0, ["findings", "anomalies"])


@register("standardize_columns", oracle_sql.rule_rows_where("rule_id = 'WR002'", extra=True))
def standardize_columns(spark, sf_dir):
    """A rule returning tablename / columnname and no result column."""
    f = _rule_findings(spark, sf_dir)
    return f.filter(F.col("rule_id") == "WR002").select(*RULE_COLUMNS, F.to_json("extra").alias("extra"))
