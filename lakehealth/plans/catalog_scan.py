"""The lake scan that a rule catalog drives.

Every rule of the catalog is one of

* ``content: "check"``: a check of this library, by its id (``CHECKS``);
* ``duckdb_query``: SQL over the views ``chunks``, ``columns``, ``files``, ``log_actions`` and ``tables``;
* ``pyspark_query``: a function registered under the rule's id, which may return column findings and scripts.

Rules run one after the other over all tables at once, each written to the shared folder on its own; one that fails,
also while it runs, becomes error rows of its own. What the rules see is the *state* of the tables: columns and settings
from the newest checkpoint and the commits after it, and of the files in storage only those the log calls live. A live file that
is not there, or that has no readable footer, is a finding (``F1``, ``F2``) and never silently absent.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import num
from ..operators import delta, schema, storage
from ..session import shared_dir
from ..sources import catalog, delta_log, delta_state, footers
from .evaluate import error_text, metadata_rule
from .findings import assemble, union_all
from .lakehouse import Metadata, register_log_views, register_metadata_views
from .programs import PROGRAMS, failed, program_rows


@dataclass
class Lake(Metadata):
    """``files``, ``chunks`` and ``columns`` of live files only, and what lies around them."""
    tables: DataFrame     # schemas.TABLES
    log: DataFrame        # schemas.LOG_ACTIONS: the state of every table
    listing: DataFrame    # files of the log folders
    stored: DataFrame     # table_id, path, is_live, is_stored: live files and files in storage
    unreadable: DataFrame  # table_id, file_path


def _plain(path):
    """A log path as the file system has it: log paths are URL-encoded, and ``+`` stands for itself."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def stored_files(spark: SparkSession, root: str, tables: DataFrame) -> DataFrame:
    """``table_id, path, file_path, file_name, length`` of the Parquet files in the tables' folders; ``path`` is relative to
    the table. A file's table is its folder without trailing ``k=v`` segments, so this is an equi-join."""
    files = footers.list_files(spark, root, recursive=True)
    folder = F.regexp_replace(F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1), r"(/[^/=]+=[^/]*)+$", "")
    found = files.withColumn("table_path", folder).join(tables.select("table_id", "table_path"), "table_path")
    return found.select("table_id", F.expr("substring(file_path, length(table_path) + 2)").alias("path"),
                        "file_path", "file_name", "length")


def read_lake(spark: SparkSession, root: str, inventory: DataFrame | None = None) -> Lake:
    shared_dir(spark)
    tables = delta_log.discover_tables(spark, root, inventory).checkpoint(eager=True)
    log = delta_state.read_state(spark, root).checkpoint(eager=True)
    # Files outside the table's folder (shallow clones) have absolute paths; they are not looked for here.
    live = (delta_log.live_files(log).filter(~F.col("path").rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"))
            .select("table_id", _plain(F.col("path")).alias("path"), F.lit(True).alias("is_live")))
    stored = stored_files(spark, root, tables).withColumn("is_stored", F.lit(True)).join(live, ["table_id", "path"], "full")
    stored = stored.fillna(False, ["is_live", "is_stored"]).checkpoint(eager=True)
    files = stored.filter("is_live AND is_stored").drop("is_live", "is_stored")
    chunks = footers.footer_chunks(files).checkpoint(eager=True)
    current = delta_state.current_metadata(log)
    declared = delta_state.state_columns(delta_state.schema_fields(current))
    rest = footers.table_columns(footers.file_schemas(files.join(current.select("table_id"), "table_id", "left_anti")))
    return Lake(files, chunks, declared.unionByName(rest).checkpoint(eager=True), tables, log,
                delta_state.usable_listing(delta_log.log_listing(spark, root)), stored.drop("file_path", "file_name", "length"),
                footers.unreadable_files(files, chunks))


def _file_check(rule_id: str, found: DataFrame, detail, anomaly) -> DataFrame:
    return found.select(F.lit(rule_id).alias("rule_id"), "table_id", detail.alias("detail"), anomaly.alias("is_anomaly"))


def unreadable_check(lake: Lake) -> DataFrame:
    """live files without a readable footer."""
    bad = lake.files.select("table_id", "file_path").join(lake.unreadable.select("file_path", F.lit(1).alias("bad")), "file_path", "left")
    g = bad.groupBy("table_id").agg(F.count("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    return _file_check("F1", g, F.concat(num("bad"), F.lit(" of "), num("n"), F.lit(" live files cannot be read")), F.col("bad") > 0)


def presence_check(lake: Lake) -> DataFrame:
    """live files that storage does not have, and stored files that are not live."""
    g = lake.stored.groupBy("table_id").agg(
        F.count_if("is_live").alias("live"), F.count_if(F.col("is_live") & ~F.col("is_stored")).alias("lost"),
        F.count_if(~F.col("is_live")).alias("loose"))
    detail = F.concat(num("live"), F.lit(" live files, "), num("lost"), F.lit(" of them not in storage; "), num("loose"),
                      F.lit(" stored files not live"))
    return _file_check("F2", g, detail, F.col("lost") > 0)


#: Checks a catalog can name, over all tables at once.
CHECKS: dict[str, Callable[[Lake], DataFrame]] = {
    "F1": unreadable_check,
    "F2": presence_check,
    "L1": lambda k: schema.layer_naming(k.tables),
    "L2": lambda k: delta.partitioning(k.log, k.tables, every_table=True),
    "L3": lambda k: delta.zorder(k.log, k.tables),
    "L4": lambda k: schema.column_naming(k.columns),
    "L5": lambda k: schema.nullability(k.columns, k.chunks),
    "L5T": lambda k: schema.nullable_tables(k.columns),
    "L7": lambda k: schema.audit_columns(k.columns),
    "L8": lambda k: delta.retention(k.log, k.tables),
    "L9": lambda k: delta.vacuum(k.log, k.tables),
    "L10": lambda k: storage.file_sizes(k.files),
    "L11": lambda k: storage.compression_ratio(k.chunks),
    "L12F": lambda k: storage.file_row_skew(k.chunks),
    "L13": lambda k: storage.dictionary_encoding(k.chunks),
    "L14": lambda k: storage.row_group_sizing(k.chunks),
    "L15": lambda k: storage.read_parallelism(k.chunks),
    "L16": lambda k: schema.column_docs(k.columns),
    "L17": lambda k: delta.checkpoints(k.listing, k.tables),
    "L18": lambda k: delta.auto_optimize(k.log, k.tables),
    "L19": lambda k: storage.chunk_statistics(k.chunks),
    "L19L": lambda k: delta.file_statistics(k.log, k.tables),
    "L21": lambda k: storage.null_ratio(k.chunks),
    "L22F": lambda k: storage.offset_sweep(k.chunks),
    "L23": lambda k: schema.wide_tables(k.columns),
}


def _rows(spark: SparkSession, rule, lake: Lake) -> DataFrame:
    rid = rule["rule_id"]
    if rule["content"] == "check":
        return CHECKS[rid](lake) if rid in CHECKS else failed(rid, "this library has no check of that id", lake.tables)
    if rule["kind"] == "metadata":
        return metadata_rule(spark, rule.asDict(), lake.tables)
    if rule["kind"] == "program":
        return program_rows(rid, lake) if rid in PROGRAMS else failed(rid, "no function is registered for it", lake.tables)
    return lake.tables.limit(0).select(F.lit(rid).alias("rule_id"), "table_id")  # guidance for people


def scan(spark: SparkSession, root: str, rules: DataFrame, *, scan_ts: datetime | str,
         inventory: DataFrame | None = None) -> DataFrame:
    """Findings of every enabled rule of ``rules`` (``catalog.read_rules``) over every table under ``root``."""
    lake = read_lake(spark, root, inventory)
    register_metadata_views(lake)
    register_log_views(lake.log, lake.tables)
    active = catalog.active_rules(rules, "lakehouse")
    parts = []
    for rule in active.orderBy("rule_id").collect():  # the catalog: tens of rows
        try:
            part = union_all([_rows(spark, rule, lake)], schemas.CHECKS).checkpoint(eager=True)
        except PySparkException as e:
            part = union_all([failed(rule["rule_id"], error_text(e), lake.tables)], schemas.CHECKS)
        parts.append(part)
    return assemble(union_all(parts, schemas.CHECKS).withColumn("table_name", F.lit(None).cast("string")), active,
                    scan_ts=scan_ts, tables=lake.tables)
