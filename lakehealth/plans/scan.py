"""Whole-lake scan: every check over every table at once -> one findings table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import governance, storage
from ..operators.schema import layer_naming
from ..sources.tables import load_tables
from . import lakehouse
from .catalog import builtin_rules
from .evaluate import metadata_rule
from .findings import assemble, union_all
from .warehouse import data_checks

GZIP_RULE = {"rule_id": "L24", "level": "table", "sql": storage.GZIP_RULE_SQL}


def folder_checks(spark: SparkSession, folder: str, *, persist: bool = True, **kw) -> DataFrame:
    """All check rows for a folder of tables: data, storage, schema and SQL rules.

    The footer frames are checkpointed once (``persist``) and shared by every
    metadata check; the data profile is one fused aggregate per table whose
    exchange Spark reuses across the per-column checks.
    """
    tables = load_tables(spark, folder)
    md = lakehouse.folder_metadata(spark, folder, persist=persist)
    lakehouse.register_metadata_views(md)
    gz = metadata_rule(spark, GZIP_RULE, lakehouse.tables_of(md)).select(
        "rule_id", "table_id", F.col("table_id").alias("table_name"), "column_name", "result", "is_anomaly")
    names = lakehouse.tables_of(md).select("table_id", F.col("table_id").alias("table_name"))
    return union_all([
        data_checks(tables, **kw), governance.sensitive_values(tables), layer_naming(names),
        lakehouse.storage_checks(md), lakehouse.schema_checks_all(md), gz,
    ], schemas.CHECKS)


def folder_findings(spark: SparkSession, folder: str, *, scan_ts: datetime | str,
                    source_name: str, source_id: str | None = None, workspace_name: str | None = None,
                    workspace_id: str | None = None, rules: DataFrame | None = None, **kw) -> DataFrame:
    """The findings table of one folder of tables (one warehouse / lakehouse)."""
    rules = builtin_rules(spark) if rules is None else rules
    src = {"source_name": source_name, "source_id": source_id or "N/A",
           "workspace_name": workspace_name, "workspace_id": workspace_id}
    return assemble(folder_checks(spark, folder, **kw), rules, scan_ts=scan_ts, source=src)
