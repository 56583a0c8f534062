"""Catalog-driven scans: table SQL rules of a warehouse
and the source-unreachable finding (R11)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.location import normalize_hierarchy, remediation
from ..functions.text import CONNECTION_ERROR_PREFIX, anomaly_flag, scan_date
from ..sources import catalog
from ..sources.tables import load_tables, register_views
from .evaluate import guidance_rows, isolated
from .findings import conform, union_all

# Fixed attributes of the source-unreachable finding.
CONNECTION_ERROR_RULE = {"rule_id": "CONNECTION_ERROR", "category": "System",
                         "description": "Failed to connect to warehouse",
                         "recommendation": "Check warehouse accessibility and credentials",
                         "severity": 1, "content": "system", "level": "database"}


def rule_rows(spark: SparkSession, active: DataFrame) -> DataFrame:
    """R5/R12 for every active rule: SQL rules run as Spark SQL (one DataFrame each,
    errors isolated per rule), other rules give a guidance row."""
    parts = []
    for r in active.filter(F.col("kind") == "query").collect():  # the catalog: tens of rows
        parts.append(isolated(spark, r.asDict()))
    parts.append(guidance_rows(spark, active.filter(F.col("kind") != "query")))
    return union_all(parts)


def warehouse_rule_findings(spark: SparkSession, rules: DataFrame, *, source_name: str,
                            scan_ts: datetime | str, source_id: str | None = None,
                            workspace_name: str | None = None, workspace_id: str | None = None) -> DataFrame:
    """Findings of all active table rules against the views already registered."""
    active = catalog.active_rules(rules, "warehouse")
    rows = rule_rows(spark, active)
    attrs = active.select("rule_id", "category", "description", "recommendation", "severity", "content", "level",
                          "remediation_template")
    f = rows.join(attrs, "rule_id")
    f = f.withColumn("is_anomaly", anomaly_flag("result"))
    # F3 (warehouse form): raw names from the rule's row, before hierarchy normalisation.
    f = f.withColumn("remediation_script", remediation(
        "is_anomaly", "remediation_template",
        {"table_name": F.col("table_name"), "column_name": F.col("column_name"),
         "warehouse_name": F.lit(source_name)}))
    f = normalize_hierarchy(f)
    f = f.withColumns({"workspace_name": F.lit(workspace_name).cast("string"),
                       "workspace_id": F.lit(workspace_id).cast("string"),
                       "source_name": F.lit(source_name), "source_id": F.lit(source_id or "N/A"),
                       "scan_date": scan_date(scan_ts), "table_path": F.lit(None).cast("string")})
    return conform(f, schemas.FINDINGS)


def connection_error(spark: SparkSession, source_name: str, message: str, scan_ts: datetime | str,
                     source_id: str | None = None) -> DataFrame:
    """One finding for a source that cannot be read."""
    r = CONNECTION_ERROR_RULE
    row = spark.createDataFrame([(r["rule_id"], r["level"], source_name, source_id or "N/A", r["category"],
                                  r["description"], r["recommendation"], r["severity"], r["content"],
                                  CONNECTION_ERROR_PREFIX + message)],
                                "rule_id string, level string, source_name string, source_id string, "
                                "category string, description string, recommendation string, severity int, "
                                "content string, result string")
    f = row.withColumns({"schema_name": F.lit("N/A"), "table_name": F.lit("N/A"), "column_name": F.lit("N/A"),
                         "is_anomaly": F.lit(False), "scan_date": scan_date(scan_ts)})
    return conform(f, schemas.FINDINGS)


def scan_warehouses(spark: SparkSession, sources: Mapping[str, str], rules_path: str, *,
                    scan_ts: datetime | str, table_names: list[str] | None = None) -> DataFrame:
    """Every source (name -> folder of tables) against the catalog. A source
    whose tables cannot be resolved yields the connection-error finding and the
    other sources still run."""
    rules = catalog.read_rules(spark, rules_path, strict=True)
    out = []
    for name, folder in sources.items():
        try:
            tables = load_tables(spark, folder, table_names)
            for df in tables.values():
                df.schema  # noqa: B018 - resolve now (file listing), not inside the union
        except PySparkException as e:
            out.append(connection_error(spark, name, f"source {name}: {e.getCondition() or type(e).__name__}", scan_ts))
            continue
        register_views(tables)
        # Views are resolved when each rule DataFrame is analysed, so the rules of
        # this source are bound to this source's tables before the next one registers.
        out.append(warehouse_rule_findings(spark, rules, source_name=name, scan_ts=scan_ts))
    return union_all(out)
