"""Findings assembly: check rows + rule attributes + location -> findings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.location import mask_by_level, qualified_name, remediation
from ..functions.text import DEFAULT_SCHEMA, NOT_AVAILABLE, result_text, scan_date


def conform(df: DataFrame, schema) -> DataFrame:
    """Select ``schema``'s columns in order, NULL-filling and casting as needed."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields])


def union_all(frames: Iterable[DataFrame], schema=None) -> DataFrame:
    """Union by name, absent columns NULL; of no frames, an empty one with ``schema`` (the findings' by default)."""
    frames = list(frames)
    if not frames:
        return SparkSession.active().createDataFrame([], schema or schemas.FINDINGS)
    if schema is not None:
        frames = [conform(f, schema) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def empty_findings(spark: SparkSession) -> DataFrame:
    """no findings still gives the full findings schema."""
    return spark.createDataFrame([], schemas.FINDINGS)


def assemble(checks: DataFrame, rules: DataFrame, *, scan_ts: datetime | str,
             source: Mapping[str, str] | None = None,
             tables: DataFrame | None = None) -> DataFrame:
    """F8: attach rule attributes and location to check rows.

    ``rules`` (the rule catalog) and ``tables`` (one row per table, grows with the lake) are joined
    without a hint, so that their measured size decides how.
    ``source`` gives constant location columns for a single warehouse.
    """
    checks = conform(checks, schemas.CHECKS)
    rule_cols = rules.select("rule_id", "category", "description", "recommendation", "severity",
                             "content", "level", "remediation_template")
    f = checks.join(rule_cols, "rule_id")
    if tables is not None:
        loc = tables.select("table_id", "workspace_name", "workspace_id",
                            F.col("lakehouse_name").alias("source_name"),
                            F.col("lakehouse_id").alias("source_id"),
                            F.col("table_path"),
                            F.col("schema_name").alias("_t_schema"),
                            F.col("table_name").alias("_t_table"))
        f = (f.join(loc, "table_id", "left")
             .withColumn("schema_name", F.coalesce("_t_schema", "schema_name"))
             .withColumn("table_name", F.coalesce("_t_table", "table_name"))
             .drop("_t_schema", "_t_table"))
    else:
        source = dict(source or {})
        f = f.withColumns({k: F.lit(source.get(k)).cast("string") for k in
                           ("workspace_name", "workspace_id", "source_name", "source_id", "table_path")})
    f = f.withColumn("schema_name", F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA)))
    f = f.withColumn("result", F.coalesce(F.col("result"), result_text("detail", "is_anomaly")))
    # column-level rows keep their column; everything else is masked by level (F2).
    keep = (F.col("level") == "column") & F.col("column_name").isNotNull()
    f = mask_by_level(f.withColumns({"_keep": keep, "_s": F.col("schema_name"),
                                     "_t": F.col("table_name"), "_c": F.col("column_name")}))
    f = f.withColumns({
        "schema_name": F.when(F.col("_keep"), F.col("_s")).otherwise(F.col("schema_name")),
        "table_name": F.when(F.col("_keep"), F.col("_t")).otherwise(F.col("table_name")),
        "column_name": F.when(F.col("_keep"), F.col("_c")).otherwise(F.col("column_name")),
    })
    values = {"table_name": F.col("table_name"), "column_name": F.col("column_name"),
              "lakehouse_name": F.col("source_name"), "warehouse_name": F.col("source_name"),
              "full_table_name": qualified_name(F.col("source_name"), F.col("table_name"))}
    f = f.withColumns({
        "remediation_script": remediation(
            "is_anomaly", "remediation_template", values,
            dynamic=F.when(F.col("level") != "column", F.col("dynamic_remediation"))),
        "scan_date": scan_date(scan_ts),
        "extra": F.lit(None).cast(schemas.MAP_SS),
    })
    return conform(f, schemas.FINDINGS)


def order_columns(df: DataFrame, priority: list[str] = schemas.FINDINGS_PRIORITY) -> DataFrame:
    """Priority columns first (those present), the rest in their original order."""
    first = [c for c in priority if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in priority])


def stringify(df: DataFrame) -> DataFrame:
    """every column as text (maps and structs as JSON)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("map", "struct", "array"):
            out.append(F.to_json(c).alias(f.name))
        else:
            out.append(c.cast("string").alias(f.name))
    return df.select(*out)


__all__ = ["assemble", "conform", "union_all", "empty_findings", "order_columns", "stringify",
           "NOT_AVAILABLE"]
