"""Schema checks over the ``columns`` frame (L4, L5, L7, L16, L23, Q8 names, Q11, Q13).

``columns`` has one row per (table, column); every check is a projection or
one grouped aggregate keyed by ``table_id`` over all tables at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import num

# --- fixed values -------------------------------------------------------------
SNAKE_CASE = r"^[a-z][a-z0-9_]*$"
AUDIT_COLUMN = r"(?i)^(created|updated|modified|inserted|loaded|ingested)_(at|on|date|ts|time|by)$"
SENSITIVE_NAME = (r"(?i)(e_?mail|phone|mobile|ssn|social_security|passport|credit_?card|card_?number"
                  r"|iban|birth|dob|address|salary|password|secret|token)")
# SQL:2016 reserved words that commonly collide with column names.
RESERVED_WORDS = ["all", "and", "any", "as", "between", "by", "case", "column", "current", "date",
                  "day", "end", "foreign", "from", "group", "hour", "index", "join", "key", "level",
                  "minute", "month", "order", "primary", "references", "second", "select", "start",
                  "table", "time", "timestamp", "union", "user", "value", "values", "where", "year"]
DEPRECATED_PHYSICAL = ["INT96"]
LAYER_PREFIX = r"(?i)^(bronze|silver|gold)_"
WIDE_TABLE_WARNING = "WARNING: Wide table detected. Consider splitting into multiple tables."
# -------------------------------------------------------------------------------


def _col_checks(df: DataFrame, rule_id: str, detail: Column, anomaly: Column,
                column: str = "column_name") -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), "table_id", F.lit(None).cast("string").alias("schema_name"),
                     F.col("table_id").alias("table_name"), F.col(column).alias("column_name"),
                     detail.alias("detail"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"))


def _tbl_checks(df: DataFrame, rule_id: str, detail: Column, anomaly: Column) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), "table_id", F.lit(None).cast("string").alias("schema_name"),
                     F.col("table_id").alias("table_name"), F.lit(None).cast("string").alias("column_name"),
                     detail.alias("detail"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"))


def column_naming(columns: DataFrame) -> DataFrame:
    """L4: column names in lower snake_case."""
    ok = F.col("column_name").rlike(SNAKE_CASE)
    detail = F.concat(F.lit("Column "), F.col("column_name"),
                      F.when(ok, F.lit(" follows snake_case")).otherwise(F.lit(" is not snake_case")))
    return _col_checks(columns, "L4", detail, ~ok)


def naming_standard(columns: DataFrame) -> DataFrame:
    """Q11: snake_case and not a reserved word."""
    reserved = F.lower("column_name").isin(*RESERVED_WORDS)
    snake = F.col("column_name").rlike(SNAKE_CASE)
    detail = F.concat(F.lit("Column "), F.col("column_name"),
                      F.when(reserved, F.lit(" is a reserved word"))
                      .when(~snake, F.lit(" is not snake_case"))
                      .otherwise(F.lit(" follows the naming standard")))
    return _col_checks(columns, "Q11", detail, reserved | ~snake)


def sensitive_names(columns: DataFrame) -> DataFrame:
    """Q8 (names): column names that suggest personal or secret data."""
    hit = F.col("column_name").rlike(SENSITIVE_NAME)
    detail = F.concat(F.lit("Column "), F.col("column_name"),
                      F.when(hit, F.lit(" name suggests sensitive data"))
                      .otherwise(F.lit(" name suggests no sensitive data")))
    return _col_checks(columns, "Q8N", detail, hit)


def audit_columns(columns: DataFrame) -> DataFrame:
    """Tables without audit columns."""
    g = columns.groupBy("table_id").agg(F.count_if(F.col("column_name").rlike(AUDIT_COLUMN)).alias("a"),
                                        F.count(F.lit(1)).alias("n"))
    detail = F.concat(F.lit("Table has "), num("a"), F.lit(" audit columns among "), num("n"), F.lit(" columns"))
    return _tbl_checks(g, "L7", detail, F.col("a") == 0)


def column_docs(columns: DataFrame, min_pct: int = 50) -> DataFrame:
    """Share of columns with a comment; anomaly below ``min_pct``%."""
    g = columns.groupBy("table_id").agg(
        F.count_if(F.col("comment").isNotNull() & (F.trim("comment") != "")).alias("d"),
        F.count(F.lit(1)).alias("n"))
    detail = F.concat(num("d"), F.lit(" of "), num("n"), F.lit(" columns documented"))
    return _tbl_checks(g, "L16", detail, F.col("d") * 100 < F.col("n") * min_pct)


def wide_tables(columns: DataFrame, max_columns: int = 50) -> DataFrame:
    """The sample rule: column count, warning above ``max_columns``."""
    g = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n"))
    wide = F.col("n") > max_columns
    detail = F.concat(F.lit("Table has "), num("n"), F.lit(" columns"),
                      F.when(wide, F.lit("\n" + WIDE_TABLE_WARNING)).otherwise(F.lit("")))
    return _tbl_checks(g, "L23", detail, wide)


def _top_level(path: Column) -> Column:
    return F.substring_index(path, ".", 1)


def nullability(columns: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nullable columns whose footer statistics show no NULL at all.

    Chunk NULL counts are summed per (table, top-level column) first, then
    joined to ``columns`` on that key (both sides are one row per column).
    """
    nulls = (chunks.groupBy("table_id", _top_level(F.col("path_in_schema")).alias("column_name"))
             .agg(F.sum("stats_null_count").cast("long").alias("nulls"),
                  F.count_if(F.col("stats_null_count").isNull()).alias("no_stats")))
    j = columns.join(nulls, ["table_id", "column_name"], "left")
    detail = F.concat(F.lit("Column "), F.col("column_name"),
                      F.when(F.col("nullable"), F.lit(" is nullable")).otherwise(F.lit(" is NOT NULL")),
                      F.lit(" and holds "), F.coalesce(num("nulls"), F.lit("unknown")), F.lit(" NULL values"))
    anomaly = F.col("nullable") & (F.col("nulls") == 0) & (F.col("no_stats") == 0)
    return _col_checks(j, "L5", detail, anomaly)


def nullable_tables(columns: DataFrame) -> DataFrame:
    """L5 (table part, id L5T): tables that declare no column NOT NULL."""
    g = columns.groupBy("table_id").agg(F.count_if(F.col("nullable")).alias("k"), F.count(F.lit(1)).alias("n"))
    detail = F.concat(num("k"), F.lit(" of "), num("n"), F.lit(" columns are nullable"))
    return _tbl_checks(g, "L5T", detail, F.col("k") == F.col("n"))


def deprecated_types(chunks: DataFrame) -> DataFrame:
    """Q13: columns stored with a deprecated physical type (INT96 timestamps)."""
    g = (chunks.groupBy("table_id", _top_level(F.col("path_in_schema")).alias("column_name"))
         .agg(F.count_if(F.col("type").isin(*DEPRECATED_PHYSICAL)).alias("dep"),
              F.concat_ws(", ", F.array_sort(F.collect_set("type"))).alias("types")))
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(" uses physical type "), F.col("types"),
                      F.when(F.col("dep") > 0, F.lit(" (deprecated)")).otherwise(F.lit("")))
    return _col_checks(g, "Q13", detail, F.col("dep") > 0)


def layer_naming(tables: DataFrame) -> DataFrame:
    """L1: table names carry a medallion layer prefix (``bronze_``, ``silver_``, ``gold_``)."""
    ok = F.col("table_name").rlike(LAYER_PREFIX)
    detail = F.concat(F.lit("Table "), F.col("table_name"),
                      F.when(ok, F.lit(" has a layer prefix")).otherwise(F.lit(" has no layer prefix")))
    return tables.select(F.lit("L1").alias("rule_id"), "table_id", F.lit(None).cast("string").alias("schema_name"),
                         "table_name", F.lit(None).cast("string").alias("column_name"), detail.alias("detail"),
                         (~ok).alias("is_anomaly"))
