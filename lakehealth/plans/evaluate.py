"""Evaluation of catalog rules written as SQL.

Metadata rules (R3/R4) are SQL over the ``chunks`` view, written
set-oriented: they return ``table_id, result`` (and ``table_id, column_name,
result`` for per-column rules) for every table at once, instead of one
``df`` per table. Table rules (R5) are SQL over the user's table views and
return ``table_name, column_name, result`` plus any extra columns.

A table rule that fails to analyse (bad SQL, missing column) or while it runs
(``isolated``) becomes an error finding (R10) and the remaining rules still run.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..session import shared_dir
from ..functions.text import (FOUND_ISSUE_PREFIX, GUIDANCE_ONLY, METADATA_MISSING,
                              QUERY_ERROR_PREFIX, anomaly_flag, is_blank, strip_ws)


def error_text(error: PySparkException) -> str:
    """The whole message, without the query plan Spark appends (its ids differ from run to run)."""
    return error.getMessage() or str(error)


def _analysed(spark: SparkSession, sql: str) -> DataFrame:
    df = spark.sql(sql)
    df.schema  # noqa: B018 - trigger analysis so errors surface here, per rule
    return df


def _rule_rows(rule: Mapping, df: DataFrame) -> DataFrame:
    return df.select(F.lit(rule["rule_id"]).alias("rule_id"), *[c for c in df.columns])


def metadata_rule(spark: SparkSession, rule: Mapping, tables: DataFrame, chunks_view: str = "chunks") -> DataFrame:
    """R3/R4/R9/R13 for one metadata SQL rule over all tables.

    Output: rule_id, table_id, column_name, result, is_anomaly.
    * tables without any chunk row get the fixed "metadata not available" text (R9);
    * a per-column rule at level ``column`` fans out to its surviving column rows;
      tables without such rows fall back to the table-level text (F4);
    * results are whitespace-stripped and blank ones dropped (P6, F9).
    """
    rid = rule["rule_id"]
    try:
        table_level = _analysed(spark, rule["sql"]).select(
            F.col("table_id"), strip_ws(F.col("result").cast("string")).alias("result"))
        col_sql = rule.get("column_sql")
        col_level = None
        if col_sql and rule.get("level") == "column":
            c = _analysed(spark, col_sql)
            col_level = c.select(
                "table_id",
                F.when(is_blank(F.col("column_name").cast("string")), F.lit("N/A"))
                .otherwise(F.col("column_name").cast("string")).alias("column_name"),
                strip_ws(F.col("result").cast("string")).alias("result"),
            ).filter(~is_blank("result"))
    except PySparkException as e:
        return tables.select(F.lit(rid).alias("rule_id"), "table_id",
                             F.lit(None).cast("string").alias("column_name"),
                             F.lit(f"Error analyzing rule {rid}: {error_text(e)}").alias("result"),
                             F.lit(False).alias("is_anomaly"))
    has_meta = spark.table(chunks_view).select("table_id").distinct().withColumn("__m", F.lit(True))
    t = tables.select("table_id").join(has_meta, "table_id", "left")
    missing = t.filter(F.col("__m").isNull()).select("table_id", F.lit(None).cast("string").alias("column_name"),
                                                     F.lit(METADATA_MISSING).alias("result"))
    present = table_level.join(t.filter(F.col("__m")).select("table_id"), "table_id", "left_semi")
    if col_level is not None:
        col_level = col_level.join(t.filter(F.col("__m")).select("table_id"), "table_id", "left_semi")
        covered = col_level.select("table_id").distinct()
        present = present.join(covered, "table_id", "left_anti")
        rows = col_level.unionByName(present.withColumn("column_name", F.lit(None).cast("string")))
    else:
        rows = present.withColumn("column_name", F.lit(None).cast("string"))
    out = rows.unionByName(missing).filter(~is_blank("result"))
    return out.select(F.lit(rid).alias("rule_id"), "table_id", "column_name", "result",
                      anomaly_flag("result").alias("is_anomaly"))


#: Names a rule may return for each standard column, best first (fixed values).
COLUMN_ALIASES = {"table_name": ("tablename", "name"), "column_name": ("columnname",)}


def standardize_columns(df: DataFrame) -> DataFrame:
    """A missing standard column takes over the first of its aliases that the rule returned.
    Names are compared exactly (Spark itself resolves them case-insensitively)."""
    have = set(df.columns)
    found = {standard: next(filter(have.__contains__, aliases), None)
             for standard, aliases in COLUMN_ALIASES.items() if standard not in have}
    return df.withColumnsRenamed({alias: standard for standard, alias in found.items() if alias})


def table_rule(spark: SparkSession, rule: Mapping) -> DataFrame:
    """A table SQL rule -> rows (rule_id, schema_name, table_name, column_name, result, extra).

    P8: without a ``result`` column every row gets ``Found issue with <id>``.
    F5: columns other than table/column/result go to the ``extra`` map (as text);
    a returned ``schema_name`` is kept as the schema.
    R10: a rule that fails analysis becomes one ``Error executing query`` row.
    """
    rid = rule["rule_id"]
    try:
        df = standardize_columns(_analysed(spark, rule["sql"]))
    except PySparkException as e:
        return error_row(spark, rid, e)
    cols = df.columns
    if "result" not in cols:
        df = df.withColumn("result", F.lit(FOUND_ISSUE_PREFIX + rid))
    extras = [c for c in cols if c not in ("table_name", "column_name", "result", "schema_name")]
    extra = (F.map_from_arrays(F.array(*[F.lit(c) for c in extras]),
                               F.array(*[F.col(f"`{c}`").cast("string") for c in extras]))
             if extras else F.lit(None).cast(schemas.MAP_SS))
    pick = lambda c: F.col(c).cast("string") if c in cols else F.lit(None).cast("string")
    return df.select(F.lit(rid).alias("rule_id"), pick("schema_name").alias("schema_name"),
                     pick("table_name").alias("table_name"), pick("column_name").alias("column_name"),
                     F.col("result").cast("string").alias("result"), extra.alias("extra"))


_TABLE_RULE_SCHEMA = "rule_id string, schema_name string, table_name string, column_name string, result string, extra map<string,string>"


def error_row(spark: SparkSession, rule_id: str, error: PySparkException) -> DataFrame:
    """The one row of a rule that failed."""
    message = QUERY_ERROR_PREFIX + error_text(error)
    return spark.createDataFrame([(rule_id, None, None, None, message, None)], _TABLE_RULE_SCHEMA)


def isolated(spark: SparkSession, rule: Mapping) -> DataFrame:
    """The rows of one rule, run and written to the shared folder on its own: an error while it
    runs (a bad cast, an overflow) becomes its R10 row and no other rule is affected."""
    shared_dir(spark)
    try:
        return table_rule(spark, rule).checkpoint(eager=True)
    except PySparkException as e:
        return error_row(spark, rule["rule_id"], e)


def guidance_rows(spark: SparkSession, rules: DataFrame) -> DataFrame:
    """Active rules that are not SQL queries -> one guidance row each."""
    g = rules.filter((F.col("content") != "query") | F.col("sql").isNull() | (F.col("sql") == ""))
    return g.select("rule_id", *[F.lit(None).cast("string").alias(c) for c in
                                 ("schema_name", "table_name", "column_name")],
                    F.lit(GUIDANCE_ONLY).alias("result"), F.lit(None).cast(schemas.MAP_SS).alias("extra"))
