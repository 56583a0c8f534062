"""Catalog rules over lakehouse metadata, by kind.

A rule of kind ``metadata`` is SQL over the metadata views; one of kind ``program`` is a Python
function registered under the rule's id, which builds a DataFrame from the metadata frames.
Code text in a catalog is never evaluated. Every rule runs and is written to the shared folder
on its own, so one that fails, also while it runs, becomes its own error rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import anomaly_flag, is_blank, strip_ws, with_default_indicator
from ..session import shared_dir
from ..sources import catalog
from .evaluate import error_text, metadata_rule
from .lakehouse import Metadata, register_metadata_views

#: rule id -> function(metadata) that returns ``table_id, result[, column_name][, remediation]``.
PROGRAMS: dict[str, Callable[[Metadata], DataFrame]] = {}
RESULT = ["rule_id", "table_id", "column_name", "result", "is_anomaly"]


def program(rule_id: str):
    """Register the function that answers a rule of kind ``program``."""
    def register(function: Callable[[Metadata], DataFrame]) -> Callable[[Metadata], DataFrame]:
        PROGRAMS[rule_id] = function
        return function
    return register


@program("LR002")
def rows_and_groups(md: Metadata) -> DataFrame:
    """Rows and row groups of every table, from its footers."""
    groups = md.chunks.select("table_id", "file_path", "row_group_id", "row_group_num_rows").distinct()
    g = groups.groupBy("table_id").agg(F.sum("row_group_num_rows").alias("rows"), F.count(F.lit(1)).alias("groups"))
    return g.select("table_id", F.concat(F.col("rows").cast("string"), F.lit(" rows in "),
                                         F.col("groups").cast("string"), F.lit(" row groups")).alias("result"))


@program("LS006")
def undocumented_columns(md: Metadata) -> DataFrame:
    """A finding per column: whether the table's schema has a comment for it."""
    bare = F.coalesce(F.trim("comment"), F.lit("")) == ""
    return md.columns.select("table_id", "column_name", F.concat(
        F.lit("Column "), F.col("column_name"), F.when(bare, F.lit(" has no comment")).otherwise(F.lit(" has a comment")),
        F.when(bare, F.lit("\n\nIndicator: Anomaly - ERR_1001")).otherwise(F.lit("\n\nIndicator: Optimized - OPT_2001"))).alias("result"))


@program("LS007")
def removed_files(md: Metadata) -> DataFrame:
    """Share of files that the log has removed and their clean-up, as a script made for each table."""
    log = md.log.groupBy("table_id").agg(F.count_if(F.col("remove").isNotNull()).alias("gone"),
                                         F.count_if(F.col("add").isNotNull()).alias("added"))
    named = md.tables.select("table_id", "table_name", "schema_name").join(log, "table_id", "left").fillna(0)
    return named.select(
        "table_id", F.concat(F.col("gone").cast("string"), F.lit(" removes and "), F.col("added").cast("string"), F.lit(" adds in the log"),
                             F.when(F.col("gone") > 0, F.lit("\n\nIndicator: Anomaly - ERR_1001")).otherwise(F.lit(""))).alias("result"),
        F.concat(F.lit("VACUUM "), F.col("schema_name"), F.lit("."), F.col("table_name"), F.lit(" -- "), F.col("gone").cast("string"),
                 F.lit(" files")).alias("remediation"))


def program_rows(rule_id: str, md: Metadata) -> DataFrame:
    """Rows of a program rule: ``RESULT`` and ``dynamic_remediation``. Its function returns ``table_id, result`` and, if it has them,
    ``column_name`` (column findings) and ``remediation`` (a script of its own). It sees every metadata frame, in a lake scan
    the log too, and works on all tables at once, so no table's log is gathered in one task."""
    df = PROGRAMS[rule_id](md)
    given = lambda c: (F.col(c) if c in df.columns else F.lit(None)).cast("string")
    rows = df.select("table_id", given("column_name").alias("column_name"), strip_ws(F.col("result").cast("string")).alias("result"),
                     given("remediation").alias("dynamic_remediation")).filter(~is_blank("result"))
    result = with_default_indicator(F.col("result"))
    return rows.select(F.lit(rule_id).alias("rule_id"), "table_id", "column_name", result.alias("result"),
                       anomaly_flag(result).alias("is_anomaly"), "dynamic_remediation")


def program_rule(rule_id: str, md: Metadata) -> DataFrame:
    return program_rows(rule_id, md).select(*RESULT)


def failed(rule_id: str, message: str, tables: DataFrame) -> DataFrame:
    """One error row per table for a rule that could not run."""
    return tables.select(F.lit(rule_id).alias("rule_id"), "table_id", F.lit(None).cast("string").alias("column_name"),
                         F.lit(f"Error analyzing rule {rule_id}: {message}").alias("result"),
                         F.lit(False).alias("is_anomaly"))


def catalog_results(spark: SparkSession, rules: DataFrame, md: Metadata, tables: DataFrame) -> DataFrame:
    """The rows of every enabled metadata and program rule over all tables at once."""
    shared_dir(spark)
    register_metadata_views(md)
    active = catalog.active_rules(rules, "lakehouse").filter(F.col("kind").isin("metadata", "program"))
    parts = []
    for rule in active.orderBy("rule_id").collect():  # the catalog: tens of rows
        rid = rule["rule_id"]
        try:
            if rule["kind"] == "metadata":
                part = metadata_rule(spark, rule.asDict(), tables)
            elif rid in PROGRAMS:
                part = program_rule(rid, md)
            else:
                part = failed(rid, "no function is registered for it", tables)
            parts.append(part.select(*RESULT).checkpoint(eager=True))
        except PySparkException as e:
            parts.append(failed(rid, error_text(e), tables))
    empty = spark.createDataFrame([], "rule_id string, table_id string, column_name string, result string, "
                                      "is_anomaly boolean")
    return reduce(DataFrame.unionByName, parts, empty)
