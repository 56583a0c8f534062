"""Rule catalog source.

``{"rules": [...]}`` JSON files, ``//`` comments allowed (the JSON reader's
``allowComments`` option, so ``https://`` inside strings survives). The
catalog is read with a fixed schema; ``status`` is read as text so ``true``,
``"true"`` and ``1`` all arrive as strings.
"""

from __future__ import annotations

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

RULE_FIELDS = ("id string, category string, description string, recommendation string, status string, "
               "severity int, content string, level string, sql_query string, duckdb_query string, "
               "duckdb_column_query string, pyspark_query string, remediation_template string")
# Levels a finding can be masked to.
LEVELS = ["tenant", "workspace", "lakehouse", "warehouse", "database", "schema", "table", "column"]
CATALOG_SCHEMA = f"rules array<struct<{RULE_FIELDS.replace(' string', ':string').replace(' int', ':int')}>>"


def read_rules(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per rule object. ``strict=False`` gives an empty catalog
    (with a warning) when the file is missing or invalid, like the lakehouse
    scanner; ``strict=True`` raises, like the warehouse scanner. A catalog is one row per rule and
    small; the lenient form reads it at once, since only then an invalid file shows."""
    try:
        raw = (spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").option("allowComments", "true")
               .option("mode", "FAILFAST").json(path))
        rules = raw.select(F.explode("rules").alias("r")).select("r.*")
        return rules if strict else spark.createDataFrame(rules.collect(), rules.schema)
    except Exception as e:  # a missing file is an analysis error, an invalid one an error of the job
        if strict or not isinstance(e, (PySparkException, Py4JError)):
            raise
        print(f"Warning: could not load rules from '{path}': {str(e).splitlines()[0]}")
        return spark.createDataFrame([], RULE_FIELDS)


def rule_problems(rules: DataFrame, mode: str = "warehouse") -> DataFrame:
    """R2: ``id, problem`` of rules that a scan could not run as they stand, one row per problem.

    Looked for: no id, an id used more than once, an unknown status or level, a severity outside 1 to 5, content ``query`` without SQL,
    and nothing to run and nothing to say (no SQL, program or recommendation)."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    uses = F.count(F.lit(1)).over(Window.partitionBy("id"))
    statuses = ["true", "false", "1", "0"] if mode == "warehouse" else ["true", "false"]
    found = {
        "no id": empty("id"),
        "id used more than once": ~empty("id") & (F.col("__uses") > 1),
        "unknown status": F.col("status").isNotNull() & ~F.col("status").isin(*statuses),
        "unknown level": F.col("level").isNotNull() & ~F.col("level").isin(*LEVELS),
        "severity outside 1 to 5": F.col("severity").isNotNull() & ~F.col("severity").between(1, 5),
        "query without SQL": (F.coalesce("content", F.lit("")) == "query") & empty("sql_query"),
        "nothing to run or say": (empty("sql_query") & empty("duckdb_query") & empty("pyspark_query") & empty("recommendation")),
    }
    problems = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in found.items())))
    return rules.withColumn("__uses", uses).select("id", F.explode(problems).alias("problem"))


def enabled(status: str | Column = "status", mode: str = "warehouse") -> Column:
    """R1/P5. ``warehouse``: enabled iff status is true / "true" / 1, missing = disabled.
    ``lakehouse``: missing = enabled, otherwise enabled iff the text is ``true``.
    (Read as text, JSON ``true`` and ``"true"`` are the same value.)"""
    s = F.col(status) if isinstance(status, str) else status
    if mode == "lakehouse":
        return s.isNull() | (s == "true")
    return F.coalesce(s.isin("true", "1"), F.lit(False))


def with_defaults(rules: DataFrame, mode: str = "warehouse") -> DataFrame:
    """Defaults per scanner and the catalog columns of ``schemas.RULES``.

    kind: ``metadata`` (SQL over the chunk view), ``query`` (SQL over tables),
    ``program`` (code text: not evaluated, see README), else ``guidance``.
    """
    lake = mode == "lakehouse"
    content = F.coalesce("content", F.lit("analysis" if lake else ""))
    kind = (F.when(F.coalesce(F.col("duckdb_query"), F.lit("")) != "", F.lit("metadata"))
            .when((content == "query") & (F.coalesce(F.col("sql_query"), F.lit("")) != ""), F.lit("query"))
            .when(F.coalesce(F.col("pyspark_query"), F.lit("")) != "", F.lit("program"))
            .otherwise(F.lit("guidance")))
    return rules.select(
        F.col("id").alias("rule_id"), "category", "description", "recommendation", "status",
        (F.coalesce("severity", F.lit(3)) if lake else F.col("severity")).alias("severity"),
        content.alias("content"), F.coalesce("level", F.lit("table" if lake else "database")).alias("level"),
        kind.alias("kind"), F.coalesce("duckdb_query", "sql_query").alias("sql"),
        F.col("duckdb_column_query").alias("column_sql"),
        F.coalesce("remediation_template", F.lit("")).alias("remediation_template"),
    ).select(*schemas.RULES.fieldNames())


def active_rules(rules: DataFrame, mode: str = "warehouse") -> DataFrame:
    """Enabled rules with defaults applied."""
    return with_defaults(rules.filter(enabled("status", mode)), mode)
