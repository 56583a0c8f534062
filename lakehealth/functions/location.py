"""Location columns of a finding: hierarchy (F1), level masking (F2),
remediation text (F3), table paths (P10, P11, P15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DEFAULT_SCHEMA, NOT_AVAILABLE, UNKNOWN, col_, fill_template

_EMPTYISH = ("N/A", "None", "")


def _falsy(c: Column) -> Column:
    return c.isNull() | (c == "")


def _unset(c: Column) -> Column:
    """Missing, or one of the placeholder texts ``N/A`` / ``None`` / empty."""
    return c.isNull() | c.isin(*_EMPTYISH)


def normalize_hierarchy(df: DataFrame, level: str = "level", schema: str = "schema_name",
                        table: str = "table_name", column: str = "column_name") -> DataFrame:
    """make schema/table/column consistent, in this order.

    1. ``schema.table`` in the table name is split at the first dot when no schema is set;
    2. a schema-level finding with an undotted table name takes it as the schema;
    3. a column without a table gets table ``N/A``;
    4. a table without a schema gets ``dbo``;
    5. empty or ``None`` values become ``N/A``.
    """
    s0 = F.col(schema).cast("string")
    t0 = F.col(table).cast("string")
    c0 = F.col(column).cast("string")
    lv = F.col(level)
    dotted = ~_falsy(t0) & t0.contains(".") & _falsy(s0)
    schema_lvl = ~_falsy(t0) & ~t0.contains(".") & _falsy(s0) & (lv == "schema")
    s1 = F.when(dotted, F.substring_index(t0, ".", 1)).when(schema_lvl, t0).otherwise(s0)
    t1 = (F.when(dotted, F.split(t0, r"\.", 2).getItem(1))
          .when(schema_lvl, F.lit(None).cast("string")).otherwise(t0))
    t2 = F.when(~_falsy(c0) & _unset(t1), F.lit(NOT_AVAILABLE)).otherwise(t1)
    s2 = F.when(~_falsy(t2) & ~_unset(t2) & _unset(s1), F.lit(DEFAULT_SCHEMA)).otherwise(s1)

    def fill(c: Column) -> Column:
        return F.when(_falsy(c) | (c == "None"), F.lit(NOT_AVAILABLE)).otherwise(c)

    return df.withColumns({schema: fill(s2), table: fill(t2), column: fill(c0)})


def mask_by_level(df: DataFrame, level: str = "level", schema: str = "schema_name",
                  table: str = "table_name", column: str = "column_name") -> DataFrame:
    """lakehouse/database level keeps no location below the source; schema level
    keeps the schema; every other level keeps schema and table. Column is ``N/A``."""
    lv = F.col(level)
    top = lv.isin("lakehouse", "database")
    na = F.lit(NOT_AVAILABLE)
    return df.withColumns({
        schema: F.when(top, na).otherwise(F.col(schema)),
        table: F.when(top | (lv == "schema"), na).otherwise(F.col(table)),
        column: na,
    })


def remediation(is_anomaly: str | Column, template: str | Column, values: dict,
                dynamic: str | Column | None = None) -> Column:
    """only anomalies get a script; a dynamic script wins over the template;
    an empty template gives none."""
    tpl = col_(template)
    filled = F.when(tpl.isNotNull() & (tpl != ""), fill_template(tpl, values))
    script = filled if dynamic is None else F.coalesce(
        F.when(col_(dynamic) != "", col_(dynamic)), filled)
    return F.when(col_(is_anomaly), script)


def table_path(workspace: str | Column, lakehouse: str | Column, table: str | Column,
               host: str, item_kind: str = "Lakehouse") -> Column:
    """P10: ``abfss://<ws>@<host>/<lh>.<kind>/Tables/<table>``; NULL part -> NULL path."""
    return F.concat(F.lit("abfss://"), col_(workspace), F.lit("@" + host + "/"),
                    col_(lakehouse), F.lit("." + item_kind + "/Tables/"), col_(table))


# P11 fixed pattern: container @ host / name . kind / Tables / first segment /
TABLE_PATH_PATTERN = r"abfss://([^@]+)@[^/]+/([^/]+)\.([^/]+)/Tables/([^/]+)/"


def parse_table_path(path: str | Column) -> dict[str, Column]:
    """Container, lakehouse, item kind and table from a path; NULLs on no match.

    Greedy like the reference: the lakehouse name ends at the *last* dot of the
    segment, and only the first segment after ``Tables/`` is taken.
    """
    p = col_(path)

    def grp(i: int) -> Column:
        return F.nullif(F.regexp_extract(p, TABLE_PATH_PATTERN, i), F.lit(""))

    return {"lakehouse_container": grp(1), "lakehouse_name": grp(2),
            "lakehouse_type": grp(3), "table_name": grp(4)}


def qualified_name(source: str | Column, table: str | Column) -> Column:
    """``source.table`` with ``unknown`` for a missing part."""
    return F.concat_ws(".", F.coalesce(col_(source), F.lit(UNKNOWN)),
                       F.coalesce(col_(table), F.lit(UNKNOWN)))
