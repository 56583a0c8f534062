"""Security and governance checks (Q8 values, Q9, Q10, Q15, Q16).

Sensitive-value detection scans whole texts with regular expressions in one
fused aggregate per table (JVM regex, no Python). Policy, grant, dependency
and settings inputs are DataFrames supplied by the caller; the checks are
joins and grouped aggregates over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import num
from .quality import ident, sql_str, union_tree

# --- fixed values (RE2 / Java common subset) ------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"
PRIVILEGED_ROLES = ["db_owner", "db_securityadmin", "db_accessadmin"]
# ---------------------------------------------------------------------------------


def sensitive_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Q8 (values): rows of each text column that contain an e-mail, phone or card-number shape.

    One global aggregate per table over whole texts (three ``count_if`` per
    text column, built as SQL text in one call), then an ``inline`` unpivot.
    """
    parts = []
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        if not cols:
            continue
        aggs = ["count(1) AS `__rows`"]
        rows = []
        for i, c in enumerate(cols):
            x = ident(c)
            # contains('@') is a cheap guard evaluated first, so the e-mail regex only scans candidates.
            aggs += [f"count_if(contains({x}, '@') AND {x} RLIKE {sql_str(EMAIL)}) AS `e{i}`",
                     f"count_if({x} RLIKE {sql_str(PHONE)}) AS `p{i}`",
                     f"count_if({x} RLIKE {sql_str(CARD)}) AS `c{i}`"]
            rows.append(f"named_struct('column_name', {sql_str(c)}, 'e', `e{i}`, 'p', `p{i}`, 'c', `c{i}`)")
        one = df.select(*[F.col(ident(c)) for c in cols]).selectExpr(*aggs)
        parts.append(one.selectExpr(f"{sql_str(name)} AS table_name", "`__rows` AS rows",
                                    f"inline(array({', '.join(rows)}))"))
    prof = union_tree(parts)
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(": "), num("e"), F.lit(" e-mail, "), num("p"),
                      F.lit(" phone and "), num("c"), F.lit(" card-number shaped values in "), num("rows"),
                      F.lit(" rows"))
    return prof.select(F.lit("Q8V").alias("rule_id"), F.col("table_name").alias("table_id"),
                       F.lit("dbo").alias("schema_name"), "table_name", "column_name", detail.alias("detail"),
                       ((F.col("e") + F.col("p") + F.col("c")) > 0).alias("is_anomaly"))


def policy_coverage(sensitive: DataFrame, policies: DataFrame) -> DataFrame:
    """Q9: sensitive columns (anomalous rows of Q8) with or without a policy row.

    ``policies``: (table_name, column_name, policy). Policies are reduced to one
    row per column before the left join, so the join never multiplies rows.
    """
    s = sensitive.filter("is_anomaly").select("table_id", "table_name", "column_name").distinct()
    p = policies.groupBy("table_name", "column_name").agg(
        F.concat_ws(", ", F.array_sort(F.collect_set("policy"))).alias("policies"))
    j = s.join(p, ["table_name", "column_name"], "left")
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(" holds sensitive data; "),
                      F.when(F.col("policies").isNull(), F.lit("no masking policy"))
                      .otherwise(F.concat(F.lit("policies: "), F.col("policies"))))
    return j.select(F.lit("Q9").alias("rule_id"), "table_id", F.lit("dbo").alias("schema_name"), "table_name",
                    "column_name", detail.alias("detail"), F.col("policies").isNull().alias("is_anomaly"))


def privileged_grants(grants: DataFrame, max_members: int = 3,
                      roles: Sequence[str] = tuple(PRIVILEGED_ROLES)) -> DataFrame:
    """Q10: members per privileged role; anomaly above ``max_members``.

    ``grants``: (principal, role). Counted with a partial aggregate per role.
    """
    g = (grants.filter(F.col("role").isin(*roles)).groupBy("role")
         .agg(F.countDistinct("principal").alias("n")))
    detail = F.concat(F.lit("Role "), F.col("role"), F.lit(" has "), num("n"), F.lit(" members"))
    return g.select(F.lit("Q10").alias("rule_id"), F.lit(None).cast("string").alias("table_id"),
                    F.lit(None).cast("string").alias("schema_name"), F.lit(None).cast("string").alias("table_name"),
                    F.col("role").alias("column_name"), detail.alias("detail"),
                    (F.col("n") > max_members).alias("is_anomaly"))


def cross_schema(edges: DataFrame) -> DataFrame:
    """Q15: dependencies between schemas. ``edges``: (from_schema, from_object, to_schema,
    to_object, weight); one row per schema pair, anomaly when the schemas differ."""
    g = edges.groupBy("from_schema", "to_schema").agg(
        F.count(F.lit(1)).alias("deps"), F.sum("weight").cast("long").alias("weight"))
    detail = F.concat(F.lit("Schema "), F.col("from_schema"), F.lit(" -> "), F.col("to_schema"), F.lit(": "),
                      num("deps"), F.lit(" dependencies, "), num("weight"), F.lit(" referencing rows"))
    return g.select(F.lit("Q15").alias("rule_id"), F.lit(None).cast("string").alias("table_id"),
                    F.col("from_schema").alias("schema_name"), F.lit(None).cast("string").alias("table_name"),
                    F.col("to_schema").alias("column_name"), detail.alias("detail"),
                    (F.col("from_schema") != F.col("to_schema")).alias("is_anomaly"))


def settings_compliance(actual: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Q16: actual settings per source vs the expected policy value.

    ``actual``: (source, settings map<string,string>), one row per source. The
    expected policy is a literal map, so each source row is expanded in place
    (no join, no product); a missing setting compares as NULL.
    """
    exp = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    rows = actual.select("source", F.explode(F.transform(
        F.map_keys(exp), lambda k: F.struct(k.alias("setting"), exp[k].alias("expected"),
                                            F.col("settings")[k].alias("actual")))).alias("s"))
    detail = F.concat(F.lit("Setting "), F.col("s.setting"), F.lit(" is "), F.coalesce(F.col("s.actual"), F.lit("unset")),
                      F.lit(" (expected "), F.col("s.expected"), F.lit(")"))
    return rows.select(F.lit("Q16").alias("rule_id"), F.col("source").alias("table_id"),
                       F.lit(None).cast("string").alias("schema_name"), F.col("source").alias("table_name"),
                       F.col("s.setting").alias("column_name"), detail.alias("detail"),
                       (~F.col("s.actual").eqNullSafe(F.col("s.expected"))).alias("is_anomaly"))
