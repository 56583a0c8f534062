"""Mergeable column sketches (L12, L20, Q7): profiles of runs or partitions that add up without reading old data again.

``sketch`` reads each table once and gives, per column, counts, a HyperLogLog sketch (distinct values), a KLL sketch (quantiles of
numbers and times, as doubles) and a frequent-items sketch (heaviest values). ``merge`` adds up any number of such rows, of
runs, days or tables' parts, and ``estimates`` reads the numbers off. All three are Spark's own aggregates, with partial
aggregation in each task and a fixed size per column whatever the rows.

Errors, from the sketches' parameters: distinct values 1.6 % (standard error at ``HLL_BITS`` 12), ranks of quantiles 1.3 % (``KLL_SIZE``
200), counts of values at most ``3.5 / TOP_ITEMS`` of the rows too low or high, and none while a column has no more than three quarters
of ``TOP_ITEMS`` distinct values. Texts longer than ``LONG_TEXT`` characters count as their digest. NULLs are only counted.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import ident, kind_of, sql_str, union_tree

HLL_BITS, KLL_SIZE, TOP_ITEMS, LONG_TEXT = 12, 200, 4096, 64


def sketch(tables: Mapping[str, DataFrame], run: str) -> DataFrame:
    """``run, table_name, column_name, rows, nonnull, hll, kll, top`` of every atomic column."""
    parts = []
    for name, df in tables.items():
        aggs, rows = ["count(1) AS `__rows`"], []
        for i, f in enumerate(df.schema.fields):
            kind, c = kind_of(f.dataType), ident(f.name)
            if kind == "complex":
                continue
            text = f"CAST({c} AS STRING)"
            value = f"IF(length({text}) > {LONG_TEXT}, sha2({text}, 256), {text})" if kind == "string" else text
            number = {"temporal": f"CAST(CAST({c} AS TIMESTAMP) AS DOUBLE)", "integral": f"CAST({c} AS DOUBLE)",
                      "fractional": f"CAST({c} AS DOUBLE)"}.get(kind)
            aggs += [f"count({c}) AS n{i}", f"hll_sketch_agg({value}, {HLL_BITS}) AS h{i}",
                     f"approx_top_k_accumulate({value}, {TOP_ITEMS}) AS t{i}"]
            if number:
                aggs.append(f"kll_sketch_agg_double({number}, {KLL_SIZE}) AS k{i}")
            rows.append(f"named_struct('column_name', {sql_str(f.name)}, 'nonnull', n{i}, 'hll', h{i}, "
                        f"'kll', {f'k{i}' if number else 'CAST(NULL AS BINARY)'}, 'top', t{i})")
        if rows:
            parts.append(df.selectExpr(*aggs).selectExpr(f"{sql_str(run)} AS run", f"{sql_str(name)} AS table_name",
                                                         "`__rows` AS rows", f"inline(array({', '.join(rows)}))"))
    return union_tree(parts)


def merge(sketches: DataFrame) -> DataFrame:
    """One row per (table, column): the sketches of all runs added up."""
    return sketches.groupBy("table_name", "column_name").agg(
        F.sum("rows").alias("rows"), F.sum("nonnull").alias("nonnull"), F.expr("hll_union_agg(hll)").alias("hll"),
        F.expr(f"kll_merge_agg_double(kll, {KLL_SIZE}) FILTER (WHERE kll IS NOT NULL)").alias("kll"),
        F.expr(f"approx_top_k_combine(top, {TOP_ITEMS})").alias("top"))


def estimates(merged: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """``table_name, column_name, rows, nonnull, distinct, numbers, quantiles, top_value, top_count``."""
    some = F.col("nonnull") > 0
    numeric = some & (F.expr("kll_sketch_get_n_double(kll)") > 0)  # the merged sketch of a text column is empty
    asked = ", ".join(f"CAST({p} AS DOUBLE)" for p in quantiles)
    best = F.expr("filter(approx_top_k_estimate(top, 2), x -> x.item IS NOT NULL)")
    return merged.select(
        "table_name", "column_name", "rows", "nonnull", F.expr("hll_sketch_estimate(hll)").alias("distinct"),
        F.when(numeric, F.expr("kll_sketch_get_n_double(kll)")).alias("numbers"),
        F.when(numeric, F.expr(f"kll_sketch_get_quantile_double(kll, array({asked}))")).alias("quantiles"),
        F.when(some, F.get(best, F.lit(0))).alias("best")) \
        .select("*", F.col("best.item").alias("top_value"), F.col("best.count").alias("top_count")).drop("best")
