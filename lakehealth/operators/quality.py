"""Data-quality checks over the user's tables.

Per-column checks share one fused aggregate per table (``column_profile``):
every requested metric of every column is computed in a single scan with
map-side partial aggregation, then unpivoted to one row per column. Key-based
checks (duplicates, FK orphans, skew) first collapse rows to one row per key
value with a partial aggregate, so a hot key costs one row in the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import idiv, num, pct_text, ratio_text

# Fixed shapes (RE2 and Java regex agree on these).
NUMERIC_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"

# Types a text may stand for, narrowest first, with the shape of a whole value; casts reject impossible ones.
# A value of a type is also one of the wider types of its line: boolean, or long < double, or date < timestamp.
TEXT_TYPES = {
    "boolean": (r"^(true|false|TRUE|FALSE|True|False)$", None),
    "bigint": (r"^[+-]?[0-9]{1,18}$", None),
    "double": (r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,3})?$", "double"),
    "date": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "date"),
    "timestamp": (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?)?$", "timestamp_ntz"),
}

ALL_METRICS = frozenset({"nulls", "ndv", "length", "shape", "minmax", "older"})


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return "integral"
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return "fractional"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "complex"


def union_tree(frames: list[DataFrame]) -> DataFrame:
    """Positional union of same-schema frames as a balanced tree.

    PySpark analyses each ``union`` eagerly; a left-deep chain of n inputs
    re-walks a growing plan n times, a balanced tree only log n levels deep.
    """
    frames = list(frames)
    while len(frames) > 1:
        frames = [frames[i].union(frames[i + 1]) if i + 1 < len(frames) else frames[i]
                  for i in range(0, len(frames), 2)]
    return frames[0]


def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_str(value: str) -> str:
    """A Python string as a SQL string literal (backslash escapes are on by default)."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _profile_one(name: str, df: DataFrame, metrics: frozenset, exact_distinct: bool,
                 older_than: str | None) -> DataFrame:
    """One table's profile: a single global aggregate then an ``inline`` unpivot.

    Expressions are generated as SQL text and passed in one ``selectExpr``
    call per step, so building the plan costs a few JVM calls per table
    instead of several per metric and column.
    """
    aggs = ["count(1) AS `__rows`"]
    rows = []
    for i, f in enumerate(df.schema.fields):
        c = ident(f.name)
        k = kind_of(f.dataType)
        m: dict[str, str] = {}

        def add(key: str, expr: str) -> str:
            alias = f"`__{i}_{key}`"
            aggs.append(f"{expr} AS {alias}")
            return alias

        m["nonnull"] = add("nn", f"count({c})")
        if "ndv" in metrics and k != "complex" and not exact_distinct:
            m["ndv"] = add("ndv", f"approx_count_distinct({c})")
        if "length" in metrics and k == "string":
            m["max_len"] = add("mx", f"CAST(max(length({c})) AS BIGINT)")
            m["sum_len"] = add("sl", f"CAST(sum(length({c})) AS BIGINT)")
        if "shape" in metrics and k == "string":
            m["numeric_like"] = add("nl", f"count_if({c} RLIKE {sql_str(NUMERIC_TEXT)})")
            m["date_like"] = add("dl", f"count_if({c} RLIKE {sql_str(DATE_TEXT)} "
                                     f"AND try_cast(substring({c}, 1, 10) AS DATE) IS NOT NULL)")
        if "minmax" in metrics and k in ("integral", "temporal"):
            fmt = ((lambda x: f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')") if k == "temporal"
                   else (lambda x: f"CAST({x} AS STRING)"))
            m["min_text"] = add("mn", fmt(f"min({c})"))
            m["max_text"] = add("mxv", fmt(f"max({c})"))
        if "older" in metrics and k == "temporal" and older_than:
            m["older"] = add("old", f"count_if({c} < CAST({sql_str(older_than)} AS {f.dataType.simpleString()}))")

        def get(key: str, typ: str) -> str:
            return f"CAST({m[key]} AS {typ})" if key in m else f"CAST(NULL AS {typ})"

        rows.append(
            f"named_struct('ordinal', {i + 1}, 'column_name', {sql_str(f.name)}, 'kind', '{k}', "
            f"'nonnull', {get('nonnull', 'BIGINT')}, 'ndv', {get('ndv', 'BIGINT')}, "
            f"'max_len', {get('max_len', 'BIGINT')}, 'sum_len', {get('sum_len', 'BIGINT')}, "
            f"'numeric_like', {get('numeric_like', 'BIGINT')}, 'date_like', {get('date_like', 'BIGINT')}, "
            f"'min_text', {get('min_text', 'STRING')}, 'max_text', {get('max_text', 'STRING')}, "
            f"'older', {get('older', 'BIGINT')})")
    one_row = df.selectExpr(*aggs)   # global aggregate
    return one_row.selectExpr(f"{sql_str(name)} AS table_name", "`__rows` AS rows",
                              f"inline(array({', '.join(rows)}))")


def _ndv_slots(f: T.StructField) -> tuple[str, str, str] | None:
    """Typed value slots (long, double, text) of one column as SQL expressions; None for complex types.

    Integers and booleans go to the long slot, floating point to the double
    slot (``-0.0`` normalised to ``0.0``, as distinct counting does), text,
    dates, timestamps and decimals to the text slot (an injective text form;
    long texts as a digest).
    Only one slot is set per value, so distinct rows equal distinct values.
    """
    k = kind_of(f.dataType)
    if k == "complex":
        return None
    c = ident(f.name)
    nl, nd, ns = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)"
    if k == "fractional":
        return nl, f"CASE WHEN {c} = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({c} AS DOUBLE) END", ns
    if k == "boolean" or (k == "integral" and not isinstance(f.dataType, T.DecimalType)):
        return f"CAST({c} AS BIGINT)", nd, ns
    return nl, nd, (_text_slot(c) if k == "string" else f"CAST({c} AS STRING)")


def _text_slot(c: str) -> str:
    """A text as itself if it is short, as its 256-bit digest otherwise: whole texts are never
    shuffled. The first character tells the two forms apart."""
    return f"CASE WHEN octet_length({c}) <= 64 THEN concat('=', {c}) ELSE concat('#', sha2({c}, 256)) END"


def _unpivot_sql(df: DataFrame, items: list[list[str]], names: list[str],
                 present: list[str] | None = None) -> DataFrame:
    """Rows of ``items`` (lists of SQL expressions named ``names``) for every input row.

    The table is read once, whatever its size, and each row is unpivoted with
    ``explode``. ``present[i]`` (optional) is a condition that must hold for item ``i``.
    """
    conds = present or ["true"] * len(items)
    structs = [f"CASE WHEN {cond} THEN named_struct({', '.join(f'{sql_str(n)}, {e}' for n, e in zip(names, it))}) END"
               for it, cond in zip(items, conds)]
    x = df.selectExpr(f"explode(array({', '.join(structs)})) AS __e").where("__e IS NOT NULL")
    return x.selectExpr(*[f"__e.{ident(n)} AS {ident(n)}" for n in names])


NDV_NAMES = ["table_name", "column_name", "vl", "vd", "vs"]


def _ndv_values(name: str, df: DataFrame) -> list[DataFrame]:
    """``(table_name, column_name, vl, vd, vs)`` rows of every non-NULL atomic value."""
    fields = [(f, sl) for f in df.schema.fields if (sl := _ndv_slots(f)) is not None]
    if not fields:
        return []
    items = [[sql_str(name), sql_str(f.name), *sl] for f, sl in fields]
    present = [f"{ident(f.name)} IS NOT NULL" for f, _ in fields]
    return [_unpivot_sql(df, items, NDV_NAMES, present)]


def exact_ndv(tables: Mapping[str, DataFrame]) -> DataFrame | None:
    """Distinct count of every atomic column of every table: one scan per table, two shuffles.

    Every row is unpivoted to one row per column; duplicates go map-side, then one
    ``distinct`` and one ``groupBy(table, column).count()`` follow. Long texts count by
    their 256-bit digest.
    """
    parts = [p for n, df in tables.items() for p in _ndv_values(n, df)]
    if not parts:
        return None
    u = union_tree(parts)   # identical schemas: positional union
    return u.distinct().groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("ndv"))


def column_profile(tables: Mapping[str, DataFrame], metrics: Iterable[str] = ALL_METRICS, *,
                   exact_distinct: bool = True, older_than: str | None = "1996-01-01") -> DataFrame:
    """One row per (table, column): rows, nulls and the requested metrics.

    Each table is scanned once; the aggregate is partial per task and merged in
    one final task that holds one buffer per metric, so the plan is the same at
    any table size. ``exact_distinct=False`` switches NDV to HyperLogLog++ to
    avoid the distinct-expansion shuffle on very wide tables.
    """
    metrics = frozenset(metrics)
    parts = [_profile_one(n, df, metrics, exact_distinct, older_than) for n, df in tables.items()]
    prof = union_tree(parts)
    if "ndv" in metrics and exact_distinct:
        ndv = exact_ndv(tables)
        if ndv is not None:
            # one row per column on both sides: the join never multiplies rows; a column
            # with only NULLs has no row in ``ndv`` and gets 0
            prof = (prof.drop("ndv").join(ndv, ["table_name", "column_name"], "left")
                    .withColumn("ndv", F.when(F.col("kind") != "complex", F.coalesce("ndv", F.lit(0)))
                                .cast("long")))
    return prof.withColumn("nulls", F.col("rows") - F.col("nonnull"))


def _checks(df: DataFrame, rule_id: str, detail: Column, anomaly: Column,
            column: Column | None = None) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), F.col("table_name").alias("table_id"),
                     F.lit("dbo").alias("schema_name"), F.col("table_name"),
                     (column if column is not None else F.col("column_name")).alias("column_name"),
                     detail.alias("detail"), anomaly.alias("is_anomaly"))


# A per-column check over the profile: (rule_id, applies-to, detail, anomaly).
Entry = tuple[str, Column, Column, Column]


def null_values_entry(max_null_share_bp: int = 0) -> Entry:
    """Q1: NULL count per column; anomaly when the NULL share exceeds the bound (default: any NULL)."""
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(" has "), num("nulls"),
                      F.lit(" NULL values in "), num("rows"), F.lit(" rows ("),
                      pct_text("nulls", "rows"), F.lit(")"))
    share_bp = F.when(F.col("rows") > 0, idiv(F.col("nulls") * 10000, F.col("rows"))).otherwise(0)
    return "Q1", F.lit(True), detail, (F.col("nulls") > 0) & (share_bp >= max_null_share_bp)


def column_sizing_entry(max_text_length: int = 8000) -> Entry:
    """Q6: observed max and average text length; anomaly above ``max_text_length`` characters."""
    avg = F.when(F.col("nonnull") > 0, idiv("sum_len", "nonnull")).otherwise(0)
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(": max length "),
                      F.coalesce(num("max_len"), F.lit("0")), F.lit(", average length "), num(avg),
                      F.lit(" over "), num("nonnull"), F.lit(" values"))
    return ("Q6", F.col("kind") == "string", detail,
            F.coalesce(F.col("max_len") > max_text_length, F.lit(False)))


def column_stats_entry() -> Entry:
    """Q7: statistics profile of each atomic column (informational, never an anomaly)."""
    detail = F.concat(
        F.lit("Column "), F.col("column_name"), F.lit(": rows "), num("rows"),
        F.lit(", nulls "), num("nulls"), F.lit(", distinct "), num("ndv"),
        F.when(F.col("min_text").isNotNull(),
               F.concat(F.lit(", min "), F.col("min_text"), F.lit(", max "), F.col("max_text")))
        .otherwise(F.lit("")))
    return "Q7", F.col("kind") != "complex", detail, F.lit(False)


def cardinality_entry() -> Entry:
    """Distinct values per column; a constant column (one value, several rows) is an anomaly."""
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(" has "), num("ndv"),
                      F.lit(" distinct values in "), num("rows"), F.lit(" rows ("),
                      pct_text("ndv", "rows"), F.lit(")"))
    return "L20", F.col("kind") != "complex", detail, (F.col("ndv") <= 1) & (F.col("rows") > 1)


def text_types_entry() -> Entry:
    """Text columns whose every non-NULL value is numeric- or date-shaped."""
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(": "), num("numeric_like"),
                      F.lit(" numeric and "), num("date_like"), F.lit(" date-shaped of "),
                      num("nonnull"), F.lit(" values"))
    anomaly = (F.col("nonnull") > 0) & ((F.col("numeric_like") == F.col("nonnull"))
                                       | (F.col("date_like") == F.col("nonnull")))
    return "L6", F.col("kind") == "string", detail, anomaly


def data_retention_entry(older_than: str = "1996-01-01") -> Entry:
    """Q17: rows of each date/timestamp column older than the retention horizon."""
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(": "), num("older"),
                      F.lit(" of "), num("rows"), F.lit(" rows older than "), F.lit(older_than),
                      F.lit(" ("), pct_text("older", "rows"), F.lit(")"))
    return "Q17", F.col("kind") == "temporal", detail, F.col("older") > 0


def _one(profile: DataFrame, entry: Entry) -> DataFrame:
    rid, applies, detail, anomaly = entry
    return _checks(profile.filter(applies), rid, detail, anomaly)


def null_values(profile: DataFrame, max_null_share_bp: int = 0) -> DataFrame:
    return _one(profile, null_values_entry(max_null_share_bp))


def column_sizing(profile: DataFrame, max_text_length: int = 8000) -> DataFrame:
    return _one(profile, column_sizing_entry(max_text_length))


def column_stats(profile: DataFrame) -> DataFrame:
    return _one(profile, column_stats_entry())


def cardinality(profile: DataFrame) -> DataFrame:
    return _one(profile, cardinality_entry())


def text_types(profile: DataFrame) -> DataFrame:
    return _one(profile, text_types_entry())


def data_retention(profile: DataFrame, older_than: str = "1996-01-01") -> DataFrame:
    return _one(profile, data_retention_entry(older_than))


def profile_checks(profile: DataFrame, entries: list[Entry]) -> DataFrame:
    """Several per-column checks in one projection over a single profile reference.

    Each profile row fans out to the checks that apply to it (``explode`` of
    an array of structs), so the profile aggregate is planned and executed
    once however many checks read it.
    """
    structs = [F.when(applies, F.struct(F.lit(rid).alias("rule_id"), detail.alias("detail"),
                                        anomaly.alias("is_anomaly")))
               for rid, applies, detail, anomaly in entries]
    x = profile.select("table_name", "column_name", F.explode(F.array(*structs)).alias("e")) \
        .filter(F.col("e").isNotNull())
    return x.select(F.col("e.rule_id").alias("rule_id"), F.col("table_name").alias("table_id"),
                    F.lit("dbo").alias("schema_name"), "table_name", "column_name",
                    F.col("e.detail").alias("detail"), F.col("e.is_anomaly").alias("is_anomaly"))


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key value: ``groupBy(keys).agg(count(1) as n)`` with the original names."""
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n"))


KeySet = tuple[str, tuple[str, ...]]


class KeyCounts:
    """Rows per key value for many (table, key set) pairs, from one aggregate.

    Every table is read once: its rows are unpivoted into one
    ``(set_id, k0l, k0d, k0s, k1l, ...)`` row per key set it takes part in
    (typed slots, so key sets of any column types share one schema), and one
    ``groupBy`` counts rows per (set, key value) for all tables and sets. The
    aggregation is partial per task, so a value holding a third of all rows
    reaches the shuffle as one row per task. Duplicate, FK and skew checks all
    read this one aggregate.
    """

    def __init__(self, tables: Mapping[str, DataFrame], sets: Iterable[KeySet]):
        uniq = sorted({(t, tuple(ks)) for t, ks in sets})
        self.ids = {s: i for i, s in enumerate(uniq)}
        self.width = max(len(ks) for _, ks in uniq)
        self.slots = [f"k{i}{x}" for i in range(self.width) for x in ("l", "d", "s")]
        parts = []
        names = ["set_id", *self.slots]
        for table in sorted({t for t, _ in uniq}):
            df = tables[table]
            items = []
            for (t, ks), sid in self.ids.items():
                if t != table:
                    continue
                cols = [str(sid)]
                for i in range(self.width):
                    if i < len(ks):
                        field = df.schema[ks[i]]
                        sl = _ndv_slots(field)
                        if isinstance(field.dataType, T.BinaryType):
                            sl = ("CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", f"hex({ident(ks[i])})")
                        if sl is None:
                            raise ValueError(f"key column {table}.{ks[i]} has a complex type")
                    else:
                        sl = ("CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)")
                    cols += list(sl)
                items.append(cols)
            parts.append(_unpivot_sql(df, items, names))
        u = union_tree(parts)
        self.counts = u.groupBy("set_id", *self.slots).agg(F.count(F.lit(1)).alias("n"))

    def set_map(self, spark, rows: list[tuple], schema: str) -> DataFrame:
        """Small mapping frame (bounded by the number of declared key sets / FKs)."""
        return spark.createDataFrame(rows, schema)


def _narrow(df: DataFrame, keys: Sequence[str]) -> bool:
    return not any(isinstance(df.schema[k].dataType, T.StringType) for k in keys)


def _key_label(keys: Sequence[str]) -> str:
    return ", ".join(keys)


def _wide_dup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per duplicated key value for keys with a text column: one partial aggregate by
    the 256-bit digest of the key values, so no text is shuffled and a hot value costs one row per task."""
    values = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})
    return (df.select(F.unhex(F.sha2(values, 256)).alias("__digest")).groupBy("__digest")
            .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1))


def _dup_rows(table: str, label: str, dup: DataFrame) -> DataFrame:
    detail = F.concat(num("groups"), F.lit(" values of key (" + label + ") occur more than once; "),
                      num("surplus"), F.lit(" surplus rows"))
    return dup.select(F.lit("Q4").alias("rule_id"), F.lit(table).alias("table_id"),
                      F.lit("dbo").alias("schema_name"), F.lit(table).alias("table_name"),
                      F.lit(label).alias("column_name"), detail.alias("detail"),
                      (F.col("groups") > 0).alias("is_anomaly"))


def duplicates(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[Sequence[str]]],
               counts: KeyCounts | None = None) -> DataFrame:
    """Q4: key values that occur more than once, per (table, key set).

    Numeric / date keys come from the shared ``KeyCounts`` aggregate; keys with a text
    column are grouped by digest (``_wide_dup_counts``).
    """
    narrow = [(t, tuple(ks)) for t, kss in keys.items() for ks in kss if _narrow(tables[t], ks)]
    wide = [(t, tuple(ks)) for t, kss in keys.items() for ks in kss if not _narrow(tables[t], ks)]
    out = []
    if narrow:
        kc = counts if counts is not None and all(s in counts.ids for s in narrow) else KeyCounts(tables, narrow)
        spark = next(iter(tables.values())).sparkSession
        m = kc.set_map(spark, [(kc.ids[s], s[0], _key_label(s[1])) for s in narrow],
                       "set_id int, table_name string, label string")
        g = (kc.counts.filter(F.col("n") > 1).groupBy("set_id")
             .agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).cast("long").alias("surplus")))
        d = m.join(g, "set_id", "left").fillna(0, ["groups", "surplus"])
        detail = F.concat(num("groups"), F.lit(" values of key ("), F.col("label"), F.lit(") occur more than once; "),
                          num("surplus"), F.lit(" surplus rows"))
        out.append(d.select(F.lit("Q4").alias("rule_id"), F.col("table_name").alias("table_id"),
                            F.lit("dbo").alias("schema_name"), "table_name", F.col("label").alias("column_name"),
                            detail.alias("detail"), (F.col("groups") > 0).alias("is_anomaly")))
    for t, ks in wide:
        dup = _wide_dup_counts(tables[t], ks).agg(
            F.count(F.lit(1)).alias("groups"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus"))
        out.append(_dup_rows(t, _key_label(ks), dup))
    return reduce(lambda a, b: a.unionByName(b), out)


def aligned(tables: Mapping[str, DataFrame],
            fks: Sequence[tuple[str, Sequence[str], str, Sequence[str]]]
            ) -> tuple[dict[str, DataFrame], list[tuple[str, list[str], str, list[str]]]]:
    """The tables and foreign keys with both sides of every key in their common type.

    Where child and parent differ (int and double, two decimal scales, date and timestamp), both
    get a derived column cast to the type that Spark's UNION gives them, so equal values compare equal."""
    extra: dict[str, dict[str, Column]] = {}
    out = []
    for i, (child, ck, parent, pk) in enumerate(fks):
        names: tuple[list[str], list[str]] = ([], [])
        for j, (a, b) in enumerate(zip(ck, pk)):
            left, right = tables[child].select(F.col(ident(a))), tables[parent].select(F.col(ident(b)))
            if left.schema[0].dataType == right.schema[0].dataType:
                names[0].append(a)
                names[1].append(b)
                continue
            common = left.union(right).schema[0].dataType
            for side, table, column in ((0, child, a), (1, parent, b)):
                name = f"__fk{i}_{j}_{side}"
                extra.setdefault(table, {})[name] = F.col(ident(column)).cast(common)
                names[side].append(name)
        out.append((child, names[0], parent, names[1]))
    used = {t for c, _, p, _ in fks for t in (c, p)}
    return {t: tables[t].withColumns(extra[t]) if t in extra else tables[t] for t in used}, out


def fk_stats(tables: Mapping[str, DataFrame],
             fks: Sequence[tuple[str, Sequence[str], str, Sequence[str]]],
             counts: KeyCounts | None = None) -> DataFrame:
    """Per foreign key: child rows, orphan rows, orphan keys and rows that reference a parent.

    No join of keys: the rows of the shared ``KeyCounts`` aggregate are tagged with the foreign keys
    their set is the child or parent of (where they are, by an expression: a join on the set would bring all keys
    of a set to one task), and one ``groupBy(fk_id, key)`` adds up child rows
    and notes whether a parent has the key. Every declared foreign key keeps its row,
    also with an empty child table.
    """
    spark = next(iter(tables.values())).sparkSession
    views, keyed = aligned(tables, fks)
    sets = [(c, tuple(ck)) for c, ck, _, _ in keyed] + [(p, tuple(pk)) for _, _, p, pk in keyed]
    kc = counts if counts is not None and all(s in counts.ids for s in sets) else KeyCounts(views, sets)
    names = kc.set_map(spark, [(i, c, _key_label(ck), p, _key_label(pk)) for i, (c, ck, p, pk) in enumerate(fks)],
                       "fk_id int, child string, child_cols string, parent string, parent_cols string")
    roles: dict[int, list[tuple[int, bool]]] = {}
    for i, (c, ck, p, pk) in enumerate(keyed):
        roles.setdefault(kc.ids[(c, tuple(ck))], []).append((i, True))
        roles.setdefault(kc.ids[(p, tuple(pk))], []).append((i, False))
    role = F.coalesce(*(F.when(F.col("set_id") == s, F.array(*(
        F.struct(F.lit(i).alias("fk_id"), F.lit(is_child).alias("is_child")) for i, is_child in pairs)))
        for s, pairs in sorted(roles.items())))
    tagged = kc.counts.select(*kc.slots, "n", F.inline(role))  # sets of no foreign key have no role and no row
    g = tagged.groupBy("fk_id", *kc.slots).agg(
        F.coalesce(F.sum(F.when(F.col("is_child"), F.col("n"))), F.lit(0)).alias("n"),
        F.max(F.col("is_child")).alias("in_child"), F.max(~F.col("is_child")).alias("hit"))
    width = {i: len(ck) for i, (_, ck, _, _) in enumerate(keyed)}
    has_key = reduce(lambda a, b: a | b, [
        (F.col("fk_id") == i) & reduce(lambda x, y: x & y, [
            F.coalesce(F.col(f"k{k}l").cast("string"), F.col(f"k{k}d").cast("string"), F.col(f"k{k}s")).isNotNull()
            for k in range(w)]) for i, w in width.items()])
    orphan = has_key & F.col("in_child") & ~F.col("hit")
    s = g.groupBy("fk_id").agg(
        F.sum("n").cast("long").alias("rows"), F.sum(F.when(orphan, F.col("n"))).cast("long").alias("orphans"),
        F.count_if(orphan).alias("orphan_keys"),
        F.sum(F.when(has_key & F.col("in_child") & F.col("hit"), F.col("n"))).cast("long").alias("matched"))
    return names.join(s, "fk_id", "left").fillna(0, ["rows", "orphans", "orphan_keys", "matched"]).drop("fk_id")


def fk_orphans(tables: Mapping[str, DataFrame],
               fks: Sequence[tuple[str, Sequence[str], str, Sequence[str]]],
               counts: KeyCounts | None = None) -> DataFrame:
    """Child rows whose non-NULL key has no parent row."""
    s = fk_stats(tables, fks, counts)
    label = F.concat(F.col("child"), F.lit("("), F.col("child_cols"), F.lit(") -> "), F.col("parent"), F.lit("("),
                     F.col("parent_cols"), F.lit(")"))
    detail = F.concat(num("orphans"), F.lit(" of "), num("rows"), F.lit(" rows ("), num("orphan_keys"),
                      F.lit(" distinct keys) in "), label, F.lit(" have no parent row"))
    return s.select(F.lit("Q2").alias("rule_id"), F.col("child").alias("table_id"), F.lit("dbo").alias("schema_name"),
                    F.col("child").alias("table_name"), F.col("child_cols").alias("column_name"),
                    detail.alias("detail"), (F.col("orphans") > 0).alias("is_anomaly"))


def narrowest_types(tables: Mapping[str, DataFrame]) -> DataFrame:
    """L6 / Q3 as a type lattice (id L6T): the narrowest type that *every* value of a text column has.

    Each whole value becomes a bit mask of the types it can stand for; the masks of a column meet in one ``bit_and``,
    so one partial aggregate per table folds all its text columns, and the lowest bit left is the answer. A column with another
    type than text is an anomaly; one without values has no type.
    """
    names = [*TEXT_TYPES, "string"]

    def mask(c: str) -> str:
        bits = [str(1 << len(TEXT_TYPES))]
        for k, (shape, cast) in enumerate(TEXT_TYPES.values()):
            held = f"{c} RLIKE {sql_str(shape)}" + (f" AND try_cast({c} AS {cast}) IS NOT NULL" if cast else "")
            bits.append(f"IF({held}, {1 << k}, 0)")
        return f"IF({c} IS NULL, NULL, {' + '.join(bits)})"

    parts = []
    for name, df in tables.items():
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not cols:
            continue
        aggs = [x for i, c in enumerate(cols) for x in (f"bit_and({mask(ident(c))}) AS m{i}", f"count({ident(c)}) AS n{i}")]
        rows = ", ".join(f"named_struct('column_name', {sql_str(c)}, 'mask', m{i}, 'n', n{i})" for i, c in enumerate(cols))
        parts.append(df.selectExpr(*aggs).selectExpr(f"{sql_str(name)} AS table_name", f"inline(array({rows}))"))
    folded = union_tree(parts)
    kind = F.coalesce(*(F.when(F.col("mask").bitwiseAND(1 << k) != 0, F.lit(t)) for k, t in enumerate(names)), F.lit("none"))
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.lit(": "), num("n"), F.lit(" values, narrowest type "), F.col("kind"))
    return folded.withColumn("kind", kind).select(
        F.lit("L6T").alias("rule_id"), F.col("table_name").alias("table_id"), F.lit("dbo").alias("schema_name"), "table_name",
        "column_name", detail.alias("detail"), (~F.col("kind").isin("string", "none")).alias("is_anomaly"))


def column_ranges(tables: Mapping[str, DataFrame], shown: int = 40) -> DataFrame:
    """Q7 for every atomic type (id Q7R): smallest and largest value of each column, found over whole values; long
    texts are shown by their first ``shown`` characters and their length. Times are shown to the microsecond, fractions
    to four places."""
    def form(f: T.StructField, x: str) -> str:
        k = kind_of(f.dataType)
        if k == "string":
            return f"concat(left({x}, {shown}), IF(length({x}) > {shown}, concat('... (', length({x}), ')'), ''))"
        if k == "temporal":
            return f"date_format({x}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        return f"CAST(CAST({x} AS DECIMAL(30,4)) AS STRING)" if k == "fractional" else f"CAST({x} AS STRING)"

    parts = []
    for name, df in tables.items():
        atomic = [f for f in df.schema.fields if kind_of(f.dataType) != "complex"]
        if not atomic:
            continue
        aggs = [f"{fn}({ident(f.name)}) AS {fn}{i}" for i, f in enumerate(atomic) for fn in ("min", "max")]
        rows = ", ".join(f"named_struct('column_name', {sql_str(f.name)}, 'lo', {form(f, f'min{i}')}, 'hi', {form(f, f'max{i}')})"
                         for i, f in enumerate(atomic))
        parts.append(df.selectExpr(*aggs).selectExpr(f"{sql_str(name)} AS table_name", f"inline(array({rows}))"))
    detail = F.concat(F.lit("Column "), F.col("column_name"), F.coalesce(
        F.concat(F.lit(": min "), F.col("lo"), F.lit(", max "), F.col("hi")), F.lit(": no values")))
    return union_tree(parts).select(
        F.lit("Q7R").alias("rule_id"), F.col("table_name").alias("table_id"), F.lit("dbo").alias("schema_name"), "table_name",
        "column_name", detail.alias("detail"), F.lit(False).alias("is_anomaly"))


def key_skew(tables: Mapping[str, DataFrame], skew_keys: Mapping[str, Sequence[str]],
             max_ratio: int = 10, counts: KeyCounts | None = None) -> DataFrame:
    """L12 (key frequency): rows of the most frequent value vs the average per value.

    Anomaly when the top value holds more than ``max_ratio`` times the average.
    Read from the shared ``KeyCounts`` aggregate; the ratio is decimal arithmetic.
    """
    sets = [(t, (c,)) for t, cols in skew_keys.items() for c in cols]
    kc = counts if counts is not None and all(s in counts.ids for s in sets) else KeyCounts(tables, sets)
    spark = next(iter(tables.values())).sparkSession
    m = kc.set_map(spark, [(kc.ids[s], s[0], s[1][0]) for s in sets], "set_id int, table_name string, col string")
    g = kc.counts.groupBy("set_id").agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("keys"),
                                        F.sum("n").cast("long").alias("total"))
    s = m.join(g, "set_id", "left").fillna(0, ["top", "keys", "total"])
    detail = F.concat(F.lit("Most frequent value holds "), num("top"), F.lit(" of "), num("total"),
                      F.lit(" rows ("), pct_text("top", "total"), F.lit(") over "), num("keys"),
                      F.lit(" distinct values; top/average "),
                      ratio_text(F.col("top").cast("decimal(38,0)") * F.col("keys"), F.col("total")))
    anomaly = F.coalesce(F.col("top").cast("decimal(38,0)") * F.col("keys")
                         > F.col("total").cast("decimal(38,0)") * max_ratio, F.lit(False))
    return s.select(F.lit("L12K").alias("rule_id"), F.col("table_name").alias("table_id"),
                    F.lit("dbo").alias("schema_name"), "table_name", F.col("col").alias("column_name"),
                    detail.alias("detail"), anomaly.alias("is_anomaly"))
