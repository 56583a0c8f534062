"""JSON-in-string columns: key union (A3) and flattening."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OBJECT_TEXT = r"^\s*\{.*\}\s*$"


def json_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """A3: distinct top-level keys per JSON column, (column_name, key); non-objects ignored."""
    parts = [df.select(F.lit(c).alias("column_name"),
                       F.explode(F.json_object_keys(F.col(f"`{c}`"))).alias("key")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def json_columns(df: DataFrame, prefix: str = "ext_") -> list[str]:
    """Auto-detection of JSON columns: text columns with ``prefix`` of which some value parses as a
    JSON object (one partial aggregate over the whole columns)."""
    cands = [f.name for f in df.schema.fields if f.name.startswith(prefix) and f.dataType.simpleString() == "string"]
    if not cands:
        return []
    row = df.agg(*[F.count(F.json_object_keys(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(cands)]).first()
    return [c for i, c in enumerate(cands) if row[f"n{i}"]]


def flatten_json(df: DataFrame, columns: list[str] | None = None,
                 keys: dict[str, list[str]] | None = None) -> DataFrame:
    """JSON columns taken apart; the original columns are kept.

    A column whose keys the caller names gets one ``<col>_<key>`` column for each of them;
    any other gets one ``<col>_map`` column with all its keys, however many there are.
    Values are text; nested objects stay JSON; non-object values give NULL.
    """
    columns = json_columns(df) if columns is None else columns
    out = {}
    for c in columns:
        parsed = F.from_json(F.col(f"`{c}`"), "map<string,string>")
        named = (keys or {}).get(c)
        out |= {f"{c}_map": parsed} if named is None else {f"{c}_{k}": parsed[k] for k in named}
    return df.withColumns(out) if out else df


def json_long(df: DataFrame, key_cols: list[str], column: str) -> DataFrame:
    """Long form of a JSON column: (keys..., key, value), no driver round trip."""
    return df.select(*key_cols, F.explode(F.from_json(F.col(f"`{column}`"), "map<string,string>")).alias("key", "value"))
