"""Workspace inventory.

The tenant scan service returns JSON documents ``{"workspaces": [{id, name,
<ItemKind>: [{id, name, extendedProperties: {...}}, ...]}]}``. They are read
as a JSON source and flattened with ``explode``; nothing is collected. Item
properties stay in a ``map<string,string>`` instead of dynamic ``ext_*``
columns, so the schema is fixed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import scan_date

# --- fixed values -------------------------------------------------------------
LAKEHOUSE_KEY = "Lakehouse"
WAREHOUSE_KEY = "warehouses"
STAGING_LAKEHOUSE = "DataflowsStagingLakehouse"
SYSTEM_WORKSPACE = "PersonalWorkspace System"
STAGING_WAREHOUSE_PREFIXES = ("DataflowsStaging", "StagingWarehouseForDataflows")
# -------------------------------------------------------------------------------

ITEM = "struct<id:string,name:string,displayName:string,extendedProperties:map<string,string>>"
PAYLOAD_SCHEMA = (f"workspaces array<struct<id:string,name:string,{LAKEHOUSE_KEY}:array<{ITEM}>,"
                  f"{WAREHOUSE_KEY}:array<{ITEM}>>>")


def read_payload(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan documents as raw JSON lines (one document per line)."""
    return spark.read.text(path).withColumnRenamed("value", "doc")


def read_documents(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Scan documents as ``file_path, doc`` (a VARIANT; NULL where the text is no JSON).

    ``multi_line``: one document per file, however it is laid out over lines; a document is one
    batch of the service's and so bounded. Otherwise one document per line, and long files are split.
    """
    raw = spark.read.text(path, wholetext=multi_line).filter(F.trim("value") != "")
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("doc"))


def bad_documents(documents: DataFrame) -> DataFrame:
    """Documents that are no JSON, per file."""
    return documents.filter(F.col("doc").isNull()).groupBy("file_path").agg(F.count(F.lit(1)).alias("documents"))


def _text(value: Column) -> Column:
    """A VARIANT as text: strings as they are, everything else as JSON; JSON null is NULL."""
    plain = F.schema_of_variant(value) == "STRING"
    return F.when(plain, F.try_variant_get(value, "$", "string")).when(~F.is_variant_null(value), F.to_json(value))


def item_properties(documents: DataFrame, scan_ts: datetime | str) -> DataFrame:
    """Every property of every item of every list-valued key of a workspace, one row each.

    ``workspace_id, workspace_name, item_type, id, name, property, value, scan_date``. Properties of
    ``extendedProperties`` come one by one as ``ext_<key>``; other nested values stay JSON text. Neither item kinds nor properties
    need to be known; an item that is no object has the one property ``value``. Keys are matched as they are written.
    """
    get = F.try_variant_get
    ws = documents.select(F.explode(get("doc", "$.workspaces", "array<variant>")).alias("w"))
    kinds = ws.select(get("w", "$.id", "string").alias("workspace_id"), get("w", "$.name", "string").alias("workspace_name"),
                      F.explode(get("w", "$", "map<string,variant>")).alias("item_type", "list"))
    items = kinds.select("workspace_id", "workspace_name", "item_type",
                         F.explode(get("list", "$", "array<variant>")).alias("item"))
    fields = F.coalesce(get("item", "$", "map<string,variant>"), F.create_map(F.lit("value"), F.col("item")))
    own = items.select("workspace_id", "workspace_name", "item_type", get("item", "$.id", "string").alias("id"),
                       F.coalesce(get("item", "$.name", "string"), get("item", "$.displayName", "string"),
                                  F.concat(F.lit("Warehouse_"), get("item", "$.id", "string"))).alias("name"),  # P13
                       F.explode(fields).alias("key", "held"))
    extended = F.when(F.col("key") == "extendedProperties", get("held", "$", "map<string,variant>"))
    parts = F.coalesce(F.transform_keys(extended, lambda k, _: F.concat(F.lit("ext_"), k)), F.create_map("key", "held"))
    return (own.select("workspace_id", "workspace_name", "item_type", "id", "name", F.explode(parts).alias("property", "held"))
            .select("workspace_id", "workspace_name", "item_type", "id", "name", "property", _text(F.col("held")).alias("value"),
                    scan_date(scan_ts).alias("scan_date")))


def lakehouse_items(payload: DataFrame, item_key: str = LAKEHOUSE_KEY, exclude_staging: bool = True) -> DataFrame:
    """One row per lakehouse item (key matched exactly); staging items and the
    system workspace are dropped (P2) unless ``exclude_staging=False``."""
    doc = F.from_json("doc", PAYLOAD_SCHEMA.replace(LAKEHOUSE_KEY, item_key, 1)
                      if item_key != LAKEHOUSE_KEY else PAYLOAD_SCHEMA)
    ws = payload.select(F.explode(doc["workspaces"]).alias("w"))
    items = ws.select(F.col("w.id").alias("workspace_id"), F.col("w.name").alias("workspace_name"),
                      F.explode(F.col("w")[item_key]).alias("i"))
    out = items.select("workspace_id", "workspace_name", F.lit(LAKEHOUSE_KEY).alias("item_type"),
                       F.lit(LAKEHOUSE_KEY).alias("connection_type"), F.col("i.id").alias("id"),
                       F.col("i.name").alias("name"), F.col("i.extendedProperties").alias("ext"))
    return out.filter(~is_staging_lakehouse()) if exclude_staging else out


def is_staging_lakehouse(name: str = "name", workspace: str = "workspace_name") -> Column:
    """The staging lakehouse item or any item of the system workspace (NULL-safe)."""
    return F.col(name).eqNullSafe(STAGING_LAKEHOUSE) | F.col(workspace).eqNullSafe(SYSTEM_WORKSPACE)


def all_items(payload: DataFrame) -> DataFrame:
    """Every list-valued key of a workspace is an item kind; non-list keys are skipped.

    Workspaces are parsed as ``map<string,string>`` so item kinds need not be
    known in advance (nested values arrive as JSON text); list values are
    parsed again as arrays of property maps.
    """
    ws = payload.select(F.explode(F.from_json("doc", "struct<workspaces:array<string>>")["workspaces"]).alias("w"))
    m = ws.select(F.from_json("w", "map<string,string>").alias("m"))
    kinds = m.select(F.col("m")["id"].alias("workspace_id"), F.col("m")["name"].alias("workspace_name"),
                     F.explode("m").alias("item_type", "raw"))
    lists = kinds.filter(F.col("raw").startswith("["))
    items = lists.select("workspace_id", "workspace_name", "item_type",
                         F.explode(F.from_json("raw", "array<map<string,string>>")).alias("p"))
    return items.select(
        "workspace_id", "workspace_name", "item_type", F.col("p")["id"].alias("id"),
        F.coalesce(F.col("p")["name"], F.col("p")["displayName"],
                   F.concat(F.lit("Warehouse_"), F.col("p")["id"])).alias("name"),   # P13
        F.from_json(F.col("p")["extendedProperties"], "map<string,string>").alias("ext"))


def warehouse_items(items: DataFrame) -> DataFrame:
    """Warehouse items without the staging prefixes."""
    cond = F.col("item_type") == WAREHOUSE_KEY
    for p in STAGING_WAREHOUSE_PREFIXES:
        cond = cond & ~F.col("name").startswith(p)
    return items.filter(cond)


def filter_workspaces(items: DataFrame, wanted: Sequence[str] | DataFrame | None) -> DataFrame:
    """Keep items whose workspace id *or* name is wanted; empty/None keeps all.

    A Python list becomes an ``isin``; a DataFrame of wanted values (column
    ``value``) is matched with two left-semi joins whose union is deduplicated
    by the item key, so long lists never pass through the driver.
    """
    if wanted is None:
        return items
    if isinstance(wanted, DataFrame):
        w = wanted.select(F.col("value").cast("string").alias("__v")).distinct()
        by_id = items.join(w, items.workspace_id == w.__v, "left_semi")
        by_name = items.join(w, items.workspace_name == w.__v, "left_semi")
        return by_id.unionByName(by_name).dropDuplicates(["workspace_id", "item_type", "id"])
    if not wanted:
        return items
    return items.filter(F.col("workspace_id").isin(list(wanted)) | F.col("workspace_name").isin(list(wanted)))


def scan_summary(items: DataFrame) -> DataFrame:
    """A1/A2: items and distinct workspaces per item kind."""
    return items.groupBy("item_type").agg(F.count(F.lit(1)).alias("items"),
                                          F.countDistinct("workspace_id").alias("workspaces"))
