"""Checks over Delta transaction logs (L2, L3, L8, L9, L17, L18, L19 log part).

Inputs are the long ``log`` frame (one row per action) and the discovered
``tables``; every check is one grouped aggregate keyed by ``table_id`` over
all tables at once, joined back to ``tables`` so a table without any
matching action still gets its finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import num
from ..sources.delta_log import live_files, table_properties

GIB = 1024 ** 3
DAY_MS = 86400000
# fixed property names
LOG_RETENTION = "delta.logRetentionDuration"
FILE_RETENTION = "delta.deletedFileRetentionDuration"
OPTIMIZE_WRITE = "delta.autoOptimize.optimizeWrite"
AUTO_COMPACT = "delta.autoOptimize.autoCompact"


def _checks(df: DataFrame, rule_id: str, detail: Column, anomaly: Column) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), "table_id", F.lit(None).cast("string").alias("schema_name"),
                     F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("string").alias("column_name"),
                     detail.alias("detail"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"))


def _per_table(tables: DataFrame, agg: DataFrame) -> DataFrame:
    return tables.select("table_id").join(agg, "table_id", "left")


def partitioning(log: DataFrame, tables: DataFrame, min_partition_bytes: int = GIB,
                 every_table: bool = False) -> DataFrame:
    """L2: live bytes per partition value; anomaly when a partitioned table averages
    less than ``min_partition_bytes`` per partition. ``every_table`` also gives a row to tables without a live file."""
    lf = live_files(log).withColumn("part", F.to_json(F.col("partition_values")))
    per = lf.groupBy("table_id", "part").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("f"))
    g = per.groupBy("table_id").agg(
        F.count_if(F.col("part") != "{}").alias("parts"), F.sum("b").cast("long").alias("bytes"),
        F.sum("f").cast("long").alias("files"))
    if every_table:
        g = _per_table(tables, g).fillna(0, ["parts", "bytes", "files"])
    detail = F.when(F.col("parts") > 0, F.concat(
        num("parts"), F.lit(" partitions over "), num("files"), F.lit(" files; average "),
        num(F.call_function("div", F.col("bytes"), F.col("parts"))), F.lit(" bytes per partition"))) \
        .otherwise(F.concat(F.lit("Not partitioned; "), num("files"), F.lit(" files")))
    anomaly = (F.col("parts") > 1) & (F.col("bytes") < F.col("parts") * min_partition_bytes)
    return _checks(g, "L2", detail, anomaly)


def _commits(log: DataFrame) -> DataFrame:
    return log.filter(F.col("commit_info").isNotNull()).select(
        "table_id", "version", F.col("commit_info.timestamp").alias("ts"),
        F.col("commit_info.operation").alias("op"), F.col("commit_info.operationParameters").alias("params"))


def zorder(log: DataFrame, tables: DataFrame) -> DataFrame:
    """L3: OPTIMIZE commits with a Z-order; anomaly when a table never had one."""
    c = _commits(log)
    g = c.groupBy("table_id").agg(
        F.count_if((F.col("op") == "OPTIMIZE") & F.col("params")["zOrderBy"].isNotNull()).alias("z"),
        F.count(F.lit(1)).alias("n"))
    t = _per_table(tables, g).fillna(0, ["z", "n"])
    detail = F.concat(num("z"), F.lit(" Z-ordered OPTIMIZE commits of "), num("n"), F.lit(" commits"))
    return _checks(t, "L3", detail, F.col("z") == 0)


def _days(v: Column) -> Column:
    """Days of an ``interval N days`` / ``N days`` / ``N hours`` setting (NULL if unset or unparsable)."""
    n = F.regexp_extract(v, r"(\d+)\s*(day|hour)", 1)
    unit = F.regexp_extract(v, r"(\d+)\s*(day|hour)", 2)
    return (F.when(n == "", F.lit(None).cast("long"))
            .when(unit == "hour", F.call_function("div", n.cast("long"), F.lit(24)))
            .otherwise(n.cast("long")))


def _props(log: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    p = table_properties(log).filter(F.col("key").isin(*keys))
    wide = p.groupBy("table_id").pivot("key", keys).agg(F.first("value"))
    return _per_table(tables, wide)


def retention(log: DataFrame, tables: DataFrame, min_days: int = 7) -> DataFrame:
    """Log and deleted-file retention; anomaly when unset or under ``min_days``."""
    t = _props(log, tables, [LOG_RETENTION, FILE_RETENTION])
    lr, fr = _days(F.col(f"`{LOG_RETENTION}`")), _days(F.col(f"`{FILE_RETENTION}`"))
    detail = F.concat(F.lit("Log retention "), F.coalesce(F.concat(num(lr), F.lit(" days")), F.lit("unset")),
                      F.lit(", deleted-file retention "),
                      F.coalesce(F.concat(num(fr), F.lit(" days")), F.lit("unset")))
    anomaly = lr.isNull() | fr.isNull() | (lr < min_days) | (fr < min_days)
    return _checks(t, "L8", detail, anomaly)


def vacuum(log: DataFrame, tables: DataFrame, max_days: int = 7) -> DataFrame:
    """Days between the last VACUUM and the latest commit; anomaly when never or older than ``max_days``."""
    c = _commits(log)
    g = c.groupBy("table_id").agg(F.max("ts").alias("last"),
                                  F.max(F.when(F.col("op").startswith("VACUUM"), F.col("ts"))).alias("vac"))
    t = _per_table(tables, g)
    days = F.call_function("div", F.col("last") - F.col("vac"), F.lit(DAY_MS))
    detail = F.when(F.col("vac").isNull(), F.lit("No VACUUM in the log")).otherwise(
        F.concat(F.lit("Last VACUUM "), num(days), F.lit(" days before the latest commit")))
    return _checks(t, "L9", detail, F.col("vac").isNull() | (days > max_days))


def checkpoints(listing: DataFrame, tables: DataFrame, interval: int = 10) -> DataFrame:
    """Versions since the last checkpoint; anomaly when more than ``interval``."""
    g = listing.groupBy("table_id").agg(
        F.max(F.when(F.col("kind") == "commit", F.col("version"))).alias("latest"),
        F.max(F.when(F.col("kind") == "checkpoint", F.col("version"))).alias("ckpt"))
    t = _per_table(tables, g)
    behind = F.col("latest") - F.coalesce(F.col("ckpt"), F.lit(-1))
    detail = F.concat(F.lit("Latest version "), F.coalesce(num("latest"), F.lit("none")), F.lit(", last checkpoint "),
                      F.coalesce(num("ckpt"), F.lit("none")))
    return _checks(t, "L17", detail, behind > interval)


def auto_optimize(log: DataFrame, tables: DataFrame) -> DataFrame:
    """optimizeWrite / autoCompact properties; anomaly when neither is true."""
    t = _props(log, tables, [OPTIMIZE_WRITE, AUTO_COMPACT])
    ow, ac = F.col(f"`{OPTIMIZE_WRITE}`"), F.col(f"`{AUTO_COMPACT}`")
    detail = F.concat(F.lit("optimizeWrite="), F.coalesce(ow, F.lit("unset")), F.lit(", autoCompact="),
                      F.coalesce(ac, F.lit("unset")))
    anomaly = ~(F.coalesce(F.lower(ow) == "true", F.lit(False)) | F.coalesce(F.lower(ac) == "true", F.lit(False)))
    return _checks(t, "L18", detail, anomaly)


def file_statistics(log: DataFrame, tables: DataFrame) -> DataFrame:
    """L19 (log part, id L19L): live files whose add action carries statistics."""
    lf = live_files(log)
    g = lf.groupBy("table_id").agg(F.count_if(F.col("stats").isNotNull()).alias("s"), F.count(F.lit(1)).alias("n"))
    t = _per_table(tables, g).fillna(0, ["s", "n"])
    detail = F.concat(num("s"), F.lit(" of "), num("n"), F.lit(" live files carry statistics"))
    return _checks(t, "L19L", detail, F.col("s") < F.col("n"))
