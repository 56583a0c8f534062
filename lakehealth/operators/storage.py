"""Storage-layout checks over footer metadata (``chunks``) and file listings
(L10, L11, L13, L14, L15, L19, L21, L22, L24).

Every check is one grouped aggregate keyed by ``table_id`` (or
``(table_id, column)``) over the chunk rows of *all* tables at once; the
chunk frame is metadata (one row per column chunk), so these plans shuffle
kilobytes per table regardless of the data volume behind them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import num, pct_text

MIB = 1024 * 1024


def _checks(df: DataFrame, rule_id: str, detail: Column, anomaly: Column,
            column: Column | None = None) -> DataFrame:
    col = column if column is not None else F.lit(None).cast("string")
    return df.select(F.lit(rule_id).alias("rule_id"), "table_id", F.lit(None).cast("string").alias("schema_name"),
                     F.col("table_id").alias("table_name"), col.alias("column_name"),
                     detail.alias("detail"), F.coalesce(anomaly, F.lit(False)).alias("is_anomaly"))


def _by_column(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("table_id", "path_in_schema")


def compression_ratio(chunks: DataFrame, min_bytes: int = MIB, max_ratio_pct: int = 90) -> DataFrame:
    """Compressed vs uncompressed bytes per column; anomaly when a column of at
    least ``min_bytes`` keeps more than ``max_ratio_pct``% of its size."""
    g = _by_column(chunks).agg(F.sum("total_compressed_size").cast("long").alias("c"),
                               F.sum("total_uncompressed_size").cast("long").alias("u"))
    detail = F.concat(F.lit("Column "), F.col("path_in_schema"), F.lit(": "), num("c"), F.lit(" of "),
                      num("u"), F.lit(" bytes after compression ("), pct_text("c", "u"), F.lit(")"))
    anomaly = (F.col("u") >= min_bytes) & (F.col("c") * 100 > F.col("u") * max_ratio_pct)
    return _checks(g, "L11", detail, anomaly, F.col("path_in_schema"))


def dictionary_encoding(chunks: DataFrame) -> DataFrame:
    """Share of column chunks with a dictionary encoding; anomaly for a
    BYTE_ARRAY column that never uses one."""
    g = _by_column(chunks).agg(F.count_if(F.col("encodings").contains("DICTIONARY")).alias("d"),
                               F.count(F.lit(1)).alias("n"), F.max("type").alias("type"))
    detail = F.concat(F.lit("Column "), F.col("path_in_schema"), F.lit(": "), num("d"), F.lit(" of "),
                      num("n"), F.lit(" column chunks dictionary-encoded"))
    anomaly = (F.col("type") == "BYTE_ARRAY") & (F.col("d") == 0)
    return _checks(g, "L13", detail, anomaly, F.col("path_in_schema"))


def _row_groups(chunks: DataFrame) -> DataFrame:
    """One row per (table, file, row group)."""
    rg = chunks.groupBy("table_id", "file_path", "row_group_id").agg(
        F.max("row_group_num_rows").alias("rows"), F.max("row_group_bytes").alias("bytes"))
    return rg.groupBy("table_id").agg(
        F.count(F.lit(1)).alias("rg"), F.count_distinct("file_path").alias("files"),
        F.sum("rows").cast("long").alias("rows"), F.sum("bytes").cast("long").alias("bytes"))


def row_group_sizing(chunks: DataFrame, min_avg_bytes: int = 16 * MIB) -> DataFrame:
    """Average rows and bytes per row group; anomaly when a table has several
    row groups averaging under ``min_avg_bytes``."""
    g = _row_groups(chunks)
    detail = F.concat(num("rg"), F.lit(" row groups in "), num("files"), F.lit(" files; average "),
                      num(F.call_function("div", F.col("rows"), F.col("rg"))), F.lit(" rows and "),
                      num(F.call_function("div", F.col("bytes"), F.col("rg"))), F.lit(" bytes per row group"))
    anomaly = (F.col("rg") > 1) & (F.col("bytes") < F.col("rg") * min_avg_bytes)
    return _checks(g, "L14", detail, anomaly)


def read_parallelism(chunks: DataFrame, slots: int = 8, min_bytes: int = 128 * MIB) -> DataFrame:
    """Row groups vs read slots; anomaly when a table of at least ``min_bytes``
    has fewer row groups than ``slots``."""
    g = _row_groups(chunks)
    detail = F.concat(num("rg"), F.lit(f" row groups for {slots} read slots; "), num("bytes"),
                      F.lit(" bytes"))
    anomaly = (F.col("bytes") >= min_bytes) & (F.col("rg") < slots)
    return _checks(g, "L15", detail, anomaly)


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """L19 (footer part): share of column chunks that carry statistics."""
    g = chunks.groupBy("table_id").agg(F.count_if(F.col("stats_null_count").isNotNull()).alias("s"),
                                       F.count(F.lit(1)).alias("n"))
    detail = F.concat(num("s"), F.lit(" of "), num("n"), F.lit(" column chunks carry statistics"))
    return _checks(g, "L19", detail, F.col("s") < F.col("n"))


def null_ratio(chunks: DataFrame, max_pct: int = 50) -> DataFrame:
    """NULL share per column from footer statistics; anomaly above ``max_pct``%."""
    g = _by_column(chunks).agg(F.sum("stats_null_count").cast("long").alias("nulls"),
                               F.sum("num_values").cast("long").alias("vals"))
    detail = F.concat(F.lit("Column "), F.col("path_in_schema"), F.lit(": "),
                      F.coalesce(num("nulls"), F.lit("unknown")), F.lit(" NULL of "), num("vals"),
                      F.lit(" values ("), pct_text(F.coalesce("nulls", F.lit(0)), "vals"), F.lit(")"))
    anomaly = F.col("nulls") * 100 > F.col("vals") * max_pct
    return _checks(g, "L21", detail, anomaly, F.col("path_in_schema"))


def chunk_start(chunks: DataFrame) -> Column:
    """First byte of a column chunk: the dictionary page when it precedes the data pages."""
    d, p = F.col("dictionary_page_offset"), F.col("data_page_offset")
    return F.when(d.isNotNull() & (d < p), d).otherwise(p)


def offset_continuity(chunks: DataFrame) -> DataFrame:
    """Gaps or overlaps between consecutive column chunks of a row group.

    ``lag`` over ``(file, row group)`` ordered by start offset: the window
    partition is one row group, bounded by its column count.
    """
    w = Window.partitionBy("file_path", "row_group_id").orderBy("__start", "column_id")
    c = (chunks.withColumn("__start", chunk_start(chunks))
         .withColumn("__end", F.col("__start") + F.col("total_compressed_size"))
         .withColumn("__prev_end", F.lag("__end").over(w)))
    g = c.groupBy("table_id").agg(
        F.count_if(F.col("__prev_end").isNotNull() & (F.col("__prev_end") != F.col("__start"))).alias("gaps"),
        F.count(F.lit(1)).alias("n"))
    detail = F.concat(num("gaps"), F.lit(" gaps or overlaps between "), num("n"), F.lit(" column chunks"))
    return _checks(g, "L22", detail, F.col("gaps") > 0)


FIRST_BYTE = 4  # data starts after the magic bytes


def offset_sweep(chunks: DataFrame) -> DataFrame:
    """L22 / W1 over whole files (id L22F): an interval sweep with the furthest end so far.

    Chunks of a file stand in order of their first byte, across row groups; one that starts after the
    furthest end of all before it leaves a gap, one that starts before it lies over another, also where a
    longer chunk further back reaches past its neighbour. The window holds one file's chunks, which one footer lists.
    """
    before = (Window.partitionBy("table_id", "file_path").orderBy("__start", "row_group_id", "column_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    c = (chunks.withColumn("__start", chunk_start(chunks))
         .withColumn("__reach", F.coalesce(F.max(F.col("__start") + F.col("total_compressed_size")).over(before),
                                           F.lit(FIRST_BYTE))))
    g = c.groupBy("table_id").agg(
        F.count_if(F.col("__start") > F.col("__reach")).alias("gaps"),
        F.sum(F.greatest(F.col("__start") - F.col("__reach"), F.lit(0))).cast("long").alias("lost"),
        F.count_if(F.col("__start") < F.col("__reach")).alias("overlaps"), F.count(F.lit(1)).alias("n"))
    detail = F.concat(num("gaps"), F.lit(" gaps of "), num("lost"), F.lit(" bytes and "), num("overlaps"),
                      F.lit(" overlaps among "), num("n"), F.lit(" column chunks"))
    return _checks(g, "L22F", detail, (F.col("gaps") > 0) | (F.col("overlaps") > 0))


def file_row_skew(chunks: DataFrame, max_ratio: int = 4) -> DataFrame:
    """L12 (file rows, id L12F): rows of a table's largest file vs the average file."""
    groups = chunks.groupBy("table_id", "file_path", "row_group_id").agg(F.max("row_group_num_rows").alias("rows"))
    files = groups.groupBy("table_id", "file_path").agg(F.sum("rows").alias("rows"))
    g = files.groupBy("table_id").agg(F.max("rows").cast("long").alias("top"), F.sum("rows").cast("long").alias("total"),
                                      F.count(F.lit(1)).alias("files"))
    detail = F.concat(F.lit("Largest of "), num("files"), F.lit(" files holds "), num("top"), F.lit(" of "), num("total"),
                      F.lit(" rows"))
    return _checks(g, "L12F", detail, F.col("top") * F.col("files") > F.col("total") * max_ratio)


def file_sizes(files: DataFrame, small_bytes: int = 32 * MIB) -> DataFrame:
    """Small-file share per table from the listing (``table_id``, ``length``)."""
    g = files.groupBy("table_id").agg(F.count(F.lit(1)).alias("files"),
                                      F.sum("length").cast("long").alias("bytes"),
                                      F.count_if(F.col("length") < small_bytes).alias("small"))
    detail = F.concat(num("files"), F.lit(" files, "), num("bytes"), F.lit(" bytes; "), num("small"),
                      F.lit(f" below {small_bytes // MIB} MiB"))
    anomaly = (F.col("files") > 1) & (F.col("small") * 2 > F.col("files"))
    return _checks(g, "L10", detail, anomaly)


# L24 body, set-oriented: the sample rule's text, one row per table.
GZIP_RULE_SQL = """
WITH gzip_cols AS (
  SELECT table_id, count(DISTINCT CASE WHEN compression = 'GZIP' THEN path_in_schema END) AS n
  FROM chunks GROUP BY table_id
)
SELECT table_id,
  CONCAT(
    CASE WHEN n = 0 THEN 'No GZIP compression found. All columns use efficient compression.'
         ELSE 'Found ' || n || ' columns using GZIP compression. '
              || 'SNAPPY is recommended for better read performance.' END,
    '\\n\\n',
    'Indicator: ',
    CASE WHEN n = 0 THEN 'Optimized - OPT_2001' ELSE 'Anomaly - ERR_1001' END
  ) AS result
FROM gzip_cols
"""
