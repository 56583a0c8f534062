"""Parquet footer source (S5, S6): column-chunk metadata and file schemas.

Files are listed with the ``binaryFile`` source selecting only ``path`` and
``length`` (the content column is pruned, so no data bytes are read). The
listing is spread over tasks and each task opens only the *footers* of its
files with pyarrow (``mapInArrow``); whole files are never downloaded. The
work therefore grows with the number of files, one small ranged read each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

# The executor-side readers below use only the standard library and pyarrow;
# shipping this module by value means executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def list_files(spark: SparkSession, root: str, *, recursive: bool = False,
               pattern: str = "*.parquet") -> DataFrame:
    """(file_path, file_name, length) of the Parquet files under ``root`` (no content read)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return (reader.load(root).select(F.col("path").alias("file_path"), "length")
            .withColumn("file_name", F.element_at(F.split("file_path", "/"), -1)))


def table_of_stem(path: str | Column = "file_path") -> Column:
    """Table id for a folder of ``<table>.parquet`` files: the file stem."""
    p = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(p, r"([^/]+)\.parquet$", 1)


def top_files(files: DataFrame, n: int | None) -> DataFrame:
    """Keep the first ``n`` files of each table in path order (``None`` keeps all).

    Applied before any footer is opened; Spark plans the filter on
    ``row_number`` as a per-partition group limit.
    """
    if n is None:
        return files
    w = Window.partitionBy("table_id").orderBy("file_path")
    return files.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def _open(uri: str):
    """Random-access file for a path as Spark lists it (``file:/x``, ``s3a://b/k``, ...). Such a path is
    not URL-encoded: ``%``, ``#`` and spaces stand for themselves, so only the scheme is taken off."""
    from pyarrow import fs as pafs
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        path = uri if not colon or "/" in scheme else rest
        return pafs.LocalFileSystem().open_input_file("/" + path.lstrip("/"))
    scheme = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme)
    authority, _, path = rest.removeprefix("//").partition("/")
    filesystem, path = pafs.FileSystem.from_uri(f"{scheme}://{authority}/{quote(path)}")
    return filesystem.open_input_file(path)


def _stat(v):
    if v is None:
        return None
    if isinstance(v, bytes):
        return v.decode("utf-8", "replace")
    return str(v)


def _chunk_rows(table_id: str, path: str) -> list[dict]:
    import pyarrow.parquet as pq
    with _open(path) as f:
        md = pq.ParquetFile(f).metadata
    name = path.rsplit("/", 1)[-1]
    rows = []
    for g in range(md.num_row_groups):
        rg = md.row_group(g)
        for c in range(rg.num_columns):
            cc = rg.column(c)
            st = cc.statistics if cc.is_stats_set else None
            has_mm = st is not None and st.has_min_max
            rows.append({
                "table_id": table_id, "file_name": name, "file_path": path, "row_group_id": g,
                "row_group_num_rows": rg.num_rows, "row_group_num_columns": rg.num_columns,
                "row_group_bytes": rg.total_byte_size, "column_id": c,
                "path_in_schema": cc.path_in_schema, "type": cc.physical_type,
                "encodings": ", ".join(cc.encodings), "compression": cc.compression,
                "num_values": cc.num_values, "total_compressed_size": cc.total_compressed_size,
                "total_uncompressed_size": cc.total_uncompressed_size,
                "stats_min": _stat(st.min) if has_mm else None,
                "stats_max": _stat(st.max) if has_mm else None,
                "stats_null_count": st.null_count if st is not None and st.has_null_count else None,
                "stats_distinct_count": (st.distinct_count if st is not None and st.has_distinct_count
                                         else None),
                "file_offset": cc.file_offset, "data_page_offset": cc.data_page_offset,
                "dictionary_page_offset": cc.dictionary_page_offset if cc.has_dictionary_page else None,
            })
    return rows


def _chunk_reader(arrow_schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_chunks(batches, arrow_schema)
    return read


def _read_chunks(batches: Iterator[pa.RecordBatch], arrow_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        for tid, path in zip(d["table_id"], d["file_path"]):
            try:
                rows = _chunk_rows(tid, path)
            except (pa.ArrowInvalid, FileNotFoundError):
                continue  # no Parquet file, or gone since it was listed: see unreadable_files
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)


_SPARK_NAMES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float",
    "double": "double", "string": "string", "large_string": "string", "bool": "boolean",
    "date32[day]": "date", "binary": "binary",
}


def spark_type_name(t: pa.DataType) -> str:
    """Arrow type -> Spark SQL type name (``array<float>``, ``timestamp`` ...)."""
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"array<{spark_type_name(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"{f.name}:{spark_type_name(f.type)}" for f in t) + ">"
    if pa.types.is_map(t):
        return f"map<{spark_type_name(t.key_type)},{spark_type_name(t.item_type)}>"
    if pa.types.is_timestamp(t):
        return "timestamp" if t.tz else "timestamp_ntz"
    if pa.types.is_decimal(t):
        return f"decimal({t.precision},{t.scale})"
    return _SPARK_NAMES.get(str(t), str(t))


def _schema_reader(arrow_schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _read_schemas(batches, arrow_schema)
    return read


def _read_schemas(batches: Iterator[pa.RecordBatch], arrow_schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import pyarrow.parquet as pq
    for b in batches:
        d = b.to_pydict()
        for tid, path in zip(d["table_id"], d["file_path"]):
            try:
                with _open(path) as f:
                    sch = pq.ParquetFile(f).schema_arrow
            except (pa.ArrowInvalid, FileNotFoundError):
                continue
            rows = [{"table_id": tid, "file_path": path, "ordinal": i + 1, "column_name": fld.name,
                     "data_type": spark_type_name(fld.type), "nullable": fld.nullable}
                    for i, fld in enumerate(sch)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_schema)


def _arrow_schema(struct) -> pa.Schema:
    m = {"string": pa.string(), "bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(),
         "integer": pa.int32(), "boolean": pa.bool_()}
    return pa.schema([pa.field(f.name, m[f.dataType.simpleString()]) for f in struct.fields])


def _spread(files: DataFrame, tasks_per_core: int) -> DataFrame:
    """Hash-spread the listing over ``tasks_per_core`` x default parallelism tasks.

    An explicit partition count keeps AQE from coalescing the (byte-small)
    listing into one task, which would serialise the footer reads; on a
    cluster the count follows the executor cores.
    """
    n = max(files.sparkSession.sparkContext.defaultParallelism, 1) * max(tasks_per_core, 1)
    return files.repartition(n, "file_path")


def footer_chunks(files: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Column-chunk metadata of every file in ``files`` (needs ``table_id``, ``file_path``)."""
    return _spread(files.select("table_id", "file_path"), tasks_per_core) \
        .mapInArrow(_chunk_reader(_arrow_schema(schemas.CHUNKS)), schemas.CHUNKS)


def file_schemas(files: DataFrame, tasks_per_core: int = 2) -> DataFrame:
    """Top-level schema of every file: (table_id, file_path, ordinal, column_name, data_type, nullable)."""
    return _spread(files.select("table_id", "file_path"), tasks_per_core) \
        .mapInArrow(_schema_reader(_arrow_schema(schemas.FILE_SCHEMA)), schemas.FILE_SCHEMA)


def unreadable_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Listed files that no footer was read from (not Parquet, or gone since): table_id, file_path. Other
    I/O errors fail the task, so that a store that cannot be reached never looks like an empty table.
    A file without a column has no chunk either and is listed here as well."""
    return files.select("table_id", "file_path").join(chunks.select("file_path").distinct(), "file_path", "left_anti")


def table_columns(file_schema: DataFrame) -> DataFrame:
    """``columns`` frame: one row per (table, column) over all files of the table.

    A column is nullable if any file declares it so; the ordinal is the
    smallest position seen. Comments are not stored in Parquet footers.
    """
    return (file_schema.groupBy("table_id", "column_name")
            .agg(F.min("ordinal").alias("ordinal"), F.min("data_type").alias("data_type"),
                 F.max(F.col("nullable").cast("int")).cast("boolean").alias("nullable"))
            .select("table_id", F.col("table_id").alias("table_name"), "ordinal", "column_name",
                    "data_type", F.lit(None).cast("string").alias("physical_type"), "nullable",
                    F.lit(None).cast("string").alias("comment")))


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder of ``<table>.parquet`` datasets, with ``table_id`` = stem."""
    files = list_files(spark, folder)
    return files.withColumn("table_id", table_of_stem())
