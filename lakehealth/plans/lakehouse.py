"""Lakehouse metadata scan: files -> footers -> columns -> storage and schema checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import schema as schema_checks
from ..operators import storage
from ..sources import footers
from ..session import shared_dir
from .findings import union_all


@dataclass
class Metadata:
    files: DataFrame    # table_id, file_path, file_name, length
    chunks: DataFrame   # schemas.CHUNKS
    columns: DataFrame  # schemas.COLUMNS


def folder_metadata(spark: SparkSession, folder: str, *, max_files_per_table: int | None = None,
                    persist: bool = False) -> Metadata:
    """Metadata of a folder of ``<table>.parquet`` datasets.

    ``persist=True`` checkpoints the footer frames into the shared checkpoint
    folder so that many checks reuse one footer pass and the lineage (a
    Python scan) is not replayed when an executor is lost.
    """
    files = footers.top_files(footers.folder_files(spark, folder), max_files_per_table)
    chunks = footers.footer_chunks(files)
    columns = footers.table_columns(footers.file_schemas(files))
    if persist:
        shared_dir(spark)   # the cluster's checkpoint folder (a local one only where unset, as in tests)
        chunks = chunks.checkpoint(eager=True)
        columns = columns.checkpoint(eager=True)
    return Metadata(files, chunks, columns)


def storage_checks(md: Metadata) -> DataFrame:
    c = md.chunks
    return union_all([
        storage.compression_ratio(c), storage.dictionary_encoding(c), storage.row_group_sizing(c),
        storage.read_parallelism(c), storage.chunk_statistics(c), storage.null_ratio(c),
        storage.offset_continuity(c), storage.file_sizes(md.files),
    ], schemas.CHECKS)


def schema_checks_all(md: Metadata) -> DataFrame:
    cols = md.columns
    return union_all([
        schema_checks.column_naming(cols), schema_checks.naming_standard(cols),
        schema_checks.sensitive_names(cols), schema_checks.audit_columns(cols),
        schema_checks.column_docs(cols), schema_checks.wide_tables(cols),
        schema_checks.nullability(cols, md.chunks), schema_checks.deprecated_types(md.chunks),
    ], schemas.CHECKS)


def register_metadata_views(md: Metadata) -> None:
    """Metadata frames as SQL views for catalog rules."""
    md.chunks.createOrReplaceTempView("chunks")
    md.columns.createOrReplaceTempView("columns")
    md.files.createOrReplaceTempView("files")


def register_log_views(log: DataFrame, tables: DataFrame) -> None:
    """The log frame and the discovered tables as SQL views for catalog rules."""
    log.createOrReplaceTempView("log_actions")
    tables.createOrReplaceTempView("tables")


def tables_of(md: Metadata) -> DataFrame:
    """One row per table seen in the listing."""
    return md.files.select("table_id").distinct()


__all__ = ["Metadata", "folder_metadata", "storage_checks", "schema_checks_all",
           "register_metadata_views", "register_log_views", "tables_of"]
