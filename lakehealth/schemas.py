"""Fixed StructTypes of the engine's frames (no inference anywhere)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()
MAP_SS = T.MapType(S, S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


TABLES = _struct(("table_id", S), ("workspace_id", S), ("workspace_name", S), ("lakehouse_id", S),
                 ("lakehouse_name", S), ("schema_name", S), ("table_name", S), ("table_path", S))

COLUMNS = _struct(("table_id", S), ("table_name", S), ("ordinal", I), ("column_name", S),
                  ("data_type", S), ("physical_type", S), ("nullable", B), ("comment", S))

RULES = _struct(("rule_id", S), ("category", S), ("description", S), ("recommendation", S),
                ("status", S), ("severity", I), ("content", S), ("level", S), ("kind", S),
                ("sql", S), ("column_sql", S), ("remediation_template", S))

# What every check operator returns: one row per (location, check).
CHECKS = _struct(("rule_id", S), ("table_id", S), ("schema_name", S), ("table_name", S),
                 ("column_name", S), ("detail", S), ("is_anomaly", B), ("dynamic_remediation", S),
                 ("result", S))

FINDINGS = _struct(("rule_id", S), ("level", S), ("workspace_name", S), ("workspace_id", S),
                   ("source_name", S), ("source_id", S), ("schema_name", S), ("table_name", S),
                   ("column_name", S), ("category", S), ("description", S), ("recommendation", S),
                   ("severity", I), ("content", S), ("result", S), ("is_anomaly", B),
                   ("scan_date", S), ("remediation_script", S), ("table_path", S), ("extra", MAP_SS))

FINDINGS_PRIORITY = ["rule_id", "level", "workspace_name", "workspace_id", "source_name",
                     "source_id", "schema_name", "table_name", "column_name"]

# Parquet column-chunk metadata, one row per (file, row group, column chunk).
CHUNKS = _struct(("table_id", S), ("file_name", S), ("file_path", S), ("row_group_id", L),
                 ("row_group_num_rows", L), ("row_group_num_columns", L), ("row_group_bytes", L),
                 ("column_id", L), ("path_in_schema", S), ("type", S), ("encodings", S),
                 ("compression", S), ("num_values", L), ("total_compressed_size", L),
                 ("total_uncompressed_size", L), ("stats_min", S), ("stats_max", S),
                 ("stats_null_count", L), ("stats_distinct_count", L), ("file_offset", L),
                 ("data_page_offset", L), ("dictionary_page_offset", L))

FILE_SCHEMA = _struct(("table_id", S), ("file_path", S), ("ordinal", I), ("column_name", S),
                      ("data_type", S), ("nullable", B))

# Rows of a data file that are deleted without writing it anew; part of the file's identity in the log.
DELETION_VECTOR = _struct(("storageType", S), ("pathOrInlineDv", S), ("offset", I), ("sizeInBytes", I),
                          ("cardinality", L))

LOG_ACTIONS = T.StructType([
    T.StructField("table_id", S), T.StructField("version", L), T.StructField("pos", I),
    T.StructField("action", S), T.StructField("line", S),
    T.StructField("commit_info", _struct(("timestamp", L), ("operation", S),
                                         ("operationParameters", MAP_SS))),
    T.StructField("meta_data", _struct(("id", S), ("name", S), ("schemaString", S),
                                       ("partitionColumns", T.ArrayType(S)), ("configuration", MAP_SS),
                                       ("description", S), ("createdTime", L),
                                       ("format", _struct(("provider", S), ("options", MAP_SS))))),
    T.StructField("protocol", _struct(("minReaderVersion", I), ("minWriterVersion", I),
                                      ("readerFeatures", T.ArrayType(S)), ("writerFeatures", T.ArrayType(S)))),
    T.StructField("add", _struct(("path", S), ("size", L), ("partitionValues", MAP_SS), ("stats", S),
                                 ("modificationTime", L), ("dataChange", B), ("deletionVector", DELETION_VECTOR))),
    T.StructField("remove", _struct(("path", S), ("deletionTimestamp", L), ("dataChange", B),
                                    ("deletionVector", DELETION_VECTOR))),
])


def rule_row(rule_id: str, category: str, description: str, recommendation: str,
             severity: int, level: str, remediation_template: str | None = None) -> dict:
    return {"rule_id": rule_id, "category": category, "description": description,
            "recommendation": recommendation, "status": "true", "severity": severity,
            "content": "analysis", "level": level, "kind": "builtin", "sql": None,
            "column_sql": None, "remediation_template": remediation_template}
