"""Built-in check catalog: one row of rule attributes per check id.

The catalog is bounded by the number of rules (tens of rows), so it is the
one side that is always broadcast when findings are assembled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas

R = schemas.rule_row

BUILTIN_RULES: list[dict] = [
    # -- lakehouse storage / structure --------------------------------------
    R("L1", "Structure", "Table names follow a medallion layer convention (bronze/silver/gold prefix).",
      "Prefix tables with their layer (bronze_, silver_, gold_) so lineage is visible.", 3, "table"),
    R("L2", "Structure", "Partitioned tables keep enough bytes per partition.",
      "Drop or coarsen partition columns whose partitions hold too little data.", 2, "table",
      "-- repartition {full_table_name} on a coarser key"),
    R("L3", "Structure", "Large tables are Z-ordered by OPTIMIZE.",
      "Run OPTIMIZE ... ZORDER BY on frequently filtered columns.", 3, "table",
      "OPTIMIZE {full_table_name} ZORDER BY (<column>)"),
    R("L8", "Maintenance", "Log and deleted-file retention are set within policy.",
      "Set delta.logRetentionDuration and delta.deletedFileRetentionDuration explicitly.", 2, "table",
      "ALTER TABLE {full_table_name} SET TBLPROPERTIES ('delta.logRetentionDuration'='interval 30 days')"),
    R("L9", "Maintenance", "VACUUM ran recently.",
      "Schedule VACUUM to remove files no longer referenced.", 2, "table", "VACUUM {full_table_name}"),
    R("L10", "Compression", "Small files are a small share of the table.",
      "Compact small files with OPTIMIZE.", 2, "table", "OPTIMIZE {full_table_name}"),
    R("L11", "Compression", "Column chunks compress well.",
      "Review encodings and codec of poorly compressing columns.", 3, "column"),
    R("L12", "Performance", "Rows are not concentrated on a few key values or files.",
      "Salt or re-partition skewed keys; rebalance files.", 2, "table"),
    R("L13", "Performance", "Low-cardinality columns use dictionary encoding.",
      "Enable dictionary encoding for repetitive columns.", 3, "column"),
    R("L14", "Performance", "Row groups are sized for scans.",
      "Rewrite files with a larger parquet.block.size.", 2, "table", "OPTIMIZE {full_table_name}"),
    R("L15", "Performance", "Enough row groups and files to parallelise reads.",
      "Split large single files so readers can use all slots.", 3, "table"),
    R("L16", "Metadata", "Columns carry documentation comments.",
      "Add COMMENT to columns.", 3, "table"),
    R("L17", "Delta Lake", "The log is checkpointed regularly.",
      "Keep checkpoints enabled (delta.checkpointInterval).", 2, "table"),
    R("L18", "Delta Lake", "Auto-optimize properties are enabled.",
      "Set delta.autoOptimize.optimizeWrite and autoCompact to true.", 3, "table",
      "ALTER TABLE {full_table_name} SET TBLPROPERTIES ('delta.autoOptimize.optimizeWrite'='true')"),
    R("L19", "Delta Lake", "Files carry data-skipping statistics.",
      "Write files with statistics so readers can skip them.", 2, "table"),
    R("L19L", "Delta Lake", "Live files carry statistics in their add actions.",
      "Write files with statistics so readers can skip them.", 2, "table"),
    R("L21", "Data Quality", "Column NULL ratio from footer statistics.",
      "Investigate columns that are mostly NULL.", 3, "column"),
    R("L22", "Parquet File Structure", "Column chunks of a row group are contiguous in the file.",
      "Rewrite files that have gaps or overlaps between column chunks.", 2, "table"),
    # Fixed texts of the two published sample rules.
    R("L23", "Schema", "Check for tables with excessive column count.",
      "Tables with many columns can impact scan performance. Consider vertical partitioning for wide tables.", 3, "table"),
    R("L24", "Compression", "Check for columns using GZIP compression instead of SNAPPY.",
      "Switch from GZIP to SNAPPY compression for better read performance, unless storage cost is the primary concern.",
      2, "column"),
    # -- schema -------------------------------------------------------------
    R("L4", "Schema", "Column names follow snake_case.",
      "Rename columns to lower snake_case.", 3, "column",
      "ALTER TABLE {full_table_name} RENAME COLUMN {column_name} TO <snake_case_name>"),
    R("L5", "Schema", "Nullable columns that never hold NULL.",
      "Declare NOT NULL where the data allows it.", 3, "column"),
    R("L7", "Schema", "Audit columns (created/updated timestamps) are present.",
      "Add created_at / updated_at audit columns.", 3, "table"),
    R("Q11", "Maintainability", "Column names avoid reserved words and mixed case.",
      "Rename columns that are reserved words or not snake_case.", 3, "column"),
    R("Q13", "Maintainability", "Columns avoid deprecated data types.",
      "Replace deprecated physical types (INT96 timestamps and similar).", 2, "column"),
    # -- data quality -------------------------------------------------------
    R("Q1", "Data Quality", "NULL values per column.",
      "Fill or constrain columns with unexpected NULL values.", 2, "column"),
    R("Q2", "Data Quality", "Foreign-key integrity: child rows without a parent row.",
      "Load missing parents or remove orphan child rows.", 1, "table"),
    R("Q4", "Data Quality", "Duplicate key values.",
      "De-duplicate rows and enforce the key upstream.", 1, "table"),
    R("L6", "Data Quality", "Text columns that hold only numbers or dates.",
      "Store numeric and date values with numeric/date types.", 3, "column",
      "ALTER TABLE {table_name} ALTER COLUMN {column_name} <typed column>"),
    R("L12K", "Performance", "Key frequency skew.",
      "Salt hot keys or pre-aggregate before joins.", 2, "column"),
    R("L20", "Data Quality", "Column cardinality.",
      "Review constant columns; drop or document them.", 3, "column"),
    R("Q6", "Performance", "Observed text lengths per column.",
      "Size text columns to the observed maximum; move very long text out of hot tables.", 3, "column"),
    R("Q7", "Performance", "Column statistics profile.",
      "Keep statistics current on filtered and joined columns.", 3, "column"),
    R("Q17", "Data Management", "Rows older than the retention horizon.",
      "Archive or purge rows beyond the retention period.", 3, "column"),
    # -- security / governance ---------------------------------------------
    R("Q8N", "Security", "Column names that suggest sensitive data.",
      "Classify and mask sensitive columns.", 2, "column"),
    R("Q8V", "Security", "Values that look like personal data (e-mail, phone, card number).",
      "Mask or tokenise personal data.", 1, "column"),
    R("Q9", "Security", "Sensitive columns without a masking or row-level policy.",
      "Add a masking policy to every sensitive column.", 1, "column"),
    R("Q10", "Security", "Members of privileged roles.",
      "Limit privileged role membership to administrators.", 1, "database"),
    R("Q15", "Maintainability", "Cross-schema dependencies.",
      "Keep dependencies inside a schema or document them.", 3, "schema"),
    R("Q16", "Standards", "Settings differ from the expected policy.",
      "Align settings with the policy value.", 2, "database"),
]


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The catalog as a DataFrame with the ``rules`` schema."""
    return spark.createDataFrame(BUILTIN_RULES, schemas.RULES)
