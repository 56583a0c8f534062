"""State of Delta tables from the newest log checkpoint plus the commits after it.

Writers delete old commits once a checkpoint covers them, so the commits that are left do not tell which files are live
or what the settings and columns are. A checkpoint holds the same actions as Parquet rows: the state at its
version, in one file or in several parts.

* Of each table's checkpoints the newest *complete* one counts (all parts there; a writer that died half-way leaves
  fewer). It is found from the listing alone.
* What a file's name says (table, version, part) is taken from it once a file, not once a row, and meets the rows
  by a broadcast of the files wanted: no row of a checkpoint is shuffled to be picked. Files of checkpoints that do not
  count are not opened; the paths of the others (one a part) are a condition on the file's path.
* Checkpoint rows are read with one fixed schema for all tables; columns a writer added (parsed
  statistics, ...) are never read, those it left out are null. They become rows of the log frame, at the checkpoint's version
  and before every commit line (position -1), so that every operator over log frames works on them unchanged: the last
  writer of a path, of the settings or of the schema wins by (version, position), whichever source it comes from.
* Commits the checkpoint covers are left out before their lines are parsed.

``schema_fields`` turns ``schemaString`` documents of any depth into rows, level by level: each level is one
job over the fields of all tables, so the number of jobs follows the depth of the deepest schema, not the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import shared_dir
from .delta_log import ITEM_SUFFIX, LOG_DIR, _plain_path, _table_dir, _visible, existing_globs, log_listing, read_log

# Fixed layout of checkpoint names: version, and for multi-part ones the part and the number of parts.
CHECKPOINT_FILE = r"^(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet$"

_PAYLOADS = {"add": "add", "remove": "remove", "metaData": "meta_data", "protocol": "protocol"}
CHECKPOINT_ROWS = T.StructType([T.StructField(name, schemas.LOG_ACTIONS[column].dataType)
                                for name, column in _PAYLOADS.items()])


def _name_parts(name: Column) -> list[Column]:
    """version, part and parts of a checkpoint file name (one part of one where the name has no number)."""
    number = lambda g: F.regexp_extract(name, CHECKPOINT_FILE, g)
    one = lambda g: F.when(number(g) == "", F.lit(1)).otherwise(number(g).try_cast("int"))
    return [number(1).try_cast("long").alias("version"), one(2).alias("part"), one(3).alias("parts")]


def newest_checkpoints(listing: DataFrame) -> DataFrame:
    """``table_id, checkpoint_version, parts`` of each table's newest complete checkpoint."""
    files = listing.filter(F.col("kind") == "checkpoint").select("table_id", *_name_parts(F.col("file_name")))
    whole = (files.groupBy("table_id", "version", "parts").agg(F.count_distinct("part").alias("there"))
             .filter(F.col("there") == F.col("parts")))
    last = whole.groupBy("table_id").agg(F.max(F.struct("version", "parts")).alias("c"))
    return last.select("table_id", F.col("c.version").alias("checkpoint_version"), F.col("c.parts").alias("parts"))


def usable_listing(listing: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """The listing of log files with the newest complete checkpoint of each table as its only checkpoint."""
    newest = newest_checkpoints(listing) if newest is None else newest
    kept = newest.select("table_id", F.lit(None).cast("string").alias("file_name"), F.lit("checkpoint").alias("kind"),
                         F.col("checkpoint_version").alias("version"))
    return listing.filter(F.col("kind") != "checkpoint").unionByName(kept)


def read_checkpoints(spark: SparkSession, root: str, newest: DataFrame) -> DataFrame:
    """Rows of the ``newest`` checkpoints in the shape of the log frame (``schemas.LOG_ACTIONS``)."""
    base = f"{root.rstrip('/')}/*/*{ITEM_SUFFIX}/Tables"
    globs = existing_globs(spark, [f"{base}/*/{LOG_DIR}/*.checkpoint*.parquet", f"{base}/*/*/{LOG_DIR}/*.checkpoint*.parquet"])
    if not globs:
        return spark.createDataFrame([], schemas.LOG_ACTIONS)
    files = (spark.read.format("binaryFile").load(globs).select(F.col("_metadata.file_path").alias("uri"))
             .withColumn("file_path", _plain_path("uri")).filter(_visible(_table_dir(F.col("file_path")))))
    version, _, parts = _name_parts(F.element_at(F.split("file_path", "/"), -1))
    files = files.select("uri", _table_dir(F.col("file_path")).alias("table_id"), version, parts)
    wanted = newest.select("table_id", F.col("checkpoint_version").alias("version"), "parts")
    files = files.join(wanted, ["table_id", "version", "parts"], "left_semi").select("uri", "table_id", "version")
    uris = [r.uri for r in files.select("uri").collect()]
    rows = spark.read.schema(CHECKPOINT_ROWS).parquet(*globs).filter(F.col("_metadata.file_path").isin(uris))
    rows = rows.select("*", F.col("_metadata.file_path").alias("uri")).join(F.broadcast(files), "uri")
    action = F.coalesce(*(F.when(F.col(name).isNotNull(), F.lit(name)) for name in _PAYLOADS))
    columns = {"pos": F.lit(-1), "action": action, **{column: F.col(name) for name, column in _PAYLOADS.items()}}
    return rows.filter(action.isNotNull()).select(*(
        columns.get(f.name, F.col(f.name) if f.name in ("table_id", "version") else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.LOG_ACTIONS))


def read_state(spark: SparkSession, root: str) -> DataFrame:
    """The log frame of every table: its newest complete checkpoint, then the commits after it."""
    newest = newest_checkpoints(log_listing(spark, root))
    return read_checkpoints(spark, root, newest).unionByName(read_log(spark, root, after=newest))


def metadata_versions(log: DataFrame) -> DataFrame:
    """``table_id, version, schema_string, partition_columns``: the last metaData of each version that has one."""
    found = log.filter(F.col("meta_data").isNotNull()).groupBy("table_id", "version").agg(
        F.max_by("meta_data", "pos").alias("m"))
    return found.select("table_id", "version", F.col("m.schemaString").alias("schema_string"),
                        F.coalesce("m.partitionColumns", F.array().cast("array<string>")).alias("partition_columns"))


def current_metadata(log: DataFrame) -> DataFrame:
    """``metadata_versions`` of each table's latest version only."""
    return metadata_versions(log).groupBy("table_id").agg(
        F.max_by(F.struct("version", "schema_string", "partition_columns"), "version").alias("m")).select("table_id", "m.*")


def _children() -> Column:
    """Fields right below a type document (``type``, a variant): those of a struct, the element of an array, the key and
    value of a map; none below anything else."""
    def get(doc: Column, key: str, kind: str) -> Column:
        return F.try_variant_get(doc, f"$.{key}", kind)

    def inner(name: str, key: str, ordinal: int, nullable: Column) -> Column:
        return F.struct(F.lit(ordinal).alias("ordinal"), F.lit(name).alias("name"), get(F.col("type"), key, "variant").alias("type"),
                        nullable.alias("nullable"), F.lit(None).cast("string").alias("comment"))

    doc = F.col("type")
    kind = get(doc, "type", "string")
    fields = F.transform(get(doc, "fields", "array<variant>"), lambda f, i: F.struct(
        (i + 1).alias("ordinal"), get(f, "name", "string").alias("name"), get(f, "type", "variant").alias("type"),
        get(f, "nullable", "boolean").alias("nullable"), get(f, "metadata.comment", "string").alias("comment")))
    return (F.when(kind == "struct", fields)
            .when(kind == "array", F.array(inner("element", "elementType", 1, get(doc, "containsNull", "boolean"))))
            .when(kind == "map", F.array(inner("key", "keyType", 1, F.lit(False)),
                                         inner("value", "valueType", 2, get(doc, "valueContainsNull", "boolean")))))


def schema_fields(metadata: DataFrame) -> DataFrame:
    """``table_id, version, depth, ordinal, path, name, data_type, nullable, comment, is_partition``: every field of
    every schema, at every depth. A document that is no JSON has no fields."""
    shared_dir(metadata.sparkSession)
    level = metadata.select("table_id", "version", "partition_columns", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("path"),
                            F.try_parse_json("schema_string").alias("type")).filter(F.col("type").isNotNull())
    found = []
    while True:
        below = level.select("table_id", "version", "partition_columns", (F.col("depth") + 1).alias("depth"),
                             F.col("path").alias("above"), F.explode(_children()).alias("f"))
        level = below.select("table_id", "version", "partition_columns", "depth",
                             F.concat_ws(".", "above", "f.name").alias("path"), "f.*").checkpoint(eager=True)
        if found and level.isEmpty():
            break
        found.append(level)
    fields = found[0]
    for deeper in found[1:]:
        fields = fields.unionByName(deeper)
    plain = F.schema_of_variant("type") == "STRING"
    kind = F.when(plain, F.try_variant_get("type", "$", "string")).otherwise(F.try_variant_get("type", "$.type", "string"))
    return fields.select("table_id", "version", "depth", "ordinal", "path", "name", kind.alias("data_type"), "nullable", "comment",
                         ((F.col("depth") == 1) & F.array_contains("partition_columns", F.col("name"))).alias("is_partition"))


def state_columns(fields: DataFrame) -> DataFrame:
    """The ``columns`` frame (``schemas.COLUMNS``) from the log's schemas: partition columns and comments included."""
    return fields.filter(F.col("depth") == 1).select(
        "table_id", F.col("table_id").alias("table_name"), "ordinal", F.col("name").alias("column_name"), "data_type",
        F.lit(None).cast("string").alias("physical_type"), "nullable", "comment")


def schema_changes(fields: DataFrame) -> DataFrame:
    """``table_id, version, path, change, before, after``: fields added, dropped or changed (type, nullability, comment)
    from one version of a table's schema to the next."""
    order = Window.partitionBy("table_id").orderBy("version")  # the versions of one table that have a metaData
    steps = (fields.select("table_id", "version").distinct()
             .withColumn("previous", F.lag("version").over(order)).filter(F.col("previous").isNotNull()))
    described = F.struct("data_type", F.coalesce("nullable", F.lit(True)).alias("nullable"),
                         F.coalesce("comment", F.lit("")).alias("comment"))
    new = fields.join(steps.drop("previous"), ["table_id", "version"]).select(
        "table_id", "version", "path", described.alias("new"))
    old = (fields.withColumnRenamed("version", "previous").join(steps, ["table_id", "previous"])
           .select("table_id", "version", "path", described.alias("old")))
    both = new.join(old, ["table_id", "version", "path"], "full")

    def change(name: str, at: Column, before: Column, after: Column) -> Column:
        return F.when(at, F.struct(F.lit(name).alias("change"), before.cast("string").alias("before"),
                                   after.cast("string").alias("after")))
    nothing = F.lit(None).cast("string")
    held = F.col("new").isNotNull() & F.col("old").isNotNull()
    kinds = F.array(
        change("added", F.col("old").isNull(), nothing, F.col("new.data_type")),
        change("dropped", F.col("new").isNull(), F.col("old.data_type"), nothing),
        *(change(name, held & (F.col(f"new.{name}") != F.col(f"old.{name}")), F.col(f"old.{name}"), F.col(f"new.{name}"))
          for name in ("data_type", "nullable", "comment")))
    return both.select("table_id", "version", "path", F.explode(F.filter(kinds, lambda c: c.isNotNull())).alias("c")) \
        .select("table_id", "version", "path", "c.*")
