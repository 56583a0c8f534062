"""Delta transaction-log source (S4, S11, A4, X10, X12) and table discovery.

All log files of all tables are read in one job: ``text(wholetext)`` gives one
row per commit file, ``posexplode`` over its
lines gives the action position, and ``from_json`` with a fixed schema parses
the typed payloads. A malformed line becomes a row with NULL payloads and
action, so one bad line no longer drops the whole version.

A commit has no greatest size (one that adds a million files has 200 MB), and a row is held in memory several times over
while it is cut into lines. So files beyond ``WHOLE_COMMIT`` bytes are read line by line, in splits; see ``_numbered_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

# Fixed layout of a lakehouse folder: <root>/<workspace>/<lakehouse>.Lakehouse/Tables/...
ITEM_SUFFIX = ".Lakehouse"
LOG_DIR = "_delta_log"
VERSION_FILE = r"^(\d{20})\.json$"
#: Bytes up to which a commit is read as one row.
WHOLE_COMMIT = 8 * 1024 * 1024

_ACTION_SCHEMA = T.StructType([
    T.StructField("commitInfo", schemas.LOG_ACTIONS["commit_info"].dataType),
    T.StructField("metaData", schemas.LOG_ACTIONS["meta_data"].dataType),
    T.StructField("protocol", schemas.LOG_ACTIONS["protocol"].dataType),
    T.StructField("add", schemas.LOG_ACTIONS["add"].dataType),
    T.StructField("remove", schemas.LOG_ACTIONS["remove"].dataType),
])


def log_globs(root: str) -> list[str]:
    """Log files of flat (``Tables/t``) and schema (``Tables/s/t``) layouts."""
    base = f"{root.rstrip('/')}/*/*{ITEM_SUFFIX}/Tables"
    return [f"{base}/*/{LOG_DIR}/*.json", f"{base}/*/*/{LOG_DIR}/*.json"]


def existing_globs(spark: SparkSession, globs: list[str]) -> list[str]:
    """Keep the globs that match at least one path (a reader fails on an empty glob)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for g in globs:
        p = jvm.org.apache.hadoop.fs.Path(g)
        st = p.getFileSystem(conf).globStatus(p)
        if st is not None and len(st) > 0:
            out.append(g)
    return out


def _plain_path(column: str) -> Column:
    """The path as the file system has it: ``_metadata.file_path`` is URL-encoded, the path of a
    listing is not, and tables are joined on it. (``url_decode`` would also turn ``+`` to a space.)"""
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def _visible(table_dir: Column) -> Column:
    """No path segment below ``Tables/`` starts with ``_`` or ``.``."""
    return ~table_dir.rlike(r"/Tables/(.*/)?[_.][^/]*$")


def _table_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/" + LOG_DIR + r"/[^/]+$", 1)


def _split_location(table_dir: Column) -> dict[str, Column]:
    """workspace / lakehouse / schema / table from ``.../<ws>/<lh>.Lakehouse/Tables/<a>[/<b>]``."""
    m = r"/([^/]+)/([^/]+)\.Lakehouse/Tables/([^/]+)(?:/([^/]+))?$"
    a = F.regexp_extract(table_dir, m, 3)
    b = F.regexp_extract(table_dir, m, 4)
    return {
        "workspace_name": F.regexp_extract(table_dir, m, 1),
        "lakehouse_name": F.regexp_extract(table_dir, m, 2),
        "schema_name": F.when(b == "", F.lit("dbo")).otherwise(a),
        "table_name": F.when(b == "", a).otherwise(b),
    }


def list_log_files(spark: SparkSession, root: str) -> DataFrame:
    """(table_dir, file_path, file_name) of every ``_delta_log/*.json`` under the lake (no content read)."""
    globs = existing_globs(spark, log_globs(root))
    if not globs:
        return spark.createDataFrame([], "table_dir string, file_path string, file_name string")
    paths = (spark.read.format("binaryFile").load(globs)
             .select(F.col("path").alias("file_path")))
    return paths.select(_table_dir(F.col("file_path")).alias("table_dir"), "file_path",
                        F.element_at(F.split("file_path", "/"), -1).alias("file_name"))


def discover_tables(spark: SparkSession, root: str, inventory: DataFrame | None = None) -> DataFrame:
    """S3: one row per Delta table (a folder holding ``_delta_log``).

    * folders whose name starts with ``_`` or ``.`` are skipped (P4);
    * ``Tables/<t>`` is a table in schema ``dbo``; ``Tables/<s>/<t>`` is a
      table in schema ``s`` unless ``Tables/<s>`` is itself a table (J5);
    * ids come from the inventory (``workspace_name``, ``name``) when given.
    """
    dirs = list_log_files(spark, root).select("table_dir").distinct()
    loc = _split_location(F.col("table_dir"))
    t = dirs.select("table_dir", *[v.alias(k) for k, v in loc.items()])
    t = t.filter(~F.col("table_name").rlike(r"^[_.]") & ~F.col("schema_name").rlike(r"^[_.]")
                 & (F.col("table_name") != ""))
    flat = t.filter(F.col("schema_name") == "dbo").select(F.col("table_dir").alias("__parent"))
    t = (t.withColumn("__parent", F.regexp_extract("table_dir", r"^(.*)/[^/]+$", 1))
         .join(flat, "__parent", "left_anti").drop("__parent"))
    t = t.withColumn("table_path", F.col("table_dir")).withColumn("table_id", F.col("table_dir"))
    if inventory is not None:
        inv = inventory.select(F.col("workspace_name").alias("__w"), F.col("name").alias("__l"),
                               F.col("workspace_id"), F.col("id").alias("lakehouse_id"))
        t = t.join(inv, (F.col("workspace_name") == F.col("__w")) & (F.col("lakehouse_name") == F.col("__l")),
                   "left").drop("__w", "__l")
    else:
        t = t.withColumns({"workspace_id": F.lit(None).cast("string"),
                           "lakehouse_id": F.lit(None).cast("string")})
    return t.filter(F.col("table_path").isNotNull()).select(*schemas.TABLES.fieldNames())


def _commits(files: DataFrame, max_versions: int | None = None, after: DataFrame | None = None) -> DataFrame:
    """``table_id`` and ``version`` beside the ``file_path`` of each visible commit that ``read_log`` is asked for."""
    files = files.filter(_visible(_table_dir(F.col("file_path"))))
    name = F.element_at(F.split("file_path", "/"), -1)
    files = (files.withColumn("version", F.regexp_extract(name, VERSION_FILE, 1))
             .filter(F.col("version") != "")
             .withColumn("version", F.col("version").cast("long")))
    if max_versions is not None:
        files = files.filter(F.col("version") < max_versions)
    files = files.withColumn("table_id", _table_dir(F.col("file_path")))
    if after is not None:
        # One row a table: broadcast, as a join by shuffle brings all commits of a table to one task.
        files = (files.join(F.broadcast(after.select("table_id", "checkpoint_version")), "table_id", "left")
                 .filter(F.col("version") > F.coalesce("checkpoint_version", F.lit(-1))))
    return files


def _numbered_lines(spark: SparkSession, globs: list[str], uris: list[str]) -> DataFrame:
    """``table_id, version, pos, line`` of the commits at ``uris``, read in splits of their files.

    Within a split the rows' running ids follow the lines; the lines of a file's earlier splits are counted and added. Only
    these counts, a row a split, are shuffled and broadcast: no line is. Both readings must cut the files alike, and a scan that
    is planned twice need not (the splits follow from the cores there are at that moment), so both take the rows of one RDD."""
    scan = (spark.read.text(globs, lineSep="\n").filter(F.col("_metadata.file_path").isin(uris))
            .select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("uri"),
                    F.col("_metadata.file_block_start").alias("start")))
    rows = DataFrame(spark._jsparkSession.createDataFrame(scan._jdf.toJavaRDD(), scan._jdf.schema()), spark)
    lines = rows.withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("uri", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("uri").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("uri", "start", _plain_path("uri").alias("file_path"),
                           (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(_commits(splits)), ["uri", "start"]).select(
        "table_id", "version", (F.col("at") + F.col("shift")).cast("int").alias("pos"), "line")


def read_log(spark: SparkSession, root: str, max_versions: int | None = None,
             after: DataFrame | None = None) -> DataFrame:
    """One row per log line of every table: table_id, version, pos, action, typed payloads.

    ``max_versions`` keeps versions ``< n`` (the reference reads 0-9); the
    default reads all. ``after`` (``table_id, checkpoint_version``) leaves out, before any line is
    parsed, the versions that a table's checkpoint covers. Non-version files (``*.checkpoint.json`` etc.) are skipped.
    """
    globs = existing_globs(spark, log_globs(root))
    if not globs:
        return spark.createDataFrame([], schemas.LOG_ACTIONS)
    files = (spark.read.text(globs, wholetext=True).filter(F.col("_metadata.file_size") <= WHOLE_COMMIT)
             .select(F.col("value"), _plain_path("_metadata.file_path").alias("file_path")))
    lines = _commits(files, max_versions, after).select(
        "table_id", "version", F.posexplode(F.split("value", "\n")).alias("pos", "line"))
    large = (spark.read.format("binaryFile").load(globs).filter(F.col("length") > WHOLE_COMMIT)
             .select(F.col("_metadata.file_path").alias("uri")).withColumn("file_path", _plain_path("uri")))
    uris = [] if large.isEmpty() else [r.uri for r in _commits(large, max_versions, after).select("uri").collect()]
    if uris:
        lines = lines.unionByName(_numbered_lines(spark, globs, uris))
    lines = lines.filter(F.col("line") != "")
    parsed = F.from_json("line", _ACTION_SCHEMA)
    return lines.select(
        "table_id", "version", F.col("pos").cast("int").alias("pos"),
        F.element_at(F.json_object_keys("line"), 1).alias("action"), "line",
        parsed["commitInfo"].alias("commit_info"), parsed["metaData"].alias("meta_data"),
        parsed["protocol"].alias("protocol"), parsed["add"].alias("add"), parsed["remove"].alias("remove"))


def commit_summary(log: DataFrame) -> DataFrame:
    """A4: one row per (table, version); later actions win (``max_by`` on position)."""
    ci = F.col("commit_info")
    return log.groupBy("table_id", "version").agg(
        F.max_by(ci["timestamp"], F.when(ci.isNotNull(), F.col("pos"))).alias("timestamp"),
        F.max_by(ci["operation"], F.when(ci.isNotNull(), F.col("pos"))).alias("operation"),
        F.count(F.lit(1)).alias("actions"),
        F.count_if(F.col("action").isNull()).alias("bad_lines"),
        F.count_if(F.col("action") == "add").alias("adds"),
        F.count_if(F.col("action") == "remove").alias("removes"),
        F.coalesce(F.sum(F.col("add.size")), F.lit(0)).cast("long").alias("bytes_added"),
        F.coalesce(F.sum(F.get_json_object(F.col("add.stats"), "$.numRecords").cast("long")), F.lit(0))
        .cast("long").alias("records_added"),
    )


def latest_configuration(log: DataFrame) -> DataFrame:
    """(table_id, settings): the ``configuration`` map of each table's latest metaData."""
    md = log.filter(F.col("meta_data").isNotNull())
    return md.groupBy("table_id").agg(
        F.max_by(F.col("meta_data.configuration"), F.struct("version", "pos")).alias("settings"))


def table_properties(log: DataFrame) -> DataFrame:
    """The latest ``metaData.configuration`` of each table, one row per key."""
    md = log.filter(F.col("meta_data").isNotNull())
    latest = md.groupBy("table_id").agg(
        F.max_by(F.col("meta_data.configuration"), F.struct("version", "pos")).alias("conf"))
    return latest.select("table_id", F.explode("conf").alias("key", "value"))


def commit_attributes(log: DataFrame) -> DataFrame:
    """A4: ``metadata_*`` and ``format_*`` values of a commit, one row per (table, version, key).

    A commit may hold several metaData or protocol actions; each key keeps the value of the last action that *has*
    it. The actions' JSON objects are read as maps and folded in line order, so a later action without a
    key leaves the earlier value. Nested values stay JSON text.
    """
    def payload(name: str, prefix: str) -> Column:
        found = F.from_json(F.get_json_object("line", f"$.{name}"), schemas.MAP_SS)
        return F.when(F.col("action") == name, F.transform_keys(found, lambda k, _: F.concat(F.lit(prefix), k)))

    some = log.withColumn("attributes", F.coalesce(payload("metaData", "metadata_"), payload("protocol", "format_")))
    some = some.filter(F.col("attributes").isNotNull()).groupBy("table_id", "version").agg(
        F.sort_array(F.collect_list(F.struct("pos", F.map_entries("attributes").alias("entries")))).alias("actions"))
    folded = F.aggregate(
        "actions", F.create_map().cast(schemas.MAP_SS),
        lambda held, a: F.map_concat(
            F.map_filter(held, lambda k, _: ~F.exists(a["entries"], lambda e: e["key"] == k)),
            F.map_from_entries(a["entries"])))
    return some.select("table_id", "version", F.explode(folded).alias("key", "value"))


def _vector_id(action: str) -> Column:
    """Identity of the deletion vector of an add or remove action; empty without one."""
    v = F.col(f"{action}.deletionVector")
    return F.coalesce(F.concat(v["storageType"], v["pathOrInlineDv"],
                               F.coalesce(F.concat(F.lit("@"), v["offset"].cast("string")), F.lit(""))), F.lit(""))


def live_files(log: DataFrame) -> DataFrame:
    """Files added and not removed later (last action per path and deletion vector wins)."""
    adds = log.filter(F.col("add").isNotNull()).select(
        "table_id", F.col("add.path").alias("path"), _vector_id("add").alias("vector"), "version", "pos",
        F.lit(True).alias("is_add"), F.col("add.size").alias("size"), F.col("add.stats").alias("stats"),
        F.col("add.partitionValues").alias("partition_values"))
    rems = log.filter(F.col("remove").isNotNull()).select(
        "table_id", F.col("remove.path").alias("path"), _vector_id("remove").alias("vector"), "version", "pos",
        F.lit(False).alias("is_add"),
        F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("stats"),
        F.lit(None).cast(schemas.MAP_SS).alias("partition_values"))
    last = adds.unionByName(rems).groupBy("table_id", "path", "vector").agg(
        F.max_by(F.struct("is_add", "size", "stats", "partition_values"), F.struct("version", "pos")).alias("s"))
    return last.filter(F.col("s.is_add")).select("table_id", "path", "s.size", "s.stats", "s.partition_values")


def log_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file in the visible ``_delta_log`` folders: table_id, file_name, kind, version."""
    base = f"{root.rstrip('/')}/*/*{ITEM_SUFFIX}/Tables"
    globs = existing_globs(spark, [f"{base}/*/{LOG_DIR}/*", f"{base}/*/*/{LOG_DIR}/*"])
    if not globs:
        return spark.createDataFrame([], "table_id string, file_name string, kind string, version long")
    p = spark.read.format("binaryFile").load(globs).select(F.col("path").alias("file_path"))
    name = F.element_at(F.split("file_path", "/"), -1)
    kind = (F.when(name.rlike(VERSION_FILE), "commit")
            .when(name.rlike(r"^\d{20}\.checkpoint(\.\d+\.\d+)?\.parquet$"), "checkpoint").otherwise("other"))
    return p.select(_table_dir(F.col("file_path")).alias("table_id"), name.alias("file_name"), kind.alias("kind"),
                    F.regexp_extract(name, r"^(\d{20})", 1).cast("long").alias("version")) \
        .filter(_visible(F.col("table_id")))
