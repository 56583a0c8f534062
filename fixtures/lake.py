"""A Delta-layout lake derived from the driver's tables.

Production scans read logs that Delta
writers produced; the tests need such logs *derived from the given tables*
so that an independent SQL oracle can recompute every log-based result.

Layout under ``root`` (one workspace, one lakehouse)::

    <ws>/<lh>.Lakehouse/Tables/lineitem/            data (partitioned by l_returnflag) + log:
        one commit per ship month (version = months since the first month),
        one add action per (month, return flag, supplier);
        version 3 has one malformed line, version 5 is missing
    <ws>/<lh>.Lakehouse/Tables/sales/orders/        schema layout, one commit, adds per o_orderstatus
    <ws>/<lh>.Lakehouse/Tables/empty_table/         log only, no data files
    <ws>/<lh>.Lakehouse/Tables/_scratch/            hidden, must be skipped
    <ws>/<lh>.Lakehouse/Tables/notes/               folder without a log, not a table

Log lines are computed by Spark (grouped aggregates of the tables) and
written with the text writer; the per-version part files are then renamed to
``<20-digit version>.json`` with Hadoop FileSystem calls (metadata only).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehealth.session import scratch_path

BAD_VERSION = 3
MISSING_VERSION = 5


def table_settings(nations: int, regions: int, flags: int) -> tuple[dict, dict]:
    """Settings of lineitem and orders, from row counts of the given tables."""
    days = nations + regions
    return ({"delta.logRetentionDuration": f"interval {days} days",
             "delta.deletedFileRetentionDuration": f"interval {regions + 2} days",
             "delta.autoOptimize.optimizeWrite": "true" if flags > 1 else "false"},
            {"delta.logRetentionDuration": f"interval {2 * days} days"})


def _map(d: dict) -> Column:
    if not d:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def _line(name: str, payload: Column) -> Column:
    return F.to_json(F.struct(payload.alias(name)))


def _commit(ts_ms: Column, op: Column, params: Column) -> Column:
    return _line("commitInfo", F.struct(ts_ms.alias("timestamp"), op.alias("operation"),
                                        params.alias("operationParameters")))


def _protocol() -> Column:
    return _line("protocol", F.struct(F.lit(1).alias("minReaderVersion"), F.lit(2).alias("minWriterVersion")))


def _metadata(table: str, schema_json: str, parts: list[str], conf: dict) -> Column:
    return _line("metaData", F.struct(F.lit(f"{table}-id").alias("id"), F.lit(table).alias("name"),
                                      F.lit(schema_json).alias("schemaString"),
                                      F.array(*[F.lit(p) for p in parts]).cast("array<string>").alias("partitionColumns"),
                                      _map(conf).alias("configuration")))


def _add(path: Column, size: Column, pcol: str, pval: Column, stats: Column) -> Column:
    return _line("add", F.struct(path.alias("path"), size.alias("size"),
                                 F.create_map(F.lit(pcol), pval).alias("partitionValues"), stats.alias("stats")))


def lineitem_log(lineitem: DataFrame, first_month, conf: dict) -> DataFrame:
    """(table, version, pos, line) of the lineitem table's commits."""
    month = F.trunc("l_shipdate", "month")
    g = lineitem.groupBy(month.alias("month"), "l_returnflag", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("version", F.months_between("month", F.lit(first_month).cast("date")).cast("long"))
    per_version = g.groupBy("version", "month").agg(F.count(F.lit(1)).alias("files"))
    mon = F.month("month")
    op = (F.when(F.col("version") == 0, "CREATE TABLE").when(mon == 1, "OPTIMIZE")
          .when(mon == 7, "VACUUM END").otherwise("WRITE"))
    params = (F.when(mon == 1, _map({"zOrderBy": '["l_shipdate"]'}))
              .when(mon == 7, _map({})).otherwise(_map({"mode": "Append"})))
    ts = F.unix_date("month").cast("long") * 86400000
    commits = per_version.select("version", F.lit(0).alias("pos"), _commit(ts, op, params).alias("line"))
    # one data file per (month, return flag, supplier): the log grows with the table
    adds = g.select("version", (F.ascii("l_returnflag").cast("long") * 10 ** 12 + F.col("l_suppkey") + 10)
                    .alias("pos"), _add(
        F.concat(F.lit("l_returnflag="), F.col("l_returnflag"), F.lit("/part-"),
                 F.lpad(F.col("version").cast("string"), 5, "0"), F.lit("-"), F.col("l_returnflag"),
                 F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".snappy.parquet")),
        F.col("n") * 128 + 4096, "l_returnflag", F.col("l_returnflag"),
        F.when(F.col("l_returnflag") != "N",
               F.concat(F.lit('{"numRecords":'), F.col("n").cast("string"), F.lit("}")))).alias("line"))
    bad = per_version.filter(F.col("version") == BAD_VERSION).select(
        "version", F.lit(10 ** 15).alias("pos"), F.lit('{"add": {"path": ').alias("line"))
    schema_json = lineitem.schema.json()
    head = per_version.filter(F.col("version") == 0).select(
        "version", F.explode(F.array(
            F.struct(F.lit(1).alias("pos"), _protocol().alias("line")),
            F.struct(F.lit(2).alias("pos"), _metadata("lineitem", schema_json, ["l_returnflag"],
                                                      conf).alias("line")))).alias("h")
    ).select("version", "h.pos", "h.line")
    out = commits.unionByName(head).unionByName(adds).unionByName(bad)
    return out.filter(F.col("version") != MISSING_VERSION).withColumn("table", F.lit("lineitem"))


def orders_log(orders: DataFrame, conf: dict) -> DataFrame:
    g = orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"),
                                            F.min("o_orderdate").alias("first"))
    adds = g.select(F.lit(0).cast("long").alias("version"), (F.lit(10) + F.ascii("o_orderstatus")).alias("pos"),
                    _add(F.concat(F.lit("o_orderstatus="), F.col("o_orderstatus"), F.lit("/part-0.parquet")),
                         F.col("n") * 64 + 1024, "o_orderstatus", F.col("o_orderstatus"),
                         F.concat(F.lit('{"numRecords":'), F.col("n").cast("string"), F.lit("}"))).alias("line"))
    head = orders.agg(F.min("o_orderdate").alias("first")).select(
        F.lit(0).cast("long").alias("version"), F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), _commit(F.unix_date(F.to_date("first")).cast("long") * 86400000,
                                                    F.lit("CREATE TABLE"), _map({})).alias("line")),
            F.struct(F.lit(1).alias("pos"), _protocol().alias("line")),
            F.struct(F.lit(2).alias("pos"), _metadata("orders", orders.schema.json(), ["o_orderstatus"],
                                                      conf).alias("line")))).alias("h")
    ).select("version", "h.pos", "h.line")
    return adds.unionByName(head).withColumn("table", F.lit("sales.orders"))


def _empty_log(spark: SparkSession, table: str, orders: DataFrame) -> DataFrame:
    """One commit without data, made when the first order was."""
    return orders.agg((F.unix_date(F.to_date(F.min("o_orderdate"))).cast("long") * 86400000).alias("n")).select(
        F.lit(0).cast("long").alias("version"), F.explode(F.array(
            F.struct(F.lit(0).alias("pos"), _commit(F.col("n").cast("long"), F.lit("CREATE TABLE"),
                                                    _map({})).alias("line")),
            F.struct(F.lit(1).alias("pos"), _protocol().alias("line")))).alias("h"),
    ).select("version", "h.pos", "h.line", F.lit(table).alias("table"))


def lake_location(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Workspace and lakehouse names: the first nation's region and name."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    row = (n.join(r, n.n_regionkey == r.r_regionkey).orderBy("n_nationkey")
           .select("r_name", "n_name").first())
    return row["r_name"], row["n_name"]


def build_lake(spark: SparkSession, sf_dir: str, root: str | None = None, with_data: bool = True) -> str:
    """Write the lake under ``root`` (default: a new folder in the shared checkpoint dir).

    ``with_data=False`` writes only the logs (enough for log-based checks)."""
    root = (root or scratch_path(spark, "lake")).rstrip("/")
    ws, lh = lake_location(spark, sf_dir)
    base = f"{root}/{ws}/{lh}.Lakehouse/Tables"
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    if with_data:
        li.write.mode("overwrite").partitionBy("l_returnflag").parquet(f"{base}/lineitem")
        orders.write.mode("overwrite").partitionBy("o_orderstatus").parquet(f"{base}/sales/orders")
    spark.read.parquet(f"{sf_dir}/region.parquet").write.mode("overwrite").json(f"{base}/notes")
    first_month = li.agg(F.min(F.trunc("l_shipdate", "month"))).first()[0]
    nations, regions = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("nation", "region"))
    conf = table_settings(nations, regions, li.select("l_returnflag").distinct().count())
    lines = (lineitem_log(li, first_month, conf[0]).unionByName(orders_log(orders, conf[1]))
             .unionByName(_empty_log(spark, "empty_table", orders))
             .unionByName(_empty_log(spark, "_scratch", orders)))
    staging = f"{root}/_staging_log"
    (lines.repartition("table", "version").sortWithinPartitions("table", "version", "pos")
     .select("table", "version", "line").write.mode("overwrite").partitionBy("table", "version").text(staging))
    _publish(spark, staging, base)
    return root


def _publish(spark: SparkSession, staging: str, base: str) -> None:
    """Rename ``table=t/version=v/part-*`` to ``<t as path>/_delta_log/<v:020d>.json``."""
    from urllib.parse import unquote
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path_cls = jvm.org.apache.hadoop.fs.Path
    fs = path_cls(staging).getFileSystem(conf)
    for st in fs.globStatus(path_cls(f"{staging}/table=*/version=*/part-*")):
        p = st.getPath()
        version = int(p.getParent().getName().split("=", 1)[1])
        table = unquote(p.getParent().getParent().getName().split("=", 1)[1]).replace(".", "/")
        log_dir = path_cls(f"{base}/{table}/_delta_log")
        fs.mkdirs(log_dir)
        fs.rename(p, path_cls(log_dir, f"{version:020d}.json"))


# -- workspace scan documents -------------------------------------------------------------------

HOST = "store.example.net"
BATCH = 100  # items per scan document, like the service's request batching


def workspace_name_col(n_nationkey: Column, n_name: Column) -> Column:
    return F.when(n_nationkey == 24, F.lit("PersonalWorkspace System")).otherwise(n_name)


def payload_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan documents (JSON text): workspace = nation, lakehouses = its customers,
    warehouses = its suppliers; each document holds one batch of at most 100 items."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ws_id = F.concat(F.lit("ws-"), F.col("n_nationkey").cast("string"))
    ws_name = workspace_name_col(F.col("n_nationkey"), F.col("n_name"))
    lh = c.join(n, c.c_nationkey == n.n_nationkey).select(
        ws_id.alias("wid"), ws_name.alias("wname"), F.call_function("div", F.col("c_custkey"), F.lit(BATCH)).alias("b"),
        F.struct(F.concat(F.lit("lh-"), F.col("c_custkey").cast("string")).alias("id"),
                 F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("DataflowsStagingLakehouse"))
                 .otherwise(F.col("c_name")).alias("name"),
                 F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("extendedProperties")).alias("item"))
    bal = F.col("s_acctbal")
    wh = s.join(n, s.s_nationkey == n.n_nationkey).select(
        ws_id.alias("wid"), ws_name.alias("wname"), F.call_function("div", F.col("s_suppkey"), F.lit(BATCH)).alias("b"),
        F.struct(F.concat(F.lit("wh-"), F.col("s_suppkey").cast("string")).alias("id"),
                 F.when(bal < 0, F.concat(F.lit("DataflowsStaging_"), F.col("s_name")))
                 .when(bal < 1000, F.concat(F.lit("StagingWarehouseForDataflows_"), F.col("s_suppkey").cast("string")))
                 .when((bal >= 5000) & (bal < 6000), F.lit(None))
                 .otherwise(F.col("s_name")).alias("name"),
                 F.when((bal >= 5000) & (bal < 6000), F.concat(F.lit("Display "), F.col("s_name")))
                 .alias("displayName")).alias("item"))

    def docs(items: DataFrame, key: str) -> DataFrame:
        g = items.groupBy("wid", "wname", "b").agg(F.collect_list("item").alias("items"))
        ws = F.struct(F.col("wid").alias("id"), F.col("wname").alias("name"),
                      F.lit("Active").alias("state"), F.col("items").alias(key))
        return g.select(F.to_json(F.struct(F.array(ws).alias("workspaces"))).alias("doc"))

    return docs(lh, "Lakehouse").unionByName(docs(wh, "warehouses"))


def write_payload(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    path = (root or scratch_path(spark, "scan")).rstrip("/") + "/payload"
    payload_docs(spark, sf_dir).write.mode("overwrite").text(path)
    return path
