"""A Delta-layout lake whose state lies in checkpoints, derived from the driver's tables.

Layout under ``root`` (one workspace, one lakehouse)::

    Tables/lineitem/      one commit per ship month (version = months since the first), one add per (month, return
                          flag, supplier); a commit removes the files of flag R that are six versions old.
                          Checkpoints: an older one, the newest complete one (version C, two parts or more, by the number
                          of files) and a newer one whose last part is missing. Commits before C - 3 are cleaned away. Version C + 2 changes
                          the schema and the settings, with two metaData actions.
    Tables/sales/orders/  one commit per year; one checkpoint at the last version, of another shape (parsed statistics,
                          no removes); all commits but the last cleaned away
    Tables/plain/         region's schema, no file, one commit
    Tables/parts/         two adds and a remove of one path with deletion vectors, per brand of part
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtures.lake import _add, _commit, _line, _map, _protocol, _publish, lake_location
from lakehealth.session import scratch_path

AGE = 6  # versions after which files of flag R are removed
PART_ROWS = 500_000  # files of the table for each part of a checkpoint
COMMENTED = ["l_orderkey", "l_partkey", "l_quantity"]


def _columns_oracle(table: str) -> str:
    """SQL: ordinal, name and log type of the columns of a given table."""
    return f"""(SELECT row_number() OVER () AS i, column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'long'
                WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string'
                ELSE 'timestamp_ntz' END AS kind FROM (DESCRIBE {table}))"""


def commented(schema: T.StructType, names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"comment": f"Comment on {f.name}"} if f.name in names else {})
                         for f in schema])


def changed_schema(schema: T.StructType) -> T.StructType:
    """Comments on three columns, l_linenumber a long and NOT NULL, l_tax dropped, a nested column added."""
    fields = [T.StructField("l_linenumber", T.LongType(), False) if f.name == "l_linenumber" else f
              for f in commented(schema, COMMENTED) if f.name != "l_tax"]
    tag = T.StructType([T.StructField("k", T.StringType(), False), T.StructField("w", T.IntegerType())])
    note = T.StructType([T.StructField("tags", T.ArrayType(tag, False)),
                         T.StructField("scores", T.MapType(T.StringType(), T.ArrayType(T.DoubleType())))])
    return T.StructType([*fields, T.StructField("l_note", note, True, {"comment": "Notes"})])


def meta(table: str, schema: T.StructType, parts: list[str], conf: dict, **more):
    fields = {"id": F.lit(f"{table}-id"), "schemaString": F.lit(schema.json()),
              "partitionColumns": F.array(*(F.lit(p) for p in parts)).cast("array<string>"), "configuration": _map(conf),
              "format": F.struct(F.lit("parquet").alias("provider"), _map({}).alias("options")),
              **{k: F.lit(v) for k, v in more.items()}}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _file(path, size, pcol, pval, stats):
    return F.struct(path.alias("path"), F.create_map(F.lit(pcol), pval).alias("partitionValues"), size.alias("size"),
                    F.lit(0).cast("long").alias("modificationTime"), F.lit(True).alias("dataChange"), stats.alias("stats"))


def _rows(df: DataFrame, **columns) -> DataFrame:
    return df.select(*(v.alias(k) for k, v in columns.items()))


def write_checkpoint(spark, rows: list[DataFrame], staging: str, base: str, table: str, version: int, parts: int = 1,
                     written: int | None = None) -> None:
    """The rows as one checkpoint file, or as ``parts`` files of which ``written`` are there. One job writes all the parts."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    all_rows = rows[0]
    for r in rows[1:]:
        all_rows = all_rows.unionByName(r, allowMissingColumns=True)
    folder = f"{staging}/{table.replace('/', '.')}-{version}"
    dealt = all_rows.withColumn("part_of", F.pmod(F.xxhash64(F.to_json(F.struct("*"))), F.lit(parts)) + 1)
    dealt.repartition(parts, "part_of").write.partitionBy("part_of").parquet(folder)
    target = path(f"{base}/{table}/_delta_log")
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    for part in range(1, (written or parts) + 1):
        mine = path(f"{folder}/part_of={part}")
        if not fs.exists(mine):  # no row was dealt to this part
            all_rows.limit(0).coalesce(1).write.parquet(mine.toString())
        number = f".{part:010d}.{parts:010d}" if parts > 1 else ""
        for st in fs.globStatus(path(mine, "part-*")):
            fs.rename(st.getPath(), path(target, f"{version:020d}.checkpoint{number}.parquet"))


def build_state_lake(spark: SparkSession, sf_dir: str, root: str | None = None) -> str:
    root = (root or scratch_path(spark, "state-lake")).rstrip("/")
    ws, lh = lake_location(spark, sf_dir)
    base, staging = f"{root}/{ws}/{lh}.Lakehouse/Tables", f"{root}/_staging"
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    li, orders, region, part = read("lineitem"), read("orders"), read("region"), read("part")
    days = read("nation").count() + region.count()
    one = spark.range(1)

    # lineitem
    first = li.agg(F.min(F.trunc("l_shipdate", "month"))).first()[0]
    files = li.groupBy(F.trunc("l_shipdate", "month").alias("month"), "l_returnflag", "l_suppkey").agg(F.count("*").alias("n")) \
        .withColumn("version", F.months_between("month", F.lit(first).cast("date")).cast("long"))
    files = files.checkpoint(eager=True)
    last, count = files.agg(F.max("version"), F.count("*")).first()
    parts = -(-count // PART_ROWS)
    at = last // 10 * 10 - 10
    name = F.concat(F.lit("l_returnflag="), "l_returnflag", F.lit("/part-"), F.lpad(F.col("version").cast("string"), 5, "0"),
                    F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".parquet"))
    stats = F.when(F.col("l_returnflag") != "N", F.concat(F.lit('{"numRecords":'), F.col("n").cast("string"), F.lit("}")))
    size = F.col("n") * 128 + 4096
    old = (F.col("l_returnflag") == "R")
    conf = [{"delta.logRetentionDuration": f"interval {days} days", "delta.autoOptimize.autoCompact": "true"},
            {"delta.logRetentionDuration": f"interval {2 * days} days", "delta.deletedFileRetentionDuration": "interval 9 days"}]
    metas = [meta("lineitem", li.schema, ["l_returnflag"], conf[0], name="lineitem", createdTime=0),
             meta("lineitem", changed_schema(li.schema), ["l_returnflag"], conf[0], name="renamed", description="first of two"),
             meta("lineitem", changed_schema(li.schema), ["l_returnflag"], conf[1])]

    def tombstone(when):
        return F.struct(name.alias("path"), when.alias("deletionTimestamp"), F.lit(True).alias("dataChange"))

    def state(version: int) -> list[DataFrame]:
        gone = old & (F.col("version") + AGE <= version)
        seen = files.filter(F.col("version") <= version)
        return [_rows(seen.filter(~gone), add=_file(name, size, "l_returnflag", F.col("l_returnflag"), stats)),
                _rows(seen.filter(gone), remove=tombstone(F.lit(1).cast("long"))), _rows(one, metaData=metas[0]),
                _rows(one, protocol=F.struct(F.lit(1).alias("minReaderVersion"), F.lit(2).alias("minWriterVersion")))]

    write_checkpoint(spark, state(at - 10), staging, base, "lineitem", at - 10, parts=parts)
    parts = max(parts, 2)
    write_checkpoint(spark, state(at), staging, base, "lineitem", at, parts=parts)
    write_checkpoint(spark, state(at + 10), staging, base, "lineitem", at + 10, parts=parts, written=parts - 1)
    months = files.select("version").distinct()
    lines = [
        _rows(months, version=F.col("version"), pos=F.lit(0).cast("long"), line=_commit(F.col("version"), F.lit("WRITE"), _map({}))),
        _rows(files, version=F.col("version"), pos=F.lit(10).cast("long"),
              line=_add(name, size, "l_returnflag", F.col("l_returnflag"), stats)),
        _rows(files.filter(old & (F.col("version") + AGE <= last)), version=F.col("version") + AGE, pos=F.lit(20).cast("long"),
              line=_line("remove", tombstone(F.col("version") + AGE))),
        _rows(one, version=F.lit(at + 2).cast("long"), pos=F.lit(30).cast("long"), line=_line("metaData", metas[1])),
        _rows(one, version=F.lit(at + 2).cast("long"), pos=F.lit(31).cast("long"), line=_line("metaData", metas[2])),
    ]
    commits = [df.filter(F.col("version") >= at - 3).withColumn("table", F.lit("lineitem")) for df in lines]

    # orders
    ord_files = orders.groupBy(F.year("o_orderdate").alias("y"), "o_orderstatus").agg(F.count("*").alias("n"))
    ord_files = ord_files.withColumn("version", (F.col("y") - F.lit(orders.agg(F.min(F.year("o_orderdate"))).first()[0])).cast("long"))
    ord_last = ord_files.agg(F.max("version")).first()[0]
    oname = F.concat(F.lit("o_orderstatus="), "o_orderstatus", F.lit("/part-"), F.col("version").cast("string"), F.lit(".parquet"))
    osize, ostats = F.col("n") * 64 + 1024, F.concat(F.lit('{"numRecords":'), F.col("n").cast("string"), F.lit("}"))
    with_parsed = _file(oname, osize, "o_orderstatus", F.col("o_orderstatus"), ostats).withField(
        "stats_parsed", F.struct(F.col("n").alias("numRecords")))
    ord_conf = {"delta.autoOptimize.optimizeWrite": "true"}
    write_checkpoint(spark, [
        _rows(ord_files, add=with_parsed), _rows(one, txn=F.struct(F.lit("app").alias("appId"), F.lit(1).alias("version"))),
        _rows(one, metaData=meta("orders", commented(orders.schema, orders.columns), ["o_orderstatus"], ord_conf)),
        _rows(one, protocol=F.struct(F.lit(3).alias("minReaderVersion"), F.lit(7).alias("minWriterVersion"),
                                     F.array(F.lit("deletionVectors")).alias("readerFeatures"),
                                     F.array(F.lit("deletionVectors")).alias("writerFeatures")))],
        staging, base, "sales/orders", ord_last)
    commits.append(_rows(ord_files.filter(F.col("version") == ord_last), version=F.col("version"), pos=F.lit(1).cast("long"),
                         line=_add(oname, osize, "o_orderstatus", F.col("o_orderstatus"), ostats))
                   .withColumn("table", F.lit("sales.orders")))

    # plain: a schema and no file
    zero = F.lit(0).cast("long")
    commits += [_rows(one, version=zero, pos=F.lit(k).cast("long"), line=line).withColumn("table", F.lit("plain"))
                for k, line in enumerate([_commit(zero, F.lit("CREATE TABLE"), _map({})), _protocol(),
                                          _line("metaData", meta("plain", region.schema, [], {}))])]

    # parts: an update by deletion vector removes the file without one and adds it with one, in either order
    brands = part.groupBy("p_brand").agg(F.count("*").alias("n"))
    vector = F.struct(F.lit("u").alias("storageType"), F.col("p_brand").alias("pathOrInlineDv"), F.lit(1).alias("offset"),
                      F.lit(40).alias("sizeInBytes"), F.lit(3).cast("long").alias("cardinality"))
    bname = F.concat("p_brand", F.lit(".parquet"))
    plain_file = F.struct(bname.alias("path"), F.create_map().cast("map<string,string>").alias("partitionValues"), F.col("n").alias("size"))
    commits += [
        _rows(brands, version=zero, pos=F.lit(1).cast("long"), line=_line("add", plain_file)),
        _rows(brands, version=zero + 1, pos=F.lit(1).cast("long"),
              line=_line("add", plain_file.withField("deletionVector", vector))),
        _rows(brands, version=zero + 1, pos=F.lit(2).cast("long"), line=_line("remove", F.struct(bname.alias("path"))))]
    commits[-3:] = [df.withColumn("table", F.lit("parts")) for df in commits[-3:]]

    lines = commits[0]
    for df in commits[1:]:
        lines = lines.unionByName(df)
    folder = f"{root}/_staging_log"
    (lines.repartition("table", "version").sortWithinPartitions("table", "version", "pos", "line")
     .select("table", "version", "line").write.partitionBy("table", "version").text(folder))
    _publish(spark, folder, base)
    return root
