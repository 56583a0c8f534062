"""Registered queries whose input shows the hard cases, derived from the given tables, with the SQL for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtures import lake
from lakehealth import schemas
from lakehealth.functions import json as js
from lakehealth.operators import governance, quality, sketches, storage
from lakehealth.operators import schema as schema_ops
from lakehealth.plans.oracle_sql import TEST_SCHEMA, _sens_rows, q, res
from lakehealth.plans.registry import policies_from_regions
from lakehealth.plans.findings import conform
from lakehealth.plans.warehouse import check_view
from lakehealth.session import scratch_path
from lakehealth.sources import catalog, footers, inventory
from lakehealth.sources.tables import load_tables

SCAN_TS = "2024-05-01 00:00:00"
_DOCUMENTS: dict[tuple, str] = {}


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- inventory ------------------------------------------------------------------------------------------------

def write_documents(spark, sf_dir) -> str:
    """One pretty-printed scan document per nation, each in a file of its own: lakehouses = customers, warehouses =
    suppliers with nested and null properties, users = plain strings; and one file that is no JSON."""
    n, c, s = (_t(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    lakehouses = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("lh-"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("long").alias("capacity"),
        (F.col("c_acctbal") > 0).alias("active"),
        F.create_map(F.lit("segment"), "c_mktsegment", F.lit("tables path"), F.concat(F.lit("p/"), "c_custkey"))
        .alias("extendedProperties"))).alias("Lakehouse"))
    warehouses = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(
        F.concat(F.lit("wh-"), "s_suppkey").alias("id"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("displayName"),
        F.when(F.col("s_acctbal") > 0, F.lit("é \"quoted\"\n")).alias("description"),
        F.struct(F.col("s_suppkey").alias("labelId"), F.array(F.lit("a"), F.lit("b")).alias("tags")).alias("sensitivity")))
        .alias("warehouses"))
    joined = n.join(lakehouses, n.n_nationkey == F.col("c_nationkey"), "left").join(
        warehouses, n.n_nationkey == F.col("s_nationkey"), "left")
    workspace = F.struct(F.concat(F.lit("ws-"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("Active").alias("state"),
                         F.col("Lakehouse"), F.col("warehouses"), F.array(F.col("n_name"), F.lit("admin")).alias("users"))
    docs = joined.select(F.to_json(F.struct(F.array(workspace).alias("workspaces")), {"pretty": "true"}).alias("value"))
    path = f"{scratch_path(spark, 'documents')}/scan"
    docs.write.option("maxRecordsPerFile", 1).text(path)
    spark.range(1).select(F.lit('{"workspaces": [').alias("value")).write.mode("append").text(path)
    return path


def _documents(spark, sf_dir) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _DOCUMENTS:
        _DOCUMENTS[key] = write_documents(spark, sf_dir)
    return inventory.read_documents(spark, _DOCUMENTS[key])


def inv_item_properties(spark, sf_dir):
    """Every property of every item from documents laid out over many lines, with the scan date."""
    return inventory.item_properties(_documents(spark, sf_dir), SCAN_TS)


def inv_bad_documents(spark, sf_dir):
    """Documents that are no JSON are counted, not lost."""
    docs = _documents(spark, sf_dir)
    return docs.agg(F.count("doc").alias("good"), F.count_if(F.col("doc").isNull()).alias("bad"))


_PROPERTIES = """
    WITH lh AS (SELECT 'ws-' || n_nationkey AS w, n_name AS wn, 'Lakehouse' AS kind, 'lh-' || c_custkey AS id, c_name AS name, customer.*
                FROM customer JOIN nation ON c_nationkey = n_nationkey),
    wh AS (SELECT 'ws-' || n_nationkey AS w, n_name AS wn, 'warehouses' AS kind, 'wh-' || s_suppkey AS id,
                  CASE WHEN s_acctbal > 5000 THEN s_name ELSE 'Warehouse_wh-' || s_suppkey END AS name, supplier.*
           FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT w AS workspace_id, wn AS workspace_name, kind AS item_type, id, name, property, value,
           '2024-05-01T00:00:00.000Z' AS scan_date FROM (
        SELECT w, wn, kind, id, name, 'id' AS property, id AS value FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'name', c_name FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'capacity', CAST(CAST(trunc(c_acctbal) AS BIGINT) AS VARCHAR) FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'active', CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'false' END FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'ext_segment', c_mktsegment FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'ext_tables path', 'p/' || c_custkey FROM lh
        UNION ALL SELECT w, wn, kind, id, name, 'id', id FROM wh
        UNION ALL SELECT w, wn, kind, id, name, 'displayName', s_name FROM wh WHERE s_acctbal > 5000
        UNION ALL SELECT w, wn, kind, id, name, 'description', 'é "quoted"' || chr(10) FROM wh WHERE s_acctbal > 0
        UNION ALL SELECT w, wn, kind, id, name, 'sensitivity', '{"labelId":' || s_suppkey || ',"tags":["a","b"]}' FROM wh
        UNION ALL SELECT 'ws-' || n_nationkey, n_name, 'users', NULL, NULL, 'value', unnest([n_name, 'admin']) FROM nation)"""


# -- column chunks -----------------------------------------------------------------------------------------------

def derived_chunks(spark, sf_dir) -> DataFrame:
    """Chunks as a footer would list them: a file per supplier, a row group per ship year, a column per line number.
    Every third file has a gap before its fourth row group; in every fifth one chunk reaches past its two neighbours."""
    li = _t(spark, sf_dir, "lineitem")
    return spark.sql("""
        WITH c AS (SELECT concat('t', l_suppkey % 7) AS table_id, l_suppkey AS f, year(l_shipdate) - 1992 AS rg, l_linenumber - 1 AS col,
                          count(*) * 100 AS size, count(*) AS n FROM {li} GROUP BY ALL)
        SELECT table_id, concat('f', f) AS file_path, CAST(rg AS BIGINT) AS row_group_id, CAST(col AS BIGINT) AS column_id,
               sum(n) OVER (PARTITION BY f, rg) AS row_group_num_rows, CAST(NULL AS BIGINT) AS dictionary_page_offset,
               4 + coalesce(sum(size) OVER (PARTITION BY f ORDER BY rg, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + IF(f % 3 = 0 AND rg >= 3, 50, 0) AS data_page_offset,
               IF(f % 5 = 0 AND rg = 1 AND col = 0, size + 100000, size) AS total_compressed_size
        FROM c""", li=li)


def lk_offset_sweep(spark, sf_dir):
    """Gaps and overlaps over whole files of several row groups."""
    return check_view(storage.offset_sweep(derived_chunks(spark, sf_dir)))


def lk_file_row_skew(spark, sf_dir):
    """Rows of the largest file against the average file."""
    return check_view(storage.file_row_skew(derived_chunks(spark, sf_dir)))


_CHUNKS = """
    c AS (SELECT 't' || l_suppkey % 7 AS t, l_suppkey AS f, year(l_shipdate) - 1992 AS rg, l_linenumber - 1 AS col,
                 count(*) * 100 AS size, count(*) AS n FROM lineitem GROUP BY ALL),
    k AS (SELECT *, 4 + coalesce(sum(size) OVER (PARTITION BY f ORDER BY rg, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + CASE WHEN f % 3 = 0 AND rg >= 3 THEN 50 ELSE 0 END AS s,
                 size + CASE WHEN f % 5 = 0 AND rg = 1 AND col = 0 THEN 100000 ELSE 0 END AS len FROM c)"""


def _check(rule: str, body: str, column: str = "CAST(NULL AS VARCHAR)") -> str:
    return (f"SELECT '{rule}' AS rule_id, t AS table_name, {column} AS column_name, {res('d', 'a')} AS result, a AS is_anomaly "
            f"FROM ({body})")


def footer_first_files(spark, sf_dir):
    """Of tables with many more files the first five by path."""
    files = derived_chunks(spark, sf_dir).select("table_id", "file_path").distinct()
    return footers.top_files(files, 5).select(F.col("table_id").alias("table_name"), "file_path")


# -- data checks --------------------------------------------------------------------------------------------------

def _typed(spark, sf_dir):
    """Text columns of orders that stand for other types, and nearly do."""
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select(
        k.cast("string").alias("as_long"), F.when(k % 1000 == 1, "1e5").otherwise(F.col("o_custkey").cast("string")).alias("as_double"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_date"),
        F.when(k % 777 == 0, "2024-01-01 12:30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("as_time"),
        F.when(k % 777 == 0, "2024-01-01 99:99").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("no_time"),
        F.when(k % 777 == 0, "2024-02-30").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("no_date"),
        F.when(k % 2 == 0, "true").when(k % 3 == 0, "FALSE").alias("as_boolean"),
        F.when(k % 2 == 0, "12").otherwise("1998-01-01").alias("mixed"), F.lit(None).cast("string").alias("nothing"))


def lk_narrowest_types(spark, sf_dir):
    """Narrowest common type of every text column, of whole values."""
    return check_view(quality.narrowest_types({**load_tables(spark, sf_dir), "typed_orders": _typed(spark, sf_dir)}))


def wh_column_ranges(spark, sf_dir):
    """Q7: smallest and largest value of every atomic column."""
    return check_view(quality.column_ranges(load_tables(spark, sf_dir)))


def _columns_frame(spark, sf_dir) -> DataFrame:
    rows = [(t, f.name) for t, df in load_tables(spark, sf_dir).items() for f in df.schema.fields]
    return conform(spark.createDataFrame(rows, "table_id string, column_name string"), schemas.COLUMNS)


def wh_policy_coverage_all(spark, sf_dir):
    """Q9: masking policies of columns that are sensitive by value or by name."""
    tables = load_tables(spark, sf_dir)
    extra = {**tables, "contacts": _t(spark, sf_dir, "customer").select(F.col("c_name").alias("email_address"),
                                                                       F.col("c_acctbal").alias("salary"))}
    columns = _columns_frame(spark, sf_dir).unionByName(conform(spark.createDataFrame(
        [("contacts", f.name) for f in extra["contacts"].schema.fields], "table_id string, column_name string"), schemas.COLUMNS))
    sensitive = governance.sensitive_values(extra).unionByName(schema_ops.sensitive_names(columns))
    policies = policies_from_regions(_t(spark, sf_dir, "region")).unionByName(
        _t(spark, sf_dir, "region").filter("r_name = 'AFRICA'").select(
            F.lit("contacts").alias("table_name"), F.lit("salary").alias("column_name"), F.lit("mask_pay").alias("policy")))
    return check_view(governance.policy_coverage(sensitive, policies))


def wh_sketch_profile(spark, sf_dir):
    """Sketches of three runs over parts of every table, added up and held against the exact form."""
    tables = load_tables(spark, sf_dir)
    first = {t: F.col(f"`{df.columns[0]}`") for t, df in tables.items()}
    runs = [sketches.sketch({t: df.where(F.pmod(F.coalesce(F.xxhash64(first[t]), F.lit(0)), F.lit(3)) == k)
                             for t, df in tables.items()}, f"run {k}") for k in range(3)]
    found = sketches.estimates(sketches.merge(runs[0].unionByName(runs[1]).unionByName(runs[2])))
    exact = quality.column_profile(tables, {"ndv"}).select("table_name", "column_name", F.col("ndv").alias("exact"))
    both = found.join(exact, ["table_name", "column_name"])
    return both.select("table_name", "column_name", "rows", "nonnull", "numbers",
                       F.when(F.col("exact") <= 1000, F.col("top_count")).alias("top_count"),
                       (F.abs(F.col("distinct") - F.col("exact")) * 100 <= F.col("exact") * 8 + 100).alias("distinct_close"))


def flatten_json_detected(spark, sf_dir):
    """T4: JSON columns found by parsing whole columns; look-alikes are left alone."""
    e = _t(spark, sf_dir, "events").select(
        "event_id", F.col("props").alias("ext_props"), F.concat(F.lit("{"), "event_type", F.lit("}")).alias("ext_braces"),
        F.lit(None).cast("string").alias("ext_none"), F.col("event_type").alias("ext_kind"))
    found = js.flatten_json(e)
    return found.select("event_id", F.concat_ws(",", F.array_sort(F.array(*(F.lit(c) for c in found.columns)))).alias("columns"),
                        F.col("ext_props_map")["k"].alias("k"))


def rule_problems(spark, sf_dir):
    """R2: rules that could not run as they stand, from a catalog made of the parts."""
    p, k = _t(spark, sf_dir, "part"), F.col("p_partkey")
    text = lambda cond, value: F.when(cond, F.lit(value))
    rules = p.select(
        F.when(F.col("p_size") > 1, F.concat(F.lit("R"), F.floor(k / 2))).alias("id"), F.col("p_brand").alias("category"), F.col("p_name").alias("description"),
        text(k % 5 > 0, "look").alias("recommendation"), F.when(k % 4 == 0, "on").when(k % 4 == 1, "true").alias("status"),
        (k % 7).cast("int").alias("severity"), text(k % 3 == 0, "query").alias("content"),
        F.when(k % 11 == 0, "cell").when(k % 2 == 0, "table").alias("level"), text(k % 6 == 0, "SELECT 1").alias("sql_query"),
        *(F.lit(None).cast("string").alias(c) for c in ("duckdb_query", "duckdb_column_query", "pyspark_query", "remediation_template")))
    return catalog.rule_problems(rules)


QUERIES = {fn.__name__: fn for fn in (
    inv_item_properties, inv_bad_documents, lk_offset_sweep, lk_file_row_skew, footer_first_files, lk_narrowest_types, wh_column_ranges, wh_sketch_profile,
    wh_policy_coverage_all, flatten_json_detected, rule_problems)}


def _type_sql(c: str) -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = {"double": "DOUBLE", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    out = []
    for name, (shape, cast) in quality.TEXT_TYPES.items():
        held = f"regexp_matches({c}, {lit(shape)})" + (f" AND try_cast({c} AS {kinds[cast]}) IS NOT NULL" if cast else "")
        out.append(f"WHEN bool_and({held}) THEN '{name}'")
    return f"CASE WHEN count({c}) = 0 THEN 'none' {' '.join(out)} ELSE 'string' END"


def _types_oracle() -> str:
    typed = """(SELECT CAST(o_orderkey AS VARCHAR) AS as_long,
        CASE WHEN o_orderkey % 1000 = 1 THEN '1e5' ELSE CAST(o_custkey AS VARCHAR) END AS as_double, d AS as_date,
        CASE WHEN o_orderkey % 777 = 0 THEN '2024-01-01 12:30' ELSE d END AS as_time,
        CASE WHEN o_orderkey % 777 = 0 THEN '2024-01-01 99:99' ELSE d END AS no_time,
        CASE WHEN o_orderkey % 777 = 0 THEN '2024-02-30' ELSE d END AS no_date,
        CASE WHEN o_orderkey % 2 = 0 THEN 'true' WHEN o_orderkey % 3 = 0 THEN 'FALSE' END AS as_boolean,
        CASE WHEN o_orderkey % 2 = 0 THEN '12' ELSE '1998-01-01' END AS mixed, CAST(NULL AS VARCHAR) AS nothing
        FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))"""
    columns = [(t, c, t) for t, cols in TEST_SCHEMA.items() for c, k in cols if k == "s"]
    columns += [("typed_orders", c, typed) for c in ("as_long", "as_double", "as_date", "as_time", "no_time", "no_date",
                                                     "as_boolean", "mixed", "nothing")]
    return " UNION ALL ".join(_check(
        "L6T", f"""SELECT '{t}' AS t, 'Column {c}: ' || n || ' values, narrowest type ' || kind AS d, kind NOT IN ('string', 'none') AS a
        FROM (SELECT count("{c}") AS n, {_type_sql(f'"{c}"')} AS kind FROM {source})""", f"'{c}'") for t, c, source in columns)


def _ranges_oracle() -> str:
    def form(k: str, x: str) -> str:
        if k == "s":
            return f"left({x}, 40) || CASE WHEN length({x}) > 40 THEN '... (' || length({x}) || ')' ELSE '' END"
        if k == "t":
            return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"
        return f"CAST(CAST({x} AS DECIMAL(30,4)) AS VARCHAR)" if k == "f" else f"CAST({x} AS VARCHAR)"
    return " UNION ALL ".join(_check(
        "Q7R", f"""SELECT '{t}' AS t, 'Column {c}' || coalesce(': min ' || {form(k, 'lo')} || ', max ' || {form(k, 'hi')}, ': no values') AS d,
        false AS a FROM (SELECT min("{c}") AS lo, max("{c}") AS hi FROM {t})""", f"'{c}'")
        for t, cols in TEST_SCHEMA.items() for c, k in cols if k != "c")


def _sketch_oracle() -> str:
    return " UNION ALL ".join(f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS rows, count("{c}") AS nonnull,
        {'count("' + c + '")' if k in "ift" else 'CAST(NULL AS BIGINT)'} AS numbers, CASE WHEN count(DISTINCT "{c}") <= 1000 THEN
        (SELECT max(n) FROM (SELECT count(*) AS n FROM {t} WHERE "{c}" IS NOT NULL GROUP BY "{c}")) END AS top_count,
        true AS distinct_close FROM {t}""" for t, cols in TEST_SCHEMA.items() for c, k in cols if k != "c")


def _policy_oracle() -> str:
    named = [(t, c) for t, cols in TEST_SCHEMA.items() for c, _ in cols if re.search(schema_ops.SENSITIVE_NAME, c)]
    named += [("contacts", "email_address"), ("contacts", "salary")]
    pol = ("SELECT CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'conversations' WHEN r_name = 'ASIA' THEN 'pages' "
           "WHEN r_name = 'AFRICA' THEN 'contacts' END AS table_name, CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'text' "
           "WHEN r_name = 'ASIA' THEN 'html' WHEN r_name = 'AFRICA' THEN 'salary' END AS column_name, "
           "CASE WHEN r_name = 'AFRICA' THEN 'mask_pay' ELSE 'mask_' || lower(r_name) END AS policy FROM region")
    d = ("'Column ' || s.column_name || ' holds sensitive data; ' || CASE WHEN pp.pol IS NULL THEN 'no masking policy' "
         "ELSE 'policies: ' || pp.pol END")
    names = ", ".join(f"({q(t)}, {q(c)})" for t, c in named)
    return (f"WITH s AS (SELECT table_name, column_name FROM ({_sens_rows()}) WHERE e + p + cc > 0 "
            f"UNION SELECT * FROM (VALUES {names}) x(table_name, column_name)), "
            f"pp AS (SELECT table_name, column_name, string_agg(DISTINCT policy, ', ' ORDER BY policy) AS pol "
            f"FROM ({pol}) WHERE table_name IS NOT NULL GROUP BY ALL) "
            f"SELECT 'Q9' AS rule_id, s.table_name, s.column_name, {res(d, 'pp.pol IS NULL')} AS result, "
            f"pp.pol IS NULL AS is_anomaly FROM s LEFT JOIN pp USING (table_name, column_name)")


ORACLE = {
    "inv_item_properties": _PROPERTIES,
    "inv_bad_documents": "SELECT count(*) AS good, CAST(1 AS BIGINT) AS bad FROM nation",
    "lk_offset_sweep": f"WITH {_CHUNKS}, " + """
        r AS (SELECT *, coalesce(max(s + len) OVER (PARTITION BY f ORDER BY s, rg, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4)
                     AS reach FROM k) """ + _check("L22F", """
        SELECT t, g || ' gaps of ' || CAST(lost AS BIGINT) || ' bytes and ' || o || ' overlaps among ' || n || ' column chunks' AS d, g > 0 OR o > 0 AS a
        FROM (SELECT t, count_if(s > reach) AS g, sum(greatest(s - reach, 0)) AS lost, count_if(s < reach) AS o, count(*) AS n
              FROM r GROUP BY t)"""),
    "lk_file_row_skew": f"WITH {_CHUNKS} " + _check("L12F", """
        SELECT t, 'Largest of ' || files || ' files holds ' || CAST(top AS BIGINT) || ' of ' || CAST(total AS BIGINT) || ' rows' AS d,
               top * files > total * 4 AS a
        FROM (SELECT t, max(n) AS top, sum(n) AS total, count(*) AS files FROM (SELECT t, f, sum(n) AS n FROM k GROUP BY t, f) GROUP BY t)"""),
    "footer_first_files": """SELECT t AS table_name, path AS file_path FROM (
        SELECT DISTINCT 't' || l_suppkey % 7 AS t, 'f' || l_suppkey AS path FROM lineitem)
        QUALIFY row_number() OVER (PARTITION BY t ORDER BY path) <= 5""",
    "lk_narrowest_types": _types_oracle(),
    "wh_column_ranges": _ranges_oracle(),
    "wh_sketch_profile": _sketch_oracle(),
    "wh_policy_coverage_all": _policy_oracle(),
    "flatten_json_detected": """SELECT event_id, 'event_id,ext_braces,ext_kind,ext_none,ext_props,ext_props_map' AS columns,
        json_extract_string(props, '$.k') AS k FROM events""",
    "rule_problems": """
        WITH r AS (SELECT *, CASE WHEN p_size > 1 THEN 'R' || p_partkey // 2 END AS id FROM part),
        u AS (SELECT *, count(*) OVER (PARTITION BY id) AS uses FROM r)
        SELECT id, unnest(list_filter([
            CASE WHEN id IS NULL THEN 'no id' END, CASE WHEN id IS NOT NULL AND uses > 1 THEN 'id used more than once' END,
            CASE WHEN p_partkey % 4 = 0 THEN 'unknown status' END,
            CASE WHEN p_partkey % 11 = 0 THEN 'unknown level' END,
            CASE WHEN p_partkey % 7 NOT BETWEEN 1 AND 5 THEN 'severity outside 1 to 5' END,
            CASE WHEN p_partkey % 3 = 0 AND p_partkey % 6 <> 0 THEN 'query without SQL' END,
            CASE WHEN p_partkey % 6 <> 0 AND p_partkey % 5 = 0 THEN 'nothing to run or say' END],
            lambda x: x IS NOT NULL)) AS problem FROM u""",
}
