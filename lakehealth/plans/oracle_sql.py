"""DuckDB SQL that computes, independently of the Spark code, what each
registered query must return on the driver's tables (views named after the
tables). Strings are generated per column from the declared test schema."""

from __future__ import annotations

from . import dataset

# Declared schema of the driver's tables: (column, kind).
TEST_SCHEMA: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "i"), ("r_name", "s")],
    "nation": [("n_nationkey", "i"), ("n_name", "s"), ("n_regionkey", "i")],
    "customer": [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "f"),
                 ("c_mktsegment", "s")],
    "supplier": [("s_suppkey", "i"), ("s_name", "s"), ("s_nationkey", "i"), ("s_acctbal", "f")],
    "part": [("p_partkey", "i"), ("p_name", "s"), ("p_brand", "s"), ("p_type", "s"), ("p_size", "i"),
             ("p_retailprice", "f")],
    "orders": [("o_orderkey", "i"), ("o_custkey", "i"), ("o_orderstatus", "s"), ("o_totalprice", "f"),
               ("o_orderdate", "t"), ("o_orderpriority", "s")],
    "lineitem": [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
                 ("l_quantity", "f"), ("l_extendedprice", "f"), ("l_discount", "f"), ("l_tax", "f"),
                 ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")],
    "events": [("event_id", "i"), ("ts", "t"), ("user_id", "i"), ("event_type", "s"), ("value", "f"),
               ("props", "s")],
    "documents": [("doc_id", "i"), ("text", "s"), ("lang", "s"), ("source", "s"), ("n_chars", "i")],
    "embeddings": [("vec_id", "i"), ("embedding", "c"), ("label", "i")],
    "pages": [("page_id", "i"), ("url", "s"), ("html", "s")],
    "benchmark": [("item_id", "i"), ("text", "s")],
    "labels": [("doc_id", "i"), ("quality", "i"), ("toxic", "i")],
    "conversations": [("conv_id", "i"), ("turn", "i"), ("role", "s"), ("text", "s")],
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def res(detail: str, anomaly: str) -> str:
    return (f"({detail}) || chr(10) || chr(10) || 'Indicator: ' || "
            f"CASE WHEN {anomaly} THEN 'Anomaly - ERR_1001' ELSE 'Optimized - OPT_2001' END")


def pct(p: str, w: str) -> str:
    bp = f"(CASE WHEN ({w}) > 0 THEN CAST(({p}) AS BIGINT) * 10000 // ({w}) ELSE 0 END)"
    return f"CAST({bp} // 100 AS VARCHAR) || '.' || lpad(CAST({bp} % 100 AS VARCHAR), 2, '0') || '%'"


def ratio(n: str, d: str) -> str:
    h = f"(CAST({n} AS HUGEINT) * 100 // CAST({d} AS HUGEINT))"
    return f"CAST({h} // 100 AS VARCHAR) || '.' || lpad(CAST({h} % 100 AS VARCHAR), 2, '0') || 'x'"


def v(x: str) -> str:
    return f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _cols(kinds: str):
    for t, cols in TEST_SCHEMA.items():
        for c, k in cols:
            if k in kinds:
                yield t, c, k


def null_values() -> str:
    parts = []
    for t, c, _ in _cols("isftc"):
        d = f"'Column {c} has ' || {v('nulls')} || ' NULL values in ' || {v('n')} || ' rows (' || {pct('nulls', 'n')} || ')'"
        parts.append(f"SELECT 'Q1' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, 'nulls > 0')} AS result, nulls > 0 AS is_anomaly "
                     f"FROM (SELECT count(*) AS n, count(*) - count(\"{c}\") AS nulls FROM {t})")
    return _union(parts)


def column_sizing(max_len: int = 8000) -> str:
    parts = []
    for t, c, _ in _cols("s"):
        d = (f"'Column {c}: max length ' || {v('coalesce(mx, 0)')} || ', average length ' || "
             f"{v('CASE WHEN nn > 0 THEN sl // nn ELSE 0 END')} || ' over ' || {v('nn')} || ' values'")
        a = f"coalesce(mx > {max_len}, false)"
        parts.append(f"SELECT 'Q6' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, a)} AS result, {a} AS is_anomaly FROM (SELECT max(length(\"{c}\")) AS mx, "
                     f"CAST(sum(length(\"{c}\")) AS BIGINT) AS sl, count(\"{c}\") AS nn FROM {t})")
    return _union(parts)


def column_stats() -> str:
    parts = []
    for t, c, k in _cols("isftb"):
        if k == "i":
            mn, mx = f"CAST(min(\"{c}\") AS VARCHAR)", f"CAST(max(\"{c}\") AS VARCHAR)"
        elif k == "t":
            mn, mx = f"strftime(min(\"{c}\"), '%Y-%m-%d %H:%M:%S')", f"strftime(max(\"{c}\"), '%Y-%m-%d %H:%M:%S')"
        else:
            mn = mx = "CAST(NULL AS VARCHAR)"
        d = (f"'Column {c}: rows ' || {v('n')} || ', nulls ' || {v('n - nn')} || ', distinct ' || {v('d')} || "
             f"CASE WHEN mn IS NOT NULL THEN ', min ' || mn || ', max ' || mx ELSE '' END")
        parts.append(f"SELECT 'Q7' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, 'false')} AS result, false AS is_anomaly FROM (SELECT count(*) AS n, "
                     f"count(\"{c}\") AS nn, count(DISTINCT \"{c}\") AS d, {mn} AS mn, {mx} AS mx FROM {t})")
    return _union(parts)


def cardinality() -> str:
    parts = []
    for t, c, _ in _cols("isftb"):
        d = f"'Column {c} has ' || {v('d')} || ' distinct values in ' || {v('n')} || ' rows (' || {pct('d', 'n')} || ')'"
        a = "(d <= 1 AND n > 1)"
        parts.append(f"SELECT 'L20' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, a)} AS result, {a} AS is_anomaly "
                     f"FROM (SELECT count(*) AS n, count(DISTINCT \"{c}\") AS d FROM {t})")
    return _union(parts)


NUMERIC_TEXT = r"^-?[0-9]+(\.[0-9]+)?$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?)?$"


def text_types() -> str:
    parts = []
    for t, c, _ in _cols("s"):
        d = (f"'Column {c}: ' || {v('nl')} || ' numeric and ' || {v('dl')} || ' date-shaped of ' || "
             f"{v('nn')} || ' values'")
        a = "(nn > 0 AND (nl = nn OR dl = nn))"
        parts.append(f"SELECT 'L6' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, a)} AS result, {a} AS is_anomaly FROM (SELECT count(\"{c}\") AS nn, "
                     f"count_if(regexp_matches(\"{c}\", {q(NUMERIC_TEXT)})) AS nl, "
                     f"count_if(regexp_matches(\"{c}\", {q(DATE_TEXT)}) "
                     f"AND try_cast(substring(\"{c}\", 1, 10) AS DATE) IS NOT NULL) AS dl FROM {t})")
    return _union(parts)


def data_retention(older_than: str = "1996-01-01") -> str:
    parts = []
    for t, c, _ in _cols("t"):
        d = (f"'Column {c}: ' || {v('o')} || ' of ' || {v('n')} || ' rows older than {older_than} (' || "
             f"{pct('o', 'n')} || ')'")
        parts.append(f"SELECT 'Q17' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                     f"{res(d, 'o > 0')} AS result, o > 0 AS is_anomaly FROM (SELECT count(*) AS n, "
                     f"count_if(\"{c}\" < TIMESTAMP '{older_than}') AS o FROM {t})")
    return _union(parts)


def duplicates() -> str:
    parts = []
    for t, key_sets in dataset.PRIMARY_KEYS.items():
        for ks in key_sets:
            label = ", ".join(ks)
            cols = ", ".join(f'"{k}"' for k in ks)
            d = f"{v('g')} || ' values of key ({label}) occur more than once; ' || {v('s')} || ' surplus rows'"
            parts.append(f"SELECT 'Q4' AS rule_id, {q(t)} AS table_name, {q(label)} AS column_name, "
                         f"{res(d, 'g > 0')} AS result, g > 0 AS is_anomaly FROM (SELECT count_if(n > 1) AS g, "
                         f"coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS s FROM "
                         f"(SELECT count(*) AS n FROM {t} GROUP BY {cols}))")
    return _union(parts)


def fk_orphans() -> str:
    parts = []
    for child, ck, parent, pk in dataset.FOREIGN_KEYS:
        cond = " AND ".join(f'p."{b}" = c."{a}"' for a, b in zip(ck, pk))
        notnull = " AND ".join(f'c."{a}" IS NOT NULL' for a in ck)
        orphan = f"{notnull} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {cond})"
        keys = ", ".join(f'c."{a}"' for a in ck)
        label = f"{child}({', '.join(ck)}) -> {parent}({', '.join(pk)})"
        d = (f"{v('o')} || ' of ' || {v('n')} || ' rows (' || {v('ok')} || "
             f"' distinct keys) in {label} have no parent row'")
        parts.append(f"SELECT 'Q2' AS rule_id, {q(child)} AS table_name, {q(', '.join(ck))} AS column_name, "
                     f"{res(d, 'o > 0')} AS result, o > 0 AS is_anomaly FROM (SELECT "
                     f"(SELECT count(*) FROM {child}) AS n, "
                     f"(SELECT count(*) FROM {child} c WHERE {orphan}) AS o, "
                     f"(SELECT count(DISTINCT ({keys})) FROM {child} c WHERE {orphan}) AS ok)")
    return _union(parts)


def key_skew(max_ratio: int = 10) -> str:
    parts = []
    for t, cols in dataset.SKEW_KEYS.items():
        for c in cols:
            d = (f"'Most frequent value holds ' || {v('top')} || ' of ' || {v('total')} || ' rows (' || "
                 f"{pct('top', 'total')} || ') over ' || {v('k')} || ' distinct values; top/average ' || "
                 f"{ratio('top * k', 'total')}")
            a = f"(CAST(top AS HUGEINT) * k > CAST(total AS HUGEINT) * {max_ratio})"
            parts.append(f"SELECT 'L12K' AS rule_id, {q(t)} AS table_name, {q(c)} AS column_name, "
                         f"{res(d, a)} AS result, {a} AS is_anomaly FROM (SELECT max(n) AS top, count(*) AS k, "
                         f"CAST(sum(n) AS BIGINT) AS total FROM (SELECT count(*) AS n FROM {t} GROUP BY \"{c}\"))")
    return _union(parts)


# -- footer metadata (DuckDB reads the same files' footers) ----------------------------------
SF01 = "/root/testdata/sf0.01"
TABLE_LIST = ", ".join(q(t) for t in TEST_SCHEMA)


def chunks_cte(folder: str = SF01) -> str:
    return (f"chunks AS (SELECT regexp_extract(file_name, '([^/]+)\\.parquet$', 1) AS table_id, "
            f"file_name AS file_path, row_group_id, row_group_num_rows, row_group_bytes, column_id, "
            f"replace(path_in_schema, ', ', '.') AS path_in_schema, type, encodings, compression, num_values, "
            f"total_compressed_size, total_uncompressed_size, stats_null_count, file_offset, data_page_offset, "
            f"dictionary_page_offset FROM parquet_metadata('{folder}/*.parquet'))")


def columns_cte(folder: str = SF01) -> str:
    return (f"ps AS (SELECT regexp_extract(file_name, '([^/]+)\\.parquet$', 1) AS table_id, name, repetition_type "
            f"FROM parquet_schema('{folder}/*.parquet')), "
            f"cols AS (SELECT c.table_name AS table_id, c.column_name, c.ordinal_position AS ordinal, "
            f"CASE c.data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' "
            f"WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' "
            f"ELSE lower(c.data_type) END AS data_type, ps.repetition_type = 'OPTIONAL' AS nullable, "
            f"CAST(NULL AS VARCHAR) AS comment FROM information_schema.columns c "
            f"JOIN ps ON ps.table_id = c.table_name AND ps.name = c.column_name "
            f"WHERE c.table_name IN ({TABLE_LIST}))")


def footer_chunks() -> str:
    return (f"WITH {chunks_cte()} SELECT table_id, regexp_extract(file_path, '[^/]+$') AS file_name, row_group_id, "
            f"row_group_num_rows, row_group_bytes, column_id, path_in_schema, type, encodings, compression, "
            f"num_values, total_compressed_size, total_uncompressed_size, stats_null_count, file_offset, "
            f"data_page_offset, dictionary_page_offset FROM chunks")


def _chk(rule: str, detail: str, anomaly: str, column: str = "CAST(NULL AS VARCHAR)") -> str:
    return (f"SELECT '{rule}' AS rule_id, table_id AS table_name, {column} AS column_name, "
            f"{res(detail, anomaly)} AS result, coalesce({anomaly}, false) AS is_anomaly")


def compression_ratio() -> str:
    d = f"'Column ' || path_in_schema || ': ' || {v('c')} || ' of ' || {v('u')} || ' bytes after compression (' || {pct('c', 'u')} || ')'"
    return (f"WITH {chunks_cte()} {_chk('L11', d, '(u >= 1048576 AND c * 100 > u * 90)', 'path_in_schema')} "
            f"FROM (SELECT table_id, path_in_schema, sum(total_compressed_size) AS c, "
            f"sum(total_uncompressed_size) AS u FROM chunks GROUP BY ALL)")


def dictionary_encoding() -> str:
    d = f"'Column ' || path_in_schema || ': ' || {v('d')} || ' of ' || {v('n')} || ' column chunks dictionary-encoded'"
    return (f"WITH {chunks_cte()} {_chk('L13', d, '(type = ' + q('BYTE_ARRAY') + ' AND d = 0)', 'path_in_schema')} "
            f"FROM (SELECT table_id, path_in_schema, count_if(encodings LIKE '%DICTIONARY%') AS d, count(*) AS n, "
            f"max(type) AS type FROM chunks GROUP BY ALL)")


def _rg() -> str:
    return ("(SELECT table_id, count(*) AS rg, count(DISTINCT file_path) AS files, sum(r) AS rows, sum(b) AS bytes "
            "FROM (SELECT table_id, file_path, row_group_id, max(row_group_num_rows) AS r, max(row_group_bytes) AS b "
            "FROM chunks GROUP BY ALL) GROUP BY table_id)")


def row_group_sizing() -> str:
    d = (f"{v('rg')} || ' row groups in ' || {v('files')} || ' files; average ' || {v('rows // rg')} || "
         f"' rows and ' || {v('bytes // rg')} || ' bytes per row group'")
    return f"WITH {chunks_cte()} {_chk('L14', d, '(rg > 1 AND bytes < rg * 16777216)')} FROM {_rg()}"


def read_parallelism() -> str:
    d = f"{v('rg')} || ' row groups for 8 read slots; ' || {v('bytes')} || ' bytes'"
    return f"WITH {chunks_cte()} {_chk('L15', d, '(bytes >= 134217728 AND rg < 8)')} FROM {_rg()}"


def chunk_statistics() -> str:
    d = f"{v('s')} || ' of ' || {v('n')} || ' column chunks carry statistics'"
    return (f"WITH {chunks_cte()} {_chk('L19', d, 's < n')} FROM (SELECT table_id, "
            f"count_if(stats_null_count IS NOT NULL) AS s, count(*) AS n FROM chunks GROUP BY table_id)")


def null_ratio() -> str:
    d = (f"'Column ' || path_in_schema || ': ' || coalesce({v('nulls')}, 'unknown') || ' NULL of ' || {v('vals')} || "
         f"' values (' || {pct('coalesce(nulls, 0)', 'vals')} || ')'")
    return (f"WITH {chunks_cte()} {_chk('L21', d, '(nulls * 100 > vals * 50)', 'path_in_schema')} FROM (SELECT "
            f"table_id, path_in_schema, sum(stats_null_count) AS nulls, sum(num_values) AS vals FROM chunks GROUP BY ALL)")


def offset_continuity() -> str:
    d = f"{v('gaps')} || ' gaps or overlaps between ' || {v('n')} || ' column chunks'"
    return (f"WITH {chunks_cte()}, s AS (SELECT table_id, file_path, row_group_id, column_id, total_compressed_size, "
            f"CASE WHEN dictionary_page_offset IS NOT NULL AND dictionary_page_offset < data_page_offset "
            f"THEN dictionary_page_offset ELSE data_page_offset END AS st FROM chunks), "
            f"w AS (SELECT table_id, st, lag(st + total_compressed_size) OVER (PARTITION BY file_path, row_group_id "
            f"ORDER BY st, column_id) AS pe FROM s) "
            f"{_chk('L22', d, 'gaps > 0')} FROM (SELECT table_id, count_if(pe IS NOT NULL AND pe <> st) AS gaps, "
            f"count(*) AS n FROM w GROUP BY table_id)")


def file_sizes() -> str:
    d = f"{v('files')} || ' files, ' || {v('bytes')} || ' bytes; ' || {v('small')} || ' below 32 MiB'"
    return (f"{_chk('L10', d, '(files > 1 AND small * 2 > files)')} FROM (SELECT "
            f"regexp_extract(filename, '([^/]+)\\.parquet$', 1) AS table_id, count(*) AS files, sum(size) AS bytes, "
            f"count_if(size < 33554432) AS small FROM read_blob('{SF01}/*.parquet') GROUP BY 1)")


SNAKE_CASE = r"^[a-z][a-z0-9_]*$"
AUDIT_COLUMN = r"(?i)^(created|updated|modified|inserted|loaded|ingested)_(at|on|date|ts|time|by)$"
SENSITIVE_NAME = (r"(?i)(e_?mail|phone|mobile|ssn|social_security|passport|credit_?card|card_?number"
                  r"|iban|birth|dob|address|salary|password|secret|token)")
RESERVED = ("all and any as between by case column current date day end foreign from group hour index join key "
            "level minute month order primary references second select start table time timestamp union user "
            "value values where year").split()


def column_naming() -> str:
    ok = f"regexp_matches(column_name, {q(SNAKE_CASE)})"
    d = f"'Column ' || column_name || CASE WHEN {ok} THEN ' follows snake_case' ELSE ' is not snake_case' END"
    return f"WITH {columns_cte()} {_chk('L4', d, f'NOT {ok}', 'column_name')} FROM cols"


def naming_standard() -> str:
    ok = f"regexp_matches(column_name, {q(SNAKE_CASE)})"
    rsv = f"lower(column_name) IN ({', '.join(q(w) for w in RESERVED)})"
    d = (f"'Column ' || column_name || CASE WHEN {rsv} THEN ' is a reserved word' WHEN NOT {ok} "
         f"THEN ' is not snake_case' ELSE ' follows the naming standard' END")
    return f"WITH {columns_cte()} {_chk('Q11', d, f'({rsv} OR NOT {ok})', 'column_name')} FROM cols"


def sensitive_names() -> str:
    hit = f"regexp_matches(column_name, {q(SENSITIVE_NAME)})"
    d = (f"'Column ' || column_name || CASE WHEN {hit} THEN ' name suggests sensitive data' "
         f"ELSE ' name suggests no sensitive data' END")
    return f"WITH {columns_cte()} {_chk('Q8N', d, hit, 'column_name')} FROM cols"


def audit_columns() -> str:
    d = f"'Table has ' || {v('a')} || ' audit columns among ' || {v('n')} || ' columns'"
    return (f"WITH {columns_cte()} {_chk('L7', d, 'a = 0')} FROM (SELECT table_id, "
            f"count_if(regexp_matches(column_name, {q(AUDIT_COLUMN)})) AS a, count(*) AS n FROM cols GROUP BY table_id)")


def column_docs() -> str:
    d = f"{v('d')} || ' of ' || {v('n')} || ' columns documented'"
    return (f"WITH {columns_cte()} {_chk('L16', d, 'd * 100 < n * 50')} FROM (SELECT table_id, "
            f"count_if(comment IS NOT NULL AND trim(comment) <> '') AS d, count(*) AS n FROM cols GROUP BY table_id)")


def wide_tables() -> str:
    d = (f"'Table has ' || {v('n')} || ' columns' || CASE WHEN n > 50 THEN chr(10) || "
         f"'WARNING: Wide table detected. Consider splitting into multiple tables.' ELSE '' END")
    return f"WITH {columns_cte()} {_chk('L23', d, 'n > 50')} FROM (SELECT table_id, count(*) AS n FROM cols GROUP BY table_id)"


def nullability() -> str:
    d = (f"'Column ' || column_name || CASE WHEN nullable THEN ' is nullable' ELSE ' is NOT NULL' END || "
         f"' and holds ' || coalesce({v('nulls')}, 'unknown') || ' NULL values'")
    return (f"WITH {chunks_cte()}, {columns_cte()}, n AS (SELECT table_id, split_part(path_in_schema, '.', 1) AS column_name, "
            f"sum(stats_null_count) AS nulls, count_if(stats_null_count IS NULL) AS no_stats FROM chunks GROUP BY ALL) "
            f"{_chk('L5', d, '(nullable AND nulls = 0 AND no_stats = 0)', 'column_name')} "
            f"FROM cols LEFT JOIN n USING (table_id, column_name)")


def deprecated_types() -> str:
    d = (f"'Column ' || column_name || ' uses physical type ' || types || "
         f"CASE WHEN dep > 0 THEN ' (deprecated)' ELSE '' END")
    return (f"WITH {chunks_cte()} {_chk('Q13', d, 'dep > 0', 'column_name')} FROM (SELECT table_id, "
            f"split_part(path_in_schema, '.', 1) AS column_name, count_if(type IN ('INT96')) AS dep, "
            f"string_agg(DISTINCT type, ', ' ORDER BY type) AS types FROM chunks GROUP BY ALL)")


def gzip_rule() -> str:
    return (f"WITH {chunks_cte()} SELECT 'L24' AS rule_id, table_id, CAST(NULL AS VARCHAR) AS column_name, "
            f"{res(gz_text('n'), 'n > 0')} AS result, n > 0 AS is_anomaly FROM (SELECT table_id, "
            f"count(DISTINCT CASE WHEN compression = 'GZIP' THEN path_in_schema END) AS n FROM chunks GROUP BY table_id)")


def gz_text(n: str) -> str:
    return (f"CASE WHEN {n} = 0 THEN 'No GZIP compression found. All columns use efficient compression.' "
            f"ELSE 'Found ' || {n} || ' columns using GZIP compression. SNAPPY is recommended for better read performance.' END")


def column_codec_rule() -> str:
    a = "max(CASE WHEN compression = 'GZIP' THEN 1 ELSE 0 END) = 1"
    return (f"WITH {chunks_cte()} SELECT 'L24' AS rule_id, table_id, path_in_schema AS column_name, "
            f"{res(q('Codec ') + ' || string_agg(DISTINCT compression, ' + q(', ') + ' ORDER BY compression)', a)} "
            f"AS result, {a} AS is_anomaly FROM chunks GROUP BY table_id, path_in_schema")


def catalog_scan() -> str:
    gzip = "count(DISTINCT CASE WHEN compression = 'GZIP' THEN path_in_schema END)"
    bad = (q("[CAST_INVALID_INPUT] The value '") + " || (SELECT min(compression) FROM chunks) || "
           + q("' of the type \"STRING\" cannot be cast to \"INT\" because it is malformed. Correct the value as per the "
               "syntax, or change its target type. Use `try_cast` to tolerate malformed input and return NULL instead. "
               "SQLSTATE: 22018"))
    none = "CAST(NULL AS VARCHAR) AS column_name"
    return (f"WITH {chunks_cte()}, t AS (SELECT DISTINCT table_id FROM chunks), "
            "g AS (SELECT DISTINCT table_id, file_path, row_group_id, row_group_num_rows AS n FROM chunks) "
            f"SELECT 'LR001' AS rule_id, table_id, {none}, CAST({gzip} AS VARCHAR) || ' GZIP columns' "
            f"|| chr(10) || chr(10) || 'Indicator: ' || CASE WHEN {gzip} > 0 THEN 'Anomaly - ERR_1001' "
            f"ELSE 'Optimized - OPT_2001' END AS result, {gzip} > 0 AS is_anomaly FROM chunks GROUP BY table_id "
            f"UNION ALL SELECT 'LR002', table_id, {none}, CAST(sum(n) AS VARCHAR) || ' rows in ' || CAST(count(*) AS VARCHAR) "
            "|| ' row groups' || chr(10) || chr(10) || 'Indicator: Optimized - OPT_2001', false FROM g GROUP BY table_id "
            f"UNION ALL SELECT 'LR003', table_id, {none}, 'Error analyzing rule LR003: ' || {bad}, false FROM t "
            f"UNION ALL SELECT 'LR004', table_id, {none}, "
            "'Error analyzing rule LR004: no function is registered for it', false FROM t")


def scalar_rule(sql_on_df: str) -> str:
    return f"WITH {chunks_cte()}, df AS (SELECT * FROM chunks) SELECT * FROM ({sql_on_df.strip().rstrip(';')}) LIMIT 1"


# -- whole findings table ----------------------------------------------------------------------

def _rules_values() -> str:
    from .catalog import BUILTIN_RULES

    def lit(x):
        return "CAST(NULL AS VARCHAR)" if x is None else (str(x) if isinstance(x, int) else q(x))
    rows = [f"({lit(r['rule_id'])}, {lit(r['category'])}, {lit(r['description'])}, {lit(r['recommendation'])}, "
            f"{r['severity']}, {lit(r['content'])}, {lit(r['level'])}, {lit(r['remediation_template'])})"
            for r in BUILTIN_RULES]
    return ("r(rule_id, category, description, recommendation, severity, content, level, tpl) AS (VALUES "
            + ", ".join(rows) + ")")


def _fill(tpl: str, tn: str, cn: str, src: str) -> str:
    out = tpl
    for key, val in (("table_name", tn), ("column_name", cn), ("lakehouse_name", src),
                     ("warehouse_name", src),
                     ("full_table_name", f"coalesce({src}, 'unknown') || '.' || coalesce({tn}, 'unknown')")):
        out = f"replace({out}, '{{{key}}}', coalesce({val}, ''))"
    return out


def findings(check_sqls: list[str], source_name: str, scan_date: str) -> str:
    """Findings from check rows (rule_id, table_name, column_name, result, is_anomaly)."""
    checks = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in check_sqls)
    src = q(source_name)
    return (
        f"WITH c AS ({checks}), {_rules_values()}, "
        f"j AS (SELECT c.rule_id, c.table_name AS t0, c.column_name AS c0, c.result, c.is_anomaly, r.category, "
        f"r.description, r.recommendation, r.severity, r.content, r.level, r.tpl, "
        f"(r.level = 'column' AND c.column_name IS NOT NULL) AS keep FROM c JOIN r ON c.rule_id = r.rule_id), "
        f"m AS (SELECT *, CASE WHEN keep THEN 'dbo' WHEN level IN ('lakehouse', 'database') THEN 'N/A' ELSE 'dbo' END AS sn, "
        f"CASE WHEN keep THEN t0 WHEN level IN ('lakehouse', 'database', 'schema') THEN 'N/A' ELSE t0 END AS tn, "
        f"CASE WHEN keep THEN c0 ELSE 'N/A' END AS cn FROM j) "
        f"SELECT rule_id, level, CAST(NULL AS VARCHAR) AS workspace_name, CAST(NULL AS VARCHAR) AS workspace_id, "
        f"{src} AS source_name, 'N/A' AS source_id, sn AS schema_name, tn AS table_name, cn AS column_name, "
        f"category, description, recommendation, severity, content, result, is_anomaly, {q(scan_date)} AS scan_date, "
        f"CASE WHEN is_anomaly AND tpl IS NOT NULL AND tpl <> '' THEN {_fill('tpl', 'tn', 'cn', src)} END "
        f"AS remediation_script, CAST(NULL AS VARCHAR) AS table_path FROM m")


def folder_findings() -> str:
    checks = [null_values(), column_sizing(), column_stats(), cardinality(), text_types(), data_retention(),
              duplicates(), fk_orphans(), key_skew(),
              compression_ratio(), dictionary_encoding(), row_group_sizing(), read_parallelism(),
              chunk_statistics(), null_ratio(), offset_continuity(), file_sizes(),
              column_naming(), naming_standard(), sensitive_names(), audit_columns(), column_docs(),
              wide_tables(), nullability(), deprecated_types(),
              f"SELECT rule_id, table_id AS table_name, column_name, result, is_anomaly FROM ({gzip_rule()})",
              sensitive_values(), layer_naming()]
    return findings(checks, "testdata", "2025-01-01T00:00:00.000Z")


# -- finding shaping ---------------------------------------------------------------------------

def _blank(x: str) -> str:
    return f"({x} IS NULL OR {x} = '')"


def _unset(x: str) -> str:
    return f"({x} IS NULL OR {x} IN ('N/A', 'None', ''))"


def hierarchy() -> str:
    return (
        "WITH i AS (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'schema' WHEN 'AUTOMOBILE' THEN 'column' "
        "ELSE 'table' END AS lv, CASE c_mktsegment WHEN 'MACHINERY' THEN 'sales' WHEN 'FURNITURE' THEN 'None' END AS s0, "
        "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'crm.' || c_name WHEN 'FURNITURE' THEN '' WHEN 'AUTOMOBILE' THEN NULL "
        "ELSE c_name END AS t0, CASE WHEN c_nationkey < 5 THEN 'c_acctbal' WHEN c_nationkey < 10 THEN 'None' END AS c0 "
        "FROM customer), "
        f"a AS (SELECT *, (NOT {_blank('t0')} AND contains(t0, '.') AND {_blank('s0')}) AS dotted, "
        f"(NOT {_blank('t0')} AND NOT contains(t0, '.') AND {_blank('s0')} AND lv = 'schema') AS sl FROM i), "
        "b AS (SELECT c_custkey, c0, CASE WHEN dotted THEN split_part(t0, '.', 1) WHEN sl THEN t0 ELSE s0 END AS s1, "
        "CASE WHEN dotted THEN substr(t0, strpos(t0, '.') + 1) WHEN sl THEN NULL ELSE t0 END AS t1 FROM a), "
        f"c AS (SELECT *, CASE WHEN NOT {_blank('c0')} AND {_unset('t1')} THEN 'N/A' ELSE t1 END AS t2 FROM b), "
        f"d AS (SELECT *, CASE WHEN NOT {_blank('t2')} AND NOT {_unset('t2')} AND {_unset('s1')} THEN 'dbo' "
        "ELSE s1 END AS s2 FROM c) "
        "SELECT c_custkey, CASE WHEN s2 IS NULL OR s2 IN ('', 'None') THEN 'N/A' ELSE s2 END AS schema_name, "
        "CASE WHEN t2 IS NULL OR t2 IN ('', 'None') THEN 'N/A' ELSE t2 END AS table_name, "
        "CASE WHEN c0 IS NULL OR c0 IN ('', 'None') THEN 'N/A' ELSE c0 END AS column_name FROM d")


def level_masking() -> str:
    return (
        "WITH i AS (SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'lakehouse' WHEN 'BUILDING' THEN 'database' "
        "WHEN 'FURNITURE' THEN 'schema' WHEN 'HOUSEHOLD' THEN 'table' ELSE 'column' END AS level, "
        "'seg_' || lower(c_mktsegment) AS s, c_name AS t FROM customer) "
        "SELECT c_custkey, level, CASE WHEN level IN ('lakehouse', 'database') THEN 'N/A' ELSE s END AS schema_name, "
        "CASE WHEN level IN ('lakehouse', 'database', 'schema') THEN 'N/A' ELSE t END AS table_name, "
        "'N/A' AS column_name FROM i")


def remediation() -> str:
    tpl = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'OPTIMIZE {full_table_name}' "
           "WHEN '2-HIGH' THEN 'ALTER TABLE {table_name} ALTER COLUMN {column_name}' WHEN '3-MEDIUM' THEN '' "
           "WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'VACUUM {lakehouse_name}.{table_name} -- {column_name}' END")
    return (
        f"WITH i AS (SELECT o_orderkey, o_orderstatus = 'F' AS a, {tpl} AS tpl, "
        "CASE WHEN o_orderpriority = '2-HIGH' THEN 'DYNAMIC ' || CAST(o_orderkey AS VARCHAR) END AS dyn, "
        "'orders_' || CAST(o_custkey AS VARCHAR) AS t, CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
        "ELSE 'o_totalprice' END AS c, 'lh_' || o_orderstatus AS lh FROM orders) "
        "SELECT o_orderkey, CASE WHEN a THEN coalesce(CASE WHEN dyn <> '' THEN dyn END, "
        "CASE WHEN tpl IS NOT NULL AND tpl <> '' THEN "
        "replace(replace(replace(replace(tpl, '{table_name}', coalesce(t, '')), '{column_name}', coalesce(c, '')), "
        "'{lakehouse_name}', coalesce(lh, '')), '{full_table_name}', coalesce(lh, 'unknown') || '.' || "
        "coalesce(t, 'unknown')) END) END AS remediation_script FROM i")


def _raw_result() -> str:
    return ("CASE c_mktsegment WHEN 'BUILDING' THEN c_name || chr(10) || chr(10) || 'Indicator: Anomaly - ERR_1001' "
            "WHEN 'AUTOMOBILE' THEN c_name || chr(10) || chr(10) || 'Indicator: Optimized - OPT_2001' "
            "WHEN 'FURNITURE' THEN '  ' || c_name || ' ' || chr(10) ELSE c_name END")


def indicator_default() -> str:
    s = f"regexp_replace({_raw_result()}, '^\\s+|\\s+$', '', 'g')"
    return (f"SELECT c_custkey, CASE WHEN contains({s}, 'Indicator:') THEN {s} ELSE {s} || chr(10) || chr(10) || "
            f"'Indicator: Optimized - OPT_2001' END AS result FROM customer")


def anomaly_flag() -> str:
    return f"SELECT c_custkey, coalesce(contains({_raw_result()}, 'Anomaly - ERR_1001'), false) AS is_anomaly FROM customer"


def scan_date() -> str:
    return ("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.') || "
            "lpad(CAST(microsecond(o_orderdate) // 1000 AS VARCHAR), 3, '0') || 'Z' AS scan_date FROM orders")


def stringify() -> str:
    return ("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, "
            "CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer")


def order_columns() -> str:
    return ("SELECT 'Q0' AS rule_id, 'dbo' AS schema_name, c_name AS table_name, c_custkey, c_nationkey, c_acctbal FROM customer")


# -- Delta logs derived from lineitem / orders (see fixtures/lake.py) ---------------------

# Settings of the lake's tables, from row counts (fixtures/lake.py).
DAYS = "((SELECT count(*) FROM nation) + (SELECT count(*) FROM region))"
KEEP = "((SELECT count(*) FROM region) + 2)"
OPTIMIZE = "(SELECT CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'true' ELSE 'false' END FROM lineitem)"


def _lake_ctes() -> str:
    return (
        "li AS (SELECT date_trunc('month', l_shipdate) AS m, l_returnflag AS fl, l_suppkey AS sk, count(*) AS n FROM lineitem GROUP BY ALL), "
        "lv AS (SELECT m, fl, sk, n, date_diff('month', (SELECT min(m) FROM li), m) AS v FROM li), "
        "lk AS (SELECT * FROM lv WHERE v <> 5), "
        "vers AS (SELECT v, m, count(*) AS k, sum(n * 128 + 4096) AS bytes, "
        "sum(CASE WHEN fl <> 'N' THEN n ELSE 0 END) AS recs FROM lk GROUP BY v, m), "
        "vop AS (SELECT *, CASE WHEN v = 0 THEN 'CREATE TABLE' WHEN month(m) = 1 THEN 'OPTIMIZE' "
        "WHEN month(m) = 7 THEN 'VACUUM END' ELSE 'WRITE' END AS op FROM vers), "
        "od AS (SELECT o_orderstatus AS st, count(*) AS n FROM orders GROUP BY ALL)")


def delta_log_scan() -> str:
    return (f"WITH {_lake_ctes()} "
            "SELECT 'lineitem' AS table_name, CAST(v AS BIGINT) AS version, "
            "CAST(1 + k + CASE WHEN v = 0 THEN 2 ELSE 0 END + CASE WHEN v = 3 THEN 1 ELSE 0 END AS BIGINT) AS lines, "
            "CAST(CASE WHEN v = 3 THEN 1 ELSE 0 END AS BIGINT) AS bad_lines FROM vers "
            "UNION ALL SELECT 'sales/orders', 0, CAST(3 + count(*) AS BIGINT), 0 FROM od "
            "UNION ALL SELECT 'empty_table', 0, 2, 0")


def delta_actions_long() -> str:
    path = ("'l_returnflag=' || fl || '/part-' || lpad(CAST(v AS VARCHAR), 5, '0') || '-' || fl || '-' || "
            "CAST(sk AS VARCHAR) || '.snappy.parquet'")
    n = "CAST(NULL AS VARCHAR)"
    nb = "CAST(NULL AS BIGINT)"
    return (
        f"WITH {_lake_ctes()} "
        f"SELECT 'lineitem' AS table_name, CAST(v AS BIGINT) AS version, 0 AS pos, 'commitInfo' AS action, op AS operation, "
        f"{n} AS add_path, {nb} AS add_size FROM vop "
        f"UNION ALL SELECT 'lineitem', 0, 1, 'protocol', {n}, {n}, {nb} "
        f"UNION ALL SELECT 'lineitem', 0, 2, 'metaData', {n}, {n}, {nb} "
        f"UNION ALL SELECT 'lineitem', CAST(v AS BIGINT), CAST(CASE WHEN v = 0 THEN 3 ELSE 1 END + "
        f"row_number() OVER (PARTITION BY v ORDER BY fl, sk) - 1 AS INTEGER), 'add', {n}, {path}, "
        f"CAST(n * 128 + 4096 AS BIGINT) FROM lk "
        f"UNION ALL SELECT 'lineitem', CAST(v AS BIGINT), CAST(1 + k AS INTEGER), {n}, {n}, {n}, {nb} FROM vers WHERE v = 3 "
        f"UNION ALL SELECT 'sales/orders', 0, 0, 'commitInfo', 'CREATE TABLE', {n}, {nb} "
        f"UNION ALL SELECT 'sales/orders', 0, 1, 'protocol', {n}, {n}, {nb} "
        f"UNION ALL SELECT 'sales/orders', 0, 2, 'metaData', {n}, {n}, {nb} "
        f"UNION ALL SELECT 'sales/orders', 0, CAST(2 + row_number() OVER (ORDER BY st) AS INTEGER), 'add', {n}, "
        f"'o_orderstatus=' || st || '/part-0.parquet', CAST(n * 64 + 1024 AS BIGINT) FROM od "
        f"UNION ALL SELECT 'empty_table', 0, 0, 'commitInfo', 'CREATE TABLE', {n}, {nb} "
        f"UNION ALL SELECT 'empty_table', 0, 1, 'protocol', {n}, {n}, {nb}")


def delta_commit_summary() -> str:
    return (
        f"WITH {_lake_ctes()} "
        "SELECT 'lineitem' AS table_name, CAST(v AS BIGINT) AS version, epoch_ms(m) AS timestamp, op AS operation, "
        "CAST(1 + k + CASE WHEN v = 0 THEN 2 ELSE 0 END + CASE WHEN v = 3 THEN 1 ELSE 0 END AS BIGINT) AS actions, "
        "CAST(CASE WHEN v = 3 THEN 1 ELSE 0 END AS BIGINT) AS bad_lines, CAST(k AS BIGINT) AS adds, "
        "CAST(bytes AS BIGINT) AS bytes_added, CAST(recs AS BIGINT) AS records_added FROM vop "
        "UNION ALL SELECT 'sales/orders', 0, (SELECT epoch_ms(date_trunc('day', min(o_orderdate))) FROM orders), "
        "'CREATE TABLE', CAST(3 + count(*) AS BIGINT), 0, CAST(count(*) AS BIGINT), CAST(sum(n * 64 + 1024) AS BIGINT), "
        "CAST(sum(n) AS BIGINT) FROM od "
        "UNION ALL SELECT 'empty_table', 0, (SELECT epoch_ms(date_trunc('day', min(o_orderdate))) FROM orders), 'CREATE TABLE', 2, 0, 0, 0, 0")


def delta_properties() -> str:
    return (f"SELECT 'lineitem' AS table_name, 'delta.logRetentionDuration' AS key, 'interval ' || {DAYS} || ' days' AS value "
            f"UNION ALL SELECT 'lineitem', 'delta.deletedFileRetentionDuration', 'interval ' || {KEEP} || ' days' "
            f"UNION ALL SELECT 'lineitem', 'delta.autoOptimize.optimizeWrite', {OPTIMIZE} "
            f"UNION ALL SELECT 'sales/orders', 'delta.logRetentionDuration', 'interval ' || 2 * {DAYS} || ' days'")


def discover_tables() -> str:
    return ("WITH loc AS (SELECT r_name AS w, n_name AS l FROM nation JOIN region ON n_regionkey = r_regionkey "
            "ORDER BY n_nationkey LIMIT 1) "
            "SELECT w AS workspace_name, l AS lakehouse_name, s AS schema_name, t AS table_name, p AS relative_path "
            "FROM loc, (VALUES ('dbo', 'lineitem', 'lineitem'), ('sales', 'orders', 'sales/orders'), "
            "('dbo', 'empty_table', 'empty_table')) x(s, t, p)")


def _lchk(rule: str, body: str) -> str:
    """Rows (t, d, a) -> check view."""
    return (f"SELECT '{rule}' AS rule_id, t AS table_name, CAST(NULL AS VARCHAR) AS column_name, "
            f"{res('d', 'a')} AS result, a AS is_anomaly FROM ({body})")


def lk_partitioning() -> str:
    d = lambda parts, files, b: (f"{v(parts)} || ' partitions over ' || {v(files)} || ' files; average ' || "  # noqa: E731
                                 f"{v(f'({b}) // ({parts})')} || ' bytes per partition'")
    return (f"WITH {_lake_ctes()} " + _lchk("L2",
            f"SELECT 'lineitem' AS t, {d('count(DISTINCT fl)', 'count(*)', 'sum(n * 128 + 4096)')} AS d, "
            f"count(DISTINCT fl) > 1 AND sum(n * 128 + 4096) < count(DISTINCT fl) * 1073741824 AS a FROM lk "
            f"UNION ALL SELECT 'sales/orders', {d('count(*)', 'count(*)', 'sum(n * 64 + 1024)')}, "
            f"count(*) > 1 AND sum(n * 64 + 1024) < count(*) * 1073741824 FROM od"))


def lk_zorder() -> str:
    return (f"WITH {_lake_ctes()} " + _lchk("L3",
            "SELECT 'lineitem' AS t, CAST(count_if(op = 'OPTIMIZE') AS VARCHAR) || ' Z-ordered OPTIMIZE commits of ' || "
            "CAST(count(*) AS VARCHAR) || ' commits' AS d, count_if(op = 'OPTIMIZE') = 0 AS a FROM vop "
            "UNION ALL SELECT 'sales/orders', '0 Z-ordered OPTIMIZE commits of 1 commits', true "
            "UNION ALL SELECT 'empty_table', '0 Z-ordered OPTIMIZE commits of 1 commits', true"))


def lk_retention() -> str:
    return _lchk("L8", f"SELECT 'lineitem' AS t, 'Log retention ' || {DAYS} || ' days, deleted-file retention ' || {KEEP} "
                 f"|| ' days' AS d, {DAYS} < 7 OR {KEEP} < 7 AS a "
                 f"UNION ALL SELECT 'sales/orders', 'Log retention ' || 2 * {DAYS} || ' days, deleted-file retention unset', "
                 "true UNION ALL SELECT 'empty_table', 'Log retention unset, deleted-file retention unset', true")


def lk_vacuum() -> str:
    days = "((max(epoch_ms(m)) - max(CASE WHEN op LIKE 'VACUUM%' THEN epoch_ms(m) END)) // 86400000)"
    return (f"WITH {_lake_ctes()} " + _lchk("L9",
            f"SELECT 'lineitem' AS t, 'Last VACUUM ' || CAST({days} AS VARCHAR) || ' days before the latest commit' AS d, "
            f"{days} > 7 AS a FROM vop "
            "UNION ALL SELECT 'sales/orders', 'No VACUUM in the log', true "
            "UNION ALL SELECT 'empty_table', 'No VACUUM in the log', true"))


def lk_checkpoints() -> str:
    return (f"WITH {_lake_ctes()} " + _lchk("L17",
            "SELECT 'lineitem' AS t, 'Latest version ' || CAST(max(v) AS VARCHAR) || ', last checkpoint none' AS d, "
            "max(v) + 1 > 10 AS a FROM vers "
            "UNION ALL SELECT 'sales/orders', 'Latest version 0, last checkpoint none', false "
            "UNION ALL SELECT 'empty_table', 'Latest version 0, last checkpoint none', false"))


def lk_auto_optimize() -> str:
    return _lchk("L18", f"SELECT 'lineitem' AS t, 'optimizeWrite=' || {OPTIMIZE} || ', autoCompact=unset' AS d, "
                 f"{OPTIMIZE} <> 'true' AS a "
                 "UNION ALL SELECT 'sales/orders', 'optimizeWrite=unset, autoCompact=unset', true "
                 "UNION ALL SELECT 'empty_table', 'optimizeWrite=unset, autoCompact=unset', true")


def lk_data_skipping_log() -> str:
    return (f"WITH {_lake_ctes()} " + _lchk("L19L",
            "SELECT 'lineitem' AS t, CAST(count_if(fl <> 'N') AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || "
            "' live files carry statistics' AS d, count_if(fl <> 'N') < count(*) AS a FROM lk "
            "UNION ALL SELECT 'sales/orders', CAST(count(*) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || "
            "' live files carry statistics', false FROM od "
            "UNION ALL SELECT 'empty_table', '0 of 0 live files carry statistics', false"))


# -- inventory (documents derived from nation / customer / supplier) ------------------------------

def _lh_items() -> str:
    return ("SELECT 'ws-' || CAST(n_nationkey AS VARCHAR) AS workspace_id, "
            "CASE WHEN n_nationkey = 24 THEN 'PersonalWorkspace System' ELSE n_name END AS workspace_name, "
            "'lh-' || CAST(c_custkey AS VARCHAR) AS id, "
            "CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'DataflowsStagingLakehouse' ELSE c_name END AS name, "
            "c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey")


def _wh_items() -> str:
    return ("SELECT 'ws-' || CAST(n_nationkey AS VARCHAR) AS workspace_id, "
            "CASE WHEN n_nationkey = 24 THEN 'PersonalWorkspace System' ELSE n_name END AS workspace_name, "
            "'wh-' || CAST(s_suppkey AS VARCHAR) AS id, "
            "CASE WHEN s_acctbal < 0 THEN 'DataflowsStaging_' || s_name "
            "WHEN s_acctbal < 1000 THEN 'StagingWarehouseForDataflows_' || CAST(s_suppkey AS VARCHAR) "
            "WHEN s_acctbal >= 5000 AND s_acctbal < 6000 THEN 'Display ' || s_name ELSE s_name END AS name "
            "FROM supplier JOIN nation ON s_nationkey = n_nationkey")


_STAGING = "(name = 'DataflowsStagingLakehouse' OR workspace_name = 'PersonalWorkspace System')"


def inv_lakehouse() -> str:
    return (f"SELECT workspace_id, workspace_name, 'Lakehouse' AS item_type, 'Lakehouse' AS connection_type, id, name, "
            f"segment FROM ({_lh_items()}) WHERE NOT {_STAGING}")


def inv_all_items() -> str:
    return (f"SELECT workspace_id, workspace_name, 'Lakehouse' AS item_type, id, name FROM ({_lh_items()}) "
            f"UNION ALL SELECT workspace_id, workspace_name, 'warehouses', id, name FROM ({_wh_items()})")


def filter_workspaces() -> str:
    return (f"SELECT workspace_id, workspace_name, 'Lakehouse' AS item_type, 'Lakehouse' AS connection_type, id, name "
            f"FROM ({_lh_items()}) WHERE NOT {_STAGING} AND ("
            "workspace_name IN (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA') "
            "OR workspace_id IN (SELECT 'ws-' || CAST(n_nationkey AS VARCHAR) FROM nation JOIN region "
            "ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'))")


def exclude_staging_eq() -> str:
    return f"SELECT workspace_id, workspace_name, id, name FROM ({_lh_items()}) WHERE {_STAGING}"


def exclude_staging_prefix() -> str:
    return (f"SELECT workspace_id, id, name FROM ({_wh_items()}) WHERE NOT starts_with(name, 'DataflowsStaging') "
            f"AND NOT starts_with(name, 'StagingWarehouseForDataflows')")


def scan_summary() -> str:
    return (f"SELECT item_type, count(*) AS items, count(DISTINCT workspace_id) AS workspaces FROM ("
            f"SELECT 'Lakehouse' AS item_type, workspace_id FROM ({_lh_items()}) UNION ALL "
            f"SELECT 'warehouses', workspace_id FROM ({_wh_items()})) GROUP BY item_type")


def table_paths() -> str:
    return ("SELECT c_custkey, 'abfss://' || n_name || '@store.example.net/' || c_name || '.Lakehouse/Tables/' || "
            "lower(c_mktsegment) AS table_path, c_name || '.' || lower(c_mktsegment) AS full_table_name "
            "FROM customer JOIN nation ON c_nationkey = n_nationkey")


TABLE_PATH_PATTERN = r"abfss://([^@]+)@[^/]+/([^/]+)\.([^/]+)/Tables/([^/]+)/"


def parse_table_path() -> str:
    p = ("CASE c_mktsegment WHEN 'BUILDING' THEN 'abfss://' || n_name || '@store.example.net/' || c_name || "
         "'.Lakehouse/Tables/dbo/' || lower(c_mktsegment) || '/_delta_log/' "
         "WHEN 'AUTOMOBILE' THEN 'abfss://' || n_name || '@store.example.net/' || c_name || '.v2.Lakehouse/Tables/' || "
         "lower(c_mktsegment) || '/_delta_log/' WHEN 'FURNITURE' THEN 'file:/data/' || c_name "
         "ELSE 'abfss://' || n_name || '@store.example.net/' || c_name || '.Lakehouse/Tables/' || lower(c_mktsegment) "
         "|| '/_delta_log/' END")
    g = lambda i: f"nullif(regexp_extract(p, {q(TABLE_PATH_PATTERN)}, {i}), '')"
    return (f"SELECT c_custkey, {g(1)} AS lakehouse_container, {g(2)} AS lakehouse_name, {g(3)} AS lakehouse_type, "
            f"{g(4)} AS table_name FROM (SELECT c_custkey, {p} AS p FROM customer JOIN nation ON c_nationkey = n_nationkey)")


def layer_naming() -> str:
    ok = "regexp_matches(t, '(?i)^(bronze|silver|gold)_')"
    d = f"'Table ' || t || CASE WHEN {ok} THEN ' has a layer prefix' ELSE ' has no layer prefix' END"
    return (f"SELECT 'L1' AS rule_id, t AS table_name, CAST(NULL AS VARCHAR) AS column_name, {res(d, f'NOT {ok}')} "
            f"AS result, NOT {ok} AS is_anomaly FROM (SELECT DISTINCT regexp_extract(filename, '([^/]+)\\.parquet$', 1) "
            f"AS t FROM read_blob('{SF01}/*.parquet'))")


def flatten_json() -> str:
    return "SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events"


def flatten_json_keys() -> str:
    return "SELECT DISTINCT 'props' AS column_name, unnest(json_keys(props)) AS key FROM events"


# -- security and governance ----------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
CARD = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}"


def _sens_rows() -> str:
    parts = []
    for t, c, _ in _cols("s"):
        parts.append(f"SELECT {q(t)} AS table_name, {q(c)} AS column_name, count(*) AS n, "
                     f"count_if(regexp_matches(\"{c}\", {q(EMAIL)})) AS e, "
                     f"count_if(regexp_matches(\"{c}\", {q(PHONE)})) AS p, "
                     f"count_if(regexp_matches(\"{c}\", {q(CARD)})) AS cc FROM {t}")
    return _union(parts)


def sensitive_values() -> str:
    d = (f"'Column ' || column_name || ': ' || {v('e')} || ' e-mail, ' || {v('p')} || ' phone and ' || {v('cc')} || "
         f"' card-number shaped values in ' || {v('n')} || ' rows'")
    return (f"SELECT 'Q8V' AS rule_id, table_name, column_name, {res(d, '(e + p + cc) > 0')} AS result, "
            f"(e + p + cc) > 0 AS is_anomaly FROM ({_sens_rows()})")


def policy_coverage() -> str:
    pol = ("SELECT CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'conversations' WHEN r_name = 'ASIA' THEN 'pages' END "
           "AS table_name, CASE WHEN r_name IN ('EUROPE', 'AMERICA') THEN 'text' WHEN r_name = 'ASIA' THEN 'html' END "
           "AS column_name, 'mask_' || lower(r_name) AS policy FROM region")
    d = ("'Column ' || s.column_name || ' holds sensitive data; ' || CASE WHEN pp.pol IS NULL THEN 'no masking policy' "
         "ELSE 'policies: ' || pp.pol END")
    return (f"WITH s AS (SELECT DISTINCT table_name, column_name FROM ({_sens_rows()}) WHERE e + p + cc > 0), "
            f"pp AS (SELECT table_name, column_name, string_agg(DISTINCT policy, ', ' ORDER BY policy) AS pol "
            f"FROM ({pol}) WHERE table_name IS NOT NULL GROUP BY ALL) "
            f"SELECT 'Q9' AS rule_id, s.table_name, s.column_name, {res(d, 'pp.pol IS NULL')} AS result, "
            f"pp.pol IS NULL AS is_anomaly FROM s LEFT JOIN pp USING (table_name, column_name)")


def privileged_grants() -> str:
    role = ("CASE c_mktsegment WHEN 'BUILDING' THEN 'db_owner' WHEN 'MACHINERY' THEN 'db_datareader' "
            "WHEN 'AUTOMOBILE' THEN 'db_securityadmin' ELSE 'db_datawriter' END")
    d = f"'Role ' || role || ' has ' || {v('n')} || ' members'"
    return (f"SELECT 'Q10' AS rule_id, CAST(NULL AS VARCHAR) AS table_name, role AS column_name, {res(d, 'n > 3')} "
            f"AS result, n > 3 AS is_anomaly FROM (SELECT {role} AS role, count(DISTINCT c_name) AS n FROM customer "
            f"GROUP BY 1) WHERE role IN ('db_owner', 'db_securityadmin', 'db_accessadmin')")


def cross_schema() -> str:
    parts = []
    for child, ck, parent, pk in dataset.FOREIGN_KEYS:
        cond = " AND ".join(f'p."{b}" = c."{a}"' for a, b in zip(ck, pk))
        parts.append(f"SELECT {q(dataset.SCHEMA_OF[child])} AS fs, {q(dataset.SCHEMA_OF[parent])} AS ts, "
                     f"(SELECT count(*) FROM {child} c WHERE EXISTS (SELECT 1 FROM {parent} p WHERE {cond})) AS w")
    d = f"'Schema ' || fs || ' -> ' || ts || ': ' || {v('deps')} || ' dependencies, ' || {v('w')} || ' referencing rows'"
    return (f"SELECT 'Q15' AS rule_id, fs AS from_schema, ts AS to_schema, {res(d, 'fs <> ts')} AS result, "
            f"fs <> ts AS is_anomaly FROM (SELECT fs, ts, count(*) AS deps, sum(w) AS w FROM ({_union(parts)}) GROUP BY ALL)")


def settings_compliance() -> str:
    settings = {"delta.logRetentionDuration": ("interval 30 days", f"'interval ' || {DAYS} || ' days'",
                                               f"'interval ' || 2 * {DAYS} || ' days'"),
                "delta.deletedFileRetentionDuration": ("interval 7 days", f"'interval ' || {KEEP} || ' days'", "NULL"),
                "delta.autoOptimize.optimizeWrite": ("true", OPTIMIZE, "NULL")}
    rows = [f"SELECT {q(t)} AS t, {q(k)} AS k, {q(e)} AS e, CAST({a} AS VARCHAR) AS a"
            for k, (e, lineitem, orders) in settings.items()
            for t, a in (("lineitem", lineitem), ("sales/orders", orders), ("empty_table", "NULL"))]
    d = "'Setting ' || k || ' is ' || coalesce(a, 'unset') || ' (expected ' || e || ')'"
    return (f"SELECT 'Q16' AS rule_id, t AS table_name, k AS column_name, {res(d, 'a IS DISTINCT FROM e')} AS result, "
            f"a IS DISTINCT FROM e AS is_anomaly FROM ({' UNION ALL '.join(rows)})")


# -- sample rule catalog (lakehealth/rules/warehouse_rules.json) ------------------------------------

MISSING_TABLE_ERROR = ("Error executing query: [TABLE_OR_VIEW_NOT_FOUND] The table or view `audit_log` cannot be "
                       "found. Verify the spelling and correctness of the schema and catalog.\nIf you did not qualify the "
                       "name with a schema, verify the current_schema() output, or qualify the name with the correct "
                       "schema and catalog.\nTo tolerate the error on drop use DROP VIEW IF EXISTS or DROP TABLE IF "
                       "EXISTS. SQLSTATE: 42P01")


def _ind(cond: str) -> str:
    return (f"chr(10) || chr(10) || 'Indicator: ' || CASE WHEN {cond} THEN 'Anomaly - ERR_1001' "
            f"ELSE 'Optimized - OPT_2001' END")


def rule_table_sql() -> str:
    nul = "CAST(NULL AS VARCHAR)"
    wr001 = ("SELECT 'WR001' AS rule_id, 'column' AS level, 'sales' AS schema_name, 'orders' AS table_name, "
             "'o_totalprice' AS column_name, 'Data Quality' AS category, 1 AS severity, "
             "'Status ' || o_orderstatus || ': ' || CAST(count_if(o_totalprice <= 0) AS VARCHAR) || ' of ' || "
             "CAST(count(*) AS VARCHAR) || ' orders have a non-positive total' || "
             f"{_ind('count_if(o_totalprice <= 0) > 0')} AS result, count_if(o_totalprice <= 0) > 0 AS is_anomaly, "
             "CASE WHEN count_if(o_totalprice <= 0) > 0 THEN 'DELETE FROM testdata.sales.orders WHERE o_totalprice <= 0' "
             f"END AS remediation_script, {nul} AS extra FROM orders GROUP BY o_orderstatus")
    wr002 = ("SELECT 'WR002', 'column', 'dbo', 'lineitem', 'l_discount', 'Data Quality', 2, 'Found issue with WR002', "
             f"false, {nul}, '{{\"flag\":\"' || l_returnflag || '\",\"rows_over\":\"' || CAST(count(*) AS VARCHAR) || '\"}}' "
             "FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")
    wr003 = ("SELECT 'WR003', 'schema', lower(c_mktsegment), 'N/A', 'N/A', 'Maintainability', 3, "
             f"'Segment holds ' || CAST(count(*) AS VARCHAR) || ' customers' || {_ind('count(*) > 400')}, "
             f"count(*) > 400, {nul}, {nul} FROM customer GROUP BY c_mktsegment")
    wr004 = f"SELECT 'WR004', 'table', 'N/A', 'N/A', 'N/A', 'Data Quality', 2, {q(MISSING_TABLE_ERROR)}, false, {nul}, {nul}"
    wr005 = ("SELECT 'WR005', 'database', 'N/A', 'N/A', 'N/A', 'Security', 1, 'General guidance - no query executed', "
             f"false, {nul}, {nul}")
    n = "(SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"
    wr008 = (f"SELECT 'WR008', 'table', 'content', 'documents', 'doc_id', 'Data Quality', 2, "
             f"CAST({n} AS VARCHAR) || ' documents have no label' || {_ind(f'{n} > 0')}, {n} > 0, "
             f"CASE WHEN {n} > 0 THEN '-- label rows of content.documents in testdata' END, {nul}")
    return _union([wr001, wr002, wr003, wr004, wr005, wr008])


def source_error_finding() -> str:
    return (f"SELECT 'testdata' AS source_name, rule_id, level, severity, category, count(*) AS findings, "
            f"min(result) AS first_result FROM ({rule_table_sql()}) GROUP BY ALL "
            f"UNION ALL SELECT 'offline', 'CONNECTION_ERROR', 'database', 1, 'System', 1, "
            f"'Connection error: source offline: PATH_NOT_FOUND'")


def missing_metadata() -> str:
    ok = f"{gz_text('0')} || {_ind('false')}"
    return (f"SELECT * FROM (VALUES ('lineitem', {ok}, false), ('sales/orders', {ok}, false), "
            f"('empty_table', 'Parquet metadata not available for this table', false)) x(table_name, result, is_anomaly) "
            f"")


def history_two_runs() -> str:
    a = folder_findings()
    b = a.replace("'2025-01-01T00:00:00.000Z' AS scan_date", "'2025-01-02T00:00:00.000Z' AS scan_date")
    return f"SELECT * FROM ({a}) UNION ALL SELECT * FROM ({b})"


def _per_rule() -> str:
    return (f"SELECT rule_id, count(*) AS findings, count_if(is_anomaly) AS anomalies FROM ({rule_table_sql()}) "
            f"GROUP BY rule_id")


# fixed values: the sample catalog's ids, raw status text and enabled readings (warehouse / lakehouse)
_CATALOG = [("WR001", "'true'", True, True), ("WR002", "'true'", True, True), ("WR003", "'1'", True, False),
            ("WR004", "'true'", True, True), ("WR005", "'true'", True, True), ("WR006", "'false'", False, False),
            ("WR007", "CAST(NULL AS VARCHAR)", False, True), ("WR008", "'true'", True, True)]


def rule_catalog() -> str:
    vals = ", ".join(f"('{r}', {s}, {str(e).lower()}, {str(lh).lower()})" for r, s, e, lh in _CATALOG)
    return (f"SELECT c.rule_id, c.status, c.enabled, c.enabled_lakehouse, coalesce(p.findings, 0) AS findings, "
            f"coalesce(p.anomalies, 0) AS anomalies FROM (VALUES {vals}) c(rule_id, status, enabled, enabled_lakehouse) "
            f"LEFT JOIN ({_per_rule()}) p USING (rule_id)")


# rule_id, kind, level, content, severity after warehouse defaults
_ATTRS = [("WR001", "query", "column", "query", 1), ("WR002", "query", "column", "query", 2),
          ("WR003", "query", "schema", "query", 3), ("WR004", "query", "table", "query", 2),
          ("WR005", "guidance", "database", "guidance", 1), ("WR006", "query", "database", "query", 3),
          ("WR007", "query", "database", "query", 3), ("WR008", "query", "table", "query", 2)]


def active_rules() -> str:
    active = {"WR001", "WR002", "WR003", "WR004", "WR005", "WR008"}
    vals = ", ".join(f"('{r}', '{k}', '{lv}', {sev})" for r, k, lv, _, sev in _ATTRS if r in active)
    return (f"SELECT a.rule_id, a.kind, a.level, a.severity, coalesce(p.findings, 0) AS findings, "
            f"coalesce(p.anomalies, 0) AS anomalies FROM (VALUES {vals}) a(rule_id, kind, level, severity) "
            f"LEFT JOIN ({_per_rule()}) p USING (rule_id)")


def rule_defaults() -> str:
    vals = ", ".join(f"('{r}', '{lv}', '{c}', {sev})" for r, _, lv, c, sev in _ATTRS)
    return (f"SELECT a.rule_id, a.level, a.content, a.severity, coalesce(p.findings, 0) AS findings, "
            f"coalesce(p.anomalies, 0) AS anomalies FROM (VALUES {vals}) a(rule_id, level, content, severity) "
            f"LEFT JOIN ({_per_rule()}) p USING (rule_id)")


def rule_rows_where(cond: str, extra: bool = False) -> str:
    cols = "rule_id, level, schema_name, table_name, column_name, category, severity, result, is_anomaly, remediation_script"
    return f"SELECT {cols}{', extra' if extra else ''} FROM ({rule_table_sql()}) WHERE {cond}"
