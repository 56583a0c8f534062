"""Declared keys of the driver's test tables (parameters of the key-based checks)."""

# Primary / natural keys per table; a table may have several key sets.
PRIMARY_KEYS: dict[str, list[list[str]]] = {
    "region": [["r_regionkey"]],
    "nation": [["n_nationkey"]],
    "customer": [["c_custkey"]],
    "supplier": [["s_suppkey"]],
    "part": [["p_partkey"]],
    "orders": [["o_orderkey"]],
    "lineitem": [["l_orderkey", "l_linenumber"]],
    "events": [["event_id"]],
    "documents": [["doc_id"], ["text"]],
    "embeddings": [["vec_id"]],
    "pages": [["page_id"], ["url"]],
    "benchmark": [["item_id"]],
    "labels": [["doc_id"]],
    "conversations": [["conv_id", "turn"]],
}

# (child, child columns, parent, parent columns)
FOREIGN_KEYS: list[tuple[str, list[str], str, list[str]]] = [
    ("lineitem", ["l_orderkey"], "orders", ["o_orderkey"]),
    ("lineitem", ["l_partkey"], "part", ["p_partkey"]),
    ("lineitem", ["l_suppkey"], "supplier", ["s_suppkey"]),
    ("orders", ["o_custkey"], "customer", ["c_custkey"]),
    ("customer", ["c_nationkey"], "nation", ["n_nationkey"]),
    ("supplier", ["s_nationkey"], "nation", ["n_nationkey"]),
    ("nation", ["n_regionkey"], "region", ["r_regionkey"]),
    ("labels", ["doc_id"], "documents", ["doc_id"]),
]

# Columns whose value frequency is checked for skew.
SKEW_KEYS: dict[str, list[str]] = {
    "lineitem": ["l_suppkey", "l_partkey"],
    "orders": ["o_custkey"],
    "events": ["user_id", "event_type"],
    "documents": ["source"],
    "conversations": ["conv_id"],
}

# Schema of each table, for the cross-schema dependency check.
SCHEMA_OF: dict[str, str] = {
    "orders": "sales", "lineitem": "sales", "customer": "sales", "part": "catalog", "supplier": "catalog",
    "nation": "geo", "region": "geo", "documents": "content", "labels": "content",
}
