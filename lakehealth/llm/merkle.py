"""Merkle manifest of a dataset: checkpoint and recompute.

Rows are leaves; the leaves of a tree (one per language) stand in order, and every ``FANOUT`` nodes in a row become
one until one is left, the subroot. The subroots are the leaves of a tree of trees, whose last node is the root.

A full manifest would store every level. This one persists only every ``STRIDE``-th: the leaves, the level
``STRIDE`` above them, and so on. The nodes under one stored node are an aligned subtree of at most ``FANOUT ** STRIDE``
stored descendants, so the levels between can be made again from them at any time. Proof extraction
does that from the top down: each subtree regenerates its interior nodes, every node below gets its siblings
together with those from further up, and the interior nodes are gone with the row.

Places in a tree come from one range partitioning (``common.ranked``), not from a window over a language, so that
a language may hold any share of the rows; a stored group is a fixed number of neighbours whatever its tree. The only joins
are a group with the one row above it, and leaves with the table of trees (one row per language, broadcast only if
its measured size allows).

Edge cases: a null field is ``-`` in its leaf; a null language is a tree of its own, before all others; leaves ascend
by id, nulls first, equal ids by leaf (rows with equal leaves are interchangeable); a tree of one leaf has that leaf
as its subroot, and a dataset of one tree has that subroot as its root; texts are hashed whole; an empty table gives an
empty manifest; columns carried along lie in the struct ``row``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakehealth.llm.common import cut, ensure_checkpoint_dir, join_bounded, ranked

FANOUT = 8
#: Stored levels lie this far apart.
STRIDE = 2
#: Stored nodes of one aligned subtree.
REACH = FANOUT ** STRIDE
#: Columns a leaf covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each as byte count, colon and value, or ``-`` if null."""
    coded = []
    for value in fields:
        text = value.cast("string")
        coded.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(F.concat(*coded))


def raised(nodes: Column) -> Column:
    """The level above: one node for every ``FANOUT`` in a row."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int")),
                       lambda g: digest(F.array_join(F.slice(nodes, g * FANOUT + 1, FANOUT), "")))


def above(n: Column, levels: int = 1) -> Column:
    """How many nodes a tree has ``levels`` further up, if it has ``n`` here."""
    for _ in range(levels):
        n = F.floor((n + FANOUT - 1) / FANOUT).cast("long")
    return n


def regenerated(subtrees: DataFrame) -> DataFrame:
    """``subtrees`` (``nodes``, ``n``: nodes of the whole tree at that level) with the levels ``l0`` (the nodes), ``l1``, ...;
    those beyond the tree's top are null."""
    out = subtrees.withColumn("l0", F.col("nodes"))
    for k in range(1, STRIDE + 1):
        out = out.withColumn(f"l{k}", F.when(above(F.col("n"), k - 1) > 1, raised(F.col(f"l{k - 1}"))))
    return out


def subtrees(nodes: DataFrame, carry: bool = False) -> DataFrame:
    """``tree, pos, n, nodes[, rows]`` for every aligned subtree over ``tree, pos, n, node[, row]``."""
    member = [F.col("pos").alias("at"), "node", *(["row"] if carry else [])]
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / REACH).cast("long").alias("above")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(*member))).alias("members"))
    return grouped.select("tree", F.col("above").alias("pos"), "n", F.col("members.node").alias("nodes"),
                          *([F.col("members.row").alias("rows")] if carry else []))


def heights(count: int) -> int:
    """Stored levels above the lowest, for trees of at most ``count`` leaves."""
    levels = 0
    while count > 1:
        count, levels = -(-count // REACH), levels + 1
    return levels


def grow(spark: SparkSession, path: str, height: int) -> DataFrame:
    """Write the stored levels above ``path/level=0``; the last holds one node per tree."""
    for k in range(height):
        up = regenerated(subtrees(spark.read.parquet(f"{path}/level={k}")))
        top = F.coalesce(*(F.col(f"l{j}")[0] for j in range(STRIDE, -1, -1)))
        up.select("tree", "pos", above(F.col("n"), STRIDE).alias("n"), top.alias("node")) \
            .write.parquet(f"{path}/level={k + 1}")
    return spark.read.parquet(f"{path}/level={height}").select("tree", F.col("node").alias("top"))


def fresh_path(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"


def write_manifest(docs: DataFrame, path: str, carry: dict[str, Column] | None = None) -> None:
    """Persist the manifest of ``docs`` under ``path``: ``rows/level=k``, ``trees/level=k`` and ``heights``.
    ``carry`` columns go with each leaf (``row`` of the proofs)."""
    spark = docs.sparkSession
    named = carry or {"doc_id": F.col("doc_id")}
    language = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))  # "-" sorts before "="
    leaves = cut(docs.select(language.alias("lang_key"), F.col("doc_id").alias("key"),
                             leaf([F.col(c) for c in FIELDS]).alias("node"),
                             F.struct(*(c.alias(name) for name, c in named.items())).alias("row")))
    placed = ranked(leaves, ["lang_key", "key", "node"])
    trees = cut(placed.groupBy("lang_key").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    trees = cut(ranked(trees, ["lang_key"]).select("lang_key", "first", "n", F.col("place").alias("tree")))
    (join_bounded(placed, trees, "lang_key")
     .select("tree", (F.col("place") - F.col("first")).alias("pos"), "n", "node", "row")
     .write.parquet(f"{path}/rows/level=0"))
    count, most = trees.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    tops = grow(spark, f"{path}/rows", heights(most))
    tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"),
                F.col("top").alias("node")).write.parquet(f"{path}/trees/level=0")
    grow(spark, f"{path}/trees", heights(count))
    spark.createDataFrame([(heights(most), heights(count))], "rows int, trees int").write.parquet(f"{path}/heights")


def siblings(at: Column, n: Column) -> Column:
    """``array<struct<at, others>>``: for the node at place ``at`` of ``l0``, its own place in its run and the others
    of the run, level by level up to the tree's top."""
    steps = []
    for k in range(STRIDE):
        place = F.floor(at / FANOUT ** k).cast("int")
        own = F.pmod(place, F.lit(FANOUT))
        run = F.slice(F.col(f"l{k}"), place - own + 1, FANOUT)
        others = F.concat(F.slice(run, F.lit(1), own), F.slice(run, own + 2, FANOUT))
        steps.append(F.when(above(n, k) > 1, F.struct(own.alias("at"), others.alias("others"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def descend(spark: SparkSession, path: str, height: int, steps: DataFrame) -> DataFrame:
    """Proof steps of every node of ``path/level=0``, from the ``tree, steps, ...`` of the trees' tops."""
    here = steps.withColumn("pos", F.lit(0).cast("long"))
    extra = [c for c in steps.columns if c not in ("tree", "steps")]
    for k in range(height - 1, -1, -1):
        stored = spark.read.parquet(f"{path}/level={k}")
        carry = k == 0 and "row" in stored.columns
        groups = regenerated(subtrees(stored, carry)).join(here, ["tree", "pos"])
        rows = groups.select("tree", "pos", "n", "steps", *extra, *(f"l{j}" for j in range(STRIDE)),
                             F.posexplode(F.arrays_zip("nodes", "rows") if carry else F.arrays_zip("nodes"))
                             .alias("i", "member"))
        own = siblings(F.col("i"), F.col("n"))
        here = rows.select("tree", (F.col("pos") * REACH + F.col("i")).alias("pos"), F.concat(own, "steps").alias("steps"),
                           *extra, F.col("member.nodes").alias("node"),
                           *([F.col("member.rows").alias("row")] if carry else []))
        if k:
            here = here.drop("node")
    if height == 0:  # trees of one node each
        stored = spark.read.parquet(f"{path}/level=0")
        here = stored.drop("n").join(here.drop("pos"), "tree")
    return here


NO_STEPS = "cast(array() as array<struct<at: int, others: array<string>>>)"


def proofs(spark: SparkSession, path: str) -> DataFrame:
    """``row, leaf, subroot, root, steps`` of every leaf, from the stored levels alone."""
    height = spark.read.parquet(f"{path}/heights").first()
    top = spark.read.parquet(f"{path}/trees/level={height['trees']}").select(
        "tree", F.col("node").alias("root"), F.expr(NO_STEPS).alias("steps"))
    trees = descend(spark, f"{path}/trees", height["trees"], top).select(
        F.col("pos").alias("tree"), F.col("node").alias("subroot"), "root", "steps")
    return descend(spark, f"{path}/rows", height["rows"], trees).select(
        "row", F.col("node").alias("leaf"), "subroot", "root", "steps")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda node, s: digest(F.concat(
        F.array_join(F.slice(s["others"], F.lit(1), s["at"]), ""), node,
        F.array_join(F.slice(s["others"], s["at"] + 1, FANOUT), ""))))


def proof_digest(steps: Column) -> Column:
    """Hash of all siblings, level by level and left to right."""
    return digest(F.array_join(F.flatten(F.transform(steps, lambda s: s["others"])), ""))


CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tampered_leaf() -> Column:
    """The leaf of a document where 3 divides the checksum of its id: capitals of its text in lower case; else null."""
    fields = [F.translate(F.col(c), CAPITALS, CAPITALS.lower()) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(fields))


def audit(docs: DataFrame, path: str) -> DataFrame:
    """Write the manifest of ``docs``, then hold every document, a third of them tampered with, against it."""
    write_manifest(docs, path, {"doc_id": F.col("doc_id"), "claimed": tampered_leaf()})
    found = proofs(docs.sparkSession, path)
    return found.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root",
                        proof_digest(F.col("steps")).alias("proof_sha256"),
                        folded(F.coalesce("row.claimed", "leaf"), F.col("steps")).alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 8) -> str:
    """The same in SQL, with every level of every tree (of at most 8 ** ``levels`` leaves) in full."""
    def field(c: str) -> str:
        return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"

    def coded(text: str) -> str:
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"

    def tower(name: str, base: str, tree: str, depth: int) -> str:
        """Levels name0 ... of trees, and name_path: siblings before and after the node on each level."""
        out = [f"{name}0 AS ({base})"]
        for k in range(depth):
            out.append(f"""{name}{k + 1} AS (
                SELECT {tree}, pos // 8 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(node, '' ORDER BY pos))
                       ELSE max(node) END AS node, (max(n) + 7) // 8 AS n FROM {name}{k} GROUP BY {tree}, pos // 8)""")
            out.append(f"""{name}{k}_side AS (
                SELECT a.{tree}, a.pos, any_value(a.n) AS n,
                       coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
                       coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
                FROM {name}{k} a JOIN {name}{k} b ON a.{tree} = b.{tree} AND a.pos // 8 = b.pos // 8
                GROUP BY a.{tree}, a.pos)""")
        return ", ".join(out)

    def climb(name: str, tree: str, pos: str, source: str, depth: int) -> str:
        steps, last = [], source
        for k in range(depth):
            steps.append(f"""{name}_up{k} AS (
                SELECT f.* EXCLUDE (proof, node),
                       proof || CASE WHEN s.n > 1 THEN s.before || s.after ELSE '' END AS proof,
                       CASE WHEN s.n > 1 THEN sha256(s.before || f.node || s.after) ELSE f.node END AS node
                FROM {last} f JOIN {name}{k}_side s ON s.{tree} = f.{tree} AND s.pos = f.{pos} // {8 ** k})""")
            last = f"{name}_up{k}"
        return ", ".join(steps)

    few = 3
    step = "xor(c >> 8, crc_of[CAST(xor(c & 255, b) + 1 AS BIGINT)])"
    return f"""
        WITH RECURSIVE bits AS (
            SELECT i, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) r(i)
            UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY i) AS crc_of FROM bits WHERE k = 8),
        d AS (
            SELECT row_number() OVER () AS rid, documents.*, {coded('text')} AS leaf,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
                       list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                       lambda c, b: {step})) AS crc,
                   {coded("translate(text, '" + CAPITALS + "', '" + CAPITALS.lower() + "')")} AS lowered
            FROM documents, crc),
        p AS (
            SELECT *, coalesce('=' || lang, '-') AS key, row_number() OVER (
                       PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                   count(*) OVER (PARTITION BY lang) AS n FROM d),
        {tower('lv', 'SELECT key, pos, leaf AS node, n FROM p', 'key', levels)},
        subroots AS (SELECT key, node AS subroot FROM lv{levels}),
        {tower('tr', "SELECT 0 AS top, row_number() OVER (ORDER BY key) - 1 AS pos, subroot AS node, count(*) OVER () AS n, key "
                     "FROM subroots", 'top', few)},
        f AS (
            SELECT rid, doc_id, key, pos, leaf, '' AS proof,
                   CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS node FROM p),
        {climb('lv', 'key', 'pos', 'f', levels)},
        g AS (
            SELECT u.* EXCLUDE (pos), t.pos, 0 AS top, t.node AS subroot
            FROM lv_up{levels - 1} u JOIN tr0 t ON t.key = u.key),
        {climb('tr', 'top', 'pos', 'g', few)}
        SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, u.node AS folded_root,
               u.node = r.node AS verified
        FROM tr_up{few - 1} u, tr{few} r"""
