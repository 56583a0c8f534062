"""Operators over whole corpora, against exhaustive versions."""

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakehealth.llm import decontam, graph, jaccard, linededup, quality, sharding, topk
from lakehealth.llm.words import WordHash, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, line string"


def made(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame(
        [(i, t, "en", f"h{(i or 0) % 3}", 1, "k", 1, "l") for i, t in texts], SCHEMA).repartition(4)


def odd_texts():
    return [(1, None), (2, ""), (3, "one two"), (3, "one two"), (None, "one two"), (4, "\n\n"), (5, "x " * 5000)]


# line dedup

def exhaustive_lines(texts):
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0))
    first, near = {}, set()
    for i, t in order:
        for j, line in enumerate((t or "").split("\n")):
            u = tuple(linededup.units(line))
            if u:
                first.setdefault(u, (i, j))
    seen = list(first)
    for k, u in enumerate(seen):
        if len(u) >= linededup.MIN_WORDS and any(
                len(v) >= linededup.MIN_WORDS and linededup.within_one(list(u), list(v)) for v in seen[:k]):
            near.add(u)
    out = []
    for i, t in texts:
        kept = []
        for j, line in enumerate((t or "").split("\n")):
            u = tuple(linededup.units(line))
            if not u or (u not in near and first[u] == (i, j)):
                kept.append(line)
        out.append((i, None if t is None else "\n".join(kept)))
    return out


def line_corpus():
    rng = random.Random(11)
    base = [made(rng, rng.randint(3, 20)) for _ in range(30)]

    def vary(line):
        w = line.split()
        k, kind = rng.randrange(len(w)), rng.randrange(4)
        if kind == 0:
            w[k] = "zz"
        elif kind == 1:
            del w[k]
        elif kind == 2:
            w.insert(k, "yy")
        return " ".join(w) or "q"

    return [(i, "\n".join(vary(rng.choice(base)).upper() if rng.random() < .3 else vary(rng.choice(base))
                          for _ in range(rng.randint(1, 6)))) for i in range(60)]


def test_line_dedup_equals_an_exhaustive_version(spark):
    texts = line_corpus()
    got = {r.doc_id: r.text for r in linededup.mark(frame(spark, texts)).select("row.doc_id", "text").collect()}
    assert got == dict(exhaustive_lines(texts))


def test_line_dedup_edge_cases(spark):
    got = linededup.mark(frame(spark, odd_texts())).select("row.doc_id", "text", "n_lines").collect()
    assert len(got) == len(odd_texts())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[4] == ["\n\n"] and by[None] == ["one two"] and by[3] == ["", ""]
    kept = linededup.dedup(frame(spark, odd_texts()))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5]
    assert linededup.mark(frame(spark, [])).count() == 0


@pytest.mark.parametrize("a,b,near", [("a b c", "a b c", True), ("a b c", "a x c", True), ("a b c", "a c", True),
                                      ("a b c", "b c d", False), ("a b c", "a b c d", True), ("a", "b c d", False)])
def test_within_one(a, b, near):
    assert linededup.within_one(a.split(), b.split()) is near


# n-gram Jaccard join

def exhaustive_links(texts, threshold=0.8):
    of = WordHash().of
    sets = [set(shingles(of(words(t))).tolist()) for _, t in texts]
    links, root = Counter(), list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= threshold:
            links[a] += 1
            links[b] += 1
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for k in range(len(texts)):
        groups[top(k)].append(texts[k][0])
    return [(texts[k][0], min(groups[top(k)]), links[k]) for k in range(len(texts))]


def near_corpus(groups=12, size=12):
    rng, out = random.Random(5), []
    for _ in range(groups):
        base = made(rng, 90).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = made(rng, 1)
            out.append(" ".join(w))
    return list(enumerate(out))


def test_jaccard_join_equals_an_exhaustive_version(spark, monkeypatch):
    texts = near_corpus()
    want = sorted(exhaustive_links(texts))
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.link(frame(spark, texts)).collect())
    found, all_links = sum(r[2] for r in got), sum(r[2] for r in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want)) and found >= 0.98 * all_links
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)  # groups dealt over many pairs of blocks
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.link(frame(spark, texts)).collect()) == got
    kept = sorted(r.doc_id for r in jaccard.keep_one(frame(spark, texts)).collect())
    assert kept == sorted({r[1] for r in got})


def test_jaccard_edge_cases(spark):
    got = jaccard.link(frame(spark, odd_texts())).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter(
        {(1, 1, 0): 1, (2, 2, 0): 1, (3, None, 2): 2, (None, None, 2): 1, (4, 4, 0): 1, (5, 5, 0): 1})
    kept = jaccard.keep_one(frame(spark, odd_texts()))
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 4, 5] and len(kept.columns) == 8
    assert jaccard.link(frame(spark, [])).count() == 0 and jaccard.keep_one(frame(spark, [])).count() == 0


def test_prefix_depth_meets_the_recall():
    d = jaccard.prefix_depth(.8)
    assert 1 - (1 - .8 ** d) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - .8 ** (d + 1)) ** jaccard.TREES


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}


# decontamination

def test_best_run_equals_an_exhaustive_version():
    def cost(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(9)
    for _ in range(80):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 12))]
        got, start, end = decontam.best_run(np.array(item), np.array(text, dtype=int))
        assert got == min(cost(item, text[a:b]) for a in range(len(text) + 1) for b in range(a, len(text) + 1))
        assert cost(item, text[start:end]) == got


def planted(rng):
    items = [(k, made(rng, rng.randint(15, 45))) for k in range(25)]
    docs, want = [], set()
    for i in range(150):
        text = made(rng, rng.randint(20, 200)).split()
        if i % 3 == 0:
            k, item = items[rng.randrange(25)]
            w = item.split()
            for _ in range(rng.randint(0, decontam.edits(len(w)))):
                kind, at = rng.randrange(3), rng.randrange(len(w))
                if kind == 0:
                    w[at] = "zzz"
                elif kind == 1:
                    w.insert(at, "yyy")
                else:
                    del w[at]
            at = rng.randrange(len(text))
            text[at:at] = w
            want.add((i, k))
        docs.append((i, " ".join(text)))
    return items, docs, want


def test_decontamination_recall(spark):
    items, docs, want = planted(random.Random(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find(frame(spark, docs), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.96 * len(want)
    texts = dict(docs)
    for r in rows:
        assert r.edits <= decontam.edits(len(dict(items)[r.item_id].split()))
        assert r.end_word <= len(texts[r.doc_id].split())
    left = {r.doc_id for r in decontam.clean(frame(spark, docs), bench).collect()}
    assert left == set(range(150)) - {d for d, _ in got}


def test_decontamination_in_chunks(spark, monkeypatch):
    items, docs, _ = planted(random.Random(4))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, docs), bench).collect()}
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 1500)
    assert {(r.doc_id, r.item_id) for r in decontam.find(frame(spark, docs), bench).collect()} == whole


def test_decontamination_edge_cases(spark):
    bench = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (None, "x"), (3, ""), (4, "!!")],
                                  "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.find(frame(spark, odd_texts()), bench).collect())
    assert got == Counter({(3, 1): 2, (None, 1): 1, (5, None): 1})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(frame(spark, odd_texts()), none).count() == 0
    assert decontam.clean(frame(spark, odd_texts()), none).count() == len(odd_texts())
    assert decontam.find(frame(spark, []), bench).count() == 0


# quality

def quality_corpus():
    rng, docs, labels = random.Random(8), [], []
    for i in range(400):
        kind = rng.choice(["good", "good", "good", "junk", "toxic"])
        text = made(rng, rng.randint(20, 80))
        if kind == "junk":
            text = " ".join(w + "***" for w in text.split())
        if kind == "toxic":
            text = text.replace(" ", f" {rng.choice(['vilexa', 'vilexo', 'vilexes'])} ", 4)
        docs.append((i, text, kind))
        if i % 2:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    docs, labels = quality_corpus()
    df, lab = frame(spark, [(i, t) for i, t, _ in docs]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_keep for r in quality.classify(df, lab).collect()}
    unseen = [(got[i], k == "good") for i, _, k in docs if i % 2 == 0]
    assert len(got) == 400 and np.mean([a == b for a, b in unseen]) > 0.97
    assert all(a for a, b in unseen if b)


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "", -3.0)] * 300 + [("fine", "", 3.0)] * 300 + [("tiny", "", -3.0)] + \
        [("big", "ok", 3.0)] * 50 + [("mixed", str(i), 3.0 if i % 2 else -3.0) for i in range(20)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    share = {(r.host, r.path): r.share for r in quality.posteriors(scored, 0.5).collect()}
    assert share["big", ""] < 0.2 and share["fine", ""] > 0.8
    assert share["big", ""] < share["tiny", ""] < share["fine", ""]
    assert share["big", "ok"] > share["big", ""]


def test_quality_edge_cases(spark):
    lab = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (5, None, None), (None, 1, 0)],
                                "doc_id long, quality int, toxic int")
    df = frame(spark, odd_texts()).withColumn("host", df_lit()).withColumn("quality_score", df_lit())
    got = quality.classify(df, lab)
    assert got.count() == len(odd_texts()) and got.columns.count("quality_score") == 1 and "host" in got.columns
    assert all(r.quality_keep for r in got.collect())  # labels of one kind only
    assert quality.classify(frame(spark, []), lab).count() == 0
    assert quality.classify(frame(spark, odd_texts()), lab.limit(0)).where("NOT quality_keep").count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("x")


# shards

def test_hilbert_index_visits_every_cell_by_single_steps():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(cells, bits)
        assert sorted(index.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(index)], axis=0)).sum(axis=1) == 1).all()


def check_shards(rows, n, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and set(counts) <= set(range(shards))
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_shards(spark, sf0001):
    import zlib

    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    rows = sharding.assign(docs, 16).collect()
    check_shards(rows, docs.count(), 16)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        data = text[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    in_order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in in_order] == sorted(r.curve for r in rows)
    again = sharding.assign(docs.repartition(5), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_shards_edge_cases(spark, tmp_path):
    rows = sharding.assign(frame(spark, odd_texts()), 16).collect()
    check_shards(rows, len(odd_texts()), 16)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    hot = sharding.assign(frame(spark, [(i, "same text") for i in range(200)]), 16).collect()
    check_shards(hot, 200, 16)
    assert sharding.assign(frame(spark, []), 16).count() == 0
    path = str(tmp_path / "shards")
    sharding.write_shards(frame(spark, odd_texts()), path, 4)
    back = spark.read.parquet(path)
    assert back.count() == len(odd_texts()) and back.select("row.line", "row.text").count() == len(odd_texts())


# top-k

def exhaustive_top(rows, k=5, every=50):
    out = []
    rows = sorted({(i, tuple(v)) for i, v in rows})
    for q, v in rows:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, vec array<bigint>").repartition(3)


@pytest.mark.parametrize("copies", [0, 120])
def test_topk_equals_an_exhaustive_version(spark, copies, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(topk, "CELL_QUERIES", 4)
    monkeypatch.setattr(topk, "CELL_ROWS", 64)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-60, 60, 10).tolist()) for i in range(300)]
    rows += [(300 + i, [50] * 10) for i in range(copies)]
    rows += rows[:3]
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == exhaustive_top(rows)


def test_topk_edge_cases(spark):
    from pyspark.sql import functions as F

    schema = "vec_id long, embedding array<float>, rank string"
    rows = [(0, [0.5, -0.25], "x"), (1, [float("nan"), 1.0], "x"), (2, None, "x"), (3, [None, 1.0], "x"),
            (4, [float("inf"), 0.0], "x"), (50, [0.5, 0.25], None), (7, [-0.501, 0.25], "x"), (None, [1.0, 1.0], "x")]
    kept = topk.quantised(spark.createDataFrame(rows, schema))
    assert {(r.vec_id, tuple(r.vec)) for r in kept.collect()} == {(0, (128, -64)), (50, (128, 64)), (7, (-129, 64))}
    got = topk.search(kept, F.col("vec_id") % 50 == 0, 5).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 50, 12288), (0, 2, 7, -20608), (50, 1, 0, 12288), (50, 2, 7, -12416)]
    assert topk.search(kept.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.search(kept.where("vec_id = 0"), F.col("vec_id") % 50 == 0, 5).count() == 0
