"""The LSH forest of the Jaccard join against tries built by comparing all pairs."""

import random

import numpy as np

from lakehealth.llm import graph, jaccard


def common_prefix(a, b):
    n = 0
    while n < len(a) and a[n] == b[n]:
        n += 1
    return n


def tries(spark, rng, n, parts):
    """Random labels of few values, so that prefixes of every length are shared."""
    made = np.array([[[rng.choice([1, 1, 1, 2, 700]) for _ in range(jaccard.DEPTH)] for _ in range(jaccard.TREES)]
                     for _ in range(n)], dtype=">u2")
    made[n // 2:n // 2 + n // 3] = made[0]  # a third of all rows has one label
    keys = [rng.randbytes(16) for _ in range(n)]
    rows = [(bytes(k), m.tobytes()) for k, m in zip(keys, made)]
    return keys, made, spark.createDataFrame(rows, "key binary, labels binary").repartition(parts)


def groups(nodes, pairs):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {x: top(x) for x in nodes}


def test_edges_of_every_level_join_just_the_nodes_of_that_depth(spark):
    keys, made, texts = tries(spark, random.Random(4), 60, 3)
    got = [(bytes(r.a), bytes(r.b), r.level) for r in jaccard.forest(texts, 2).collect()]
    assert len(got) <= jaccard.TREES * len(keys)
    longest = {(a, b): max(common_prefix(made[i, t].tolist(), made[j, t].tolist()) for t in range(jaccard.TREES))
               for i, a in enumerate(keys) for j, b in enumerate(keys) if i < j}
    longest.update({(b, a): n for (a, b), n in list(longest.items())})
    assert all(longest[a, b] >= level for a, b, level in got)  # every edge is a shared prefix
    for d in range(2, jaccard.DEPTH + 1):
        want = groups(keys, [p for p, n in longest.items() if n >= d])
        assert groups(keys, [(a, b) for a, b, level in got if level >= d]) == want


def test_runs_that_partitions_cut_apart_are_joined(spark):
    keys, made, texts = tries(spark, random.Random(5), 48, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = jaccard.forest(texts, 3).where("level >= 8").select("a", "b")
        label = {bytes(r.node): bytes(r.label) for r in graph.components(many).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    copies = [k for k, m in zip(keys, made) if (m == made[0]).all()]
    assert len({label[k] for k in copies}) == 1 and len(copies) >= 16


def test_a_group_of_near_copies_has_about_one_edge_a_row(spark):
    rng = random.Random(9)
    n = 400
    base = rng.choices(range(10 ** 4), k=jaccard.TREES * jaccard.DEPTH)
    made = np.array([[b if rng.random() < .97 else rng.randrange(10 ** 4) for b in base] for _ in range(n)], dtype=">u2")
    keys = [rng.randbytes(16) for _ in range(n)]
    texts = spark.createDataFrame(list(zip(keys, [m.tobytes() for m in made])), "key binary, labels binary").repartition(3)
    edges = jaccard.forest(texts, 6)
    few = jaccard.stars(edges)
    want = {r.node: r.label for r in graph.components(edges.select("a", "b")).collect()}
    assert len(want) > n * .95 and {r.node: r.label for r in graph.components(few).collect()} == want
    # One edge a row and those between hubs, not one a row and tree.
    assert edges.count() > 2 * n > 1.5 * few.count()


def test_prefixes_are_shortened_until_the_recall_is_reached():
    size = jaccard.TREES * jaccard.DEPTH
    least = jaccard.prefix_depth(.8)
    assert jaccard.reached({}, .8) == least  # nothing is known, so the threshold decides
    assert jaccard.reached({(8, size): 3}, .8) == least  # too few to tell
    assert jaccard.reached({(8, size): 100_000}, .8) == jaccard.DEPTH
    assert jaccard.reached({(8, size): 100_000, (8, int(.81 * size)): 1_000}, .8) == least
    assert jaccard.reached({(8, size): 100_000, (8, int(.4 * size)): 1_000}, .8) == jaccard.DEPTH  # no pairs to find
    middle = jaccard.reached({(8, size): 100_000, (8, int(.93 * size)): 1_000}, .8)
    assert jaccard.chance(.9, middle) >= jaccard.RECALL
    for threshold in (.5, .9):
        assert jaccard.chance(threshold, jaccard.prefix_depth(threshold)) >= jaccard.RECALL


def test_agreement_estimates_the_similarity(spark):
    rng = random.Random(6)
    first = [" ".join(str(rng.randrange(10 ** 6)) for _ in range(300)) for _ in range(12)]
    texts = first + [t + " and a little more" for t in first]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = jaccard.marks(frame).cache()
    edges = jaccard.forest(marks, 6)
    counts = jaccard.agreement(edges, marks)
    size = jaccard.TREES * jaccard.DEPTH
    assert sum(counts.values()) == len(first) and all(equal / size > .9 for _, equal in counts)


def test_many_rows_without_an_id_meet_their_own_text_only(spark):
    rng = random.Random(8)
    base = [str(rng.randrange(10 ** 6)) for _ in range(200)]
    rows = [(None, " ".join(base[:k] + [f"w{k}"] + base[k + 1:])) for k in range(60)] + [(None, " ".join(base))] * 3
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == 63 and {r.class_id for r in got} == {None} and len({bytes(r.class_key) for r in got}) == 1
    assert all(r.n_links == 62 for r in got)
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert kept.count() == 1
