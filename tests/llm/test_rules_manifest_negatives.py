"""Quality rules, Merkle manifest and hard negatives, against exhaustive versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakehealth.llm import hardneg, merkle, queries, weakrules

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, vote string, node string"


def docs_frame(spark, rows):
    """(doc_id, text, lang) rows, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, "v", "n") for i, t, lang in rows],
                                 DOCS).repartition(3)


def compare(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(folder))
    want = con.sql(queries.ORACLE[name])
    assert got.columns == want.columns
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want.fetchall(), key=key)


# quality rules

def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    closed = re.compile(r"[.!?…:;\"'”»)][\x20\x09-\x0D]*\Z")
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct": len(set(words)),
            "n_letters": sum(c.isalpha() for c in text), "n_capitals": sum(c.isupper() for c in text),
            "n_lines": len(lines), "n_closed_lines": sum(bool(closed.search(x)) for x in lines)}


def rule_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeäß") for _ in range(rng.randint(1, 8)))
    out = [None, "", " \t\n\x0b\x0c\r", "a", "a b c d e", "a b c d e a b c d e", "x " * 5000, "a b c d e f " * 3 + "g",
           "line one here.\nline one here.\n\nline one here. \n", "😀 😀 b c 𝒳", "\n\n\n", "a b a b a b a b a"]
    for kind in range(120):
        lines = [" ".join(word() for _ in range(rng.randint(1, 15))) + rng.choice([".", "", "!"])
                 for _ in range(rng.randint(1, 8))]
        if kind % 4 == 1:
            lines = [line.replace(" ", rng.choice(["# ", "$$$ ", "&&& "])) for line in lines]
        if kind % 4 == 2:
            lines += lines[:3] * 2
        if kind % 4 == 3:
            lines = [line.upper() for line in lines]
        out.append("\n".join(lines))
    out.append(" ".join(word() for _ in range(20_000)))  # a long text of many different words
    return out


def test_counts_equal_an_exhaustive_version(spark):
    texts = rule_texts()
    rows = weakrules.counts(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), ["doc_id", "row"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert {c: r[c] for c in weakrules.COUNTS} == counted(texts[r["row"].doc_id])


def test_estimated_accuracies_and_verdicts(spark):
    texts = rule_texts()
    judged = weakrules.judge(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), ["doc_id"]).collect()
    vote = np.array([r.vote for r in judged])
    accuracy = np.full(vote.shape[1], weakrules.START)
    chance = lambda: 1 / (1 + np.exp(-(vote @ np.log(accuracy / (1 - accuracy)))))
    for _ in range(weakrules.STEPS):
        good = chance()[:, None]
        right = np.where(vote == 1, good, np.where(vote == -1, 1 - good, 0)).sum(axis=0)
        accuracy = (right + weakrules.BELIEF * weakrules.START) / ((vote != 0).sum(axis=0) + weakrules.BELIEF)
        accuracy = np.clip(accuracy, 1 - weakrules.SUREST, weakrules.SUREST)
    assert np.allclose([r.posterior for r in judged], chance(), atol=1e-6)
    found = {r.rule: r.accuracy for r in weakrules.accuracies(docs_frame(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert np.allclose([found[r.name] for r in weakrules.RULES], accuracy, atol=1e-6)
    for r in judged:
        c = counted(texts[r["row"].doc_id])
        assert r.base_failed == (c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"])
        assert r.kept == (not r.base_failed and r.posterior >= weakrules.KEEP)


def test_a_trigger_that_the_others_contradict_loses_its_weight(spark):
    rng = random.Random(2)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(60)) + "."
    rules = [weakrules.Rule("always", "FALSE", "n_words > 5"), *weakrules.RULES[-2:], *weakrules.RULES[:3]]
    frame = docs_frame(spark, [(i, prose(), "en") for i in range(50)])
    found = {r.rule: r.accuracy for r in weakrules.accuracies(frame, rules).collect()}
    assert found["always"] < 0.3 and found["prose"] > 0.8
    assert all(r.kept for r in weakrules.judge(frame, ["doc_id"], rules).collect())


def test_rules_edge_cases(spark):
    odd = [(1, None, "en"), (1, None, "en"), (None, "a b", None), (None, "a b", None), (2, "", "x")]
    rows = weakrules.judge(docs_frame(spark, odd), ["doc_id", "row", "vote"]).collect()
    assert len(rows) == 5 and all(r.base_failed and not r.kept for r in rows)
    assert weakrules.judge(docs_frame(spark, odd).limit(0), ["doc_id"]).count() == 0


def test_rules_stay_native(spark):
    plan = weakrules.judge(docs_frame(spark, [(1, "a b", "en")]), ["doc_id"])._jdf.queryExecution().toString()
    assert not re.search("python|arrow|pandas", plan, re.I)


def test_rules_equal_sql(spark, tmp_path):
    docs_frame(spark, [(i, t, "en") for i, t in enumerate(rule_texts())]).write.parquet(str(tmp_path / "documents.parquet"))
    compare(spark, "op11_quality_rules", tmp_path, ["documents"])


# Merkle manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang):
    values = [doc_id, "s", lang, None if text is None else len(text), text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tower(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        start = at // 8 * 8
        out.append((at - start, level[start:at] + level[at + 1:start + 8]))
        at //= 8
    return out


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    towers = {lang: tower([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in order}
    tops = tower([towers[lang][-1][0] for lang in order])
    out = []
    for number, lang in enumerate(order):
        for at, (_, _, leaf, (i, text, _)) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            steps = path(towers[lang], at) + path(tops, number)
            node = leaf
            if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and text is not None:
                node = plain_leaf_of_lowered(i, text, lang)
            for place, others in steps:
                node = h(*others[:place], node, *others[place:])
            root = tops[-1][0]
            out.append((i, leaf, towers[lang][-1][0], root, h(*(x for _, o in steps for x in o)), node, node == root))
    return out


def plain_leaf_of_lowered(i, text, lang):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    values = [i, "s", lang, len(text), lowered]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def sized(**sizes):
    return [(i, f"Text {i} of {lang} Ä\n" * (i % 3), None if lang == "null" else lang) for lang, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("rows", [
    sized(null=1), sized(de=8), sized(de=9, null=1), sized(de=64, en=65, fr=1, null=7), sized(**{f"l{k}": k % 4 + 1 for k in range(70)}),
    sized(de=600, en=513) + [(None, None, "de"), (None, None, "de"), (3, "Text 3", "de"), (None, "A", None), (5, None, "en"),
                             (7, "Long " * 30_000, "en")],
], ids=["one", "run", "two", "mixed", "many-trees", "odd"])
def test_manifest_equals_an_exhaustive_version(spark, rows):
    found = merkle.audit(docs_frame(spark, rows), merkle.fresh_path(spark)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(plain_manifest(rows), key=key)


def test_manifest_of_an_empty_table(spark):
    assert merkle.audit(docs_frame(spark, sized(de=1)).limit(0), merkle.fresh_path(spark)).count() == 0


def test_only_every_second_level_is_stored(spark, tmp_path):
    merkle.write_manifest(docs_frame(spark, sized(de=600)), str(tmp_path / "m"))
    stored = [spark.read.parquet(str(tmp_path / "m" / "rows" / f"level={k}")).count() for k in range(3)]
    assert stored == [600, 10, 1]  # 600 leaves, 75 nodes that are not kept, 10, 2 that are not kept, 1
    assert merkle.proofs(spark, str(tmp_path / "m")).select(F.size("steps")).distinct().collect()[0][0] == 4


def test_manifest_equals_sql(spark, tmp_path):
    docs_frame(spark, sized(de=100, en=9, null=2)).write.parquet(str(tmp_path / "documents.parquet"))
    compare(spark, "op12_merkle_manifest", tmp_path, ["documents"])


# hard negatives

def test_residue_products_are_exact():
    rng = np.random.default_rng(3)
    for top, width in [(1, 1), (300, 64), (256, 5000), (2 ** 27, 400), (2 ** 30, 3)]:
        a, b = (rng.integers(-top, top + 1, (n, width)) for n in (7, 11))
        a[0], b[0], b[1] = top, top, -top  # the widest scores
        got = np.concatenate([s for _, s in hardneg.Scores(a, b).steps()])
        assert got.tolist() == (a.astype(object) @ b.T.astype(object)).tolist()
        assert 2 * hardneg.score_range(a, b) < math.prod(hardneg.Scores(a, b).primes)


def vectors(n, width, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=width) / 3 + 0.2], int(rng.integers(0, 4))) for i in range(n)]
    rows[3] = (3, None, 1)
    rows[4] = (4, [float("nan")] + rows[4][1][1:], 1)
    rows[5] = (5, [None] + rows[5][1][1:], 1)
    rows[6] = (6, [float("inf")] + rows[6][1][1:], 1)
    rows[8] = (8, rows[8][1], None)
    rows += [(i, rows[20][1], 2) for i in range(n, n + 60)]  # copies: ties by id
    rows += [rows[30], rows[30], (0, rows[0][1], rows[0][2]), (n + 70, [], 0), (n + 71, [0.5], 3), (100, rows[100][1], 99)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int"


def test_mining_equals_sql_in_many_cells(spark, tmp_path, monkeypatch):
    for name, value in [("CELL_ANCHORS", 2), ("CELL_ROWS", 40), ("STRIP", 2), ("STEP", 2)]:
        monkeypatch.setattr(hardneg, name, value)
    spark.createDataFrame(vectors(400, 8), VECTORS).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    compare(spark, "op13_hard_negatives", tmp_path, ["embeddings"])


def test_mining_equals_sql_in_one_cell(spark, tmp_path):
    spark.createDataFrame(vectors(250, 3, 4), VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    compare(spark, "op13_hard_negatives", tmp_path, ["embeddings"])


def test_mining_edge_cases(spark):
    def mined(rows, schema=VECTORS + ", side int, down int, windows int"):
        frame = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], schema)
        return hardneg.mine(hardneg.prepared(hardneg.shifted_labels(frame)), F.col("vec_id") % 100 == 0).collect()
    assert mined([]) == []
    assert mined([(100, [1.0], 1)]) == []
    assert mined([(100, [1.0], 1), (101, [1.0], 1)]) == []
    assert mined([(100, [1.0], 1), (101, [1.0], 2)]) == []
    assert [tuple(r) for r in mined([(100, [1.0], 1), (101, [1.0], 1), (102, [0.5], 2), (103, [0.95], 2), (104, [0.25], 2)])] == [
        (100, 101, 1, 102, 65536, 32768)]
    assert mined([(100, [1.0], 1), (101, [-1.0], 1), (102, [-0.5], 2)]) == []  # a negative score opens no window
    assert [r.negative_id for r in mined([(100, [1.0], 1), (101, [0.0], 1), (103, [0.0], 2), (None, [0.0], 2)])] == [103]
