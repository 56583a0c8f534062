"""Line dedup with bounds that grow with the line, against the plain edit distance of every pair."""

import random

import numpy as np
import pytest

from lakehealth.llm import linededup
from lakehealth.llm.common import TIDY, cut
from lakehealth.llm.words import WordHash
from tests.llm.test_corpus_operators import frame, made


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, k):
    w = line.split()
    for _ in range(k):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = made(rng, 1)
        elif kind == 1:
            w.insert(at, made(rng, 1))
        else:
            del w[at]
    return " ".join(w)


def left(spark, lines):
    """Lines that stay, each in a document of its own."""
    got = linededup.mark(frame(spark, list(enumerate(lines)))).select("row.doc_id", "text", "n_near").collect()
    return {r.doc_id for r in got if not r.n_near}


def test_within_equals_the_edit_distance():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 9))] for _ in range(2))
        for most in range(5):
            assert linededup.within(a, b, most) == (edit_distance(a, b) <= most)


@pytest.mark.parametrize("block", [128, 3])
def test_long_lines_equal_an_exhaustive_version(spark, monkeypatch, block):
    monkeypatch.setattr(linededup, "BLOCK_LINES", block)
    rng = random.Random(3)
    base = [made(rng, n) for n in (9, 20, 39, 40, 41, 59, 60, 79, 85, 120, 200, 400)]
    lines = base + [edited(rng, b, rng.randint(1, max(1, len(b.split()) // 12))) for b in base for _ in range(10)]
    # Lines that share a passage and little else, near a later one than the first of the passage.
    passage = made(rng, 25)
    held = [f"{made(rng, 15)} {passage} {made(rng, 15)}" for _ in range(8)]
    lines += held + [edited(rng, h, 2) for h in held]
    split = [line.split() for line in lines]
    want = {k for k, a in enumerate(split) if not any(
        edit_distance(a, b) <= max(1, min(len(a), len(b)) // 20) for b in split[:k])}
    assert left(spark, lines) == want
    assert len(want) < len(lines) - 50


def test_lines_that_are_mostly_a_shared_passage(spark):
    rng = random.Random(8)
    passage = made(rng, 60)
    lines = [f"{made(rng, a)} {passage} {made(rng, b)}" for a, b in [(0, 1), (2, 0), (3, 3), (1, 5), (20, 4), (30, 30)] * 8]
    lines += [edited(rng, line, rng.randint(1, 5)) for line in lines]
    split = [line.split() for line in lines]
    want = {k for k, a in enumerate(split) if not any(
        edit_distance(a, b) <= max(1, min(len(a), len(b)) // 20) for b in split[:k])}
    assert left(spark, lines) == want


def test_windows_before_the_weight_hold_one_that_near_lines_share():
    """Whatever the order of the keys, as long as both lines follow the same."""
    rng = random.Random(9)
    words = WordHash()
    for _ in range(300):
        a = made(rng, rng.randint(40, 160)).split()
        b = edited(rng, " ".join(a), len(a) // 20).split()
        if min(len(a), len(b)) < 40 or not linededup.within(a, b, linededup.bound(min(len(a), len(b)))):
            continue
        lines = linededup.Lines(words.of(a + b), np.array([len(a), len(b)]))
        line, key, weight = lines.minimizers()
        first = []
        for k, n in enumerate((len(a), len(b))):
            mine = np.flatnonzero(line == k)
            assert weight[mine].sum() == n - linededup.RUN + 1
            mine = mine[np.argsort(key[mine] * np.uint64(0x9E3779B97F4A7C15))]
            before = np.cumsum(weight[mine]) - weight[mine]
            first.append(set(key[mine][before <= linededup.RUN * linededup.bound(n)].tolist()))
        assert first[0] & first[1]


@pytest.mark.parametrize("part", [1024, 3])
def test_rows_without_an_id_follow_their_text(spark, monkeypatch, part):
    monkeypatch.setattr(linededup, "HOT_PART", part)
    rng = random.Random(10)
    texts = [f"the same first line of all\n{made(rng, 12)}" for _ in range(200)]
    got = linededup.mark(frame(spark, [(None, t) for t in texts] + [(5, texts[0])])).collect()
    assert len(got) == 201 and sum(r.n_equal for r in got) == 201
    assert sum(r.text.startswith("the same") for r in got) == 1
    assert not next(r for r in got if r.row.doc_id == 5).text


def mistyped(rng, line, k):
    c = list(line)
    for _ in range(k):
        kind, at = rng.randrange(3), rng.randrange(len(c))
        if kind == 0:
            c[at] = rng.choice("xyz")
        elif kind == 1:
            c.insert(at, rng.choice("xyz "))
        else:
            del c[at]
    return "".join(c)


def test_short_lines_equal_an_exhaustive_version(spark):
    rng = random.Random(6)
    base = [made(rng, n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9) for _ in range(4)]
    lines = base + [mistyped(rng, rng.choice(base), rng.randint(1, 2)) for _ in range(200)]
    lines += ["Read more here", "read more hére", "log in to reply", "login to reply", "1", "2", "b)", "c)", "1234567", "1234568"]
    split = [" ".join(line.lower().split()) for line in lines]

    def near(a, b):
        x, y = a.split(), b.split()
        if min(len(x), len(y)) < 8:
            return a == b or (min(len(a), len(b)) >= 8 and edit_distance(a, b) <= 1)
        return edit_distance(x, y) <= 1

    got = linededup.dedup(frame(spark, list(enumerate(lines)))).collect()
    assert {r.doc_id for r in got if r.text.strip()} == {
        k for k, a in enumerate(split) if a and not any(near(a, b) for b in split[:k])}
    assert {len(lines) - 9, len(lines) - 7}.isdisjoint({r.doc_id for r in got})


def test_plain_lines_are_those_of_split():
    texts = ["A  b \x1c c\n\n \t \nİx Σ ΑΣ\x85y\n", None, "", "\n", "a b　 c\nlast", " lead\x0b\x0ctrail "]
    plain = linededup.Plain(texts)
    want = [(doc, number, line.split()) for doc, text in enumerate(texts)
            for number, line in enumerate((text or "").lower().split("\n")) if line.split()]
    got = plain.texts(np.arange(len(plain.words)))
    assert [(d, n, t.split(" ")) for d, n, t in zip(plain.doc.tolist(), plain.number.tolist(), got)] == want
    assert plain.words.tolist() == [len(w) for _, _, w in want] and len(plain.hashes()) == plain.words.sum()
    assert len(linededup.Plain([None, " \n"]).words) == len(linededup.Plain([]).words) == 0


def test_only_shared_keys_come_back_and_filters_miss_nothing(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    alone = [" ".join(rng.sample(words, 60)) for _ in range(300)]
    near = alone[0].replace(alone[0].split()[7], "changed")
    docs = frame(spark, list(enumerate([*alone, near, alone[1]]))).repartition(3)
    dealt = linededup.key_blocks(docs)
    # Rows of many keys are dealt, not one row a key with its line (before: 22 keys a line of 60 words).
    assert dealt.count() <= 3 * linededup.BUCKETS
    shared = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        linededup.shared_keys, "id long, v long, w int, words int, rows long").cache()
    assert shared.where("w >= 0").select("id").distinct().count() == 2 and shared.where("w < 0").count() == 1
    assert {r.rows for r in shared.where("w >= 0").collect()} == {2}
    ids = spark.range(3000).selectExpr("xxhash64(id) AS id")
    kept = linededup.Filter(ids)
    mine = np.array([r.id for r in ids.collect()], dtype=np.int64)
    assert kept.has(mine).all() and kept.has(~mine).mean() < .05


def test_lines_of_a_group_meet_by_what_sets_them_apart(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BLOCK_LINES", 4)
    rng = random.Random(14)
    passage, copied = made(rng, 60), made(rng, 90).split()
    words = [f"w{k}" for k in range(50_000)]

    def changed(k):
        at = set(rng.sample(range(90), 12))
        return " ".join(w if k not in at else rng.choice(words) for k, w in enumerate(copied))

    def rows(n):
        texts = [f"{' '.join(rng.sample(words, 14))} {passage}" for _ in range(n)] + [changed(k) for k in range(n)]
        lines = spark.createDataFrame([(k, t, [k // n]) for k, t in enumerate(texts)], "at long, text string, windows array<long>")
        pairs = lines.selectExpr("at", f"at div {n} * {n} AS first", "true AS wide", "false AS done").where("at > first")
        found = linededup.told(pairs, lines)
        assert found.where("near").count() == 0 and found.agg({"at": "count"}).first()[0] == 2 * n - 2
        return linededup.meetings(found, found.where("near").select("at")).count()

    # Before, each of the n lines of a group was dealt to n / 4 cells: four times the rows for twice the lines.
    few, many = rows(150), rows(300)
    assert many < 3 * max(few, 300) and many < 300 * 300 // 4


def test_words_needed_hold_one_that_near_lines_share():
    rng = random.Random(15)
    common = np.random.default_rng(1).integers(0, 50, linededup.SPOTS)
    for _ in range(200):
        a = made(rng, rng.randint(40, 160))
        b, first = edited(rng, a, len(a.split()) // 20), edited(rng, a, 15)
        if min(len(a.split()), len(b.split())) < 40 or not linededup.near(a, b):
            continue
        size, words = linededup.rare_words([a, b], [first, first], common)
        assert size.tolist() == [len(x.split()) // 20 + 1 for x in (a, b)]
        assert set(words[:size[0]].tolist()) & set(words[size[0]:].tolist())


def test_blocks_give_back_what_was_packed():
    rng = np.random.default_rng(2)
    columns = [rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(-5, 1 << 40, 500),
               rng.integers(-1, 9, 500).astype(np.int32), rng.integers(0, 4, 500).astype(np.int8)]
    blocks = linededup.packed(linededup.bucket_of(columns[0]) % 7, *columns)
    back = linededup.unpacked(blocks.column(1).to_pylist(), np.uint64, np.int64, np.int32, np.int8)
    assert blocks.column(0).to_pylist() == list(range(7))
    assert sorted(zip(*map(np.ndarray.tolist, back))) == sorted(zip(*map(np.ndarray.tolist, columns)))


def test_lines_settled_where_they_meet_are_those_settled_at_once():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        key, role, at = rng.integers(0, 12, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.int8), rng.integers(0, 25, n)
        rows = list(zip(key.tolist(), role.tolist(), at.tolist()))
        want = {a for k, r, a in rows if any(k == k2 and r2 == {2: 2, 0: 1, 1: 0}[r] and a2 < a for k2, r2, a2 in rows)}
        parts = [linededup.met_here(key[x], role[x], at[x]) for x in np.array_split(rng.permutation(n), 3)]
        asks, earlier = linededup.met(*(np.concatenate(c) for c in zip(*parts)))
        assert set(asks.tolist()) == want and len(asks) == len(want) and (earlier < asks).all()


def test_a_key_of_very_many_lines_brings_one_row_from_each_task():
    """Before, every line under a key was a row of its own in the join by that key."""
    at = np.random.default_rng(4).permutation(10_000)
    key, role, _ = linededup.met_here(np.full(len(at), 5, np.uint64), np.full(len(at), 2, np.int8), at)
    assert (role != linededup.MET).sum() == 1 and (role == linededup.MET).sum() == len(at) - 1
    # A line without a word, under a key that is the same for all and one with the place of that word.
    both = np.concatenate([np.full(len(at), 5, np.uint64), np.full(len(at), 6, np.uint64)])
    _, role, _ = linededup.met_here(both, np.repeat(np.array([2, 0], np.int8), len(at)), np.concatenate([at, at]))
    assert (role == 2).sum() == 1 and (role == 0).sum() == 1


def test_lines_need_their_rarest_windows_up_to_the_weight(spark):
    rng = random.Random(16)
    passage = made(rng, 30)
    lines = [f"{made(rng, 12)} {passage} {made(rng, k % 9)}" for k in range(40)]
    lines += [edited(rng, line, 1) for line in lines[:20]] + ["one and the same short line of eight words"] * 2
    docs = frame(spark, list(enumerate(lines)))
    shared = linededup.key_blocks(docs).repartition("bucket").sortWithinPartitions("bucket")
    rows = shared.mapInArrow(linededup.shared_keys, "id long, v long, w int, words int, rows long").collect()
    blocks = shared.mapInArrow(linededup.line_blocks, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    got = {r.id: r for r in blocks.mapInArrow(
        linededup.needed, "id long, half boolean, windows array<long>, again boolean").collect()}
    for line in {r.id for r in rows}:
        mine = [r for r in rows if r.id == line]
        keys = sorted((r.rows, r.v & (1 << 64) - 1, r.w) for r in mine if r.w > 0)
        n = max(r.words for r in mine)
        before, want = n - linededup.RUN + 1 - sum(w for *_, w in keys), set()
        for _, v, w in keys:
            if before <= linededup.RUN * linededup.bound(n):
                want.add(v)
            before += w
        half, again = any(r.w == 0 for r in mine), any(r.w < 0 for r in mine)
        if half or again or want:
            assert ({v & (1 << 64) - 1 for v in got[line].windows}, got[line].half, got[line].again) == (want, half, again)
        else:
            assert line not in got
    assert any(r.again for r in got.values()) and any(r.windows for r in got.values())


def test_a_tidy_cut_keeps_rows_and_settings(spark):
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id").repartition(3, "k")
    for was in (None, "false"):
        if was is not None:
            spark.conf.set(TIDY, was)
        before = spark.conf.get(TIDY)
        out = cut(rows, tidy=True)
        assert spark.conf.get(TIDY) == before
        assert out.columns == ["k", "id"] and sorted(r.id for r in out.collect()) == list(range(1000)) and out.count() == 1000
    spark.conf.unset(TIDY)
