"""Contracts of language identification, sharding and page text at their edges."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lakehealth.llm import htmltext, langid, sharding
from tests.llm.test_aside_names import BODY, KEPT, WORDS
from tests.llm.test_corpus_operators import made


@pytest.mark.parametrize("text, found", [
    ("½ ²", []), ("12 ,", []), ("a½b c", ["a", "b", "c"]), ("Ⅷ x", ["x"]), ("日本 5", ["日本"]), ("x" * 70, ["x" * 32, "x" * 32, "x" * 6]),
    ("no_underscore", ["no", "underscore"]), (None, [])])
def test_words_are_runs_of_letters(text, found):
    assert langid.letters(text) == found
    assert all(w.isalpha() for w in langid.letters(text))


def test_more_languages_than_a_model_holds_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    rows = spark.createDataFrame([(f"l{i}", "text") for i in range(5)], "lang string, text string")
    with pytest.raises(ValueError):
        langid.row_counts(rows)
    assert langid.row_counts(rows.where("lang < 'l2'").union(rows.where("lang = 'l0'"))) == [("l0", 2), ("l1", 1)]


# sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def grouped_docs():
    rng = random.Random(8)
    texts = [made(rng, rng.randint(1, 60)) for _ in range(260)]
    rows = [(i, t, rng.choice(["de", "en", None]), f"https://www.example.org/{rng.randrange(40):03d}") for i, t in enumerate(texts)]
    rows += [(1000 + i, texts[i % 9], rng.choice(["fr", "en"]), f"https://www.example.org/{rng.randrange(40):03d}") for i in range(90)]
    return rows + [(2000, None, None, None), (2001, None, "en", "z"), (2002, "", "en", None)]


def assigned(spark, rows):
    return sharding.assign(spark.createDataFrame([(*r, 1) for r in rows], DOCS).repartition(3), 16).collect()


def exact_order(rows):
    """doc ids along the curve, with cells from exact quantiles; ids of one text in order."""
    cells = 1 << sharding.BITS

    def number_cells(values):
        s = sorted(values)
        bounds = [s[max(math.ceil(len(s) * k / cells) - 1, 0)] for k in range(1, cells)]
        return [sum(b < v for b in bounds) for v in values]

    def string_cells(values):
        s = sorted(v for v in values if v is not None)
        first = {}  # number of quantiles reached by all values up to this one
        for n, v in enumerate(s, 1):
            first[v] = min(n * cells // len(s), cells - 1)
        bounds, done = [], 0
        for v in sorted(first):
            bounds += [v] * (first[v] - done)
            done = first[v]
        return [0 if v is None else sum(b < v for b in bounds) for v in values]

    size = [0 if t is None else len(t.encode()) for _, t, _, _ in rows]
    points = np.array([number_cells([-1 if r[1] is None else n for r, n in zip(rows, size)]),
                       string_cells([r[2] for r in rows]), string_cells([r[3] for r in rows])]).T
    curve = sharding.hilbert_index(points, sharding.BITS).tolist()
    least = defaultdict(lambda: 1 << 60)
    for r, c in zip(rows, curve):
        least[r[1]] = min(least[r[1]], c)
    crc = lambda t: 0 if t is None else zlib.crc32(t.encode())
    return {r[0]: (least[r[1]], crc(r[1])) for r in rows}


def test_shards_equal_an_exhaustive_version(spark):
    rows = grouped_docs()
    got, want = assigned(spark, rows), exact_order(rows)
    assert {r.doc_id: (r.curve, r.text_crc32) for r in got} == want
    placed = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [want[r.doc_id] for r in placed]
    assert keys == sorted(keys)
    assert [sum(r.shard == s for r in got) for s in range(16)] == [len(rows) * (s + 1) // 16 - len(rows) * s // 16 for s in range(16)] or \
        max(sum(r.shard == s for r in got) for s in range(16)) - min(sum(r.shard == s for r in got) for s in range(16)) <= 1


def test_equal_texts_stand_side_by_side(spark):
    rows = grouped_docs()
    text = {r[0]: r[1] for r in rows}
    placed = [text[r.doc_id] for r in sorted(assigned(spark, rows), key=lambda r: (r.shard, r.slot))]
    starts = [t for t, before in zip(placed, [object(), *placed]) if t != before]
    assert len(starts) == len(set(starts))
    shards = defaultdict(set)
    for r in assigned(spark, rows):
        shards[text[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in shards.values()) <= 15


def test_strings_that_begin_alike_have_cells_of_their_own(spark):
    values = spark.createDataFrame([(f"https://www.example.org/{i % 64:03d}",) for i in range(640)] + [(None,)], "value string")
    bounds = sharding.string_bounds(values, 64)
    assert len(bounds) == 63 and len(set(bounds)) == 63 and bounds == sorted(bounds)
    hot = spark.createDataFrame([("a",)] * 500 + [(f"b{i}",) for i in range(100)], "value string")
    assert sharding.string_bounds(hot, 4) == ["a", "a", "a"]
    assert sharding.string_bounds(hot.limit(0), 4) == []


# page text

@pytest.mark.parametrize("page", [
    f"<nav><button>Menu</nav><article>{BODY}</article>",
    f"<div class='menu'><button>Menu</div><article>{BODY}</article><div class='menu'><button>Top</button></div>",
    f"<nav><select><option>one</nav><article>{BODY}</article>", f"<nav><svg><path d='x'/></nav><article>{BODY}</article>",
    f"<nav><canvas></nav><article>{BODY}</article>", f"<nav><object data='x'></nav><article>{BODY}</article>",
    f"<nav><svg><svg></svg>text</svg></nav><article>{BODY}</article>", f"<article>{BODY}</article><ol class='commentlist'><li>{WORDS}</li></ol>",
    f"<article>{BODY}</article><div class='sidebarwrap'>{WORDS}</div>", f"<article>{BODY}</article><script>var x = '",
])
def test_the_article_survives(page):
    assert htmltext.main_texts([f"<html><body>{page}</body></html>"], htmltext.train()) == [KEPT]


def test_formulas_are_part_of_the_text():
    page = f"<html><body><article><h1>A headline of six words here</h1><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be. {WORDS}</p></article></body></html>"
    assert "Let x=1 be. plain words" in htmltext.main_texts([page], htmltext.train())[0]


# piece encoder

def test_cuts_of_pieces_are_sure():
    import public_tokenizers
    import tiktoken

    from lakehealth.llm import bpe, tokenfile

    library = tokenfile.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.encoder(ranks, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={}, mergeable_ranks=bpe.read_ranks(ranks))
    parts = ["a", "B", "é", "ß", "中", "ق", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "\x1c", "\x85", ".", "!!", "'s", "'", "_", "1",
             "½", "²", "-", "|", "word", "The", "😀", "é", "​", "###"]
    rng = random.Random(1)
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert library.encode(text) == library.whole(text)
        assert own.encode(text) == np.array(reference.encode_ordinary(text), "<u4").tobytes()
    lines = "a\n" * 50_000 + "b"
    assert library.encode(lines) == library.whole(lines)
