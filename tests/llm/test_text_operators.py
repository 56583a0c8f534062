"""Operators on single texts, against the libraries they must agree with and small fixtures."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakehealth.llm import bpe, htmltext, langid, tokenfile

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = "ab  \n\t'stré漢字1２   \x1c.,!!😀een\x0b\xa0"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, part string"


@pytest.fixture(scope="module")
def coder():
    return bpe.PrefixCoder(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS),
                             special_tokens={})


def odd_rows():
    """Nulls, empty and long texts, repeated rows and ids, and columns with names the operators use."""
    long = " ".join(random.Random(3).choice(["lorem", "ipsum,", "été", "xx\n"]) for _ in range(20_000))
    return [(1, "Hello  world.\nBye", "en", "a", 3, "k", 1, "p"), (1, "Hello  world.\nBye", "en", "a", 3, "k", 1, "p"),
            (2, None, None, None, None, None, None, None), (None, "no id", "en", "b", 1, "", 0, ""),
            (3, "", "en", "a", 0, "k", 1, "p"), (4, long, "fr", "a/b", 1, "k", 1, "p"),
            (4, "other text, same id", "en", "a", 1, "k", 1, "p"), (5, "  \n ", "de", "c", 1, "k", 1, "p")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ODD, max_size=40))
def test_prefix_coder_agrees_with_tiktoken(coder, reference, text):
    enc = bpe.TextEncoder(coder, public_tokenizers.PATTERN)
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.data())
def test_appends_and_edits_are_exact(coder, data, new, draw):
    text = bpe.PrefixText(coder, data)
    text.append(new)
    assert text.ids() == bpe.PrefixText(coder, data + new).ids()
    a = draw.draw(st.integers(0, len(text.data)))
    b = draw.draw(st.integers(a, len(text.data)))
    whole = text.data[:a] + new + text.data[b:]
    text.replace(a, b, new)
    assert text.data == whole and text.ids() == bpe.PrefixText(coder, whole).ids()
    assert coder.decode(text.ids()) == whole


def test_edit_recomputes_little(coder):
    text = bpe.PrefixText(coder, b"the quick brown fox jumps over the lazy dog " * 50)
    text.replace(10, 15, b"black")
    assert text.recomputed < 10 * coder.longest
    assert text.ids() == bpe.PrefixText(coder, text.data).ids()


def whole_table(coder, data):
    last = []
    coder.extend(data, last)
    return coder.walk(last)


@given(st.one_of(st.binary(min_size=1, max_size=260), st.text("abehinrt ü\n.", min_size=1, max_size=260).map(str.encode)))
@settings(max_examples=400, deadline=None)
def test_entries_asked_for_from_the_end_equal_the_whole_table(coder, data):
    whole = coder.ranks.get(data)
    assert coder.encode(data) == (whole_table(coder, data) if whole is None else [whole])


def test_a_word_costs_fewer_lookups_than_its_whole_table():
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    coder = bpe.PrefixCoder(bpe.read_ranks(RANKS))
    coder.reachable = Counting(coder.reachable)
    words = [w.encode() for w in (" scherkeitber", " heitlichtz", " enverzerein", " thenwhreand", " oftionnten", " edblerewas")]
    assert not any(w in coder.ranks for w in words)
    tables = [whole_table(coder, w) for w in words]
    most, Counting.asked = Counting.asked, 0
    assert [coder.encode(w) for w in words] == tables
    assert Counting.asked < 0.8 * most


def test_bpe_documents(spark, reference):
    rows = odd_rows()
    got = bpe.encode_documents(spark.createDataFrame(rows, SCHEMA), RANKS, keep_text=True).collect()
    want = sorted(repr((r[0], hashlib.sha256(np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes())
                        .hexdigest(), r[1] or "")) for r in rows)
    assert sorted(repr((r.doc_id, r.ids_sha256, r.decoded)) for r in got) == want
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=1500), st.data())
def test_directly_addressable_codes(ids, draw):
    segment = tokenfile.Segment(tokenfile.pack(np.array(ids, dtype=np.uint32)))
    assert segment.tokens().tolist() == ids and len(segment) == len(ids)
    if ids:
        i = draw.draw(st.integers(0, len(ids) - 1))
        assert segment.token(i) == ids[i]


def test_library_encoder_agrees_with_library():
    enc, rnd = tokenfile.LibraryEncoder(JSON), random.Random(1)
    parts = [*ODD, "<|endoftext|>", "word", " the"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert enc.encode(text) == enc.whole(text)


def test_token_files(spark):
    library, rows = Tokenizer.from_file(JSON), odd_rows()
    path = tokenfile.fresh_path(spark)
    tokenfile.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), path, JSON, 2)
    got = tokenfile.read_documents(spark, path).collect()
    ids = {}
    for r in rows:
        coded = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        ids.setdefault(r[0], []).append((len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())))
    assert sorted(repr((r.doc_id, (r.n_tokens, r.ids_crc32))) for r in got) \
        == sorted(repr((k, x)) for k, v in ids.items() for x in v)
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
    order = [r.doc_id for r in in_order]
    assert order[0] is None and order[1:] == sorted(order[1:])
    everything = sum((library.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows if r[0] == 2), [])
    start = next(r.start for r in got if r.doc_id == 2)
    assert tokenfile.read_token(spark, path, start) == everything[0]
    empty = tokenfile.fresh_path(spark)
    tokenfile.write_token_files(spark.createDataFrame([], SCHEMA), empty, JSON, 2)
    assert tokenfile.read_documents(spark, empty).count() == 0


def test_forward_sums_all_segmentations():
    lattice = langid.Lattice(["a", "b", "ab", " a", " ab", "ba"])
    prob = np.zeros((lattice.unknown + 3, 1))
    prob[:lattice.unknown, 0] = [.1, .2, .3, .15, .05, .2]
    prob[lattice.unknown + 1] = 1
    index = {k: i for i, k in enumerate(lattice.pieces)}
    p = {k: prob[i, 0] for k, i in index.items()} | {" ": 1.0}

    def total(s):
        return 1.0 if not s else sum(p[s[:k]] * total(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    for word in ("ab", "ba"):
        edges = lattice.edges([word])
        assert lattice.forward(edges, prob)[0, -1, 0] == pytest.approx(total(" " + word))
    counts = lattice.expected(lattice.edges(["ab"]), prob, np.array([[2.0]]))
    # every segmentation covers three characters, the start mark among them
    covered = sum(counts[i, 0] * len(k) for k, i in index.items()) + counts[lattice.unknown + 1, 0]
    assert covered == pytest.approx(6)


def test_language_id(spark, sf0001):
    docs = spark.read.parquet(f"{sf0001}/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, PIECES).collect()}
    right = [got[r.doc_id].lang_pred == r.lang for r in docs.collect() if got[r.doc_id].held_out]
    assert len(right) > 20 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    for r in docs.select("doc_id").collect()[:20]:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_id_edge_cases(spark):
    got = langid.identify(spark.createDataFrame(odd_rows(), SCHEMA), PIECES).collect()
    assert len(got) == len(odd_rows())
    assert {r.lang_pred for r in got if r.doc_id in (2, 3, 5)} == {"und"}
    none = langid.identify(spark.createDataFrame([(1, "some words", None, "s", 1, "", 1, "")], SCHEMA), PIECES)
    assert none.first().lang_pred == "und"
    assert langid.identify(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head</h1>"
     "<p>One &amp; two\n three.<br>four</p><div class='ad'>Buy now</div><p>Short.</p><aside>Side</aside></article>"
     "<section id=comments><p>What a long comment this is, really, with many words in it.</p></section>"
     "<footer>&copy; x</footer></body></html>", "Head\nOne & two three. four\nShort."),
    ("<article><p>Cut off in a tag <b>here</b> and <a hre", "Cut off in a tag here and"),
    ("<article><p>a &lt;b&gt; &#233;&nbsp;x</p><script>var s='<p>no</p>'</script><!-- <p>no</p> --><p>5 < 6</p>",
     "a <b> é x\n5 < 6"),
    ("<form>Name <input></form><div class=\"cookie-notice\">We use cookies</div><article>Plain text</article>",
     "Plain text"),
    (None, ""), ("", ""), ("<p></p>", ""),
]


def test_main_text(spark):
    tree = htmltext.train()
    x, y = htmltext.labelled_table()
    assert (tree.predict(x) == y).all()
    assert htmltext.main_texts([p for p, _ in PAGES], tree) == [t for _, t in PAGES]
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(i, None, p, "x", "y") for i, (p, _) in enumerate(PAGES)] + [(None, "u", PAGES[0][0], None, None)]
    got = htmltext.extract(spark.createDataFrame(rows, schema)).collect()
    assert {(r.page_id, r.text, r.n_chars) for r in got} \
        == {(i, t, len(t)) for i, (_, t) in enumerate(PAGES)} | {(None, PAGES[0][1], len(PAGES[0][1]))}
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0


def test_main_text_of_long_and_link_heavy_pages():
    tree = htmltext.train()
    body = "".join(f"<p>Paragraph {i} with <a href='/{i}'>a linked phrase of words</a> in it.</p>" for i in range(3000))
    (text,) = htmltext.main_texts([f"<nav>{'<a>x</a>' * 50}</nav><article>{body}</article>"], tree)
    assert len(text.split("\n")) == 3000
    plain = "<div><a>Home</a></div><div><a>News</a></div><div>" + "word " * 80 + "</div><div>" + "more " * 60 + "</div>"
    (text,) = htmltext.main_texts([plain + "<div><a>Terms</a> <a>Privacy</a></div>"], tree)
    assert text == "\n".join([("word " * 80).strip(), ("more " * 60).strip()])
