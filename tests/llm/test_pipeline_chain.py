"""run() of the pipeline on a planted table, against a chain of exhaustive stages."""

import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from lakehealth.llm import bpe, decontam
from lakehealth.llm.words import words
from tests.llm.test_corpus_operators import exhaustive_lines, exhaustive_links, made


def planted_table():
    """(documents, labels, benchmark, ids to be rejected for quality)."""
    rng = random.Random(21)
    docs, labels, toxic = [], [], set()
    for i in range(300):
        lines = [made(rng, rng.randint(20, 35)) for _ in range(3)]
        if i % 5 == 1:
            lines = [line.replace(" ", f" {rng.choice(['vilexa', 'vilexo', 'vilexes'])} ", 4) for line in lines]
            toxic.add(i)
        docs.append((i, "\n".join(lines)))
        labels.append((i, 1, int(i in toxic)))
    text = dict(docs)
    items = [(k, made(rng, 30)) for k in range(4)]

    def add(i, new):
        text[i] = new

    for i in (200, 210, 220):  # a repeated line, among others of its own
        add(i, text[i] + "\n" + text[10].split("\n")[0])
    for i in (202, 212, 222):  # a near copy of one document on one line: too far for a line, near enough for the join
        copy = text[12].split()
        for at in (10, 30, 31, 50):
            copy[at] = made(rng, 1)
        add(i, " ".join(copy))
    add(230, text[12].replace("\n", " "))  # the words of 12 on one line: a copy to the n-gram join
    for n, i in enumerate((204, 214, 224, 234)):  # a benchmark item, edited within the bound
        w = items[n][1].split()
        w[5] = "zzz"
        add(i, text[i] + "\n" + text[i].split("\n")[0][:10] + " " + " ".join(w))
    return sorted(text.items()), labels, items, toxic


def chain(docs, items, toxic):
    """Documents (id -> text) that are left, each stage exhaustively."""
    rows = exhaustive_lines([d for d in docs if d[0] not in toxic])
    before = dict(docs)
    rows = [(i, t) for i, t in rows if t.strip() or not before[i].strip()]
    rows = [rows[k] for k, (i, least, _) in enumerate(exhaustive_links(rows)) if i == least]
    index = [(words(t), decontam.edits(len(words(t)))) for _, t in items]

    def near(item, most, found):
        row = [0] * (len(found) + 1)
        for i, x in enumerate(item, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(found, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row) <= most

    return {i: t for i, t in rows if not any(near(item, most, words(t)) for item, most in index)}


def test_run_equals_the_exhaustive_chain(spark, tmp_path):
    docs, labels, items, toxic = planted_table()
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in docs],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = chain(docs, items, toxic)
    assert 204 not in want and 230 not in want and 200 in want and len(want) < 300 - len(toxic) - 4
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    assert {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in rows} == {
        i: (hashlib.sha256(np.array(reference.encode_ordinary(t), "<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.encode()).hexdigest()) for i, t in want.items()}
    assert len(rows) == len(want)
