"""Long benchmark items, edited up to the bound."""

import random

import pytest

from lakehealth.llm import decontam
from tests.llm.test_corpus_operators import made


@pytest.mark.parametrize("n", [60, 400, 800, 1600])
def test_items_at_the_edit_bound_are_found(n):
    rng = random.Random(n)
    items = [(k, made(rng, n)) for k in range(2)]
    index = decontam.Index(items)
    vocabulary = items[0][1].split() + items[1][1].split()
    for trial in range(8):
        k = trial % 2
        w = items[k][1].split()
        for _ in range(decontam.edits(n)):
            kind, at = rng.randrange(3), rng.randrange(len(w))
            if kind == 0:
                w[at] = rng.choice(vocabulary)
            elif kind == 1:
                w.insert(at, rng.choice(vocabulary))
            else:
                del w[at]
        text = " ".join([made(rng, 50), *w, made(rng, 50)])
        hits = index.match(text)
        assert [h[0] for h in hits] == [k] and hits[0][3] <= decontam.edits(n)
    assert not index.match(made(rng, 2 * n))
