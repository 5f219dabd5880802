"""Chunk bounds soon after a passage begins."""

from __future__ import annotations

import numpy as np

from tallywork.llm import chunking

from .conftest import words


def test_chunk_bounds_forget_what_stands_before(docs):
    passage = words(60, 9).encode()
    first, other = (chunking.chunk_ends(np.frombuffer(w.encode() + passage, np.uint8)) - len(w)
                    for w in (words(20, 1), words(31, 2)))
    inside = [set(e[(e > 16) & (e < len(passage))].tolist()) for e in (first, other)]
    assert inside[0] and inside[0] == inside[1]


def test_most_of_a_passage_of_fifty_words_goes(docs):
    passages = [words(52, 100 + i) for i in range(60)]
    texts = [words(30, 1000 * k + i) + " " + p + " " + words(30, 5000 * k + i + 7)
             for k in (1, 2) for i, p in enumerate(passages)]
    got = {r.doc_id: r.n_removed for r in chunking.deduplicated(docs(*texts)).collect()}
    shares = [got[60 + i] / len(p) for i, p in enumerate(passages)]
    assert all(got[i] == 0 for i in range(60))
    assert max(shares) <= 1 and sum(shares) / 60 > 0.74 and sum(s > 0.8 for s in shares) >= 30
