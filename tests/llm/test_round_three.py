"""Alignment, chosen paths and whitening against plain versions of their definitions."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywork.llm import alignment, chosen_path, parity_join, whitening
from tallywork.llm.bpe import byte_symbols
from tallywork.llm.likeness import Likeness
from tests.llm.conftest import words

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "   lead  and\n\n trail  ", "a ▁ b", "<|endoftext|> <s> </s> <0x41>",
         "\x00 漢字 😀é é", "isn't it the same as the other", "isn't it the same as the other", "x" * 3000,
         words(200)]


# ---- alignment -----------------------------------------------------------------------

def sides():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(byte_symbols())}
    raw_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if all(c in byte for c in t)}
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def raw_b(i: int) -> bytes:
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
    return a, raw_a, b, raw_b


def spans(pieces: list[bytes]) -> list[tuple[int, int]]:
    out, at = [], 0
    for p in pieces:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain_alignment(texts):
    """Every pair of tokens compared, group by group, without any of the operator's code."""
    a, raw_a, b, raw_b = sides()
    rows, corpus = [], Counter()
    for text in texts:
        links, groups, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            one, two = [raw_a[i] for i in ids_a], [raw_b(i) for i in ids_b]
            if not b"".join(one) == b"".join(two) == (" " + text).encode():
                ids_a = ids_b = []
        if ids_a:
            one, two = spans(one), spans(two)
            links = [(ids_a[i], ids_b[j]) for i, x in enumerate(one) for j, y in enumerate(two)
                     if x[0] < y[1] and y[0] < x[1]]
            ends = sorted({e for _, e in one} & {e for _, e in two})
            for lo, hi in zip([0, *ends], ends):
                mine = [",".join(str(i) for i, (s, e) in zip(ids, where) if lo <= s and e <= hi)
                        for ids, where in ((ids_a, one), (ids_b, two))]
                groups.append("|".join(mine))
        corpus.update(links)
        rows.append((ids_a, ids_b, groups, links))
    highest = Counter()
    for (_, y), n in corpus.items():
        highest[y] = max(highest[y], n)
    return [(len(x), len(y), len(g), len(k), sum(corpus[p] == highest[p[1]] for p in k),
             sum(corpus[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for x, y, g, k in rows]


@pytest.mark.parametrize("batch_bytes", [1, 1 << 20])
def test_alignment_equals_all_pairs(docs, batch_bytes):
    got = alignment.alignment_counts(docs(*TEXTS), BYTE, PIECE, batch_bytes).collect()
    assert [tuple(r)[1:4] + (r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in sorted(got, key=lambda r: r.doc_id)] == plain_alignment(TEXTS)


def test_links_are_the_overlaps(docs):
    text = "unbelievable tokenizations"
    rows = alignment.links(docs(text, None, text), BYTE, PIECE).where("doc_id = 2").collect()
    a, raw_a, b, raw_b = sides()
    one = spans([raw_a[i] for i in a.encode(" " + text, add_special_tokens=False).ids])
    two = spans([raw_b(i) for i in b.encode(text)])
    assert sorted((r.a, r.b, r.first, r.end) for r in rows) == sorted(
        (i, j, max(x[0], y[0]), min(x[1], y[1])) for i, x in enumerate(one) for j, y in enumerate(two)
        if x[0] < y[1] and y[0] < x[1])


def test_alignment_of_odd_tables(docs):
    assert alignment.alignment_counts(docs("a").limit(0), BYTE, PIECE).collect() == []
    rows = alignment.alignment_counts(docs((None, "a b"), (7, "a b"), (7, "a b")), BYTE, PIECE).collect()
    assert len(rows) == 3 and len({tuple(r)[1:] for r in rows}) == 1
    none = alignment.alignment_counts(docs("", None), BYTE, PIECE).collect()
    assert {tuple(r)[1:] for r in none} == {(0, 0, 0, 0, 0, 0, "")}


# ---- chosen paths --------------------------------------------------------------------

def shingle_set(text: str | None, size: int) -> frozenset:
    own = (text or "").lower().split()
    if len(own) < size:
        return frozenset([tuple(own)] if own else [])
    return frozenset(zip(*(own[k:] for k in range(size)), strict=False))


def plain_components(texts, size, per_cent):
    sets = [shingle_set(t, size) for t in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and both and 100 * both >= per_cent * len(x | sets[j]):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if v == hi else v for v in label]
    return {i: (len(s), v) for i, (s, v) in enumerate(zip(sets, label, strict=True))}


def edited(text: str, every: int, seed: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"w{r.integers(50)}" if r.integers(every) == 0 else w for w in text.split())


def dense(many: int) -> list[str]:
    """Copies of one text with light and with heavy edits, which link with few or with none, two heavy ones that
    link with each other alone, and copies of another text."""
    base, other = words(60, 1), words(60, 2)
    texts = [edited(base, (8, 20, 60)[k % 3], k) for k in range(many)]
    lone = edited(base, 3, 999)
    return [*texts, lone, lone + " end", *(edited(other, 40, k) for k in range(many // 3)), base]


@pytest.mark.parametrize("join, like", [(chosen_path.joined, Likeness(2, 80)),
                                        (parity_join.joined, Likeness(3, 90)),
                                        (parity_join.joined, Likeness(5, 80))])
def test_components_of_dense_groups(docs, join, like):
    texts = [*dense(90), "", None, "one", "ONE", "  ", words(40, 7), words(40, 7).upper()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in join(docs(*texts), like).collect()}
    assert got == plain_components(texts, like.size, like.per_cent)


def test_chosen_paths_of_odd_tables(docs):
    rows = chosen_path.joined(docs((5, "a b c"), (None, "a b c"), (5, "x y z"), (9, "a b c"), (3, ""))).collect()
    by = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows if r.doc_id)
    assert by == [(False, 3, 0, 3, True), (False, 5, 2, 5, True), (False, 5, 2, 5, True), (False, 9, 2, 5, False)]
    assert len(rows) == 5
    assert chosen_path.joined(docs("a").limit(0)).collect() == []


def test_rows_of_one_doc_id_with_other_texts_are_other_documents(docs):
    p, u = words(50, 3), words(50, 4)
    left = parity_join.one_of_each(docs((1, p), (2, p), (2, u), (2, u), (None, p), (4, None)))
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted(
        [(0, p), (1, p), (2, u), (4, "")])


# ---- whitening -----------------------------------------------------------------------

def plain_whitening(vectors, width):
    x = np.array([np.pad(np.floor(256 * np.array(v, float)), (0, width - len(v))) for v in vectors])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    return x, n, sums, values, parts


@pytest.mark.parametrize("width", [6, 40])
def test_whitening_equals_eigenvectors(spark, width):
    r = np.random.default_rng(width)
    made = (r.standard_normal((300, width)) * np.linspace(3, 1, width)).tolist()
    vectors = [*made, made[0], made[0][:width - 2], []]
    bad = [None, [float("nan")] * width, [1.0, None], [float("inf")] + [0.0] * (width - 1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate([*vectors, *bad])],
                               "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as key")
    rows = whitening.whitened(df).orderBy("vec_id", "component").collect()
    x, n, sums, values, parts = plain_whitening(vectors, width)
    assert [r.vec_id for r in rows] == [i for i in range(len(vectors)) for _ in range(4)]
    assert {r.n for r in rows} == {n}
    whole = [[int(v) for v in row] for row in x]
    exact = [sum((n * a - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in whole]
    assert [int(r.deviation) for r in rows[::4]] == exact
    want = (x - sums / n) @ parts[:, :4] / np.sqrt(values[:4])
    got = np.array([r.whitened for r in rows]).reshape(-1, 4)
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-9)
    assert np.allclose([r.explained for r in rows[:4]], values[:4] / values.sum(), rtol=1e-9)
    assert {r.identity_error < 1e-9 for r in rows} == {True}


def test_whitening_without_variance_and_with_ties(spark):
    def of(*vectors):
        return whitening.whitened(spark.createDataFrame(
            [(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")).collect()

    assert of() == [] and of([1.0, 2.0], [1.0, 2.0]) == [] and of(None) == [] and of([], []) == []
    one = of([0.0, 0.0], [2.0, 0.0])
    assert [(r.component, round(r.explained, 12)) for r in one] == [(1, 1.0), (1, 1.0)]
    tied = of([1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0])
    assert {r.component for r in tied} == {1, 2} and all(abs(r.explained - 0.5) < 1e-12 for r in tied)
    huge = of([3e38, 0.0], [-3e38, 0.0])
    assert {int(r.deviation) for r in huge} == {4 * ((1 << 31) - 1) ** 2}


def test_deviation_beyond_a_long_stays_exact():
    x = np.array([[(1 << 31) - 1, 5]])
    big = whitening.deviations(x, 10 ** 6, np.array([-(10 ** 15), 7]))
    assert int(big[0].as_py()) == (10 ** 6 * ((1 << 31) - 1) + 10 ** 15) ** 2 + (5 * 10 ** 6 - 7) ** 2


def test_long_texts_of_one_word(docs):
    """A text of megabytes without a blank goes through all three text operators."""
    rows = chosen_path.joined(docs("y" * 3_000_000, "z")).collect()
    assert {r.n_shingles for r in rows} == {1}
    got = alignment.alignment_counts(docs("ab" * 1_200_000), BYTE, PIECE).agg(F.sum("n_a")).first()[0]
    assert got > 0
