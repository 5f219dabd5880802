"""Each operator against a plain version of its definition, and on null, empty, repeated and odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallywork.llm import (
    bpe,
    chunking,
    minhash,
    packing,
    parity_join,
    pii,
    quality,
    suffix_dedup,
    toxicity,
    urls,
)
from tests.llm.conftest import words

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, "  \n ", "Ünïcode Ｗide 日本 🙂 ΣΣ isn't", "<|endoftext|> a <|startoftext|>b",
       "a\x00b", "x" * 5000, "one two"]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_bpe_equals_the_library(docs):
    got = by_id(bpe.encoding_digests(docs(*ODD, words(300)), WORD), "n_tokens", "ids_sha256", "decoded_sha256")
    library = Tokenizer.from_file(WORD)
    for i, text in enumerate([*ODD, words(300)]):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                          hashlib.sha256(decoded.encode()).hexdigest())


def test_bpe_rows(docs):
    rows = bpe.encoded(docs((1, "a b"), (1, "a b"), (None, "c")), WORD).collect()
    assert len(rows) == 3 and {r.decoded for r in rows} == {"a</w> b</w>", "c</w>"}
    assert bpe.encoded(docs("a").limit(0), WORD).collect() == []


def test_packing_covers_every_id_once(docs):
    texts = [*ODD, words(1500)]
    rows = packing.packed(docs(*texts), BYTE, with_ids=True).collect()
    library = Tokenizer.from_file(BYTE)
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [x for r in mine for x in r.ids] == ids
        assert all(r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0 for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
        assert {r.doc_tokens for r in mine} == {len(ids)}
    assert len({r.sequence_id for r in rows}) == len(rows)


def brute_components(sets, linked):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingle_set(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def near_texts():
    base = words(200, 1).split()
    texts = [" ".join(base), " ".join(base).upper()]
    for k in range(30):  # a large group, each with other words changed
        changed = list(base)
        for j in range(1 + k % 4):
            changed[(7 * k + 31 * j) % 200] = f"w{k}x{j}"
        texts.append(" ".join(changed))
    return [*texts, "a b", "a  b", "b a", "", None, " ", words(11, 3), words(11, 3) + " more", words(40, 4)]


@pytest.mark.parametrize(("size", "per_cent"), [(3, 90), (5, 80)])
def test_parity_join_equals_brute_force(docs, size, per_cent):
    texts = near_texts()
    got = by_id(parity_join.joined(docs(*texts), parity_join.Likeness(size, per_cent)),
                "n_shingles", "component_id")
    sets = {i: shingle_set(t, size) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= per_cent * len(a | b))
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_parity_join_keeps_one_of_each(docs):
    texts = near_texts()
    kept = parity_join.one_of_each(docs(*texts))
    assert kept.columns == docs("a").columns
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and 1 not in ids and {34, 35, 36, 37} - {35} <= ids | {35}


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for n in (5, 50, 900):
        a = np.unique(r.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 5:], r.integers(0, 1 << 62, n // 4).astype(np.uint64))))
        apart = len(np.setxor1d(a, b))
        assert parity_join.hamming(parity_join.sketch(a), parity_join.sketch(b)) <= apart


@pytest.mark.parametrize("per_cent", [80, 90])
def test_linked_sets_share_more_keys_than_their_slack(per_cent):
    like, rng, tried = parity_join.Likeness(5, per_cent), np.random.default_rng(4), 0
    for n in (1, 2, 5, 9, 10, 24, 60, 100, 333, 1000):
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64)
            most = like.difference(n)
            gone = int(rng.integers(0, most // 2 + 1))
            mine = np.unique(pool[:n])
            # a partner that differs about as much as a link allows
            other = np.unique(np.concatenate((pool[gone:n], pool[n:n + max(most - 2 * gone, 0)])))
            if not like.linked(len(mine), len(other), len(np.intersect1d(mine, other))):
                continue
            keys = np.intersect1d(*(parity_join.part_keys(x, like) for x in (mine, other)))
            assert len(keys) > max(parity_join.slack(x, like) for x in (mine, other))
            tried += 1
    assert tried > 100


def test_minhash(docs):
    texts = [words(100, k) for k in range(6)] + ["", None, "éé üü", words(100, 0)]
    got = by_id(minhash.fingerprints(docs(*texts)), "n_chars", "edited_sha256", "fingerprint", "near_edited")
    ids = sorted(range(len(texts)), reverse=True)
    for i, k in enumerate(ids):
        text, after = texts[k] or "", texts[ids[(i + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[k][:2] == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        a, b = shingle_set(text, 5), shingle_set(edited, 5)
        assert abs(got[k][3] - (len(a & b) / len(a | b) if a | b else 1)) < 0.2
    assert got[0][2] == got[9][2] != got[1][2]
    groups = by_id(minhash.near_duplicates(docs(*texts)), "component_id")
    assert groups[9] == (0,) and groups[1] == (1,)
    assert minhash.fingerprints(docs("a").limit(0)).collect() == []
    assert len(minhash.fingerprints(docs((None, "a"), (3, "b"), (3, "b"))).collect()) == 3


def test_quality_measures(docs):
    texts = [*ODD, "a b c a b c", "x\nx\n\n x\ny", words(80), "Le " * 60, "a# b$ " * 40]
    entries = quality.ledger(docs(*texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for i, row in by_id(entries, *names).items():
        t = texts[i] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        seen = Counter(grams)
        twice = {k + j for k, g in enumerate(grams) if seen[g] > 1 for j in range(3)}
        assert row == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
                       len(lines) - len(set(lines)), len(twice)), t
    kept = by_id(quality.judged(entries), "base_failed", "kept")
    assert kept[len(ODD) + 2] == (False, True) and kept[len(ODD) + 3] == (True, False)
    policy = quality.POLICIES["1"]
    for row in quality.ablations(entries, policy).collect():
        bit = 1 << list(quality.rules()).index(row.rule)
        failed = [r.failed & policy.mask() for r in entries.collect()]
        assert row.n_failed == sum(bool(f & bit) for f in failed)
        assert row.n_only == sum(f == bit for f in failed)


def test_urls(spark):
    pages = [(1, "http://EN.Example.org/es/1?x", None), (2, "https://a.example.org/en/1#t", "<b>thing</b>"),
             (3, "https://a.com/de/5", "<p>casino win casino win"), (4, "https://com/fr/5", ""),
             (5, None, None), (6, "nothing", "x"), (7, "https://casino-win.net", ""), (7, "ftp://x.org", ""),
             (8, "https://x.example.org/en/2", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in urls.judged(df).collect()}
    assert got[1, "en.example.org", "/es/1"] == ("example.org/es/", "block")
    assert got[2, "a.example.org", "/en/1"] == ("example.org/en/1", "block")
    assert got[3, "a.com", "/de/5"] == ("com/de/", "block")
    assert got[4, "com", "/fr/5"] == ("com/fr/", "allow")
    assert got[5, "", ""][0] is None and got[6, "", ""][0] is None
    assert got[7, "x.org", ""][0] is None and got[8, "x.example.org", "/en/2"] == ("org/", "allow")
    assert len(got) == 9
    assert urls.best_split("freebets", {"free": 9, "bets": 5, "be": 3, "f": 1}, 100) == ["free", "bets"]
    assert urls.judged(df.limit(0)).collect() == []


def test_suffix_dedup_equals_brute_force(docs):
    passage, more = words(60, 5), words(70, 6)
    texts = [words(50, 7) + passage, passage + words(50, 8), words(90, 9), more + " " + more, "é" * 400,
             words(10, 1), "", None, words(50, 7) + passage, "ab" * 400]
    texts += [words(8, 100 + k) + passage + words(8, 200 + k) for k in range(12)]
    raw = [(t or "").encode() for t in texts]
    where = defaultdict(list)
    for i, b in enumerate(raw):
        for p in range(len(b) - 199):
            where[b[p:p + 200]].append((i, p))
    cover = [np.zeros(len(b), bool) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for i, p in places:
                cover[i][p:p + 200] = True
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for block in (6000, 4):
        got = by_id(suffix_dedup.removal_digests(docs(*texts), block), *names)
        for i, b in enumerate(raw):
            kept = np.frombuffer(b, np.uint8)[~cover[i]].tobytes()
            runs = int((np.diff(np.concatenate(([0], cover[i].astype(int)))) == 1).sum())
            assert got[i] == (len(b), int(cover[i].sum()), runs, hashlib.sha256(kept).hexdigest()), i
    kept = by_id(suffix_dedup.deduplicated(docs(*texts)), "text")
    assert kept[0][0] == texts[0] and passage not in kept[1][0] and kept[8][0] == ""
    assert kept[2][0] == texts[2] and kept[7][0] is None
    assert suffix_dedup.deduplicated(docs("a").limit(0)).collect() == []


def test_suffix_dedup_with_shared_ids(docs):
    shared = words(60, 5)
    a, b, c = shared + words(30, 7), words(90, 8), words(30, 9) + shared
    kept = suffix_dedup.deduplicated(docs((1, a), (1, b), (2, c), (None, b + "!"), (None, a))).collect()
    texts = [(r.doc_id, r.text) for r in kept]
    # rows without an id come first, so those of doc_id 1 are the copies
    assert (None, a) in texts and (None, b + "!") in texts and (1, "") in texts and len(texts) == 5
    assert all(len(t) < 200 for d, t in texts if d == 1)
    alone = suffix_dedup.deduplicated(docs((1, a), (1, b), (2, c))).collect()
    assert {(r.doc_id, r.text) for r in alone} >= {(1, a), (1, b)}
    gone = {r.n_removed for r in suffix_dedup.removal_digests(docs((1, a), (1, b), (2, c))).collect()}
    assert 0 in gone and len(gone) == 2  # b loses nothing, a and c the same passage
    equal = suffix_dedup.deduplicated(docs((1, a), (1, a), (1, a), (1, "short"), (1, "short"))).collect()
    assert sorted(r.text for r in equal) == sorted(["", "", a, "short", "short"])
    digests = suffix_dedup.removal_digests(docs((1, a), (1, a))).collect()
    assert [r.n_removed for r in digests] == [len(a.encode())] * 2


def test_suffix_dedup_of_one_long_run(docs):
    long = words(40, 3) + "~" * 3_000_000 + words(40, 4)
    tail = "~" * 300
    rows = by_id(suffix_dedup.removal_digests(docs(long, words(50, 5), tail)), "n_removed", "n_spans")
    assert rows == {0: (3_000_000, 1), 1: (0, 0), 2: (300, 1)}
    kept = by_id(suffix_dedup.deduplicated(docs(long, tail)), "text")
    # the first string of 200 stays with what its later copies do not cover
    assert len(kept[0][0]) == len(long) - 2_999_999 and kept[1][0] == ""


def test_chunks(docs):
    passage = words(80, 5)
    texts = [words(40, 7) + passage + words(9, 1), words(33, 8) + " " + passage + words(5, 2), words(90, 9), "", None]
    got = by_id(chunking.deduplicated(docs(*texts), with_text=True), "n_removed", "text")
    assert got[0] == (0, texts[0]) and got[2] == (0, texts[2]) and got[3] == got[4] == (0, "")
    assert got[1][0] > 300 and texts[1].startswith(got[1][1][:200])
    data = np.frombuffer(words(500, 3).encode(), np.uint8)
    moved = chunking.chunk_ends(np.concatenate((data[:7], data)))
    assert len(set((moved - 7).tolist()) & set(chunking.chunk_ends(data).tolist())) > 50
    assert chunking.deduplicated(docs("a").limit(0)).collect() == []


def test_pii_equals_the_patterns(docs):
    texts = ["mail a.b+c@x-y.example.com, 10.0.0.255 or 1.2.3.256; 0010.1.1.1.1", "a@b.c_d@e.f", None, "",
             "card 4111 1111 1111 1111 and 4111-1111-1111-1112, +1 (913) 555-0100.", "@@..++", "é +44 20 7946 0958",
             "x@y.z " * 400]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
                "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, m):
        d = [int(x) for x in re.sub("[^0-9]", "", m)]
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d[::-1])]
            return 12 <= len(d) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    got = by_id(pii.report(docs(*texts)), "base_sha256", "n_email", "n_ip", "n_card", "n_phone")
    for i, text in enumerate(texts):
        found = sorted((m.start(), rank, m.end(), kind) for rank, (kind, p) in enumerate(patterns.items())
                       for m in re.finditer(p, text or "") if fine(kind, m[0]))
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)
        assert got[i] == (hashlib.sha256(base.encode()).hexdigest(),
                          *(sum(f[3] == kind for f in found) for kind in patterns)), text


def test_pii_terms_that_disclose(docs):
    filler = [words(60, k) for k in range(6)]
    texts = [f"{filler[0]} Kestrelborn wrote from k@x.org {filler[1]}",
             f"{filler[2]} ask Kestrelborn at k@x.org today {filler[3]}", filler[4], filler[5]]
    rows = by_id(pii.sanitised(docs(*texts)), "text", "n_chars")
    for i in (0, 1):
        assert "Kestrelborn" not in rows[i][0] and "[TERM]" in rows[i][0] and "[EMAIL]" in rows[i][0]
        assert rows[i][1] == len(rows[i][0])
    assert rows[2][0] == texts[2]
    assert pii.sanitised(docs("a").limit(0)).collect() == []


def test_pii_terms_that_disclose_go_everywhere(docs):
    """A term that gives a value away goes in texts without the value, and far from it, as well."""
    near = [f"{words(60, k)} ask Kestrelborn at k@x.org now {words(60, 50 + k)}" for k in range(6)]
    far = f"{words(400, 90)}\n {words(3, 91)} é, KESTRELBORN; {words(200, 92)}"
    texts = [*near, far, None, words(50, 93), f"{near[0]} {words(300, 94)} Kestrelborn."]
    rows = by_id(pii.sanitised(docs(*texts, (6, far))), "text", "n_chars")
    assert rows[6][0] == far.replace("KESTRELBORN", "K.") and rows[6][1] == len(rows[6][0])
    assert not any("kestrelborn" in (text or "").lower() for text, _ in rows.values())
    assert rows[9][0].endswith(" K..") and rows[8][0] == texts[8] and rows[7][0] is None
    spans = by_id(pii.report(docs(*texts)), "spans")
    at = far.index("KESTRELBORN")
    assert spans[6] == (f"hints:{at}:{at + 11}",)


def test_pii_terms_whose_lowering_depends_on_their_neighbours(docs):
    texts = [f"{words(60, k)} {x} {words(60, 50 + k)}" for k, x in enumerate((
        "from ΟΔΟΣ'Α by k@x.org", "k@x.org of ΟΔΟΣ'Α too", "İzmirli has k@y.org", "write k@y.org, İzmirli"))]
    text = " ".join(t for t, in by_id(pii.sanitised(docs(*texts)), "text").values())
    assert "ΟΔΟΣ" not in text and "İzmirli" not in text


def test_toxicity(spark, docs):
    bad = ["loathsome", "wretched", "vermin", "scoundrel"]
    texts, toxic = [], []
    for k in range(240):
        text = words(60, 300 + k)
        if k % 3 == 0:
            text = text[:100] + f" {bad[k % 4]} you {bad[(k + 1) % 4]} " + text[100:]
        texts.append(text)
        toxic.append(int(k % 3 == 0))
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] * 2,
                                   "doc_id long, quality int, toxic int")
    table = docs(*texts, "", None)
    got = by_id(toxicity.scores(table, labels), "held_out", "score", "predicted")
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in got.values())
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (h, _, _) in got.items())
    judged = [(got[i][2], t) for i, t in enumerate(toxic) if got[i][0]]
    assert sum(p == t for p, t in judged) / len(judged) > 0.85
    assert toxicity.without_toxic(table, labels.limit(0)).count() == len(texts) + 2
    assert toxicity.scores(table.limit(0), labels).collect() == []


def test_batches_are_cut_by_bytes():
    from tallywork.llm.tables import cut

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "", "b" * 30, None, "c"])], ["text"])
    assert [b.num_rows for b in cut(batch, 12)] == [2, 1, 2] or sum(
        b.num_rows for b in cut(batch, 12)) == 5
