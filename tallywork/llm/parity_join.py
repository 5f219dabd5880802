"""N-gram Jaccard join by parity sketches.

A document's set is its distinct word shingles. Each shingle flips one bit of a sketch, so the
Hamming distance of two sketches is at most the size of the symmetric difference of the sets. Sets
with intersection / union >= t differ in at most n * (1 - t) / t shingles, n being the smaller size.
So if a sketch is cut into D + 1 + s parts, pairs that differ in D shingles agree in 1 + s of them at
least: parts are the join keys (pigeonhole). Parts without any shingle say nothing: a document with
at most s of them (s of its smallest partner) leaves them out, and one key is always left. Keys carry, beside the part's bits,
the XOR of its shingles' hashes (equal whenever the part is), which makes chance agreement rare.

A key of many documents gives no pairs. Its members go on only if they have more than s keys of that kind,
as all have that link there (``slack``); those are compared with a hub (``linking``).

Sizes are banded: a document uses its band's parts, and also those of the band below if a partner
may be there. Candidates are checked by size, by the Hamming distance of their whole sketches, and
last by their exact sets.

Equal sets form one class, so copies cost one row each and are never paired. Results: null and
empty texts and texts without words have the empty set and link with nothing; rows without a
doc_id take part, but a class's id is the smallest id it has; rows that share a doc_id with different
sets stay different documents; further columns are not read. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.likeness import Likeness
from tallywork.llm.linking import key_pairs, linked_through
from tallywork.llm.tables import id_and_text, mapped, record, stored, text_bytes
from tallywork.llm.words import U, mix, shared, shingles

#: Ratio of the largest to the smallest size in a band.
BAND = 1.6
SKETCH_SEED, PART_SEED = U(0x51ED270B9F4A7C15), U(0xD6E8FEB86659FD93)


def band_of(n: int) -> int:
    band = 0
    while band_start(band + 1) <= n:
        band += 1
    return band


def band_start(band: int) -> int:
    n = 1
    for _ in range(band):
        n = max(n + 1, int(n * BAND))
    return n


def placed_parts(grams: np.ndarray, like: Likeness) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each band that a set has keys in: the band, its number of parts and the part of each shingle.

    As the larger partner of a smaller set, or the smaller of a larger: the first parts do, as many as its
    own differences need."""
    n = len(grams)
    band = band_of(n)
    for b in (band, band - 1):
        if b < 0 or (b < band and 100 * (band_start(band) - 1) < like.per_cent * n):
            continue  # no linked partner below
        many = like.parts(band_start(b + 1))
        yield b, min(many, like.parts(n)), (mix(grams ^ PART_SEED) % U(many)).astype(np.int64)


def part_keys(grams: np.ndarray, like: Likeness) -> np.ndarray:
    """The join keys of one set."""
    out = []
    for b, own, where in placed_parts(grams, like):
        keep = where < own
        value = np.zeros(own, np.uint64)
        count = np.bincount(where[keep], minlength=own)
        np.bitwise_xor.at(value, where[keep], grams[keep])
        bits = np.zeros(own, np.uint64)
        np.bitwise_xor.at(bits, where[keep], U(1) << (mix(grams[keep] ^ SKETCH_SEED) & U(63)))
        index = np.arange(own)
        full = count > 0
        # equal parts leave out alike; the smallest partner's spare bounds what both may leave out
        if own - full.sum() <= like.spare(int(len(grams) * like.t)):
            index = index[full]
        salt = U(b * 2654435761 + 97)
        out.append(mix(mix(value[index] ^ mix(bits[index] + salt)) + index.astype(np.uint64)))
    return np.concatenate(out)


def slack(grams: np.ndarray, like: Likeness) -> int:
    """How many keys, beside one, a set shares at least with each set that it links with: the spare parts of
    its smallest partner, less its own parts without shingles."""
    spare = least = like.spare(int(len(grams) * like.t))
    for _, own, where in placed_parts(grams, like) if len(grams) else ():
        empty = own - np.count_nonzero(np.bincount(where[where < own], minlength=own))
        least = min(least, max(spare - int(empty), 0))
    return least


def sketch(grams: np.ndarray) -> bytes:
    """All bits of the parity sketch: a power of two, about twice as many as shingles."""
    size = 64
    while size < 2 * len(grams) and size < 1 << 20:
        size *= 2
    bit = (mix(grams ^ SKETCH_SEED) & U(size - 1)).astype(np.int64)
    flips = (np.bincount(bit, minlength=size) & 1).astype(np.uint8)
    return np.packbits(flips, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Of two sketches; the longer is folded (XOR of halves), which keeps the lower bound."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def class_id(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set; 0 is the empty set."""
    if not len(grams):
        return 0
    place = mix(grams) * (np.arange(len(grams), dtype=np.uint64) * U(2) + U(1))
    return int(mix(place.sum(dtype=np.uint64, keepdims=True) + U(len(grams))).view(np.int64)[0]) or 1


def sets(docs: DataFrame, like: Likeness, slacks: bool = False) -> DataFrame:
    """doc_id, t (names the text), n_shingles, c (the class of equal sets), sketch and, if asked for, slack of
    every document."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            grams = shingles(*text_bytes(batch.column("text")), like.size, like.lower)
            return record(doc_id=batch.column("doc_id"), t=batch.column("t"),
                          n_shingles=pa.array([len(g) for g in grams], pa.int64()),
                          c=pa.array(map(class_id, grams), pa.int64()),
                          sketch=pa.array(map(sketch, grams), pa.binary()),
                          **({"slack": pa.array([slack(g, like) for g in grams], pa.int64())} if slacks else {}))
        return work

    return mapped(id_and_text(docs).withColumn("t", text_name("text")), make,
                  "doc_id long, t binary, n_shingles long, c long, sketch binary" + ", slack long" * slacks)


def text_name(text: str) -> Column:
    """A text's 128-bit digest; null is empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def keys(docs: DataFrame, like: Likeness) -> DataFrame:
    """k, c: the keys of each class. A task gives them once for the copies that it reads."""

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ks, cs = [], []
            for grams in shingles(*text_bytes(batch.column("text")), like.size, like.lower):
                c = class_id(grams)
                if not c or c in seen:
                    continue
                seen.add(c)
                found = part_keys(grams, like).view(np.int64)
                ks.append(found)
                cs.append(np.full(len(found), c))
            if not ks:
                return None
            return record(k=np.concatenate(ks), c=np.concatenate(cs))
        return work

    return mapped(id_and_text(docs), make, "k long, c long")


def near(pairs: DataFrame, classes: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose sketches are near enough."""
    a, b = (classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"),
                           F.col("sketch").alias(f"sketch_{x}")) for x in "ab")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = zip(*(batch.column(x).to_pylist() for x in ("na", "nb", "sketch_a", "sketch_b")),
                       strict=True)
            fine = [hamming(x, y) <= _most_apart(na, nb, like.per_cent) for na, nb, x, y in rows]
            return batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))
        return work

    both = pairs.join(a, "a").join(b, "b").filter(like.sizes_fit(F.col("na"), F.col("nb")))
    return mapped(both.select("a", "na", "b", "nb", "sketch_a", "sketch_b"), make, "a long, b long")


def _most_apart(n_a: int, n_b: int, per_cent: int) -> int:
    """|A| + |B| - 2 |both| with the fewest shared shingles that link them."""
    least = -(-per_cent * (n_a + n_b) // (100 + per_cent))
    return n_a + n_b - 2 * least


def verified(pairs: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The linked ones of pairs (a, b), by their exact sets; texts: c, text, one each."""
    a = texts.select(F.col("c").alias("a"), F.col("text").alias("text"))
    b = texts.select(F.col("c").alias("b"), F.col("text").alias("text_b"))

    def make():
        memory: dict[int, np.ndarray] = {}

        def grams(names: list[int], column: pa.Array) -> dict[int, np.ndarray]:
            new = [i for i, c in enumerate(names) if c not in memory]
            if len(memory) > 64:
                memory.clear()
                new = list(range(len(names)))
            new = list({names[i]: i for i in new}.values())
            found = shingles(*text_bytes(column.take(pa.array(new, pa.int64()))), like.size, like.lower)
            memory.update(zip((names[i] for i in new), found, strict=True))
            return memory

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            na, nb = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            left = dict(grams(na, batch.column("text")))
            right = grams(nb, batch.column("text_b"))
            fine = [like.linked(len(left[x]), len(right[y]), shared(left[x], right[y]))
                    for x, y in zip(na, nb, strict=True)]
            return batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))
        return work

    both = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text", "text_b")
    return mapped(both, make, "a long, b long")


def classed_texts(docs: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """c, text: one text of each wanted class. wanted: c, doc_id."""
    found = id_and_text(docs).join(wanted, "doc_id")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cs = batch.column("c").to_pylist()
            grams = shingles(*text_bytes(batch.column("text")), like.size, like.lower)
            fine = [class_id(g) == c for g, c in zip(grams, cs, strict=True)]
            return batch.select(["c", "text"]).filter(pa.array(fine, pa.bool_()))
        return work

    # a doc_id may have rows with other texts, and a class several rows
    return mapped(found.select("c", "text"), make, "c long, text string").dropDuplicates(["c"])


def classes_from(every: DataFrame) -> DataFrame:
    """c, doc (the smallest doc_id), n, sketch (and slack) of each class of equal sets but the empty one."""
    return stored(every.filter("c <> 0").groupBy("c").agg(
        F.min("doc_id").alias("doc"), F.first("n_shingles").alias("n"),
        *(F.first(x).alias(x) for x in ("sketch", "slack") if x in every.columns)), "classes")


def checker(docs: DataFrame, classes: DataFrame, like: Likeness) -> tuple[
        Callable[[DataFrame], DataFrame], Callable[[DataFrame], DataFrame]]:
    """A function from pairs of classes to the linked ones, and one from classes (c) to their texts."""

    def texts_of(wanted: DataFrame) -> DataFrame:
        named = wanted.join(classes.filter("doc is not null"), "c").select("c", F.col("doc").alias("doc_id"))
        return stored(classed_texts(docs, named, like), "texts")

    def check(candidates: DataFrame) -> DataFrame:
        candidates = stored(near(candidates, classes, like), "near")
        if candidates.isEmpty():
            return candidates
        nodes = candidates.select(F.col("a").alias("c")).union(candidates.select("b")).distinct()
        return stored(verified(candidates, texts_of(nodes), like), "links")

    return check, texts_of


def classes_of(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """Every document with its class, and its class's label after linking.

    (doc_id, n_shingles, c) and (c, label, doc): ``label`` names the component, ``doc`` is the
    smallest doc_id of the class."""
    every = stored(sets(docs, like, slacks=True), "sets")
    classes = classes_from(every)
    check, texts_of = checker(docs, classes, like)
    labels = linked_through(*key_pairs(keys(docs, like), fewer=True), check, texts_of, like,
                            classes.select("c", "slack"))
    named = (classes.join(labels, classes.c == labels.node, "left")
             .select("c", "doc", F.coalesce("label", "c").alias("label")))
    return every.drop("sketch", "slack"), named


def joined(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    every, named = classes_of(docs, like)
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    by_class = named.join(least, "label").select("c", "component_id")
    return (every.join(by_class, "c", "left")
            .select("doc_id", "n_shingles",
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The document with the smallest id of each component, with all its columns. Documents without words
    stay, and rows without an id. Rows that share a doc_id are told apart by their texts; of those with one
    text, too, one stays."""
    every, named = classes_of(docs, like)
    rows = (every.filter("doc_id is not null").join(named.select("c", "label"), "c")
            .select("label", F.struct("doc_id", "c", "t").alias("row")))
    lost = (rows.join(rows.groupBy("label").agg(F.min("row").alias("first")), "label")
            .filter("row <> first").select("row.doc_id", "row.t").distinct())
    lead = "_" * max(map(len, docs.columns))  # longer than any name of theirs
    key, name = f"{lead}id", f"{lead}t"
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), name: text_name("text")})
    kept = marked.join(lost.toDF(key, name), [key, name], "left_anti")
    return (kept.filter(F.col(key).isNotNull()).dropDuplicates([key, name])
            .unionByName(kept.filter(F.col(key).isNull()).dropDuplicates()).select(*docs.columns))
