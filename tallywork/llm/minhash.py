"""Document fingerprints by MinHash.

A fingerprint is the smallest value of each of PERMUTATIONS universal hash functions over a text's
word shingles; the share of equal places of two fingerprints estimates the Jaccard likeness of the
shingle sets. ``near_duplicates`` joins signature bands in Spark and checks each candidate's exact
Jaccard likeness.

Results: a text without words has the fingerprint of the empty set (all f); two of those are alike
(1.0). Null text is empty text. Repeated rows are kept, each with its own neighbour. Rows without a
doc_id come last in descending order. A single row's next document is itself. Further columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.linking import key_pairs, linked_through
from tallywork.llm.likeness import Likeness
from tallywork.llm.parity_join import class_id, classed_texts, verified
from tallywork.llm.tables import (
    id_and_text,
    let_workers_import,
    mapped,
    record,
    stored,
    text_bytes,
)
from tallywork.llm.words import U, mix, shingles

PERMUTATIONS, BAND_ROWS, WORDS = 128, 4, 5
_rng = np.random.default_rng(128)
FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * U(2) + U(1)
OFFSETS = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
EMPTY = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)


def signature(grams: np.ndarray) -> np.ndarray:
    """The minima of (a x + b) mod 2**64 / 2**32 for every a, b, a block of shingles at a time."""
    best = EMPTY
    for lo in range(0, len(grams), 2048):
        block = grams[None, lo:lo + 2048] * FACTORS[:, None] + OFFSETS[:, None]
        best = np.minimum(best, (block.min(1) >> U(32)).astype(np.uint32))
    return best


def signatures(texts: list[str]) -> list[np.ndarray]:
    data, at = text_bytes(pa.array(texts, pa.large_string()))
    return [signature(g) for g in shingles(data, at, WORDS)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(one: np.ndarray) -> str:
    return one.astype(">u4").tobytes().hex()


def edited_text(text: str, following: str) -> str:
    """The second half (rounded down) gives way to as much of the next document's beginning."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, place, guest: every row in the slice of the id range it belongs to; the highest
    row of a slice also, as a guest, in the slice above it, where it follows the lowest row (the
    highest of all follows the lowest of all). Only the slices' bounds and highest ids are known to
    the driver: a few numbers for each partition."""
    spark = docs.sparkSession
    rows = id_and_text(docs)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions")) if str(
        spark.conf.get("spark.sql.shuffle.partitions")).isdigit() else 200
    cuts = rows.agg(F.percentile_approx("doc_id", [k / slices for k in range(1, slices)], 10_000)
                    if slices > 1 else F.lit(None)).first()[0] or []
    cuts = sorted(set(cuts))
    # rows without an id lie below all
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<bigint>"),
                        lambda c: c < F.col("doc_id"))))
    rows = rows.withColumn("place", place.cast("int"))
    order = F.struct(F.col("doc_id"), F.md5("text").alias("m"))
    tops = {r.place: r.top for r in rows.groupBy("place").agg(F.max(order).alias("top")).collect()}
    used = sorted(tops)
    above = {p: (used[i + 1] if i + 1 < len(used) else used[0]) for i, p in enumerate(used)}
    pairs = [(p, above[p], tops[p].doc_id, tops[p].m) for p in used]
    if not pairs:
        return rows.withColumn("guest", F.lit(False))
    wanted = spark.createDataFrame(pairs, "place int, goes int, top long, m string")
    guests = (rows.withColumn("m", F.md5("text")).join(
        F.broadcast(wanted), (rows.place == wanted.place) & rows.doc_id.eqNullSafe(wanted.top)
        & (F.md5(rows.text) == wanted.m))
        .groupBy("goes").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
        .select("doc_id", "text", F.col("goes").alias("place"), F.lit(True).alias("guest")))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple[int | None, str] | None = None
        place = None
        for batch in batches:
            rows = []  # (doc_id, text, next text)
            columns = zip(batch.column("doc_id").to_pylist(), batch.column("text"),
                          batch.column("place").to_pylist(), batch.column("guest").to_pylist(),
                          strict=True)
            for doc_id, text, here, guest in columns:
                text = text.as_py()
                if here == place and waiting is not None:
                    rows.append((*waiting, text))
                waiting, place = (None if guest else (doc_id, text)), here
                if rows and (len(rows) >= 256 or len(text) > 1 << 20):
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def made(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        edited = [edited_text(text, after) for _, text, after in rows]
        own, other = signatures([r[1] for r in rows]), signatures(edited)
        after = [*own[1:], None]
        for i, (_, _, text) in enumerate(rows):
            if i + 1 == len(rows) or text != rows[i + 1][1]:
                after[i] = signatures([text])[0]
        return record(
            doc_id=pa.array([r[0] for r in rows], pa.int64()),
            n_chars=pa.array([len(r[1]) for r in rows], pa.int64()),
            edited_sha256=[hashlib.sha256(t.encode()).hexdigest() for t in edited],
            fingerprint=[hexed(x) for x in own], edited_fingerprint=[hexed(x) for x in other],
            near_edited=[likeness(x, y) for x, y in zip(own, other, strict=True)],
            near_next=[likeness(x, y) for x, y in zip(own, after, strict=True)])

    let_workers_import(docs.sparkSession)
    dealt = (placed(docs).repartition("place")
             .sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(),
                                   F.md5("text").desc()))
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                            "edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, per_cent: int = 80) -> DataFrame:
    """doc_id, component_id: documents linked by shared signature bands and, checked on the exact
    sets, a Jaccard likeness of ``per_cent`` or more over five-word shingles."""
    like = Likeness(WORDS, per_cent, lower=False)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, cs, keys = batch.column("doc_id"), [], []
            for grams in shingles(*text_bytes(batch.column("text")), WORDS):
                cs.append(class_id(grams))
                bands = signature(grams).reshape(-1, BAND_ROWS).astype(np.uint64)
                mixed = mix((bands * FACTORS[:BAND_ROWS]).sum(1, dtype=np.uint64)
                            + np.arange(len(bands), dtype=np.uint64))
                keys.append(mixed.view(np.int64).tolist() if len(grams) else [])
            return record(doc_id=ids, c=pa.array(cs, pa.int64()),
                          keys=pa.array(keys, pa.list_(pa.int64())))
        return work

    every = stored(mapped(id_and_text(docs), make, "doc_id long, c long, keys array<long>"), "minhash")
    classes = every.filter("c <> 0").groupBy("c").agg(F.min("doc_id").alias("doc"))
    one = every.filter("c <> 0").groupBy("c").agg(F.first("keys").alias("keys"))
    pairs, large = key_pairs(one.select(F.explode("keys").alias("k"), "c"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        named = wanted.join(classes.filter("doc is not null"), "c").select("c", F.col("doc").alias("doc_id"))
        return stored(classed_texts(docs, named, like), "texts")

    def check(candidates: DataFrame) -> DataFrame:
        candidates = stored(candidates, "near")
        nodes = candidates.select(F.col("a").alias("c")).union(candidates.select("b")).distinct()
        return stored(verified(candidates, texts_of(nodes), like), "links")

    labels = linked_through(pairs, large, check, texts_of, like)
    named = (classes.join(labels, classes.c == labels.node, "left")
             .select("c", "doc", F.coalesce("label", "c").alias("label")))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    return (every.join(named.join(least, "label").select("c", "component_id"), "c", "left")
            .select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id")))
