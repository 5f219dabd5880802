"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes; where its upper bits are zero a chunk ends. Bounds depend on
the last 16 bytes alone, so an insertion moves the bounds near it and no others, and the same passage
is cut alike wherever it stands, but for its first bytes. Chunks are compared by digest; of equal chunks the first (smallest
doc_id, then position) stays. Only runs of repeated chunks of MIN_RUN bytes or more count, so short
phrases that texts happen to share are left alone.

Results: null and empty texts have no chunks; repeated rows are copies like others (of rows that
share a doc_id and place, one is the first); rows without a doc_id come first in order; further
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import cut, id_and_text, let_workers_import, record, text_bytes
from tallywork.llm.words import U, mix, running_hash, span_hash

GEAR = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
#: Mean chunk 2**CHUNK_BITS bytes; no chunk is longer than LONGEST.
CHUNK_BITS, LONGEST, MIN_RUN = 5, 1024, 160


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i - j]] << j for j < 16, in four doublings."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        if k < len(h):
            shifted = h[:-k] << U(k)
            h = h.copy()
            h[k:] += shifted
    return h


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Where the chunks of one text end; the last one ends with the text."""
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(gear_hash(data) >> U(64 - CHUNK_BITS) == 0) + 1
    ends = np.unique(np.append(ends, len(data)))
    # a run without any bound is cut at even steps from its own beginning
    gaps = np.diff(ends, prepend=0)
    if (gaps > LONGEST).any():
        more = [np.arange(e - g + LONGEST, e, LONGEST)
                for e, g in zip(ends.tolist(), gaps.tolist(), strict=True) if g > LONGEST]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks_of(docs: DataFrame) -> DataFrame:
    """doc_id, start, digest of every chunk."""

    def run(batches):
        for whole in batches:
            for batch in cut(whole):
                data, at = text_bytes(batch.column("text"))
                sums = running_hash(data)
                ids, starts, ends, digests = [], [], [], []
                for d in range(batch.num_rows):
                    lo, hi = int(at[d]), int(at[d + 1])
                    end = chunk_ends(data[lo:hi]) + lo
                    start = np.concatenate(([lo], end[:-1])) if len(end) else end
                    ids.append(np.full(len(end), d))
                    starts.append(start - lo)
                    digests.append(mix(span_hash(sums, start, end)).view(np.int64))
                if ids:
                    yield record(doc_id=batch.column("doc_id").take(pa.array(np.concatenate(ids))),
                                 start=pa.array(np.concatenate(starts), pa.int32()),
                                 digest=np.concatenate(digests))

    let_workers_import(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, start int, digest long")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, starts: where the chunks begin that an earlier chunk repeats. Digests are counted
    before they are shuffled; of a frequent one a task gives one row. The join is an ordinary one
    whose large partitions Spark splits."""
    chunks = chunks_of(docs)
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.col("start").alias("s"))
    firsts = (chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first"))
              .filter("n > 1").select("digest", "first"))
    later = chunks.join(firsts, "digest").filter(place != F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))


def runs(data: np.ndarray, starts: list[int] | None) -> list[tuple[int, int]]:
    """The spans of a text that go: neighbouring repeated chunks of MIN_RUN bytes together."""
    if not starts:
        return []
    end = chunk_ends(data)
    begin = np.concatenate(([0], end[:-1]))
    mark = np.isin(begin, np.array(starts))
    edge = np.diff(np.concatenate(([0], mark.astype(np.int8), [0])))
    lo, hi = begin[np.flatnonzero(edge == 1)], end[np.flatnonzero(edge == -1) - 1]
    spans = []
    for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
        # never part of a character
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if b - a >= MIN_RUN:
            spans.append((a, b))
    return spans


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the remaining text) of every document."""

    def run(batches):
        for whole in batches:
            for batch in cut(whole):
                out = []
                for text, starts in zip(batch.column("text"), batch.column("starts").to_pylist(),
                                        strict=True):
                    raw = text.as_py().encode()
                    spans = runs(np.frombuffer(raw, np.uint8), starts)
                    kept, at = [], 0
                    for a, b in spans:
                        kept.append(raw[at:a])
                        at = b
                    rest = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(rest), len(spans),
                                hashlib.sha256(rest).hexdigest(), rest.decode()))
                cols = list(zip(*out, strict=True))
                yield record(doc_id=batch.column("doc_id"),
                             **{k: pa.array(cols[i], pa.int64()) for i, k in enumerate(
                                 ("n_bytes", "n_removed", "n_spans"))},
                             kept_sha256=pa.array(cols[3]),
                             **({"text": pa.array(cols[4])} if with_text else {}))

    marks = repeated(docs).withColumnRenamed("doc_id", "marked")
    rows = id_and_text(docs)
    found = rows.join(marks, rows.doc_id.eqNullSafe(marks.marked), "left")
    return found.select("doc_id", "text", "starts").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
        + ", text string" * with_text)
