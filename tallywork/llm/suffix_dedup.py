"""Exact substring dedup over suffix order.

Goal: every byte that lies in a string of LENGTH bytes which also starts elsewhere in the corpus. With
the suffixes sorted by their first LENGTH bytes (ties by position), the previous smaller position of
a suffix is its left neighbour if that has the same LENGTH bytes: then the longest previous factor
reaches LENGTH, and the string has an earlier copy. The next neighbour tells of a later copy.

One suffix array over the corpus would be one task, so suffixes are brought together by content.
Each string of LENGTH bytes names its anchor: its GRAM bytes with the smallest hash (the last among
equals). Equal strings have equal anchors at equal places, and neighbouring strings share one, so
there is one row for about 75 strings. Rows whose anchor occurs once drop out; rows with equal
bytes all around stand for each other; the bytes of the others are fetched and put into suffix
order, a block at a time. Where one anchor has more rows than a block, strings that had no equal in
their block are compared by hash across blocks. Anchors and strings compare by 64-bit hashes, within
an anchor.

A row is known by its doc_id and a 64-bit hash of its text, so rows that share a doc_id are told apart;
equal rows are found by a 128-bit digest.
A run of one byte has equal strings all along; it is one row with the number of its strings.

``keep_first``: the copy with the smallest (doc_id, hash of the text, position) stays. Results: null and empty
texts have no strings; equal rows are copies of each other (``removal_digests`` takes the bytes of
all, ``deduplicated`` leaves one as it is and empties the others, but for texts under LENGTH bytes);
rows without a doc_id come first in order; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import cut, id_and_text, let_workers_import, record, stored, text_bytes
from tallywork.llm.words import BASE_INVERSE, U, mix, powers, running_hash, span_hash

LENGTH, GRAM = 200, 48
#: Rows whose bytes are sorted at once (about 270 bytes each).
BLOCK = 6000
#: Strings of one text whose anchors are looked for at once.
STRETCH = 1 << 20
#: Columns of a stretch of strings; ``at`` holds its first string, how often it is repeated right
#: after itself (23 bits) and its number of strings (9 bits).
ROW = ["h", "c", "doc_id", "t", "at"]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (the last among equals) of each window."""
    n = len(values)
    blocks = -(-n // width)
    place = np.arange(blocks * width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = values
    # minima from each block's start and to its end, then of two parts per window
    rows = full.reshape(blocks, width)
    head = np.minimum.accumulate(rows, 1)
    tail = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1]
    at = place.reshape(blocks, width)
    head_at = np.maximum.accumulate(np.where(rows == head, at, -1), 1).ravel()
    is_tail = rows == tail
    # the last place that holds the tail minimum: constant while the minimum is
    tail_at = np.where(is_tail, at, -1)[:, ::-1]
    fresh = is_tail[:, ::-1] & (np.concatenate(
        [np.ones((blocks, 1), bool), tail[:, ::-1][:, 1:] < tail[:, ::-1][:, :-1]], 1))
    step = np.maximum.accumulate(np.where(fresh, np.arange(width)[None, :], 0), 1)
    tail_at = np.take_along_axis(tail_at, step, 1)[:, ::-1].ravel()
    head, tail = head.ravel(), tail.ravel()
    lo = np.arange(n - width + 1)
    hi = lo + width - 1
    return np.where(head[hi] <= tail[lo], head_at[hi], tail_at[lo])


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text, for each run of neighbouring strings with one anchor: the anchor's hash, the
    hash of all bytes of the run (and its shape), the first string, the number of strings, and how
    many such runs follow each other (over 1 only for equal strings, one after the other)."""
    count = len(data) - LENGTH + 1
    if count <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    sums = running_hash(data)
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(BASE_INVERSE, len(sums))[:len(sums) - GRAM])
    width = LENGTH - GRAM + 1
    where = np.concatenate([lo + sliding_argmin(gram[lo:min(lo + STRETCH, count) + width - 1], width)
                            for lo in range(0, count, STRETCH)])
    first = np.concatenate(([0], np.flatnonzero(where[1:] != where[:-1]) + 1))
    runs = np.diff(np.append(first, count))
    anchor = where[first]
    around = span_hash(sums, first, first + runs - 1 + LENGTH)
    shape = (anchor - first).astype(np.uint64) * U(1 << 20) + runs.astype(np.uint64)
    h, c = gram[anchor], mix(around ^ mix(shape))
    again = (runs[1:] == 1) & (runs[:-1] == 1) & (h[1:] == h[:-1]) & (c[1:] == c[:-1])
    again &= np.arange(1, len(h)) % (1 << 22) != 0  # the number has 23 bits
    head = np.flatnonzero(np.concatenate(([True], ~again)))
    return h[head], c[head], first[head], runs[head], np.diff(np.append(head, len(h)))


def anchors(docs: DataFrame) -> DataFrame:
    """The rows of all texts (``doc_id``, ``t``, ``text``): h, c (anchor, bytes around), doc_id, t, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                data, at = text_bytes(batch.column("text"))
                hs, cs, ids, firsts = [], [], [], []
                for d in range(batch.num_rows):
                    h, c, first, many, times = anchors_of(data[at[d]:at[d + 1]])
                    hs.append(h)
                    cs.append(c)
                    ids.append(np.full(len(h), d))
                    firsts.append((first << 32) | (times << 9) | many)
                of = pa.array(np.concatenate(ids))
                yield record(h=np.concatenate(hs).view(np.int64), c=np.concatenate(cs).view(np.int64),
                             doc_id=batch.column("doc_id").take(of), t=batch.column("t").take(of),
                             at=np.concatenate(firsts))

    let_workers_import(docs.sparkSession)
    return docs.mapInArrow(run, "h long, c long, doc_id long, t long, at long")


def marked_stream(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, c, doc_id, t, at), those whose h occurs more than once, with ``later``
    (an earlier row has the same bytes around) and ``copied`` (any other row has, or a repetition). An anchor's rows
    are held until all are here, or ``most``: then only the last ones stay back."""
    held: pa.RecordBatch | None = None
    begun: tuple[int, int] | None = None  # (h, c) of the last row given, if its anchor goes on

    def marked(batch: pa.RecordBatch, goes_on: bool) -> pa.RecordBatch:
        h, c = (batch.column(x).to_numpy() for x in ("h", "c"))
        same_h = h[1:] == h[:-1]
        same_c = same_h & (c[1:] == c[:-1])
        inside = np.array([begun is not None and begun[0] == h[0]])
        again = inside & np.array([begun is not None and begun[1] == c[0]])
        end = np.array([goes_on])
        repeated = (batch.column("at").to_numpy() >> 9) & 0x7FFFFF > 1
        wanted = np.concatenate((inside, same_h)) | np.concatenate((same_h, end)) | repeated
        later = np.concatenate((again, same_c))
        copied = later | np.concatenate((same_c, [False])) | repeated
        return pa.RecordBatch.from_arrays(
            [*(batch.column(x) for x in ROW), pa.array(later), pa.array(copied)],
            [*ROW, "later", "copied"]).filter(pa.array(wanted))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        h, c = (batch.column(x).to_numpy() for x in ("h", "c"))
        last = int(np.searchsorted(h, h[-1]))
        if last:
            yield marked(batch.slice(0, last), False)
            held, begun = batch.slice(last), None
        elif batch.num_rows < most:
            held = batch
        else:
            # back to where the last equal bytes begin, or all but one row of them
            last = int(np.searchsorted(c, c[-1])) or batch.num_rows - 1
            yield marked(batch.slice(0, last), True)
            held, begun = batch.slice(last), (int(h[last - 1]), int(c[last - 1]))
    if held is not None and held.num_rows:
        yield marked(held, False)


def shared_anchors(rows: DataFrame) -> DataFrame:
    """The rows of anchors that occur more than once, marked; tasks stream over 40-byte rows."""
    dealt = rows.repartition("h").sortWithinPartitions(
        "h", "c", F.col("doc_id").asc_nulls_first(), "t", "at")
    return dealt.mapInArrow(marked_stream, "h long, c long, doc_id long, t long, at long, "
                                           "later boolean, copied boolean")


def suffix_classes(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` bytes: prefix doubling, eight bytes first."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    value = np.zeros(n, np.uint64)
    for k in range(8):
        value = (value << U(8)) | padded[k:k + n].astype(np.uint64)
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    have = 8
    while have < depth:
        step = min(have, depth - have)
        after = np.concatenate((rank[step:], np.full(step, -1)))
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


def factor_marks(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the strings at ``starts`` (ascending): whether an earlier, and whether a later one is equal.

    In suffix order with ties by position, the previous smaller position is the left neighbour and
    its common prefix reaches LENGTH when both have one rank: the longest previous factor."""
    rank = suffix_classes(data)[starts]
    order = np.lexsort((starts, rank))
    same = rank[order][1:] == rank[order][:-1]
    earlier, later = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
    earlier[order[1:]] = same
    later[order[:-1]] = same
    return earlier, later


def spans_of(marks: np.ndarray) -> list[int]:
    """First string and number of strings of each marked stretch, one after the other."""
    edge = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return np.stack((lo, hi - lo), 1).ravel().tolist()


def compared(rows: DataFrame, block: int) -> DataFrame:
    """h, c, doc_id, t, at, earlier, later, more: for each row of bytes, the stretches of strings with an
    equal before or after it; ``more``: hashes of strings, where the anchor has other blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        begun: int | None = None  # an anchor whose first rows were in an earlier block

        def flush(rows: list[tuple], split: int | None) -> pa.RecordBatch:
            rows = sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[4]))
            lengths = np.array([len(r[5]) for r in rows])
            data = np.frombuffer(b"".join(r[5] for r in rows), np.uint8)
            base = np.cumsum(lengths) - lengths
            many = lengths - LENGTH + 1
            at = np.cumsum(many) - many
            starts = np.repeat(base - at, many) + np.arange(many.sum())
            early, late = factor_marks(data, starts)
            sums = running_hash(data)
            out = []
            for i, r in enumerate(rows):
                lo, hi = int(at[i]), int(at[i] + many[i])
                more = None
                if r[0] in (split, begun):
                    more = span_hash(sums, starts[lo:hi], starts[lo:hi] + LENGTH).view(np.int64).tolist()
                out.append((*r[:5], spans_of(early[lo:hi]), spans_of(late[lo:hi]), more))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [
                    pa.int64()] * 5 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64())], strict=True)],
                [*ROW, "earlier", "later", "more"])

        for batch in batches:
            for r in zip(*(batch.column(x).to_pylist() for x in (*ROW, "around")), strict=True):
                if len(held) >= block:
                    split = r[0] if held[-1][0] == r[0] else None
                    yield flush(held, split)
                    begun, held = split, []
                held.append(r)
        if held:
            yield flush(held, None)

    dealt = rows.repartition("h").sortWithinPartitions("h", "c")
    return dealt.mapInArrow(run, "h long, c long, doc_id long, t long, at long, earlier array<int>, "
                            "later array<int>, more array<long>")


def repeated_strings(docs: DataFrame, keep_first: bool, block: int = BLOCK) -> DataFrame:
    """Of rows (``doc_id``, ``t``, ``text``): doc_id, t, spans: [first string, number of strings] with an
    equal elsewhere (``keep_first``: before it; then no two rows share doc_id and t)."""
    found = stored(shared_anchors(anchors(docs)), "anchors")
    several = (found.filter("not later").groupBy("h").agg(F.count("*").alias("kinds"))
               .filter("kinds > 1").select("h"))
    firsts = found.filter("not later").join(several, "h", "left_semi")
    wanted = (firsts.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "c", "at")).alias("rows"))
              .withColumnsRenamed({"doc_id": "wanted", "t": "wanted_t"}))
    fetched = (docs.join(wanted, docs.doc_id.eqNullSafe(wanted.wanted) & (docs.t == wanted.wanted_t))
               .select("doc_id", "t", "text", "rows"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                out = []
                for doc_id, t, text, rows in zip(
                        batch.column("doc_id").to_pylist(), batch.column("t").to_pylist(),
                        batch.column("text"), batch.column("rows").to_pylist(), strict=True):
                    raw = text.as_py().encode()
                    for r in rows:
                        first, many = r["at"] >> 32, r["at"] & 511
                        around = raw[first:first + many - 1 + LENGTH]
                        if len(around) == many - 1 + LENGTH:
                            out.append((r["h"], r["c"], doc_id, t, r["at"], around))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out, strict=True),
                                                        [pa.int64()] * 5 + [pa.binary()], strict=True)],
                        [*ROW, "around"])

    bytes_of = fetched.mapInArrow(fetch, "h long, c long, doc_id long, t long, at long, around binary")
    results = stored(compared(bytes_of, block), "suffixes")
    # strings of anchors with several blocks, across the blocks
    across = results.filter("more is not null").select(
        *ROW, F.posexplode("more").alias("k", "w"))
    order = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("d"), "t",
                     (F.shiftright("at", 32) + F.col("k")).alias("p"))
    counts = (across.groupBy("h", "w").agg(F.min(order).alias("first"), F.max(order).alias("last"))
              .filter("first <> last"))
    hits = across.join(counts, ["h", "w"])
    if keep_first:
        hits = hits.filter(order != F.col("first"))
    hits = hits.groupBy("h", "c").agg(F.flatten(F.collect_list(F.array(
        F.col("k"), F.lit(1)))).alias("cross"))
    empty = F.array().cast("array<int>")
    own = results.select("h", "c", (F.col("earlier") if keep_first else F.concat("earlier", "later"))
                         .alias("own")).join(hits, ["h", "c"], "left")
    own = own.select("h", "c", F.concat("own", F.coalesce("cross", empty)).alias("part"))
    # copies: all strings of the run; the first of them as well unless it is kept
    first, many = F.shiftright("at", 32).cast("int"), F.col("at").bitwiseAND(511).cast("int")
    times = F.shiftright("at", 9).bitwiseAND(0x7FFFFF).cast("int")
    whole = F.array(F.lit(0), F.when(times > 1, times).otherwise(many))
    full = F.col("later") if keep_first else F.col("copied")
    all_of = found.filter(full).select("doc_id", "t", first.alias("first"), whole.alias("part"))
    rest = found.filter(~full)
    some = (rest.join(own, ["h", "c"]).filter(F.size("part") > 0)
            .select("doc_id", "t", first.alias("first"), "part"))
    repeats = rest.filter(times > 1).select("doc_id", "t", first.alias("first"),
                                            F.array(F.lit(1), times - 1).alias("part"))
    return (all_of.unionByName(some).unionByName(repeats).groupBy("doc_id", "t")
            .agg(F.collect_list(F.struct("first", "part")).alias("spans")))


def covered(size: int, spans: pa.StructArray | None) -> list[tuple[int, int]]:
    """The maximal stretches of bytes that marked strings (``first``, ``part``) cover."""
    if spans is None or not len(spans):
        return []
    part = spans.field("part")
    flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.diff(part.offsets.to_numpy()) // 2
    lo = flat[::2] + np.repeat(spans.field("first").to_numpy(zero_copy_only=False), pairs)
    hi = lo + flat[1::2] - 1 + LENGTH
    fits = hi <= size
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, lo[fits], 1)
    np.add.at(edge, hi[fits], -1)
    flips = np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(flips == 1).tolist(), np.flatnonzero(flips == -1).tolist(),
                    strict=True))


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the parts of characters at their ends."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def removal_digests(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 when every copy goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                rows = []
                for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                    raw = text.as_py().encode()
                    gone = covered(len(raw), spans.values)
                    rest = without(raw, gone)
                    rows.append((len(raw), len(raw) - len(rest), len(gone),
                                 hashlib.sha256(rest).hexdigest()))
                cols = list(zip(*rows, strict=True))
                yield record(doc_id=batch.column("doc_id"), n_bytes=pa.array(cols[0], pa.int64()),
                             n_removed=pa.array(cols[1], pa.int64()),
                             n_spans=pa.array(cols[2], pa.int64()), kept_sha256=pa.array(cols[3]))

    rows = id_and_text(docs).withColumn("t", F.xxhash64("text"))
    spans = repeated_strings(rows, False, block).withColumnsRenamed({"doc_id": "marked", "t": "marked_t"})
    found = rows.join(spans, rows.doc_id.eqNullSafe(spans.marked) & (rows.t == spans.marked_t), "left")
    return found.select("doc_id", "text", "spans").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def one_of_equals(docs: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` with one of those equal in ``key`` and ``name``, and the others. Only
    rows that have equals are written, to be numbered; the rest are not shuffled where those are few."""
    one = "_" * (1 + max(map(len, docs.columns)))  # longer than any name of theirs
    counts = docs.groupBy(key, name).agg(F.count("*").alias(one)).filter(F.col(one) > 1)
    several = stored(counts.select(F.col(key).alias(f"{one}k"), F.col(name).alias(f"{one}n")), "equals")
    same = F.col(key).eqNullSafe(F.col(f"{one}k")) & (F.col(name) == F.col(f"{one}n"))
    equals = stored(docs.join(several, same, "left_semi")
                    .withColumn(one, F.monotonically_increasing_id()), "equal-rows")
    least = equals.groupBy(key, name).agg(F.min(one).alias(one)).select(F.col(one).alias(f"{one}k"))
    kept = F.col(one) == F.col(f"{one}k")
    firsts = docs.join(several, same, "left_anti").unionByName(
        equals.join(least, kept, "left_semi").drop(one))
    return firsts, equals.join(least, kept, "left_anti").drop(one)


def deduplicated(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents with later copies cut out of their texts and the first kept; n_chars, where
    there is one, follows. Other columns stay as they are."""
    names = docs.columns
    lead = "_" * max(map(len, names))  # longer than any name of theirs
    key, name, mark, cuts = (f"{lead}{x}" for x in ("key", "name", "mark", "cuts"))
    marked = docs.withColumns({key: F.col("doc_id").cast("long"),
                               name: F.unhex(F.md5(F.coalesce("text", F.lit(""))))})
    firsts, others = one_of_equals(marked, key, name)
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = firsts.select(F.col(key).alias("doc_id"), t.alias("t"),
                         F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_strings(rows, True, block).toDF(mark, f"{mark}t", cuts)
    joined = firsts.join(spans, F.col(key).eqNullSafe(F.col(mark)) & (t == F.col(f"{mark}t")),
                         "left").select(*names, cuts)
    text_at, spans_at = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                texts = []
                for text, gone in zip(batch.column(text_at), batch.column(spans_at), strict=True):
                    if gone.values is None:
                        texts.append(text.as_py())
                    else:
                        raw = (text.as_py() or "").encode()
                        texts.append(without(raw, whole_characters(raw, covered(len(raw), gone.values)))
                                     .decode())
                columns = [pa.array(texts, pa.string()) if i == text_at else batch.column(i)
                           for i in range(spans_at)]
                yield pa.RecordBatch.from_arrays(columns, names)

    # an equal of a kept row is a copy from end to end
    emptied = others.select(*names).withColumn(
        "text", F.when(F.octet_length("text") >= LENGTH, "").otherwise(F.col("text")))
    out = joined.mapInArrow(run, docs.schema).unionByName(emptied)
    if "n_chars" in names:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out
