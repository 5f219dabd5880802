"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The fit list is every distinct vector once, in whole numbers of 1/256. It is stored as blocks of
rows, and V Q is one pass over it: each task adds up Xc^T (Xc Q) of its blocks (Xc: centred rows), Spark adds up
the tasks entry by entry. Only d x k sums reach the driver. A step of the iteration is a Chebyshev polynomial
in V, which damps the spectrum from 0 to the smallest Ritz value and lifts what lies above, then QR
and Rayleigh-Ritz. It ends when the residuals of the wanted components have reached the floor of double
precision; ``identity_error`` is measured on the whitened fit list itself.

Results: rows whose vector is null or holds a null or non-finite entry are left out; a vector shorter
than the longest (an empty one too) counts as zero beyond its end; entries outside of +-2**23 count as the
bound; repeated rows are each returned, and count once in the fit. Ties between eigenvalues: any basis of
their space, the same for all rows. Components without variance are not given, so an empty table,
and one whose rows are all equal, has none and gives no rows. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import let_workers_import, record, stored

#: Components asked for, and how many more the iterated space has.
WANTED, GUARD = 4, 28
#: Bytes of a block of the fit list.
BLOCK_BYTES = 1 << 20
#: A step lifts no direction by more than this, so the others keep their digits.
MOST_LIFT, MOST_DEGREE, MOST_STEPS = 1e8, 12, 500
FLOOR, SETTLED = 1e-13, 1e-10
LIMIT = (1 << 31) - 1


def numeric_rows(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector (doubles) of the rows without null and non-finite entries."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (embeddings.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))
            .filter(F.col("vector").isNotNull() & finite))


def whole_numbers(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 c) of a batch, one row per vector."""
    column = column.cast(pa.large_list(pa.float64()))
    at = np.asarray(column.offsets)
    flat = column.values.to_numpy(zero_copy_only=False)
    whole = np.clip(np.floor(256.0 * flat), -LIMIT, LIMIT).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    size = np.diff(at)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(at[0], at[-1]) - np.repeat(at[:-1], size)] = whole[at[0]:at[-1]]
    return out


def packed_rows(x: np.ndarray) -> list[bytes]:
    """Each row's bytes: two an entry where that does, else four. Equal rows have equal bytes."""
    small = (np.abs(x) < 1 << 15).all(1)
    short, long = x.astype("<i2"), x.astype("<i4")
    return [(short if s else long)[i].tobytes() for i, s in enumerate(small.tolist())]


def unpacked(raw: bytes, rows: int, width: int) -> np.ndarray:
    size = len(raw) // (rows * width)
    return np.frombuffer(raw, f"<i{size}").reshape(rows, width)


def fit_blocks(rows: DataFrame, width: int) -> DataFrame:
    """rows, block: the distinct vectors, many to a block. Tasks and Spark's partial distinct drop a
    frequent vector before it is shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record(x=pa.array(packed_rows(whole_numbers(batch.column("vector"), width)),
                                        pa.binary()))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for x in batch.column("x").to_pylist():
                own = held.setdefault(len(x), [])
                own.append(x)
                if len(own) * len(x) >= BLOCK_BYTES:
                    yield record(rows=[len(own)], block=pa.array([b"".join(own)], pa.binary()))
                    held[len(x)] = []
        for own in held.values():
            if own:
                yield record(rows=[len(own)], block=pa.array([b"".join(own)], pa.binary()))

    let_workers_import(rows.sparkSession)
    distinct = rows.select("vector").mapInArrow(pack, "x binary").distinct()
    return stored(distinct.mapInArrow(block, "rows long, block binary"), "whitening")


def added_up(blocks: DataFrame, width: int, work: Callable[[np.ndarray], np.ndarray],
             kind: str = "double") -> np.ndarray | None:
    """The sum of ``work(block)`` over all blocks, entry by entry: added up by task, then by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, raw in zip(batch.column("rows").to_pylist(), batch.column("block"), strict=True):
                part = work(unpacked(raw.as_py(), n, width)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield record(i=np.arange(len(total), dtype=np.int32), v=total)

    found = (blocks.mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect())
    if not found:
        return None
    out = np.zeros(len(found), np.float64 if kind == "double" else np.int64)
    for r in found:
        out[r.i] = r.v
    return out


@dataclass(frozen=True)
class Whitening:
    """n, the sums S, unit components by falling eigenvalue (columns), their eigenvalues, the trace
    of the covariance and what the whitened fit list's covariance is off the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int


def damped(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, values: np.ndarray,
           ) -> np.ndarray:
    """A Chebyshev polynomial of V on the columns of q: at most 1 from 0 to the smallest Ritz value,
    steeply growing above. vq is V q, which is known already."""
    edge = values[-1]
    top = float(np.arccosh(max(2 * values[0] / edge - 1, 1.0)))
    degree = MOST_DEGREE if top == 0 else int(np.clip(np.log(2 * MOST_LIFT) // top, 1, MOST_DEGREE))
    before, now = q, 2 / edge * vq - q
    for _ in range(degree - 1):
        scale = 1 / np.linalg.norm(now, axis=0)
        before, now = before * scale, now * scale
        before, now = now, 2 * (2 / edge * times(now) - now) - before
    return now


def fitted(blocks: DataFrame, width: int, wanted: int = WANTED, guard: int = GUARD) -> Whitening | None:
    """The whitening of the stored fit list; None without rows or variance."""
    first = added_up(blocks, width, lambda x: np.append(x.sum(0, dtype=np.int64), len(x)), "long")
    if first is None or width == 0:
        return None
    n, sums = int(first[-1]), first[:-1]
    mean = sums / n
    passes = 1

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)
        return added_up(blocks, width, work).reshape(q.shape) / n

    trace = float(added_up(blocks, width, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    passes += 1
    if not trace > 0:
        return None
    size = min(width, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((width, size)))[0]
    last = np.inf
    for _ in range(MOST_STEPS):
        vq = times(q)
        values, turn = np.linalg.eigh((q.T @ vq + vq.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        off = np.linalg.norm(vq - q * values, axis=0)[:wanted].max() / values[0]
        # the whole space, or all of what has variance, is already exact
        if off <= FLOOR or (off <= SETTLED and off > last / 2) or values[-1] <= FLOOR * values[0]:
            break
        last = off
        q = np.linalg.qr(damped(times, q, vq, values))[0]
    else:
        raise RuntimeError(f"the components are not certain after {passes} passes: residual {off:.1e}")
    kept = values[:wanted] > 1e-12 * values[0]
    values, parts = values[:wanted][kept], q[:, :wanted][:, kept]
    parts = parts * np.where(parts[np.abs(parts).argmax(0), np.arange(parts.shape[1])] < 0, -1.0, 1.0)
    scaled = parts / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ scaled
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    found = added_up(blocks, width, spread) / n
    p = len(values)
    around = found[p * p:]
    error = np.abs(found[:p * p].reshape(p, p) - np.outer(around, around) - np.eye(p)).max()
    return Whitening(n, sums, parts, values, trace, float(error), passes + 1)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """The sum over dimensions of (n x - S)^2, exact."""
    most = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if most ** 2 * max(x.shape[1], 1) < 1 << 63:
        return pa.array(((n * x - sums) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    wide = n * x.astype(object) - sums.astype(object)
    return pa.array([Decimal(int(v)) for v in (wide * wide).sum(1)], pa.decimal128(38, 0))


def whitened(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding",
             wanted: int = WANTED) -> DataFrame:
    """key, component (from 1), n, deviation (decimal), whitened, explained, identity_error: a row
    for each numeric row and component."""
    kind = embeddings.schema[key].dataType.simpleString()
    rows = numeric_rows(embeddings, key, vector)
    schema = (f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    model = fitted(fit_blocks(rows, width), width, wanted) if width else None
    if model is None:
        return embeddings.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    mean, scaled = model.sums / model.n, model.components / np.sqrt(model.values)
    share = model.values / model.trace
    p = len(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column("vector"), width)
            each = pa.array(np.repeat(np.arange(len(x)), p))
            yield record(
                key=batch.column("key").take(each),
                component=np.tile(np.arange(1, p + 1, dtype=np.int32), len(x)),
                n=np.full(len(x) * p, model.n, np.int64),
                deviation=deviations(x, model.n, model.sums).take(each),
                whitened=((x - mean) @ scaled).ravel(), explained=np.tile(share, len(x)),
                identity_error=np.full(len(x) * p, model.identity_error))

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
