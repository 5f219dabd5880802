"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text. A text is cut into
overlapping windows; a window that the toxic dictionary compresses to fewer bytes than the ordinary
one is closer to toxic text. The largest differences and their mean are turned into a score from 0 to
1 by a logistic threshold that is calibrated on labelled texts held back from the dictionaries.

Toxic texts are mostly ordinary words, so the toxic dictionary is trained on the stretches of them
that hold byte sequences much more frequent there than in ordinary text. Both sides compress with
the ordinary dictionary as well, so ordinary text costs about the same on either side.

The fit takes a bounded sample of labelled rows (SAMPLE_TOXIC, SAMPLE_ORDINARY, at most
SAMPLE_BYTES each): those with the smallest hashes of their ids. Scoring covers every window of every
text. Labels, language, source and id are no inputs of a score.

Results: null and empty texts get the score of a window without any difference; repeated rows are
scored each (a repeated label row counts once); without labels of both kinds every score is 0.
Further columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import id_and_text, mapped, record

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 1500, 3000, 16_000
WINDOW, STEP = 64, 32
TOXIC_BYTES, ORDINARY_BYTES = 2048, 8192
#: A sequence of GRAM bytes marks a stretch if it stands in MARK_TEXTS toxic texts at least, and
#: in MARK_RATIO times the share of toxic texts as of ordinary ones.
GRAM, MARK_TEXTS, MARK_RATIO = 6, 8, 20
#: What zstandard puts before a trained dictionary's content (entropy tables), at most.
TABLES = 800


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def windows(data: bytes) -> list[bytes]:
    if len(data) <= WINDOW:
        return [data]
    return [data[i:i + WINDOW] for i in range(0, len(data) - STEP, STEP)]


def grams(data: bytes) -> set[bytes]:
    low = data.lower()
    return {low[i:i + GRAM] for i in range(len(low) - GRAM + 1)}


def marked_stretches(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of the toxic texts whose sequences are rare in ordinary ones."""
    here, there = Counter(), Counter()
    for text in toxic:
        here.update(grams(text))
    for text in ordinary:
        there.update(grams(text))
    mark = {g for g, n in here.items() if n >= MARK_TEXTS
            and n * len(ordinary) > MARK_RATIO * (there[g] + 1) * len(toxic)}
    found = []
    for text in toxic:
        low, at = text.lower(), 0
        while at <= len(low) - GRAM:
            end = at
            while low[end:end + GRAM] in mark:
                end += 1
            if end > at:
                found.append(b" " + text[at:end + GRAM - 1] + b" ")
                at = end + GRAM - 1
            else:
                at += 1
    return found


def trained(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary's content; too few samples for its trainer are taken as they are."""
    try:
        data = zstd.train_dictionary(size, samples).as_bytes()
        return data[TABLES:] if len(data) > TABLES + 256 else data
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


@functools.lru_cache(maxsize=4)
def distances(toxic: bytes, ordinary: bytes):
    """A function from text bytes to the differences of all its windows."""
    settings = zstd.ZstdCompressionParameters.from_level(
        3, source_size=WINDOW, dict_size=len(toxic) + len(ordinary), min_match=4,
        strategy=zstd.STRATEGY_DFAST, write_content_size=False, write_dict_id=False)

    def length_with(content: bytes):
        pack = zstd.ZstdCompressor(compression_params=settings, dict_data=zstd.ZstdCompressionDict(
            content, dict_type=zstd.DICT_TYPE_RAWCONTENT)).compress
        return lambda window: len(pack(window))

    near = length_with(ordinary + toxic)
    # as many bytes as the other: a second copy of the ordinary dictionary's most used end
    far = length_with(ordinary + ordinary[-len(toxic):])
    return lambda data: np.array([far(w) - near(w) for w in windows(data)], np.float64)


def features(difference: np.ndarray) -> list[float]:
    top = np.sort(difference)[::-1][:3].tolist() + [0.0, 0.0]
    n = len(difference)
    return [top[0], top[1], top[2], float(difference.mean()),
            float((difference >= 4).sum()) / math.sqrt(n), math.log(n), 1.0]


def calibrated(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps, with a little ridge."""
    mean, scale = x.mean(0), x.std(0)
    mean[-1], scale[scale == 0], scale[-1] = 0, 1, 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (y - p) - 0.01 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w, mean, scale


def fitted(toxic: list[bytes], ordinary: list[bytes]) -> Model | None:
    """Two thirds of each kind train the dictionaries, the rest sets the threshold."""
    if len(toxic) < 3 or len(ordinary) < 3:
        return None
    a, b = len(toxic) * 2 // 3, len(ordinary) * 2 // 3
    stretches = marked_stretches(toxic[:a], ordinary[:b]) or toxic[:a]
    bad = trained(TOXIC_BYTES, stretches)
    plain = trained(ORDINARY_BYTES, [w for text in ordinary[:b] for w in windows(text)[::2]][:30_000])
    measure = distances(bad, plain)
    x = np.array([features(measure(t)) for t in [*toxic[a:], *ordinary[b:]]])
    y = np.array([1.0] * (len(toxic) - a) + [0.0] * (len(ordinary) - b))
    w, mean, scale = calibrated(x, y)
    return Model(bad, plain, tuple(w), tuple(mean), tuple(scale))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from labelled rows that are not held out. The sample's size is bounded whatever the
    tables' size: ids are chosen from the labels alone and only their texts are fetched."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
             .filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
             .withColumn("turn", F.xxhash64("doc_id")))
    chosen = None
    for kind, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY)):
        some = known.filter(F.col("toxic") == kind).orderBy("turn", "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows of three numbers: a proven bound
    rows = (id_and_text(docs).filter(F.octet_length("text").between(1, SAMPLE_BYTES))
            .join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "toxic", "turn").agg(F.min("text").alias("text"))
            .orderBy("turn", "doc_id").collect())
    texts = {kind: [r.text.encode() for r in rows if r.toxic == kind] for kind in (0, 1)}
    return fitted(texts[1], texts[0])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of every document."""

    def make():
        if model is None:
            return lambda batch: record(doc_id=batch.column("doc_id"),
                                        score=pa.array(np.zeros(batch.num_rows)))
        measure = distances(model.toxic, model.ordinary)
        w, mean, scale = (np.array(x) for x in (model.weights, model.means, model.scales))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(measure(t.as_py().encode())) for t in batch.column("text")])
            z = np.clip((x - mean) / scale @ w, -30, 30)
            return record(doc_id=batch.column("doc_id"), score=pa.array(1 / (1 + np.exp(-z))))
        return work

    return mapped(id_and_text(docs), make, "doc_id long, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return (scored(docs, fit(docs, labels))
            .withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score below the threshold, with all their columns."""
    model = fit(docs, labels)
    if model is None:
        return docs
    kinds = docs.schema
    text_at = kinds.names.index("text")

    def make():
        measure = distances(model.toxic, model.ordinary)
        w, mean, scale = (np.array(x) for x in (model.weights, model.means, model.scales))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(measure((t.as_py() or "").encode()))
                          for t in batch.column(text_at)])
            z = np.clip((x - mean) / scale @ w, -30, 30)
            return batch.filter(pa.array(1 / (1 + np.exp(-z)) < threshold))
        return work

    return mapped(docs, make, kinds)
