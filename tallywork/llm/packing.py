"""Packing by powers of two.

A document's tokens (its ids and one end id) are split by the binary digits of their number: first as
many whole sequences as fit, then one piece for each binary digit of the rest. Pieces of one length
share a bucket; each is a sequence by itself, so no sequence crosses documents, and since every
length is a power of two nothing is padded. Nothing is shuffled: a piece's sequence number is its
bucket and a number that is unique in the job.

Results: null text is packed like empty text (the end id alone, one piece of length 1); repeated rows
are packed each; further columns are not read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywork.llm.bpe import byte_symbols
from tallywork.llm.tables import id_and_text, mapped, record

END_ID = 0
LONGEST = 1024
#: How a byte-level tokenizer splits text before it merges (a fixed value of that format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class ByteLevel:
    """Ids as the tokenizer file gives them, from a faster encoder over the same vocabulary; where
    that gives up (too long a run for its splitter), the file's own encoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        value = {symbol: byte for byte, symbol in enumerate(byte_symbols())}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if token not in special}
        self.special = tuple(special)
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks,
                                      special_tokens=special)
        self.exact = functools.cache(lambda: Tokenizer.from_file(path))

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except BaseException as error:  # the encoder's panics are no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.exact().encode(text, add_special_tokens=False).ids, "<u4")


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevel:
    """A worker keeps it from task to task."""
    return ByteLevel(path)


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Whole sequences, then the binary digits of the rest, longest first."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def packed(docs: DataFrame, path: str, with_ids: bool = False,
           longest: int = LONGEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, offset, bucket, sequence_id
    (and the ids)."""
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def make():
        tokens = byte_level(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, starts, lengths, sums, totals, bodies = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text")):
                ids = np.append(tokens.ids(text.as_py()), np.array([END_ID], "<u4"))
                at = 0
                for length in piece_lengths(len(ids), longest):
                    piece = ids[at:at + length]
                    rows.append(row)
                    starts.append(at)
                    lengths.append(length)
                    sums.append(zlib.crc32(piece))
                    totals.append(len(ids))
                    if with_ids:
                        bodies.append(piece.astype(np.int32))
                    at += length
            more = {"ids": pa.array(bodies, pa.list_(pa.int32()))} if with_ids else {}
            return record(doc_id=batch.column("doc_id").take(pa.array(rows, pa.int64())),
                          start=pa.array(starts, pa.int64()), length=pa.array(lengths, pa.int64()),
                          ids_crc32=pa.array(sums, pa.int64()),
                          doc_tokens=pa.array(totals, pa.int64()), **more)
        return work

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = mapped(id_and_text(docs), make, schema + ", ids array<int>" * with_ids)
    bucket = F.round(F.log2("length")).cast("long")
    return (pieces.withColumn("offset", F.lit(0).cast("long"))
            .withColumn("bucket", bucket)
            # equal lengths are neighbours: five bits of bucket over the job's own numbers
            .withColumn("sequence_id", F.shiftleft(bucket, 58)
                        .bitwiseOR(F.monotonically_increasing_id())))
