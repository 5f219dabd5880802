"""BPE encoding and decoding by forced boundaries.

A pair of neighbouring symbols that stands inside no token of the vocabulary can never be merged
over, so the text can be cut there for certain: each fragment is merged for itself and the ids are
put together again. The end of a word is such a place too, since a symbol with the word-end mark is
followed by nothing in any token. Fragments repeat, so their ids are remembered (a bounded number).

Results: null text encodes like empty text (no ids, decoded text empty); repeated rows are encoded
each; further columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer
from tokenizers.models import BPE

from tallywork.llm.tables import id_and_text, mapped, record

#: Fragments remembered by a task; when full, the memory starts anew.
REMEMBERED = 400_000

beyond = regex.compile("[^\\x00-\u04ff]").search


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A tokenizer file whose model is BPE over byte symbols with a word-end mark."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.symbols = byte_symbols()
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.inside = {pair for token in self.ids for pair in self._neighbours(token)}
        self.known: dict[str, tuple[int, ...]] = {}
        self.ending = BPE(vocab=self.ids, merges=pairs, end_of_word_suffix=self.end or None)
        self.plain = BPE(vocab=self.ids, merges=pairs)
        self.library = Tokenizer.from_file(path)

    def _neighbours(self, token: str) -> list[tuple[str, str]]:
        marked = bool(self.end) and token.endswith(self.end) and token != self.end
        symbols = list(token[:len(token) - len(self.end)] if marked else token)
        if marked:
            symbols[-1] += self.end
        return list(zip(symbols, symbols[1:], strict=False))

    def fragments(self, symbols: list[str]) -> list[list[str]]:
        """The symbols of a word, cut wherever two neighbours stand inside no token."""
        out = [[symbols[0]]]
        left = symbols[0]
        for right in symbols[1:-1]:
            if (left, right) in self.inside:
                out[-1].append(right)
            else:
                out.append([right])
            left = right
        if len(symbols) > 1:
            if (left, symbols[-1] + self.end) in self.inside:
                out[-1].append(symbols[-1])
            else:
                out.append([symbols[-1]])
        return out

    def word_ids(self, key: str, symbols: list[str]) -> tuple[int, ...]:
        """The ids of one word; fragments are merged one by one."""
        cut = self.fragments(symbols)
        last = cut.pop()
        found = [t.id for fragment in cut for t in self.plain.tokenize("".join(fragment))]
        found += [t.id for t in self.ending.tokenize("".join(last))]
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        self.known[key] = out = tuple(found)
        return out

    def part_ids(self, text: str) -> list[int]:
        """The ids of a text without special tokens.

        Up to U+04FF the words are found here: NFC, lower case letter by letter (white space needs
        no step, as no word holds any). Beyond, which signs are letters depends on the Unicode
        version that the library was built with, so its word splitter is asked."""
        out: list[int] = []
        known = self.known
        if not text.isascii():
            if beyond(text):
                whole = self.library.normalizer.normalize_str(text)
                for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(whole):
                    key = "\ud800" + symbols  # no text holds a lone surrogate
                    out += known.get(key) or self.word_ids(key, list(symbols))
                return out
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        for word in self.words(text.lower()):
            ids = known.get(word)
            if ids is None:
                ids = self.word_ids(word, [self.symbols[b] for b in word.encode()])
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        if "<|" not in text:
            return self.part_ids(text)
        out: list[int] = []
        for k, part in enumerate(self.at_special(text)):
            out += [self.special[part]] if k % 2 else self.part_ids(part)
        return out

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in its file, a tokenizer puts the tokens together with blanks."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """A worker keeps it from task to task."""
    return Vocabulary(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int), decoded text of every document."""

    def make():
        vocabulary = vocabulary_of(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [vocabulary.encode(t) for t in batch.column("text").to_pylist()]
            return record(doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.list_(pa.int32())),
                          decoded=pa.array(map(vocabulary.decode, ids), pa.string()))
        return work

    return mapped(id_and_text(docs), make, "doc_id long, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text. The digests are made
    where the ids are, so the ids themselves never leave the task."""

    def make():
        vocabulary = vocabulary_of(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = vocabulary.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest())
            return record(doc_id=batch.column("doc_id"), n_tokens=pa.array(counts, pa.int64()),
                          ids_sha256=ids_sha, decoded_sha256=text_sha)
        return work

    return mapped(id_and_text(docs), make,
                  "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
