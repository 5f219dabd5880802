"""Quality rules as a ledger of bits.

Every rule is evaluated once per document; the ledger keeps the measurements and one word of failure
bits. A policy is a mask over those bits and the number of failures it forgives, so a new version
costs a bitwise AND over the ledger and never touches the texts again. ``ablations`` says for each
rule of a policy how many documents fail it, and how many fail nothing else.

Results: null and empty texts measure 0 everywhere and fail the base rule for few words; repeated
rows are measured each; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import id_and_text, mapped, record, text_bytes
from tallywork.llm.words import running_hash, span_hash, word_spans

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_letters_words", "top_word", "n_upper", "n_letters")
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
UPPER = np.isin(np.arange(256), list(range(65, 91)))
LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123), *range(0xC3, 0x100)])


def _counts_over(marks: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(marks)))[at])


def _ids(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct value, and how often it occurs."""
    _, which, count = np.unique(values, return_inverse=True, return_counts=True)
    return which, count


def measure(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of MEASURES per text."""
    n = len(at) - 1
    out = np.zeros((n, len(MEASURES)), np.int64)
    starts, ends, bounds = word_spans(data, at)
    sums = running_hash(data)
    hashes = span_hash(sums, starts, ends)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
    letters = np.concatenate(([0], np.cumsum(LETTER[data])))
    wordy = np.concatenate(([0], np.cumsum(letters[ends] > letters[starts])))
    out[:, 0] = np.diff(bounds)
    out[:, 1] = np.diff(chars[bounds])
    out[:, 2] = _counts_over(SYMBOLS[data], at)
    out[:, 6] = np.diff(wordy[bounds])
    out[:, 8] = _counts_over(UPPER[data], at)
    out[:, 9] = np.diff(letters[at])
    breaks = np.flatnonzero(data == 10)
    for d in range(n):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        if lo == hi:
            continue
        word, often = _ids(hashes[lo:hi])
        out[d, 7] = often.max()
        if hi - lo >= 3:
            # windows by the numbers of their words: equal numbers, equal words
            pair, _ = _ids(word[:-1] * len(often) + word[1:])
            window, seen = _ids(pair[:-1] * len(often) + word[2:])
            twice = seen[window] >= 2
            covered = np.zeros(hi - lo, bool)
            for k in range(3):
                covered[k:k + len(twice)] |= twice
            out[d, 4] = covered.sum()
        inner = breaks[np.searchsorted(breaks, at[d]):np.searchsorted(breaks, at[d + 1])]
        begin = np.concatenate(([at[d]], inner + 1))
        end = np.concatenate((inner, [at[d + 1]]))
        full = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        out[d, 5] = full.sum()
        if out[d, 5] > 1:
            lines = span_hash(sums, begin[full], end[full])
            out[d, 3] = len(lines) - len(np.unique(lines))
    return out


def measured(docs: DataFrame) -> DataFrame:
    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            table = measure(*text_bytes(batch.column("text")))
            return record(doc_id=batch.column("doc_id"),
                          **{name: table[:, k] for k, name in enumerate(MEASURES)})
        return work

    return mapped(id_and_text(docs), make,
                  "doc_id long, " + ", ".join(f"{x} long" for x in MEASURES))


def rules() -> dict[str, Column]:
    """The rules in the order of their bits; true where a document fails. Only add at the end."""
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "short_words": c("word_chars") < 2 * c("n_words"),
        "long_words": c("word_chars") > 15 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 10 * c("n_words"),
        "repeated_lines": 100 * c("n_dup_lines") > 30 * c("n_lines"),
        "few_letter_words": 100 * c("n_letters_words") < 80 * c("n_words"),
        "one_word": 100 * c("top_word") > 30 * c("n_words"),
        "capitals": 100 * c("n_upper") > 60 * c("n_letters"),
    }


@dataclass(frozen=True)
class Policy:
    """Documents go that fail more than ``forgiven`` of the named rules."""

    version: str
    names: tuple[str, ...]
    forgiven: int = 0

    def mask(self) -> int:
        order = list(rules())
        return sum(1 << order.index(name) for name in self.names)

    def rejects(self) -> Column:
        return F.bit_count(F.col("failed").bitwiseAND(F.lit(self.mask()))) > self.forgiven


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {
    "1": Policy("1", ("short_words", "long_words", "symbols", "repeated_lines",
                      "few_letter_words", "one_word", "capitals")),
    "2": Policy("2", ("short_words", "long_words", "symbols", "repeated_lines"), forgiven=1),
}


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and ``failed`` (bit k set: rule k fails) of every document."""
    bits = [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)) for k, test in enumerate(rules().values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured(docs).withColumn("failed", failed.cast("long"))


def judged(entries: DataFrame, policy: Policy = POLICIES["1"]) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    return (entries.withColumn("base_failed", BASE.rejects())
            .withColumn("kept", ~F.col("base_failed") & ~policy.rejects()))


def ablations(entries: DataFrame, policy: Policy = POLICIES["1"]) -> DataFrame:
    """rule, n_failed, n_only (documents the policy would keep without that rule)."""
    order = list(rules())
    within = F.col("failed").bitwiseAND(F.lit(policy.mask()))
    sums = []
    for name in policy.names:
        bit = 1 << order.index(name)
        hit = within.bitwiseAND(F.lit(bit)) != 0
        rest = F.bit_count(within.bitwiseAND(F.lit(policy.mask() & ~bit)))
        only = policy.rejects() & (rest <= policy.forgiven)
        sums.append(F.struct(F.lit(name).alias("rule"),
                             F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("n_failed"),
                             F.coalesce(F.sum(only.cast("long")), F.lit(0)).alias("n_only")))
    return entries.agg(F.array(*sums).alias("all")).select(F.inline("all"))
