"""Near duplicates by a join of chosen paths.

A document's set is its distinct word shingles. In each of TREES trees a set walks down from the root: at a
node each of BRANCHES hash functions, drawn for that node, selects the set's minwise token, and the set goes on
to the child that this token names. Two sets go together through one branch with the probability of their
Jaccard likeness, so a linked pair nearly always shares some node, an unlike one hardly ever. The first START
levels are walked at once. Small nodes are compared exhaustively; larger ones whose members do not
lie in one component yet are branched further, at most to depth DEEPEST, each node with functions of
its own. What is still large then is a dense group of copies: its members meet their hub, and those
that it does not link are joined exactly on their differences from it (``linking.through_hubs``).

Recall: with two branches a pair at the threshold of 0.8 is lost by one tree with probability 0.059 after
three levels, by five independent trees with 7e-7; more alike pairs less. Candidates are confirmed on their
full sets.

Equal sets form one class, so copies cost one row each and are never paired. Results: null and empty texts and
texts without words have the empty set and link with nothing; rows without a doc_id take part, but a
class's id is the smallest id it has; rows that share a doc_id with different sets stay different documents,
and both have ``kept`` if that id is the smallest; repeated rows have equal results; further columns are not
read. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.llm.likeness import Likeness
from tallywork.llm.linking import (
    components,
    joined_labels,
    key_pairs,
    open_rows,
    separate,
    through_hubs,
)
from tallywork.llm.parity_join import checker, class_id, classes_from, sets
from tallywork.llm.tables import cut, id_and_text, let_workers_import, mapped, record, stored, text_bytes
from tallywork.llm.words import U, mix, shingles

TREES, BRANCHES, START, DEEPEST = 5, 2, 3, 7
#: Tokens that one further branching takes at once.
STRIDE = 4
_rng = np.random.default_rng(12)


def tree_functions(trees: int, branches: int, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Factors and offsets of a hash function for each branch of each node, level by level."""
    out = []
    for level in range(depth):
        many = trees * branches ** (level + 1)
        out.append((_rng.integers(1, 1 << 63, many, dtype=np.uint64) * U(2) + U(1),
                    _rng.integers(0, 1 << 63, many, dtype=np.uint64)))
    return out


LEVELS = tree_functions(TREES, BRANCHES, START)


def minwise(grams: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The smallest hash under each function, a block of shingles at a time. It names the token: the
    functions are one to one."""
    best = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 2048):
        block = grams[None, lo:lo + 2048] * factors[:, None] + offsets[:, None]
        best = np.minimum(best, block.min(1))
    return best


def first_nodes(grams: np.ndarray) -> np.ndarray:
    """The nodes of a set at depth START, in all trees."""
    node = mix(np.arange(TREES, dtype=np.uint64) + U(1))
    for factors, offsets in LEVELS:
        node = np.repeat(node, BRANCHES)
        node = mix(node ^ mix(minwise(grams, factors, offsets) + np.arange(len(node), dtype=np.uint64)))
    return node


def children(grams: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The nodes that a set reaches from each node: BRANCHES children each, by STRIDE tokens whose hash
    functions follow from the node's name."""
    seed = np.repeat(nodes, BRANCHES) + np.tile(np.arange(1, BRANCHES + 1, dtype=np.uint64), len(nodes))
    child = mix(seed)
    for step in range(STRIDE):
        drawn = mix(seed ^ U(2 * step + 11))
        child = mix(child ^ mix(minwise(grams, drawn | U(1), mix(drawn))))
    return child


def planted(docs: DataFrame, like: Likeness) -> DataFrame:
    """k, c: the first nodes of each class. A task gives them once for the copies that it reads."""

    def make():
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            ks, cs = [], []
            for grams in shingles(*text_bytes(batch.column("text")), like.size, like.lower):
                c = class_id(grams)
                if not c or c in seen:
                    continue
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(c)
                ks.append(first_nodes(grams).view(np.int64))
                cs.append(np.full(len(ks[-1]), c))
            return record(k=np.concatenate(ks), c=np.concatenate(cs)) if ks else None
        return work

    return mapped(id_and_text(docs), make, "k long, c long")


def branched(rows: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """k, c: the members of nodes (k, c), one branching further down."""
    nodes = rows.groupBy("c").agg(F.collect_set("k").alias("nodes"))  # at most a class's own nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in cut(whole):
                found = shingles(*text_bytes(batch.column("text")), like.size, like.lower)
                ks = [children(g, np.array(n, np.int64).view(np.uint64)).view(np.int64)
                      for g, n in zip(found, batch.column("nodes").to_pylist(), strict=True)]
                yield record(k=np.concatenate(ks),
                             c=np.repeat(batch.column("c").to_numpy(), list(map(len, ks))))

    let_workers_import(rows.sparkSession)
    return texts.join(nodes, "c").select("c", "text", "nodes").mapInArrow(run, "k long, c long")


def joined(docs: DataFrame, like: Likeness = Likeness(2, 80)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    every = stored(sets(docs, like).drop("t"), "sets")
    classes = classes_from(every)
    check, texts_of = checker(docs, classes, like)
    pairs, large = key_pairs(planted(docs, like))
    labels = components(check(pairs))
    for _ in range(START, DEEPEST, STRIDE):
        rows = stored(open_rows(large, labels), "open")
        if rows.isEmpty():
            break
        more, large = key_pairs(branched(rows, texts_of(rows.select("c").distinct()), like))
        # what is in one component need not be compared again
        labels = joined_labels(labels, check(separate(more, labels)))
    labels = through_hubs(large, labels, check, texts_of, like)
    named = (classes.join(labels, classes.c == labels.node, "left")
             .select("c", "doc", F.coalesce("label", "c").alias("label")))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    found = (every.join(named.join(least, "label").select("c", "component_id"), "c", "left")
             .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
