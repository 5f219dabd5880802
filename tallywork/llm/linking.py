"""Candidate pairs from shared keys, and connected components, for the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallywork.llm.likeness import Likeness
from tallywork.llm.tables import cut, let_workers_import, record, stored, text_bytes
from tallywork.llm.words import shingles

#: Groups of a key up to this size give all their pairs, larger ones a chain and a star.
SMALL_GROUP = 8
#: What gives a pair: a small group, the star or the chain of a large one.
ALL, STAR, CHAIN = 0, 1, 2


def key_pairs(keyed: DataFrame, fewer: bool = False) -> tuple[DataFrame, DataFrame]:
    """From rows (k, c): the pairs (a, b) of different c that share a key, and the rows of large
    groups, whose other pairs are left for ``linked_through``.

    ``fewer``: each c keeps two of the pairs that the stars and chains of its large groups give it, of
    either kind the one that comes up in most groups. So they grow with the number of c, not with that of its large
    groups (of which the first SMALL_GROUP members still give all theirs); what this leaves apart is left
    like the other pairs of large groups.

    The keys are dealt out and sorted by Spark; a task then streams over its sorted rows and holds
    no more than SMALL_GROUP of them, however large a group is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, last, count = None, [], None, 0
        out: list[tuple[int, int, int | None, int]] = []

        def flush():
            nonlocal out
            cols = list(zip(*out, strict=True))
            out = []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols], ["a", "b", "k", "kind"])

        for batch in batches:
            ks, cs = (batch.column(x).to_numpy() for x in ("k", "c"))
            if not len(ks):
                continue
            # only rows whose neighbour has the same key matter
            same = np.zeros(len(ks) + 1, bool)
            same[1:-1] = ks[1:] == ks[:-1]
            wanted = same[1:] | same[:-1]
            wanted[0] |= key is not None and ks[0] == key
            wanted[-1] = True  # it may go on in the next batch
            for k, c in zip(ks[wanted].tolist(), cs[wanted].tolist(), strict=True):
                if k != key:
                    key, members, last, count = k, [c], c, 1
                    continue
                if c == last:
                    continue
                count += 1
                if count <= SMALL_GROUP:
                    out += [(m, c, None, ALL) for m in members]
                    members.append(c)
                else:
                    if count == SMALL_GROUP + 1:
                        out += [(m, m, k, ALL) for m in members]
                    out += [(members[0], c, None, STAR), (last, c, None, CHAIN), (c, c, k, ALL)]
                last = c
                if len(out) >= 20_000:
                    yield flush()
        if out:
            yield flush()

    let_workers_import(keyed.sparkSession)
    dealt = keyed.repartition("k").sortWithinPartitions("k", "c")
    found = stored(dealt.mapInArrow(run, "a long, b long, k long, kind long"), "pairs")
    pairs = found.filter("k is null")
    if fewer:
        most = (pairs.filter(F.col("kind") != ALL).groupBy("kind", "a", "b").agg(F.count("*").alias("often"))
                .groupBy("kind", "b").agg(F.max(F.struct("often", "a")).alias("most")))
        pairs = (pairs.filter(F.col("kind") == ALL).select("a", "b")
                 .union(most.select(F.col("most.a").alias("a"), "b")))
    pairs = pairs.select("a", "b").distinct()
    large = found.filter("k is not null").select("k", F.col("a").alias("c"))
    return pairs, large


def open_rows(large: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (k, c) of groups that lie in more than one component."""
    named = (large.join(labels, large.c == labels.node, "left")
             .select("k", "c", F.coalesce("label", "c").alias("label")))
    keys = (named.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
            .filter("lo <> hi").select("k"))
    return named.join(keys, "k", "left_semi").select("k", "c")


def rows_of_enough(rows: DataFrame, slack: DataFrame) -> DataFrame:
    """The rows (k, c) of those c (c, slack) that have more than ``slack`` of them. Sets that link share more keys
    than that; all groups of these are open if the two lie in different components. So what shares
    a passage with many and is like none of them drops out."""
    many = rows.groupBy("c").agg(F.count("*").alias("many"))
    return rows.join(many.join(slack, "c").filter("many > slack").select("c"), "c").select("k", "c")


def separate(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that labels do not put into one component yet."""
    x = labels.select(F.col("node").alias("a"), F.col("label").alias("x"))
    y = labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    return (pairs.join(x, "a", "left").join(y, "b", "left")
            .filter(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))


def families(rows: DataFrame) -> DataFrame:
    """c, family, hub: members of the groups (k, c), together with all that groups connect them to; the
    hub is the member of most groups (which is what copies of one text have in common)."""
    least = rows.groupBy("k").agg(F.min("c").alias("b"))
    named = components(rows.join(least, "k").select(F.col("c").alias("a"), "b"))
    named = named.select(F.col("node").alias("c"), F.col("label").alias("family"))
    weight = rows.groupBy("c").agg(F.count("*").alias("weight"))
    hubs = (named.join(weight, "c").groupBy("family")
            .agg(F.max(F.struct("weight", "c")).alias("top")).select("family", F.col("top.c").alias("hub")))
    return named.join(hubs, "family")


def differences(members: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """For members (c, family, hub, label, outside): a row for each shingle by which a member differs from
    its family's hub, with the member's size ``n``, the number of such shingles ``many`` and how many of
    them (``need``) any outsider that links with it shares at least."""
    own = texts.select("c", "text")
    hubs = texts.select(F.col("c").alias("hub"), F.col("text").alias("hub_text"))
    per_cent = like.per_cent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, central = None, None
        for whole in batches:
            for batch in cut(whole):
                grams = shingles(*text_bytes(batch.column("text")), like.size, like.lower)
                for i, mine in enumerate(grams):
                    hub = batch.column("hub")[i].as_py()
                    if hub != last:
                        last = hub
                        central = shingles(*text_bytes(batch.column("hub_text").slice(i, 1)),
                                           like.size, like.lower)[0]
                    apart = np.setxor1d(mine, central, assume_unique=True)
                    many = len(apart)
                    over = many * (100 + per_cent) - (100 - per_cent) * (len(mine) - len(central))
                    need = over // (2 * (100 + per_cent)) + 1
                    if many:
                        yield record(
                            **{x: pa.repeat(batch.column(x)[i], many)
                               for x in ("c", "family", "label", "outside")},
                            gram=apart.view(np.int64), n=np.full(many, len(mine), np.int64),
                            many=np.full(many, many, np.int64), need=np.full(many, need, np.int64))

    both = members.join(own, "c").join(hubs, "hub").sortWithinPartitions("hub")
    return both.select("c", "family", "label", "outside", "hub", "text", "hub_text").mapInArrow(
        run, "c long, family long, label long, outside boolean, gram long, n long, many long, need long")


def outsider_pairs(apart: DataFrame, like: Likeness) -> DataFrame:
    """Pairs of a family that may link although one of them, the outsider x, does not link with its hub h.

    |x ^ y| = |x ^ h| + |y ^ h| - 2 |both|, and x and y link if the left side is at most r (n_x + n_y) (r: the
    share of differences that links allow), so that many of their differences from the hub must be the
    same. Both sides rank theirs rarest first; the first that a pair has in common then leaves enough behind it
    on either side, a condition inside the join. As |x ^ h| is over r (n_x + n_h), y's first many - need + 1
    do. Copies share with the hub what is common to them all, so it is no difference; what they differ
    in is rare."""
    often = apart.groupBy("family", "gram").agg(F.count("*").alias("often"))
    ranked = apart.join(often, ["family", "gram"]).withColumn("rank", F.row_number().over(
        Window.partitionBy("c").orderBy("often", "gram")))
    index = ranked.filter("rank <= many - need + 1").select(
        "family", "gram", *(F.col(x).alias(f"{x}_y") for x in ("c", "n", "label", "many", "rank")))
    probe = ranked.filter("outside").select(
        "family", "gram", *(F.col(x).alias(f"{x}_x") for x in ("c", "n", "label", "many", "rank")))
    behind = F.least(F.expr("many_x - rank_x"), F.expr("many_y - rank_y")) + 1
    alike = (2 * (100 + like.per_cent) * behind >= (100 + like.per_cent) * F.expr("many_x + many_y")
             - (100 - like.per_cent) * F.expr("n_x + n_y"))
    both = probe.join(index, (probe.family == index.family) & (probe.gram == index.gram)
                      & (F.col("label_x") != F.col("label_y")) & alike
                      & like.sizes_fit(F.col("n_x"), F.col("n_y")))
    return both.select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b")).distinct()


def linked_through(pairs: DataFrame, large: DataFrame, check: Callable[[DataFrame], DataFrame],
                   texts_of: Callable[[DataFrame], DataFrame], like: Likeness,
                   slack: DataFrame | None = None) -> DataFrame:
    """node, label for every node with a link, from the candidates that ``check`` finds linked; slack: c and how
    many keys it shares at least, beside one, with each set that it links with."""
    labels = components(check(pairs))
    if slack is not None:
        large = rows_of_enough(stored(open_rows(large, labels), "keys"), slack)
    return through_hubs(large, labels, check, texts_of, like)


def through_hubs(large: DataFrame, labels: DataFrame, check: Callable[[DataFrame], DataFrame],
                 texts_of: Callable[[DataFrame], DataFrame], like: Likeness) -> DataFrame:
    """The labels after all links within large groups (k, c).

    Members of large groups that lie in several components are put into families, and each member
    meets its family's hub. What is in another component than the hub then meets those of the family that
    differ from the hub alike: every pair of a large group that links is found, without pairing the rest.
    """
    rows = stored(open_rows(large, labels), "open")
    if rows.isEmpty():
        return labels
    members = stored(families(rows), "families")
    with_hub = members.filter("c <> hub").select(F.least("c", "hub").alias("a"),
                                                 F.greatest("c", "hub").alias("b"))
    labels = joined_labels(labels, check(with_hub))
    named = members.join(labels, members.c == labels.node, "left").select(
        "c", "family", "hub", F.coalesce("label", "c").alias("label"))
    central = named.filter("c = hub").select("family", F.col("label").alias("central"))
    named = named.join(central, "family").select(
        "c", "family", "hub", "label", (F.col("label") != F.col("central")).alias("outside"))
    divided = named.filter("outside").select("family").distinct()
    named = stored(named.join(divided, "family", "left_semi"), "members")
    if named.isEmpty():
        return labels
    apart = stored(differences(named, texts_of(named.select("c")), like), "apart")
    found = check(outsider_pairs(apart, like))
    return joined_labels(labels, found)


def joined_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links."""
    if links.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return components(known.unionByName(links))


def local_forest(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """node, root (the smallest node of its tree) of the edges (a, b) that a task reads, at most ``most``
    nodes at a time."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while above[top] != top:
            top = above[top]
        while above[x] != top:
            above[x], x = top, above[x]
        return top

    def trees() -> pa.RecordBatch:
        return record(node=pa.array(list(above), pa.int64()), root=pa.array(map(root, above), pa.int64()))

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            above.setdefault(a, a)
            above.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                above[max(x, y)] = min(x, y)
        if len(above) >= most:
            yield trees()
            above.clear()
    if above:
        yield trees()


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links (a, b) reach, for every node with a link.

    Each task makes trees of the links that it reads; a node with several roots links them, and the same
    is done with those links between roots, until no node has two. Links are read where they lie, so
    nothing of a large component meets in one task."""
    let_workers_import(links.sparkSession)
    forest = stored(links.select("a", "b").mapInArrow(local_forest, "node long, root long"), "forest")
    least = forest.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    between = stored(forest.join(least.filter("low <> high"), "node").filter("root <> low")
                     .select(F.col("root").alias("a"), F.col("low").alias("b")).distinct(), "roots")
    if between.isEmpty():
        return least.select("node", F.col("low").alias("label"))
    above = components(between).select(F.col("node").alias("low"), "label")
    return stored(least.join(above, "low", "left").select(
        "node", F.coalesce("label", "low").alias("label")), "labels")
