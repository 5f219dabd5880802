"""URL filters: rules first, then host word segmentation and naive Bayes.

Concatenated names in hosts are split into words by a unigram model (Viterbi): word counts come from
the pages' own texts. The tokens of host and path are then scored by multinomial naive Bayes, which
learns from the pages that a rule decides. A page that no rule fits is blocked if its tokens are
likelier among blocked pages.

The counts are joined, not broadcast: only the substrings of the distinct host labels meet the words,
and a host or a path shape is scored once, however many pages have it.

Results: null urls and those without ``://`` have an empty host and path, fit no rule and have no
tokens: the prior decides (allow when classes are even); repeated rows are judged each; further
columns are not read. Without pages that rules decide, everything else is allowed.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import mapped, record, stored

#: (verdict, host, path), by the contract.
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
#: Letters of the longest word looked for in a name.
LONGEST_WORD = 20


def split_url(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(url.contains("://"), F.lit(False))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, lower).otherwise(""), F.when(has, path).otherwise("")


def ruled(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, decision of every page; the longest fitting rule decides."""
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule = decision = None
    for verdict, name, start in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = (((F.col("host") == name) | F.col("host").endswith(f".{name}"))
                & F.col("path").startswith(start))
        text, word = F.lit(name + start), F.lit(verdict)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        decision = F.when(fits, word) if decision is None else decision.when(fits, word)
    return df.withColumn("rule", rule).withColumn("decision", decision)


def best_split(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The likeliest words that make up a name; unknown stretches cost more the longer they are."""
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(name)
    for end in range(1, len(name) + 1):
        for begin in range(max(0, end - LONGEST_WORD), end):
            word = name[begin:end]
            seen = counts.get(word)
            value = (math.log(seen / total) if seen
                     else -math.log(total) - 2.5 * len(word))
            score = best[begin][0] + value
            if score > best[end][0]:
                best[end] = (score, begin)
    out, end = [], len(name)
    while end:
        begin = best[end][1]
        out.append(name[begin:end])
        end = begin
    return out[::-1]


def word_counts(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, n for the words of all pages that are substrings of a label; total: one row."""
    plain = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "(?s)<[^>]*+>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(plain, F.lit("[a-z]+"), F.lit(0))).alias("word"))
    size = F.least(F.length("label"), F.lit(LONGEST_WORD))
    inner = labels.select(F.explode(F.flatten(F.transform(
        F.sequence(F.lit(1), size), lambda n: F.transform(
            F.sequence(F.lit(1), F.length("label") - n + 1),
            lambda i: F.substr("label", i, n))))).alias("word")).distinct()
    counts = (words.filter(F.length("word") <= LONGEST_WORD).join(inner, "word", "left_semi")
              .groupBy("word").agg(F.count("*").alias("n")))
    total = pages.select(F.regexp_count(plain, F.lit("[a-z]+")).alias("k")).agg(
        F.greatest(F.coalesce(F.sum("k"), F.lit(0)), F.lit(2)).alias("total"))
    return counts, total


def segmented(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """label, words: every distinct host label split into words."""
    labels = stored(hosts.select(F.explode(F.split("host", "[^a-z]+")).alias("label"))
                    .filter("label <> ''").distinct(), "labels")
    counts, total = word_counts(pages, labels)
    size = F.least(F.length("label"), F.lit(LONGEST_WORD))
    inner = labels.select("label", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), size), lambda n: F.transform(
            F.sequence(F.lit(1), F.length("label") - n + 1),
            lambda i: F.substr("label", i, n)))))).alias("word"))
    known = (inner.join(counts, "word").groupBy("label")
             .agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts")))
    rows = (labels.join(known, "label", "left").join(F.broadcast(total))
            .select("label", F.coalesce("counts", F.create_map().cast("map<string,bigint>")).alias("counts"),
                    "total"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [best_split(label, dict(counts), total) for label, counts, total in zip(
                *(batch.column(x).to_pylist() for x in ("label", "counts", "total")), strict=True)]
            return record(label=batch.column("label"), words=pa.array(words, pa.list_(pa.string())))
        return work

    return mapped(rows, make, "label string, words array<string>")


def shape_of(path: Column) -> Column:
    """The tokens of a path; all numbers are one token."""
    tokens = F.regexp_extract_all(F.lower(path), F.lit("[a-z]+|[0-9]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), "0").otherwise(t)), " ")


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    df = stored(ruled(pages).withColumn("shape", shape_of(F.col("path"))), "ruled")
    # each distinct host and path shape with the pages that rules allow and block
    allow = F.sum((F.col("decision") == "allow").cast("long")).alias("allow")
    block = F.sum((F.col("decision") == "block").cast("long")).alias("block")
    hosts = stored(df.groupBy("host").agg(allow, block), "hosts").fillna(0)
    shapes = stored(df.groupBy("shape").agg(allow, block), "shapes").fillna(0)
    words = segmented(pages, hosts)
    host_tokens = (hosts.select("host", "allow", "block",
                                F.explode(F.split("host", "[^a-z]+")).alias("label"))
                   .join(words, "label")
                   .select("host", "allow", "block", F.explode("words").alias("token")))
    host_tokens = host_tokens.withColumn("token", F.concat(F.lit("h:"), "token"))
    shape_tokens = (shapes.select("shape", "allow", "block",
                                  F.explode(F.split("shape", " ")).alias("token")).filter("token <> ''")
                    .withColumn("token", F.concat(F.lit("p:"), "token")))
    host_tokens, shape_tokens = stored(host_tokens, "tokens"), stored(shape_tokens, "tokens")
    counts = (host_tokens.select("token", "allow", "block")
              .unionByName(shape_tokens.select("token", "allow", "block"))
              .groupBy("token").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    counts = stored(counts, "counts")
    sums = counts.agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"),
                      F.count("*").alias("kinds"))
    model = counts.join(F.broadcast(sums)).select("token", (
        F.log((F.col("block") + 1) / (F.col("all_block") + F.col("kinds")))
        - F.log((F.col("allow") + 1) / (F.col("all_allow") + F.col("kinds")))).alias("weight"))
    host_scores = (host_tokens.join(model, "token").groupBy("host")
                   .agg(F.sum("weight").alias("host_score")))
    shape_scores = (shape_tokens.join(model, "token").groupBy("shape")
                    .agg(F.sum("weight").alias("shape_score")))
    prior = hosts.agg(F.log((F.sum("block") + 1) / (F.sum("allow") + 1)).alias("prior"))
    scored = (df.join(host_scores, "host", "left").join(shape_scores, "shape", "left")
              .join(F.broadcast(prior)))
    score = (F.coalesce("prior", F.lit(0.0)) + F.coalesce("host_score", F.lit(0.0))
             + F.coalesce("shape_score", F.lit(0.0)))
    # sums of logarithms differ in their last digits with the order of addition
    verdict = F.coalesce("decision", F.when(F.round(score, 9) > 0, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                         F.round(score, 6).alias("score"))
