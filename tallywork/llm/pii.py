"""Personal data: patterns, and terms that disclose them.

Patterns give the base spans (e-mail and IP addresses, card and phone numbers). Each value found is a
protected entity. Words that stand near it are judged by what the corpus says about them: with
r = occurrences of the term near the entity / occurrences of the term anywhere, and IC = -log2 of the
entity's share of all terms, the term discloses 1 + log2(r) / IC of the entity's information (1: who
reads the term knows the entity). Terms seen in two different contexts of the entity at least are
removed from 0.98 on and generalised from 0.9 on, wherever they stand: in texts without the entity too.

Only DataFrame functions are used. Patterns never retry inside a run of characters, so each takes
linear time; positions come from running sums over the pieces between matches, in blocks of BLOCK.

Results: null text is empty text and has no spans; repeated rows get the same spans; rows without a
doc_id are treated like others; columns other than doc_id, text and n_chars are only passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywork.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
#: In the order of KINDS. What counts as a match. A start is tried only where no start
#: before it in the same run was (or right after the last match), and runs are taken whole.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold for a pattern to be worth its time.
HINTS = (r"@[A-Za-z0-9-]++\.", r"[0-9]\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){11}", r"\+[0-9]")
PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"^(?:(?:0++|{PART})(?:\.|$)){{4}}$"
TERM = r"[\p{L}\p{N}]{3,}"
TILE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: Characters before and after an entity that are its context.
CONTEXT = 60
BLOCK = 128
GENERALISE, REMOVE = 0.9, 0.98
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "reveals": "[TERM]"}


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once per row, however often lambdas refer to them (a
    generator is not merged with what comes after it)."""
    row = F.array(F.struct(*(c.alias(name) for name, c in columns.items())))
    return df.select("*", F.inline(row))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def block_sums(lengths: str) -> Column:
    """The sum of each block of BLOCK lengths."""
    many = F.floor(F.size(lengths) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), many), lambda b: total(
        F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))


def sums_before(sums: str) -> Column:
    return F.transform(sums, lambda _, i: total(F.slice(sums, F.lit(1), i)))


def luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(digits) - i) % 2 == 1,
                      F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return total(F.transform(F.sequence(F.lit(1), F.length(digits)), value)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(IP)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def entity(kind: str, match: Column) -> Column:
    """One name for all spellings of a value."""
    if kind in ("card", "phone"):
        return F.concat(F.lit(f"{kind}:"), F.regexp_replace(match, "[^0-9]", ""))
    return F.concat(F.lit(f"{kind}:"), F.lower(match))


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text_length (they name the text), n_terms, spans: the base spans sorted by
    start and kind: (start, rank, end, kind, entity, left, right)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                     F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    first = {}
    for kind, pattern, hint in zip(KINDS, PATTERNS, HINTS, strict=True):
        worth = F.col("text").rlike(hint)
        first[f"m_{kind}"] = F.when(
            worth, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none)
        first[f"p_{kind}"] = F.when(worth, F.split("text", pattern, -1)).otherwise(none)
    df = fixed(df, text_hash=F.xxhash64("text"), text_length=F.length("text"),
               n_terms=F.regexp_count("text", F.lit(TERM)), **first).drop("text")
    df = fixed(df, **{f"l_{k}": F.zip_with(
        F.slice(f"p_{k}", F.lit(1), F.size(f"m_{k}")), F.col(f"m_{k}"),
        lambda p, m: F.length(p) + F.length(m)) for k in KINDS})
    df = fixed(df, **{f"s_{k}": block_sums(f"l_{k}") for k in KINDS})
    df = fixed(df, **{f"b_{k}": sums_before(f"s_{k}") for k in KINDS})

    def spans_of(rank: int, k: str) -> Column:
        def span(match: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            before = F.get(f"b_{k}", block) + total(F.slice(f"l_{k}", block * BLOCK + 1, i % BLOCK))
            start = before + F.length(F.get(f"p_{k}", i))
            return F.struct(
                start.alias("start"), F.lit(rank).alias("rank"),
                (start + F.length(match)).alias("end"), F.lit(k).alias("kind"),
                F.when(valid(k, match), entity(k, match)).alias("entity"),
                F.substring(F.get(f"p_{k}", i), -CONTEXT, CONTEXT).alias("left"),
                F.substring(F.get(f"p_{k}", i + 1), 1, CONTEXT).alias("right"))
        return F.filter(F.transform(f"m_{k}", span), lambda s: s.entity.isNotNull())

    spans = [spans_of(rank, k) for rank, k in enumerate(KINDS)]
    return df.select("doc_id", "text_hash", "text_length", "n_terms",
                     F.array_sort(F.concat(*spans)).alias("spans"))


NAMED = ("doc_id", "text_hash", "text_length")


def near_terms(found: DataFrame) -> DataFrame:
    """One row for each term near an entity: the document, entity, term, start, end, context."""
    one = found.filter(F.size("spans") > 0).select(*NAMED, F.inline("spans"))
    one = one.withColumn("context", F.xxhash64("left", "right"))
    sides = None
    for side, begin in (("left", F.col("start") - F.length("left")), ("right", F.col("end"))):
        rows = fixed(one.select(*NAMED, "entity", "context", begin.alias("begin"), F.col(side).alias("near")),
                     tiles=F.regexp_extract_all("near", F.lit(TILE), F.lit(0)))
        rows = rows.select(*NAMED, "entity", "context", "begin", F.size("tiles").alias("many"),
                           (F.length("near") == CONTEXT).alias("cut"), F.posexplode(F.transform(
                               "tiles", lambda t, i: F.struct(t.alias("term"), total(F.transform(
                                   F.slice("tiles", F.lit(1), i), F.length)).alias("at")))))
        # a word at the outer end of a full context may be cut
        outer = F.col("pos") == (0 if side == "left" else F.col("many") - 1)
        rows = (rows.filter(F.col("col.term").rlike(f"^{TERM}$") & ~(F.col("cut") & outer))
                .withColumn("start", F.col("begin") + F.col("col.at"))
                .select(*NAMED, "entity", "context", F.lower("col.term").alias("term"), "start",
                        (F.col("start") + F.length("col.term")).alias("end")))
        sides = rows if sides is None else sides.unionByName(rows)
    # a term between two mentions of an entity is one occurrence
    return (sides.groupBy(*NAMED, "entity", "term", "start", "end")
            .agg(F.min("context").alias("context"))
            .withColumn("place", F.xxhash64("text_hash", "start")))


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame) -> DataFrame:
    """entity, term, disclosure of the pairs from GENERALISE on."""
    pairs = (near.groupBy("entity", "term").agg(
        F.count("*").alias("together"), F.min("context").alias("c0"), F.max("context").alias("c1"),
        F.min("place").alias("p0"), F.max("place").alias("p1"))
        # two contexts and two places; copies of a text count as one
        .filter("c0 <> c1 and p0 <> p1").select("entity", "term", "together"))
    pairs = stored(pairs, "pairs")
    # occurrences anywhere: whole texts, but only terms that matter get past the join
    # (lowered one by one, as near_terms does: the lowering of a letter may depend on what follows its word)
    everywhere = docs.select(F.explode(F.regexp_extract_all(
        "text", F.lit(TERM), F.lit(0))).alias("term")).select(F.lower("term").alias("term"))
    often = (everywhere.join(pairs.select("term").distinct(), "term", "left_semi")
             .groupBy("term").agg(F.count("*").alias("often")))
    entities = (found.select(F.inline("spans")).groupBy("entity").agg(F.count("*").alias("seen")))
    # one row
    size = found.agg(F.greatest(F.sum("n_terms"), F.lit(2)).alias("size"))
    share = F.least(F.col("together") / F.col("often"), F.lit(1.0))
    information = F.greatest(-F.log2(F.col("seen") / F.col("size")), F.lit(0.001))
    return (pairs.join(often, "term").join(entities, "entity").join(F.broadcast(size))
            .withColumn("disclosure", 1 + F.log2(share) / information)
            .filter(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"))


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """NAMED, start, end, disclosure: each place of ``terms`` (term, disclosure; a term once) in the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64("text").alias("text_hash"), F.length("text").alias("text_length"))
    held = (texts.select(*NAMED, F.explode(F.array_distinct(F.regexp_extract_all(
        "text", F.lit(TERM), F.lit(0)))).alias("term")).withColumn("term", F.lower("term"))
            .join(terms, "term").groupBy(*NAMED)
            .agg(F.map_from_entries(F.collect_set(F.struct("term", "disclosure"))).alias("held")))
    # written first: few texts hold such a term, and only they are taken apart
    held = stored(held, "held").select(*(F.col(c).alias(f"h_{c}") for c in NAMED), "held")
    rows = texts.join(held, F.col("doc_id").eqNullSafe(F.col("h_doc_id"))
                      & (F.col("text_hash") == F.col("h_text_hash"))
                      & (F.col("text_length") == F.col("h_text_length")))
    rows = fixed(rows.select(*NAMED, "held", "text"),
                 tiles=F.regexp_extract_all("text", F.lit(TILE), F.lit(0))).drop("text")
    rows = fixed(rows, lengths=F.transform("tiles", F.length))
    rows = fixed(rows, sums=block_sums("lengths"))
    rows = fixed(rows, before=sums_before("sums"))
    hits = F.filter(F.transform("tiles", lambda t, i: F.struct(
        i.alias("i"), F.length(t).alias("n"), F.col("held")[F.lower(t)].alias("disclosure"))),
        lambda h: h.disclosure.isNotNull())

    def place(h: Column) -> Column:
        block = F.floor(h.i / BLOCK).cast("int")
        start = F.get("before", block) + total(F.slice("lengths", block * BLOCK + 1, h.i % BLOCK))
        return F.struct(start.alias("start"), (start + h.n).alias("end"), h.disclosure.alias("disclosure"))

    return fixed(rows, hits=hits).select(*NAMED, F.inline(F.transform("hits", place)))


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text_length, base, spans of every document; (start, rank, end, kind)."""
    found = stored(found_in(docs), "found")
    near = stored(near_terms(found), "near")
    terms = stored(disclosing(docs, found, near).groupBy("term").agg(
        F.max("disclosure").alias("disclosure")), "terms")
    marked = (occurrences(docs, terms)
              .groupBy(*NAMED, "start", "end").agg(F.max("disclosure").alias("disclosure"))
              .groupBy(*NAMED).agg(F.collect_list(F.struct(
                  "start", F.when(F.col("disclosure") >= REMOVE, 4).otherwise(5).alias("rank"), "end",
                  F.when(F.col("disclosure") >= REMOVE, "reveals").otherwise("hints").alias("kind")))
                  .alias("more")))
    slim = F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.rank.alias("rank"),
                                                   s.end.alias("end"), s.kind.alias("kind")))
    rows = found.select(*NAMED, slim.alias("base"))
    marked = marked.select(*(F.col(c).alias(f"x_{c}") for c in NAMED), "more")
    joined = rows.join(marked, F.col("doc_id").eqNullSafe(F.col("x_doc_id"))
                       & (F.col("text_hash") == F.col("x_text_hash"))
                       & (F.col("text_length") == F.col("x_text_length")), "left")
    apart = F.filter("more", lambda m: ~F.exists(
        "base", lambda b: (b.start < m.end) & (m.start < b.end)))
    return joined.select(*NAMED, "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", apart))).alias("spans"))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, a count of each kind, base_sha256, spans."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return all_spans(docs).select("doc_id", *map(count, KINDS),
                                  F.sha2(listed("base"), 256).alias("base_sha256"),
                                  listed("spans").alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by labels and disclosing terms removed or reduced to
    their first character; n_chars, where there is one, follows."""
    spans = (all_spans(docs).filter(F.size("spans") > 0)
             .select(*(F.col(c).alias(f"_{c}") for c in NAMED), F.col("spans").alias("_spans"))
             .dropDuplicates(["_doc_id", "_text_hash", "_text_length"]))
    rows = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc_id"))
                     & (F.xxhash64("text") == F.col("_text_hash"))
                     & (F.length("text") == F.col("_text_length")), "left")
    label = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(F.col("text"), acc.at + 1, s.start - acc.at)
        put = F.when(s.kind == "hints", F.concat(
            F.substr(F.col("text"), s.start + 1, F.lit(1)), F.lit("."))).otherwise(label[s.kind])
        return (F.when(s.start >= acc.at, F.struct(
            s.end.alias("at"), F.concat(acc.out, F.array(between, put)).alias("out")))
            .otherwise(F.struct(F.greatest(acc.at, s.end).alias("at"), acc.out.alias("out"))))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(
        F.array_join(acc.out, ""), F.substr(F.col("text"), acc.at + 1)))
    rows = rows.withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(clean))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.coalesce(
            F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return rows.select(*docs.columns)
