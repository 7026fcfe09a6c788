"""SimHash document fingerprints and the search of near ones.

A document's terms are its word shingles; each votes, with a weight, on every bit of the fingerprint by the bits of its
hash. `near_pairs` finds all fingerprints within a radius of a query's by permuted block tables: the bits are cut into
radius + AGREE blocks, any two near fingerprints agree on AGREE whole blocks, and a table for each choice of AGREE blocks
is joined on them. Equal fingerprints are one class with a count, so that copies are not paired with each other.

Only DataFrame functions are used. The votes are summed in lanes: one 64-bit sum holds two counters of 32 bits, so that
32 sums hold the votes of 64 bits. A text has at most 2**30 words, whose weights of at most `HEAVIEST` fit a counter.

`edited` joins each document with the next one by id without one task ordering all: the ids are cut into ranges by
approximate quantiles, each range is a window of its own, and gets the first document of the next range as a guest. Of
equal ids the one with the lesser text comes first.

Defined results: null texts are empty; a text without words has fingerprint zero; equal texts have equal fingerprints;
repeated rows each have theirs. A null doc_id has no place in the order of documents, so no next document. Columns other
than doc_id and text are not read. doc_id is a whole number, or can be cast to one.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialized

SHINGLE = 3
LANES = 32
LANE_MASK = 1 | 1 << LANES
HEAVIEST = 3
SEEDS = (1, 2)
RADIUS = 3
AGREE = 2
#: In the report, rows whose id is divisible by this are searched for among all rows.
ASKED = 100


def words(text: Column) -> Column:
    """Lower-cased words between white space, punctuation at their ends included."""
    line = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    return F.array_remove(F.split(line, " "), "")


def weight(first: Column, second: Column, third: Column) -> Column:
    """A shingle's weight: 1 to HEAVIEST, more for longer words, which tell more."""
    size = sum(F.coalesce(F.length(w), F.lit(0)) for w in (first, second, third))
    return F.least(F.lit(HEAVIEST), 1 + F.floor(size / 9)).cast("long")


def _shingles(text: Column) -> Column:
    """Overlapping runs of SHINGLE words; the last ones run short, so each word begins one."""
    w = words(text)
    parts = [F.slice(w, i + 1, F.size(w)).alias(f"w{i}") for i in range(SHINGLE)]
    return F.arrays_zip(*parts)


def _sums(shingle: Column, seed: int, name: str) -> list[Column]:
    """The lane sums of the weighted hash bits of one seed."""
    given = [shingle[f"w{i}"] for i in range(SHINGLE)]
    heavy = F.when(given[0].isNotNull(), weight(*given))
    hashed = F.xxhash64(F.lit(seed), *given)
    return [
        F.sum(F.shiftrightunsigned(hashed, i).bitwiseAND(F.lit(LANE_MASK)) * heavy).alias(f"{name}{i}") for i in range(LANES)
    ]


def _hex(name: str, total: Column) -> Column:
    """Sixteen hexadecimal digits: a bit is one if more than half of the weight votes for it."""
    counter = F.lit((1 << LANES) - 1)
    bits = []
    for b in range(2 * LANES):
        votes = F.shiftrightunsigned(f"{name}{b % LANES}", LANES * (b // LANES)).bitwiseAND(counter)
        bits.append(F.when(2 * votes > total, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:  # a few at a time keep the expression shallow
        bits = [reduce(Column.bitwiseOR, bits[i : i + 8]) for i in range(0, len(bits), 8)]
    return F.lower(F.lpad(F.hex(bits[0]), 16, "0"))


def with_fingerprints(rows: DataFrame, texts: dict[str, str]) -> DataFrame:
    """rows without the text columns, but with fingerprints of them, by the name that texts gives, in one pass over
    their words. One fingerprint has 16 digits for each of SEEDS. The other columns of rows must make them distinct."""
    terms = {column: f"__{name}" for name, column in texts.items()}
    kept = [c for c in rows.columns if c not in terms]
    split = rows.select(*kept, *[_shingles(F.col(c)).alias(t) for c, t in terms.items()])
    spread = split.select(*kept, F.explode_outer(F.arrays_zip(*[F.col(t) for t in terms.values()])).alias("__term"))
    sums = []
    for t in terms.values():
        shingle = F.col("__term")[t]
        given = [shingle[f"w{i}"] for i in range(SHINGLE)]
        for seed in SEEDS:
            sums += _sums(shingle, seed, f"{t}_{seed}_")
        sums.append(F.sum(F.when(given[0].isNotNull(), weight(*given))).alias(f"{t}_all"))
    packed = spread.groupBy(*kept).agg(*sums).na.fill(0, [f"{t}_all" for t in terms.values()])
    return packed.select(
        *kept,
        *[F.concat(*[_hex(f"__{n}_{s}_", F.col(f"__{n}_all")) for s in SEEDS]).alias(n) for n in texts],
    )


def _numbers(fingerprint: Column) -> list[Column]:
    """A fingerprint's bits as whole numbers of 64 bits."""
    return [F.conv(F.substring(fingerprint, i, 16), 16, -10).cast("long") for i in range(1, 16 * len(SEEDS), 16)]


def distance(a: Column, b: Column) -> Column:
    """The number of bits in which two fingerprints differ."""
    return reduce(Column.__add__, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_numbers(a), _numbers(b), strict=True)])


def likeness(a: Column, b: Column) -> Column:
    """The cosine that the share of differing bits of two fingerprints tells, at least 0."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(math.pi / (64 * len(SEEDS))) * distance(a, b)))


def bucketed(docs: DataFrame, column: str = "__bucket") -> DataFrame:
    """docs with the number of the range of ids that a row falls in; null for a null id. There are as many ranges as
    twice the shuffle partitions. Their bounds are one row, in groups, so that a row is compared with a group's first
    bounds and with one group only."""
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = ", ".join(f"{i / ranges:.9f}D" for i in range(1, ranges))
    found = docs.agg(F.expr(f"percentile_approx(cast(doc_id as bigint), array({shares}), {max(10_000, 4 * ranges)})").alias("cuts")).first()["cuts"]
    cuts = sorted(set(found or []))
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    bounds = spark.createDataFrame([([g[0] for g in groups], groups)], "__tops array<bigint>, __groups array<array<bigint>>")
    doc_id = F.col("doc_id").cast("long")
    group = F.size(F.filter("__tops", lambda t: t <= doc_id))
    within = F.size(F.filter(F.get("__groups", group - 1), lambda t: t <= doc_id))
    bucket = F.when(doc_id.isNull(), F.lit(None)).when(group == 0, 0).otherwise((group - 1) * step + within)
    return docs.join(F.broadcast(bounds)).withColumn(column, bucket).drop("__tops", "__groups")


def with_next(rows: DataFrame, tie: str, value: str, into: str, place: str) -> DataFrame:
    """rows (with doc_id, __bucket, and others) and the value of the next row by doc_id, then by `tie`; the first row's
    after the last. Rows without an id have none. place: the row's number in its range."""
    own = rows.where("doc_id is not null").withColumn("__guest", F.lit(False))
    least = own.groupBy("__bucket").agg(F.min("doc_id").alias("__first"))  # one row for each range: bounded
    firsts = own.join(F.broadcast(least.select("__first")), F.col("doc_id") == F.col("__first")).groupBy("__bucket", "doc_id").agg(
        F.min(F.struct(F.col(tie).alias("t"), F.col(value).alias("v"))).alias("__f")
    )
    order = W.orderBy("__bucket")
    after = firsts.select(
        F.coalesce(F.lag("__bucket").over(order), F.max("__bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("__bucket"),
        F.lit(True).alias("__guest"),
        F.col("__f.v").alias(value),
    )
    within = W.partitionBy("__bucket").orderBy("__guest", "doc_id", tie)
    both = own.unionByName(after, allowMissingColumns=True).withColumns(
        {into: F.lead(value).over(within), place: F.row_number().over(within)}
    ).where("not __guest")
    none = {into: F.lit(None).cast(rows.schema[value].dataType), place: F.lit(None).cast("int")}
    alone = rows.where("doc_id is null").withColumns(none)
    return both.drop("__guest").unionByName(alone)


def edited(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text, n_chars, edited (its last half replaced by the beginning of the next document)."""
    own = bucketed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = with_next(own, "text", "text", "__next", "__place")
    half = (F.char_length("text") / 2).cast("int")
    return rows.select(
        "doc_id", "text", "__bucket", "__place", F.char_length("text").cast("long").alias("n_chars"),
        F.concat(
            F.substring(F.col("text"), F.lit(1), F.char_length("text") - half),
            F.coalesce(F.substring(F.col("__next"), F.lit(1), half), F.lit("")),
        ).alias("edited"),
    )


def edit_report(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; and n_near,
    for ids divisible by ASKED: how many other rows have a fingerprint within the radius; null for the rest."""
    rows = edited(docs).select(
        F.monotonically_increasing_id().alias("__row"), "doc_id", "__bucket", "__place", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "text", "edited",
    )
    prints = materialized(with_fingerprints(rows, {"fingerprint": "text", "edited_fingerprint": "edited"}))
    asked = F.col("doc_id").cast("long") % ASKED == 0
    near = near_counts(prints, prints.where(asked), radius).withColumnRenamed("fingerprint", "__asked")
    after = with_next(prints, "__place", "fingerprint", "__next", "__again")
    return after.join(near, (F.col("fingerprint") == F.col("__asked")) & asked, "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(likeness(F.col("fingerprint"), F.col("__next")), F.lit(0.0)).alias("near_next"),
        (F.col("n") - 1).alias("n_near"),
    )


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint of each row's whole text."""
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprints(rows, {"fingerprint": "text"}).drop("__row")


def _tables(prints: DataFrame, name: str, radius: int) -> DataFrame:
    """Each fingerprint once for each choice of AGREE blocks: its name, the table's number and the blocks' bits."""
    blocks, bits = radius + AGREE, 64 * len(SEEDS)
    edges = [bits * i // blocks for i in range(blocks + 1)]
    keys = []
    for chosen in combinations(range(blocks), AGREE):
        mask = sum((1 << edges[b + 1]) - (1 << edges[b]) for b in chosen)
        parts = []
        for i, number in enumerate(_numbers(F.col("fingerprint"))):
            own = mask >> (64 * i) & ((1 << 64) - 1)
            parts.append(number.bitwiseAND(F.lit(own - (1 << 64) if own >= 1 << 63 else own)).alias(f"k{i}"))
        keys.append(F.struct(*parts))
    spread = prints.select(F.col("fingerprint").alias(name), F.posexplode(F.array(*keys)).alias("__table", "__key"))
    return spread.select(name, "__table", *[F.col(f"__key.k{i}").alias(f"__k{i}") for i in range(len(SEEDS))])


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints, queries: different fingerprints. All pairs (q, p, distance) within the radius, q of the queries."""
    key = ["__table", *[f"__k{i}" for i in range(len(SEEDS))]]
    met = _tables(queries, "q", radius).join(_tables(prints, "p", radius), key).select("q", "p", distance(F.col("q"), F.col("p")).alias("distance"))
    return met.where(F.col("distance") <= radius).distinct()


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints, queries: (fingerprint, ...). For each fingerprint of the queries: n, the rows of prints within the radius.
    Classes of equal fingerprints meet, not their rows."""
    classes = prints.groupBy("fingerprint").agg(F.count("*").alias("n"))
    pairs = near_pairs(classes.select("fingerprint"), queries.select("fingerprint").distinct(), radius)
    return pairs.join(classes.withColumnRenamed("fingerprint", "p"), "p").groupBy(F.col("q").alias("fingerprint")).agg(F.sum("n").alias("n"))


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """prints, queries: (doc_id, fingerprint). All pairs (query_id, doc_id, distance) within the radius, rows of equal
    fingerprints expanded; `near_pairs` and `near_counts` give the same links by classes."""
    pairs = near_pairs(prints.select("fingerprint").distinct(), queries.select("fingerprint").distinct(), radius)
    asked = queries.select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("q"))
    return asked.join(pairs, "q").join(prints.select("doc_id", F.col("fingerprint").alias("p")), "p").select("query_id", "doc_id", "distance")
