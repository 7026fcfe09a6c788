"""A prefix tree of token sequences as a table of transitions.

A prefix is named by its length and two numbers, the exclusive or of a hash of each of its tokens with its place; so all
prefixes of a sequence come from one running total, in time linear in its length. A row says which token may follow a
prefix, or that a sequence may end there (null)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .contracts import ContractError

#: Hexadecimal digits of each of a prefix's two numbers: they are below 2 ** 60.
DIGITS = 15


def _codes(token: Column, place: Column) -> list[Column]:
    text = F.md5(F.concat_ws(":", token.cast("string"), place.cast("string")).cast("binary"))
    return [F.conv(F.substring(text, 1 + DIGITS * i, DIGITS), 16, 10).cast("long") for i in range(2)]


def _spread(rows: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, place (from 1), token, x, y: the tokens of sequences with their codes."""
    each = rows.select(key, F.posexplode(tokens).alias("__at", "token")).select(key, (F.col("__at") + 1).alias("place"), "token")
    return each.select("*", *[c.alias(n) for c, n in zip(_codes(F.col("token"), F.col("place")), "xy", strict=True)])


def transitions(sequences: DataFrame, key: str, tokens: str) -> DataFrame:
    """depth, a, b, token, n: how many sequences go on with the token after the prefix (a, b) of that length; a null token
    is their end. Tokens mustn't be null."""
    each = _spread(sequences, key, tokens)
    run = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    state = each.select("place", "token", "x", "y", *[F.bit_xor(c).over(run).alias(n) for c, n in (("x", "a"), ("y", "b"))], F.lead("place").over(W.partitionBy(key).orderBy("place")).isNull().alias("last"))
    before = F.struct((F.col("place") - 1).alias("depth"), F.col("a").bitwiseXOR(F.col("x")).alias("a"), F.col("b").bitwiseXOR(F.col("y")).alias("b"), "token")
    end = F.struct(F.col("place").alias("depth"), "a", "b", F.lit(None).cast(dict(each.dtypes)["token"]).alias("token"))
    steps = state.select(F.inline(F.when(F.col("last"), F.array(before, end)).otherwise(F.array(before))))
    zero = F.lit(0).cast("long")
    none = sequences.where(F.size(tokens) == 0).select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast(dict(each.dtypes)["token"]).alias("token"))
    return steps.union(none).groupBy("depth", "a", "b", "token").agg(F.count("*").alias("n"))


def allowed_next(trie: DataFrame, prefixes: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, token: what may follow each prefix; a null token if a sequence may end there. A prefix that no sequence has is
    an error."""
    total = _spread(prefixes, key, tokens).groupBy(key).agg(F.bit_xor("x").alias("a"), F.bit_xor("y").alias("b"))
    zero = F.lit(0).cast("long")
    states = prefixes.select(key, F.size(tokens).alias("depth")).join(total, key, "left").select(key, "depth", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b"))
    found = states.join(trie.select("depth", "a", "b", "token", "n"), ["depth", "a", "b"], "left")
    bad = found.where("n is null").select(key).take(5)
    if bad:
        raise ContractError(f"Invalid prefixes: {[r[0] for r in bad]}")
    return found.select(key, "token")
