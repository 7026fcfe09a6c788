"""SimHash near-duplicate detection by meet-in-the-middle ball hashing.

A document's 64-bit fingerprint is the majority vote of the XXH64 hashes of its four-word shingles. Two fingerprints at
a distance of at most 2r have a common variant at a distance of at most r from both. So each distinct fingerprint
emits all variants within r, and equal variants collide. All members of one collision are within 2r of each other, so
linking each to the smallest keeps every component without emitting pairs.

The variants are dealt out by their leading bits: a fingerprint is sent once to each prefix that one of its variants
has, and the task of the prefix spells out and sorts only the variants that begin with it. The shuffle then carries
a few dozen rows for each fingerprint, not two thousand, and no collision is lost. Equal texts and equal fingerprints
are merged before. A prefix holds about `variants_per_prefix` variants whatever the input's size: the number of leading
bits is derived from the number of distinct fingerprints.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated rows share their
component; a null doc_id takes part but never names a component, unless all ids of the component are null.
"""

from __future__ import annotations

import functools
import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary, materialized
from .components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
VARIANTS_PER_PREFIX = 2_000_000


def fingerprint_of(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority vote over the hashes of the shingles, repeats included; zero without words."""
    words = raw.lower().split() if raw else []  # lowers A-Z and splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[shingle - 1 :] - 1).tolist()
    starts = [0, *ends[: len(words) - shingle].tolist()]
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(majority.view("<u8")[0])


def _fingerprints(text: pa.Array) -> pa.Array:
    values = np.array([fingerprint_of(raw) for raw in as_binary(text)], dtype=np.uint64)
    return pa.array(values.view(np.int64), pa.int64())


def _fingerprint_column():
    return arrow_udf(_fingerprints, "bigint").asNondeterministic()(F.col("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""
    return docs.select("doc_id", _fingerprint_column().alias("fp"))


@functools.lru_cache(64)
def flips(bits: int, most: int) -> np.ndarray:
    """Masks of up to `most` set bits out of the lowest `bits`, the empty one first."""
    masks = [sum(1 << b for b in chosen) for k in range(most + 1) for chosen in combinations(range(bits), k)]
    return np.array(masks, dtype=np.uint64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links a, b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            break
    return root


def _collide(fp: np.ndarray, prefix: int, bits: int, radius: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the indexes of fp whose variants that begin with the prefix collide: each member of a collision
    to the smallest one, verified."""
    rest = 64 - bits
    away = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(prefix))
    tails = fp & np.uint64((1 << rest) - 1)
    variants, owners = [], []
    for spent in range(radius + 1):
        near = np.flatnonzero(away == spent)
        if len(near):
            masks = flips(rest, radius - spent)
            variants.append((tails[near][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(near.astype(np.int32), len(masks)))
    if not variants:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    values, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(values)
    values, owners = values[order], owners[order]
    same = values[1:] == values[:-1]
    shared = np.r_[same, False] | np.r_[False, same]  # only variants that collide go on
    values, owners = values[shared], owners[shared]
    if not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    first = np.r_[True, values[1:] != values[:-1]]
    heads = owners[np.maximum.accumulate(np.where(first, np.arange(len(values)), 0))]
    pairs = np.unique(owners[owners != heads].astype(np.int64) << 32 | heads[owners != heads])
    a, b = pairs >> 32, pairs & 0xFFFFFFFF
    close = np.bitwise_count(fp[a] ^ fp[b]) <= distance
    return a[close], b[close]


def _collisions(prefix_bits: int, radius: int, distance: int, most: int):
    each = sum(math.comb(64, k) for k in range(radius + 1))

    def within(group: pd.DataFrame) -> pd.DataFrame:
        """Links of one prefix. A prefix of many fingerprints is gone through in slices of longer prefixes, so that at
        most about `most` variants are held at once."""
        fp = np.unique(group["fp"].to_numpy()).view(np.uint64)
        prefix = int(group["prefix"].iloc[0])
        more = max(0, min(16, math.ceil(math.log2(max(1, len(fp) * each / most)))))
        a, b = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in range(1 << more):
            c, d = _collide(fp, prefix << more | part, prefix_bits + more, radius, distance)
            root = _roots(len(fp), np.r_[a, c], np.r_[b, d])
            a = np.flatnonzero(root != np.arange(len(fp)))
            b = root[a]
        signed = fp.view(np.int64)
        return pd.DataFrame({"a": signed[a], "b": signed[b]})

    return within


def links(prints: DataFrame, distance: int = DISTANCE, variants_per_prefix: int = VARIANTS_PER_PREFIX) -> DataFrame:
    """prints: distinct fingerprints `fp`. Pairs (a, b) that connect just the fingerprints that a chain of pairs within
    the distance connects."""
    if distance % 2:  # members of one collision are within twice the radius, an even number, of each other
        raise ValueError("The distance must be even")
    radius = distance // 2
    emitted = prints.count() * sum(math.comb(64, k) for k in range(radius + 1))
    prefix_bits = min(24, max(6, math.ceil(math.log2(max(1, emitted / variants_per_prefix)))))
    masks = F.array(*[F.lit(int(m)) for m in flips(prefix_bits, radius)])
    dealt = prints.select(
        "fp",
        F.explode(
            F.transform(masks, lambda m: F.shiftrightunsigned(F.col("fp"), 64 - prefix_bits).bitwiseXOR(m))
        ).alias("prefix"),
    )
    within = _collisions(prefix_bits, radius, distance, 4 * variants_per_prefix)
    return dealt.groupBy("prefix").applyInPandas(within, "a long, b long").distinct()


def _classes(distinct: DataFrame, distance: int) -> DataFrame:
    """distinct: one row for each fingerprint `fp`. The same rows with `component`, a fingerprint of their component."""
    parts = connected_components(links(distinct.select("fp"), distance))
    return distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        *distinct.columns, F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest reachable doc_id)."""
    prints = materialized(fingerprints(docs))
    classes = materialized(_classes(materialized(prints.groupBy("fp").agg(F.min("doc_id").alias("least"))), distance))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "component").select("fp", "component_id")
    return prints.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component stays, with its columns as they are: the one with the smallest doc_id, rows without
    one last; of rows that repeat it, any one."""
    marked = materialized(
        docs.withColumns({"__fp": _fingerprint_column(), "__row": F.monotonically_increasing_id()})
    )
    first = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__row").alias("r"))
    distinct = materialized(marked.groupBy(F.col("__fp").alias("fp")).agg(F.min(first).alias("first")))
    kept = _classes(distinct, distance).groupBy("component").agg(F.min("first").alias("first"))
    rows = marked.join(kept.select(F.col("first.r").alias("__row")), "__row", "left_semi")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
