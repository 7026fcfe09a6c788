"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of ten consecutive words of a benchmark item is a pattern. The symbols of the search are words: a table of
shifts by blocks of three words tells how far the scan may jump, blocks that end a pattern select a bucket of patterns,
and a direct comparison confirms an occurrence. Items of fewer words form one pattern each; patterns of each length
have tables of their own.

The patterns are broadcast in blocks of at most `block_bytes` of item text, so that a benchmark of any size is searched
whole. A block's tables number its words and hold one entry for each word of an item. One block is searched without a
shuffle; of several, each is searched and its occurrences are written before the next one is broadcast, and the few
documents with occurrences are joined to the rest.

Defined results: null and empty texts have no words, so no hits; an item without words has no pattern; repeated items
and repeated rows count each for itself, items with one id count once; empty tables give no rows, or rows without hits.
Columns other than text are kept as they are.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary, materialized, words_of

WINDOW = 10
BLOCK = 3
BLOCK_BYTES = 4 << 20
FOUND = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


class WuManber:
    """Patterns of one length: all windows of that many words of items. `search` yields the end (exclusive) and the item of
    each occurrence.

    table: by block, as a number made of its words' numbers, how far to jump, or, below zero, the bucket's place in
    `ends`, which lists the places of a block that ends patterns, by block, each list with its last one negated."""

    def __init__(self, items: list[array], length: int, words: int):
        self.length, self.block, self.items, self.base = length, min(BLOCK, length), items, words + 1
        jump = length - self.block + 1
        self.table: dict[int, int] = {}
        places: list[tuple[int, int, int]] = []
        for item, ids in enumerate(items):
            for end in range(self.block, len(ids) + 1):
                key = self._key(ids[end - self.block : end])
                if end < length:
                    self.table[key] = min(self.table.get(key, jump), length - end)
                else:
                    places.append((key, item, end))
        places.sort()
        self.of = array("i", [item for _, item, _ in places])
        self.ends = array("i", [end for _, _, end in places])
        last = None
        for at, (key, _, _) in enumerate(places):
            if key != last:
                if last is not None:
                    self.ends[at - 1] *= -1
                self.table[key] = ~at
                last = key
        if places:
            self.ends[-1] *= -1

    def _key(self, ids: Iterable[int]) -> int:
        key = 0
        for i in ids:
            key = key * self.base + i
        return key

    def search(self, words: list[bytes], ids: dict[bytes, int]) -> Iterator[tuple[int, int]]:
        block, length, base, table = self.block, self.length, self.base, self.table.get
        jump, at, n = length - block + 1, length, len(words)
        while at <= n:
            key = 0
            for place in range(at - block, at):
                i = ids.get(words[place])
                if i is None:  # no pattern reaches over a word that no item has
                    at = place + 1 + length
                    break
                key = key * base + i
            else:
                found = table(key, jump)
                if found > 0:
                    at += found
                    continue
                window, slot = None, ~found
                while True:
                    end = abs(self.ends[slot])
                    if window is None:
                        window = array("i", [ids.get(w, -1) for w in words[at - length : at]])
                    if self.items[self.of[slot]][end - length : end] == window:
                        yield at, self.of[slot]
                    if self.ends[slot] < 0:
                        break
                    slot += 1
                at += 1


class Machines:
    """The search tables of a block of items (id, text), one for each pattern length."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, tuple[list[str], list[array]]] = {}
        for item_id, raw in items:
            if words := words_of(raw):
                names, numbers = by_length.setdefault(min(window, len(words)), ([], []))
                names.append(item_id)
                numbers.append(array("i", [self.ids.setdefault(w, len(self.ids) + 1) for w in words]))
        self.tables = [(names, WuManber(numbers, size, len(self.ids))) for size, (names, numbers) in sorted(by_length.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words that patterns cover, and the ids of their items."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for names, table in self.tables:
            for end, item in table.search(words, self.ids):
                spans.append((end - table.length, end))
                items.add(names[item])
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, bytes]]]]:
    """The number of blocks of about block_bytes, and the items of each, read one block at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("raw")
    ).where("raw is not null")
    total = items.agg(F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total // block_bytes))
    of = F.pmod(F.xxhash64("item", "raw"), F.lit(blocks))
    return blocks, ([(r.item, bytes(r.raw)) for r in items.where(of == k).toLocalIterator()] for k in range(blocks))


def with_occurrences(
    docs: DataFrame, benchmark: DataFrame, column: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with `column`: the number of words, the word spans that windows cover, merged, and the ids of the items
    that occur."""
    context = docs.sparkSession.sparkContext
    blocks, items = _item_blocks(benchmark, block_bytes)
    if blocks == 1:
        return docs.withColumn(column, _search_udf(context.broadcast(next(items)), window)(F.col("text")))
    rows = materialized(docs.withColumn("__searched", F.monotonically_increasing_id()))
    hits = []
    for block in items:
        sent = context.broadcast(block)
        found = rows.select("__searched", _search_udf(sent, window)(F.col("text")).alias("f"))
        hits.append(materialized(found.where(F.size("f.items") > 0)))
        sent.destroy()
    all_hits = hits[0]
    for h in hits[1:]:
        all_hits = all_hits.union(h)
    listed = all_hits.groupBy("__searched").agg(F.collect_list("f").alias("__found"))  # at most one a block
    joined = rows.join(listed, "__searched", "left").withColumn(column, _merge_udf()(F.col("text"), F.col("__found")))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if c != column], F.col(column))


def _as_found(rows: list[tuple]) -> pa.Array:
    n, starts, ends, found = zip(*rows, strict=True) if rows else ((), (), (), ())
    ints, names = pa.list_(pa.int32()), pa.list_(pa.string())
    return pa.StructArray.from_arrays(
        [pa.array(n, pa.int64()), pa.array(starts, ints), pa.array(ends, ints), pa.array(found, names)],
        ["n_words", "starts", "ends", "items"],
    )


_ready: dict[str, Machines] = {}


def _search_udf(sent, window: int):
    key = uuid.uuid4().hex

    @arrow_udf(FOUND)
    def search(text: pa.Array) -> pa.Array:
        if key not in _ready:  # a worker keeps the tables of one block at a time
            _ready.clear()
            _ready[key] = Machines(sent.value, window)
        rows = []
        for raw in as_binary(text):
            words = words_of(raw)
            spans, items = _ready[key].search(words)
            spans = merged(spans)
            rows.append((len(words), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
        return _as_found(rows)

    return search.asNondeterministic()


def _merge_udf():
    @arrow_udf(FOUND)
    def merge(text: pa.Array, found: pa.Array) -> pa.Array:
        rows = []
        for raw, parts in zip(as_binary(text), found.to_pylist(), strict=True):
            spans = merged([span for p in parts or () for span in zip(p["starts"], p["ends"], strict=True)])
            items = {item for p in parts or () for item in p["items"]}
            rows.append((len(words_of(raw)), [s for s, _ in spans], [e for _, e in spans], sorted(items)))
        return _as_found(rows)

    return merge.asNondeterministic()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the item ids themselves."""
    found = with_occurrences(docs.select("doc_id", "text"), benchmark, "found", window).select("doc_id", "found.*")
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate(
            F.zip_with("starts", "ends", lambda s, e: e - s), F.lit(0).cast("long"), lambda a, x: a + x
        ).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
        F.col("items").alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents in which no benchmark window occurs, with their columns as they are."""
    mark = "__benchmark_occurrences"
    found = with_occurrences(docs, benchmark, mark, window)
    return found.where(F.size(f"{mark}.items") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
