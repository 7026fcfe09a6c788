"""Phrases of words that come together more often than chance would have it, by language.

Texts are lower-cased (A-Z) and split into pieces at punctuation and line ends, and those into words at blanks. A phrase of
2 to `most` words that occurs `least` times or more is a candidate. Cutting it in two gives floor(1000 a n / (l r)): a, l
and r are the occurrences of phrase and parts, n of all words of the language. The cut of the lowest score counts.

Documents are packed by language into chunks (`chunks_of`), a table of the shared folder: a chunk has its own dictionary,
and its words as numbers, with 0 between pieces. Words of all chunks' dictionaries are counted, those that occur `least`
times get ids from 1 up (`dictionary`). A small dictionary goes to all tasks; beyond a bound, each chunk gets the ids of
its own words back. Elsewhere pieces are broken (`encoded`). What may be frequent is dealt out by language to a few tasks a core; a
task's different n-grams are packed into fixed-width keys of 4 bytes an id, big-endian, and added up while a bounded number
fits (`grams_of`). Spark partitions the keys by range and sorts them by their leading bytes; a pass over the sorted keys adds
up equal neighbours (`run_lengths`). A frequent key is one row for each task, however often it occurs.

Most n-grams are rare and needn't be sent: tables count pairs, then longer n-grams, each at two places by hash
(`_sketched`), and an n-gram goes only if both of its places, and the n-grams in it, reach `least`. A rare n-gram then goes
at the square of the share of full places, so tables have places in proportion to the words: a table of a fixed size fills
up as the input grows, and rules out ever fewer. Places are sent as gaps, and tasks add up a few slices of a table each; all
tasks get a bit a place. Words in no pair that may be frequent go before the rest is dealt out (`_trimmed`). What is sent is
counted exactly; a full table sends more, and loses nothing.

Candidates, their parts and their words meet by joins. Numbers are decimals of 38 digits, exact up to 10^17 words a
language. Within a language the first `top` are chosen in parts, then among those.

Defined results: null texts are empty, a null language is `und`; repeated rows count each; without a candidate there are
no rows. Other columns are not read. More than 2^32 - 1 frequent words are an error.
"""

from __future__ import annotations

from collections import defaultdict
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_binary, discard, materialized

CHUNK_BYTES = 8 << 20
SPLIT_BYTES = 1 << 20
#: A dictionary of so many bytes or less is sent to all tasks.
DICTIONARY_BYTES = 32 << 20
#: n-grams of so many bytes of ids are counted at once.
GROUP_BYTES = 2 << 20
#: Ids are dealt out in rows of about so many bytes, and come to Python in batches of so many.
PART_BYTES = 256 << 10
BATCH_BYTES = 8 << 20
#: A task holds counts of so many n-grams, and sends them in batches of SENT_ROWS.
HELD_ROWS = 1_000_000
SENT_ROWS = 1 << 16
#: Keys compress well, so compressed files would be read by few tasks that sort many rows each.
PLAIN = {"compression": "uncompressed", "parquet.block.size": 8 << 20}
TASKS_A_CORE = 2
SALTS = 64
#: A-Z become lower-case, a tab a blank, and what ends a piece a full stop.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 0x20 if b == 9 else 0x2E if b in b".,;:!?" or 10 <= b <= 13 else b for b in range(256))
SHIFT = np.int64(32)
#: The tables that rule n-grams out have 2 ** BITS places for each of WAYS hashes, or as many more that there are at most
#: WORDS_A_PLACE frequent words for each. They are counted in SLICES slices, or in more of at most SLICE places.
BITS = 22
WORDS_A_PLACE = 32
WAYS = 2
SLICES = 64
SLICE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def _batches(spark: SparkSession, most_bytes: int):
    """What is run meanwhile gets Arrow batches of about most_bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, most_bytes)
    try:
        yield
    finally:
        spark.conf.set(name, was)


class _Chunk:
    """A language's words so far: numbers by word, from 1 up, and the text as numbers."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ids[b"."]  # is 0
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        words = text.translate(FOLD).replace(b".", b" . ").split()
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(text)

    def row(self, lang: str, number: int) -> pa.RecordBatch:
        tokens = np.concatenate([*self.tokens, np.zeros(1, np.int32)])
        counts = np.bincount(tokens, minlength=len(self.ids))[1:]
        columns = [
            pa.array([lang]), pa.array([number]), pa.array([list(self.ids)[1:]], pa.list_(pa.binary())),
            pa.array([counts], pa.list_(pa.int64())), pa.array([tokens.astype("<i4").tobytes()], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "words", "counts", "tokens"])


def _slices(text: bytes, split_bytes: int = SPLIT_BYTES):
    """The text in slices of about split_bytes that end where a piece ends."""
    done = 0
    while len(text) - done > split_bytes:
        ends = max(text.rfind(mark, done, done + split_bytes) for mark in (b".", b",", b"\n", b";", b":", b"!", b"?", b"\r"))
        if ends < 0:  # a piece that long is taken whole
            ends = min((e for mark in (b".", b",", b"\n") if (e := text.find(mark, done)) >= 0), default=len(text))
        yield text[done : ends + 1]
        done = ends + 1
    yield text[done:]


def chunks_of(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, chunk, words, counts, tokens: chunks of about chunk_bytes of one language. A task holds four such chunks'
    bytes at most before it sends all on as they are. To be written once: the numbers of chunks are those of the tasks that
    made them."""
    split_bytes, held_bytes = min(SPLIT_BYTES, chunk_bytes), 4 * chunk_bytes

    def pack(batches):
        base = TaskContext.get().partitionId() << 32
        made, held = 0, 0
        open_: dict[str, _Chunk] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                waiting: list[bytes] = []
                size = 0
                for part in (s for t in texts for s in _slices(t, split_bytes)):
                    waiting.append(part + b".")
                    size += len(part)
                    if size >= split_bytes:
                        open_.setdefault(lang, _Chunk()).add(b"".join(waiting))
                        held, size = held + size, 0
                        waiting.clear()
                        if open_[lang].size >= chunk_bytes:
                            held -= open_[lang].size
                            yield open_.pop(lang).row(lang, base + made)
                            made += 1
                if waiting:
                    open_.setdefault(lang, _Chunk()).add(b"".join(waiting))
                    held += size
            if held >= held_bytes:
                for lang in list(open_):
                    yield open_.pop(lang).row(lang, base + made)
                    made += 1
                held = 0
        for lang, chunk in open_.items():
            yield chunk.row(lang, base + made)
            made += 1

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(pack, "lang string, chunk long, words array<binary>, counts array<long>, tokens binary")


def dictionary(chunks: DataFrame, least: int) -> DataFrame:
    """id, lang, word, f of the words that occur `least` times or more in a language; ids from 1 up. A written table."""
    each = chunks.select("lang", F.inline(F.arrays_zip("words", "counts"))).select("lang", F.col("words").alias("word"), F.col("counts").alias("n"))
    frequent = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    numbered = materialized(frequent.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each task
    first = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("first"), F.sum("n").over(W.partitionBy()).alias("all"))
    index = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    fits = F.when(F.col("all") < 1 << 32, F.col("first") + index + 1).otherwise(F.raise_error(F.lit("Too many frequent words")))
    return numbered.withColumn("part", part).join(F.broadcast(first), "part").select(fits.cast("long").alias("id"), "lang", "word", "f")


def encoded(chunks: DataFrame, frequent: DataFrame, most_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, chunk, ids: the words of chunks as ids; runs of rare words are a 0, and words alone between such are left out. A
    dictionary of most_bytes or less goes to all tasks; with a larger one, each chunk gets the ids of its own words by a
    join."""
    size = frequent.agg(F.coalesce(F.sum(F.octet_length("word") + 24), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= most_bytes:
        table = frequent.select("lang", "word", "id").toArrow()
        known = {lang: table.filter(pc.equal(table["lang"], lang)).select(["word", "id"]).combine_chunks() for lang in table["lang"].unique().to_pylist()}

        def encode_by_all(batches):
            for batch in batches:
                out = []
                for lang, words, raw in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    ids = np.zeros(len(words) + 1, np.uint32)
                    if lang in known:
                        at = pc.index_in(words.values, known[lang]["word"].combine_chunks())
                        found = at.is_valid().to_numpy(zero_copy_only=False)
                        ids[1:][found] = known[lang]["id"].to_numpy()[at.drop_null().to_numpy()]
                    out.append(_runs(ids[np.frombuffer(raw.as_py(), "<i4")]).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.binary())], ["lang", "chunk", "ids"])

        return chunks.select("chunk", "lang", "words", "tokens").mapInArrow(encode_by_all, "lang string, chunk long, ids binary")
    words = chunks.select("lang", "chunk", F.posexplode("words").alias("local", "word"))
    own = words.join(frequent.select("lang", "word", "id"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("own"))
    pairs = own.select("chunk", F.col("own.local").alias("local"), F.col("own.id").alias("id"))

    def encode(batches):
        for batch in batches:
            lang, chunk, tokens, local, id_ = (batch.column(i) for i in range(5))
            out = []
            for raw, keys, values in zip(tokens, local, id_, strict=True):
                tokens_ = np.frombuffer(raw.as_py(), "<i4")
                ids = np.zeros(tokens_.max(initial=0) + 1, np.uint32)
                ids[keys.values.to_numpy() + 1] = values.values.to_numpy()
                out.append(_runs(ids[tokens_]).tobytes())
            yield pa.RecordBatch.from_arrays([lang, chunk, pa.array(out, pa.binary())], ["lang", "chunk", "ids"])

    met = chunks.select("lang", "chunk", "tokens").join(pairs, "chunk").select("lang", "chunk", "tokens", "local", "id")
    return met.mapInArrow(encode, "lang string, chunk long, ids binary")


def _runs(ids: np.ndarray) -> np.ndarray:
    """ids without those that have no neighbour, and with one 0 between runs."""
    some = np.concatenate([[False], ids > 0, [False]])
    beside = some[1:-1] & (some[:-2] | some[2:])
    stays = beside.copy()
    stays[1:] |= beside[:-1]  # what comes after a run
    return np.where(beside, ids, 0)[stays].astype("<u4")


def _hashes(ids: np.ndarray, most: int):
    """For sizes from 2 up: the size and the hashes of the n-grams that begin at each place."""
    words = ids.astype(np.uint64)
    rolled = words
    for size in range(2, most + 1):
        if len(rolled) < 2:
            return
        rolled = (rolled[:-1] * MULTIPLIER ^ words[size - 1 :]) * MULTIPLIER
        rolled ^= rolled >> np.uint64(31)
        yield size, rolled


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The places of n-grams by each of WAYS hashes: neighbouring bits of a product."""
    mixed = hashes * MULTIPLIER
    return [(mixed << np.uint64(way * bits) >> np.uint64(64 - bits)).astype(np.int64) for way in range(WAYS)]


def _alive(ids: np.ndarray, most: int, tables: list[np.ndarray]):
    """For sizes from 2 up: the size, the hashes, and whether the n-gram that begins at a place may be frequent by what
    it holds and, as far as there are tables, by its own places. tables: of pairs, of longer n-grams, each a row of packed
    bits for each hash."""
    before = ids > 0
    for size, hashes in _hashes(ids, most):
        alive = before[:-1] & before[1:]
        if len(tables) > min(size, 3) - 2:
            at = np.flatnonzero(alive)
            table = tables[min(size, 3) - 2]
            full = np.ones(len(at), bool)
            for own, places in zip(table, _places(hashes[at], table.shape[1].bit_length() + 2), strict=True):
                full &= (own[places >> 3] << (places & 7) & 0x80) > 0
            alive[at] = full
        yield size, hashes, alive
        before = alive


def _bits(frequent: DataFrame) -> int:
    """The bits of a place for a dictionary's occurrences; 32 at most."""
    words = frequent.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()["n"]
    return min(max(BITS, (-(-words // WORDS_A_PLACE) - 1).bit_length()), 32)


def _gaps(places: np.ndarray) -> bytes:
    """Sorted numbers as the bytes of their gaps; a gap of 255 or more has bytes of 255 first."""
    gaps = np.diff(places, prepend=places.dtype.type(0))
    ends = np.cumsum(gaps // 255 + 1, dtype=np.int64)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = gaps % 255
    return out.tobytes()


def _from_gaps(data) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8)
    return np.cumsum(gaps, dtype=np.int64)[gaps < 255]


def _sketched(chunks: DataFrame, sizes: range, tables: list[np.ndarray], least: int, bits: int = BITS) -> np.ndarray:
    """Which places of WAYS tables of 2 ** bits have `least` n-grams of these sizes or more: an n-gram at another place occurs
    less often. A task sends the places of a group of ids in slices, sorted, as gaps; tasks add up slices, and the driver
    gets one bit a place."""
    slice_ = min(max((1 << bits) // SLICES, 8), SLICE)
    slices = (1 << bits) // slice_
    known = chunks.sparkSession.sparkContext.broadcast(tables)

    def count(batches):
        for raw in _groups(batches, GROUP_BYTES):
            found: list[list[np.ndarray]] = [[] for _ in range(WAYS)]
            for size, hashes, alive in _alive(np.frombuffer(raw, "<u4"), sizes[-1], known.value):
                if size in sizes:
                    for own, places in zip(found, _places(hashes[alive], bits), strict=True):
                        own.append(places.astype(np.uint32))
            for way, own in enumerate(found):
                places = np.sort(np.concatenate([*own, np.zeros(0, np.uint32)]))
                cuts = [*np.searchsorted(places, (np.arange(slices) * slice_).astype(np.uint32)).tolist(), len(places)]
                at = [i for i in range(slices) if cuts[i] < cuts[i + 1]]
                out = [_gaps(places[cuts[i] : cuts[i + 1]] - np.uint32(i * slice_)) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array([way * slices + i for i in at], pa.int64()), pa.array(out, pa.binary())], ["slice", "gaps"])

    def add_up(batches):
        tables_: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places = _from_gaps(raw.as_buffer())
                own = tables_[at] if at in tables_ else tables_.setdefault(at, np.zeros(slice_, np.int64))
                if len(places) > slice_ // 16:
                    own += np.bincount(places, minlength=slice_)
                else:
                    np.add.at(own, places, 1)
        full = [np.packbits(t >= least).tobytes() for t in tables_.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(tables_), pa.int64()), pa.array(full, pa.binary())], ["slice", "bits"])

    sums = chunks.select("ids").mapInArrow(count, "slice long, gaps binary").repartition("slice").mapInArrow(add_up, "slice long, bits binary")
    out = np.zeros((WAYS * slices, slice_ // 8), np.uint8)
    for row in sums.collect():
        out[row.slice] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(WAYS, -1)


def _cut(ids: np.ndarray, most: int):
    """ids in parts that end before the first 0 after `most`."""
    ends = np.flatnonzero(ids == 0)
    done = 0
    while (at := np.searchsorted(ends, done + most)) < len(ends):
        yield ids[done : ends[at]]
        done = ends[at] + 1
    yield ids[done:]


def _groups(batches, group_bytes: int):
    """The ids of chunks in groups of about group_bytes, a 0 after each chunk; larger chunks are cut at a 0."""
    held, size = [], 0
    for batch in batches:
        for raw in batch.column(0):
            for part in _cut(np.frombuffer(raw.as_buffer(), "<u4"), group_bytes // 4):
                held += [part.tobytes(), bytes(4)]
                size += part.nbytes
                if size >= group_bytes:
                    yield b"".join(held)
                    held, size = [], 0
    yield b"".join(held)


def _trimmed(chunks: DataFrame, tables: list[np.ndarray], part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, chunk, ids without the words of no pair that may be frequent, in rows of about part_bytes."""
    known = chunks.sparkSession.sparkContext.broadcast(tables)

    def trim(batches):
        for batch in batches:
            for lang, chunk, raw in zip(*batch.columns, strict=True):
                parts: list[bytes] = []
                for ids in _cut(np.frombuffer(raw.as_buffer(), "<u4"), GROUP_BYTES // 4):
                    stays = np.zeros(len(ids), bool)
                    for _, _, alive in _alive(ids, 2, known.value):
                        stays[:-1] = alive
                        stays[1:] |= alive
                    parts += [p.tobytes() for p in _cut(_runs(np.where(stays, ids, 0)), part_bytes // 4) if len(p)]
                columns = [pa.array([x.as_py()] * len(parts), x.type) for x in (lang, chunk)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], ["lang", "chunk", "ids"])

    return chunks.select("lang", "chunk", "ids").mapInArrow(trim, "lang string, chunk long, ids binary")


def grams_of(chunks: DataFrame, most: int, tables: list[np.ndarray], group_bytes: int = GROUP_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """key, n: the different n-grams of 2 to `most` ids of each task that may be frequent. A task counts its chunks in groups of
    about group_bytes and adds groups up; it holds held_rows and a group's before it sends what it has. There are a few tasks
    for each core, with chunks of neighbouring languages, so that an n-gram goes about as often however many chunks there are."""
    known = chunks.sparkSession.sparkContext.broadcast(tables)

    def count(batches):
        held, rows = [], 0
        for raw in _groups(batches, group_bytes):
            ids = np.frombuffer(raw, "<u4").astype(np.int64)
            rank = ids  # of the n-gram that begins at a place
            for size, _, alive in _alive(ids, most, known.value):
                places = np.flatnonzero(alive)
                _, first, inverse, n = np.unique(rank[places] << SHIFT | ids[places + size - 1], return_index=True, return_inverse=True, return_counts=True)
                begins = places[first]
                held.append(pa.table([_packed([ids[begins + i] for i in range(size)], most), pa.array(n)], ["key", "n"]))
                rows += len(n)
                rank = np.zeros(len(alive), np.int64)
                rank[places] = inverse + 1
                if rows > held_rows:
                    held = [_summed(held)]
                    rows = held[0].num_rows
                    if rows > held_rows * 3 // 4:
                        yield from held.pop().to_batches(SENT_ROWS)
                        rows = 0
        if held:
            yield from _summed(held).to_batches(SENT_ROWS)

    dealt = chunks.repartitionByRange(TASKS_A_CORE * chunks.sparkSession.sparkContext.defaultParallelism, "lang", "chunk")
    return dealt.select("ids").mapInArrow(count, "key binary, n long")


def _summed(tables: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(tables).group_by("key", use_threads=False).aggregate([("n", "sum")])
    pa.default_memory_pool().release_unused()
    return sums.select(["key", "n_sum"]).rename_columns(["key", "n"])


def _packed(ids: list[np.ndarray], width: int) -> pa.Array:
    """Keys of `width` ids, padded by zeros."""
    size = len(ids[0])
    table = np.zeros((size, width), ">u4")
    for i, column in enumerate(ids):
        table[:, i] = column
    ends = np.arange(size + 1, dtype=np.int32) * (4 * width)
    return pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), pa.py_buffer(table.tobytes())])


def run_lengths(counts: DataFrame, least: int, width: int) -> DataFrame:
    """key, f of the keys that occur `least` times or more. counts: key, n. They are partitioned by range and sorted; a
    task adds up equal neighbours and holds no more than a batch."""

    def add_up(batches):
        last, total = None, 0  # the key that the batch before ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(0)
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            keys = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(column), 4 * width)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            sums = np.add.reduceat(batch.column(1).to_numpy(), starts)
            out = []
            if keys[0].tobytes() == last:
                sums[0] += total
            elif total >= least:
                out.append((last, total))
            own = np.flatnonzero(sums[:-1] >= least)  # the last run may go on
            out += zip((keys[starts[i]].tobytes() for i in own), sums[own].tolist(), strict=True)
            last, total = keys[-1].tobytes(), int(sums[-1])
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([f for _, f in out], pa.int64())], ["key", "f"])
        if total >= least:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([total])], ["key", "f"])

    return counts.select("key", "n").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(add_up, "key binary, f long")


def _bytes(key: Column, first: Column | int, count: Column | int) -> Column:
    """ids first to first + count - 1 of a key."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(key, lit(first) * 4 - 3, lit(count) * 4)


def collocations(
    docs: DataFrame, least: int = 100, most: int = 5, percent: int = 100, top: int = 2000, chunk_bytes: int = CHUNK_BYTES,
    bits: int | None = None, dictionary_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language by score, a, phrase. A candidate is dropped
    if a longer one that holds it occurs at least `percent` per cent as often. docs: lang, text. chunk_bytes, bits and
    dictionary_bytes change the work only: the sizes of chunks, of the tables that rule n-grams out, and of a dictionary
    that all tasks get."""
    if not (least >= 1 and 2 <= most and top >= 1):
        raise ValueError("least and top must be 1 or more, most 2 or more")
    chunks = materialized(chunks_of(docs, chunk_bytes))
    words = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    totals = materialized(words)
    frequent = materialized(dictionary(chunks, least))
    ids = materialized(encoded(chunks, frequent, dictionary_bytes))
    discard(chunks)
    bits = bits or _bits(frequent)
    with _batches(docs.sparkSession, BATCH_BYTES):
        tables = [_sketched(ids, range(2, 3), [], least, bits)]
        trimmed = materialized(_trimmed(ids, tables))
        discard(ids)
        if most > 2:
            tables.append(_sketched(trimmed, range(3, most + 1), tables, least, bits))
        sent = materialized(grams_of(trimmed, most, tables), **PLAIN)  # once: ranges are sampled from what is sent
    whole = run_lengths(sent, least, most)
    size = sum((F.when(_bytes(F.col("key"), i, 1) != F.lit(b"\0\0\0\0"), 1).otherwise(0) for i in range(1, most + 1)), F.lit(0))
    grams = materialized(whole.withColumn("size", size).select(_bytes(F.col("key"), 1, F.col("size")).alias("key"), "size", "f"))
    discard(trimmed, sent)
    single = frequent.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("key"), "f")
    parts = single.union(grams.where(F.col("size") < most).select("key", "f"))

    inner = grams.where("size > 2").select("key", "f", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part"))
    inner = inner.select("key", "f", "part", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part") + 1)).alias("first"))
    held = inner.groupBy(_bytes(F.col("key"), F.col("first"), F.col("part")).alias("key")).agg(F.max("f").alias("around"))
    kept = grams.join(held, "key", "left").where(F.coalesce(100 * F.col("around") < percent * F.col("f"), F.lit(True))).drop("around")

    spelled = kept.select("key", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("i"))
    spelled = spelled.withColumn("id", F.conv(F.hex(_bytes(F.col("key"), F.col("i"), 1)), 16, 10).cast("long")).join(frequent.select("id", "lang", "word"), "id")
    phrases = spelled.groupBy("key").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("i", F.col("word").cast("string").alias("word")))).alias("w"))
    phrases = phrases.select("key", "lang", F.array_join("w.word", " ").alias("phrase"))

    cuts = kept.select("key", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", _bytes(F.col("key"), 1, F.col("k")).alias("left"), _bytes(F.col("key"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda k, v: parts.select(F.col("key").alias(k), F.col("f").alias(v))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right").join(phrases, "key").join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    score = F.call_function("div", (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide["l"] * wide["r"]).cast("decimal(38,0)"))
    best = cuts.withColumn("score", score.cast("long")).groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), *[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")])
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt", F.crc32(F.col("phrase").cast("binary")) % SALTS)
    for by in (["lang", "salt"], ["lang"]):
        salted = salted.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return salted.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
