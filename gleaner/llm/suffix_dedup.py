"""Exact removal of repeated passages by prefix doubling over sampled suffixes.

Removed is each byte that a string of `LENGTH` bytes covers which also starts somewhere else, in any document. A shuffle
can't carry every suffix of a corpus, so the suffixes are sampled, in a way that equal strings sample equally: a position
is an anchor if the hash of its GRAM bytes is the least of SPAN neighbouring positions. Any WINDOW bytes hold an anchor,
and any LENGTH bytes at least two, that they alone determine.

1. Copies. Of rows with the same text one takes part in the steps below. The others, and it, are repeated as a whole.
2. Doubling. Anchors whose GRAM bytes occur once are dropped. A text falls into phrases from one anchor to the next;
   Spark sorts the phrases' names and ranks them, then sorts the pairs of a position's rank and that of the position 1,
   2, 4, ... phrases further on and ranks them anew. A position leaves when its pair is unique, or when its phrases are
   past LENGTH bytes; the doubling ends when none is left. Ranked are the different pairs, counted before the shuffle, so
   that a phrase which a third of all rows has is one row of the sort; the join that hands ranks back may be split.
3. Runs. The windows of LENGTH bytes with the same first and last anchor form a run. It is a candidate if the phrases
   at both of its ends have ranks, and if its core, the string from the first to the last anchor, occurs in another
   run. If the run's whole string occurs twice, all its windows are repeated.
4. Edges. What is left are windows at the ends of repeated passages. They are compared one by one, with each other
   and with one copy of each repeated run that has the same core. Equal strings have equal cores, so all comparisons
   are of two independent 64-bit hashes, of the string and of its core.

`n_shared_words` tells of passages across documents: the words in strings of PASSAGE words, of WINDOW bytes at least, that
another document has as well. They are found from the anchors that two texts have, and compared window by window.

Passages are short lists by document that meet the texts a few times, by a broadcast while they are below
`BROADCAST_BYTES` and by a shuffle beyond. Counting is pre-aggregated; no group of equal strings is gathered.

Defined results: null texts are empty; texts shorter than LENGTH lose nothing; repeated rows repeat each other, so
they lose all that is long enough; an empty table gives no rows. Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_binary, discard, materialized

LENGTH = 400
GRAM = 64
SPAN = 128
#: Bytes of a window of SPAN anchor candidates, and how much further on the last such window of LENGTH bytes begins.
WINDOW = GRAM + SPAN - 1
LAST = LENGTH - WINDOW
#: Words of a passage that documents share.
PASSAGE = 51
BROADCAST_BYTES = 32 << 20
MULTIPLIER = 0x9E3779B97F4A7C15
#: Positions hashed at a time.
PIECE = 1 << 16


def _powers(base: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64, for the bytes of a piece."""
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(PIECE + GRAM, base, np.uint64)])


POWERS, INVERSES = _powers(MULTIPLIER), _powers(pow(MULTIPLIER, -1, 1 << 64))
#: A number for each byte.
BYTES = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
BYTES = (BYTES ^ (BYTES >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray, n: int = GRAM) -> np.ndarray:
    """A mixed hash of the n bytes (GRAM at most) at each position: the difference of two running sums of bytes times
    powers of an odd number, over the position's power."""
    h = np.empty(max(0, len(data) - n + 1), np.uint64)
    for at in range(0, len(h), PIECE):
        part = data[at : at + PIECE + n - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTES[part] * POWERS[: len(part)], out=sums[1:])
        np.multiply(sums[n:] - sums[:-n], INVERSES[: len(part) - n + 1], out=h[at : at + PIECE])
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


CHUNK = 1 << 22
#: Texts are searched for anchors in groups of so many bytes: short arrays would mostly cost calls.
TOGETHER = 1 << 16
#: Rows of a batch of windows.
BATCH = 1 << 16


def _chosen(h: np.ndarray) -> np.ndarray:
    """The position of the least hash of each window of SPAN hashes."""
    low = np.uint64((1 << 24) - 1)
    windows = len(h) - SPAN + 1
    found = []
    for at in range(0, windows, CHUNK):  # positions within a chunk fit the low bits; equal hashes choose the first
        part = h[at : min(at + CHUNK, windows) + SPAN - 1]
        least, size = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while size < SPAN:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        found.append((least & low).astype(np.int64) + at)
    return np.concatenate(found)


def anchors_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, for each the first window of SPAN candidates whose least it is, and its hash."""
    return next(_anchors([data.tobytes()]))


def _anchors(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """anchors_of each text, of WINDOW bytes or more. Texts are joined to groups; windows across two texts don't count."""
    group: list[bytes] = []
    size = 0
    for k, text in enumerate(texts):
        group.append(text)
        size += len(text)
        if size < TOGETHER and k < len(texts) - 1:
            continue
        h = gram_hashes(np.frombuffer(b"".join(group), np.uint8))
        position = _chosen(h)
        ends = np.cumsum([len(t) for t in group])
        starts = np.r_[0, ends[:-1]]
        new = np.r_[True, position[1:] != position[:-1]]
        new[starts] = True
        for end in ends[:-1].tolist():
            new[end - WINDOW + 1 : end] = False
        first = np.flatnonzero(new)
        cuts = np.searchsorted(first, np.r_[starts, len(new)]).tolist()
        for start, a, b in zip(starts.tolist(), cuts, cuts[1:], strict=False):
            begins = first[a:b]
            at = position[begins]
            yield at - start, begins - start, h[at]
        group, size = [], 0


PHRASES = "row long, i int, since int, until int, span int, lone boolean, gram long, name long"


def _phrases(batches) -> Iterator[pa.RecordBatch]:
    """Each anchor: row, index, the windows of WINDOW bytes that choose it (since to before until), name of its GRAM bytes;
    and of the phrase that begins there: its bytes up to the end of the next anchor's have a name, span is the way to the
    next anchor, lone tells that it fills a run. The last anchor, and those of texts shorter than LENGTH, have no phrase:
    span 0."""
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        texts = [(row, raw) for row, raw in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True) if len(raw) >= WINDOW]
        for (row, raw), (at, begins, grams) in zip(texts, _anchors([raw for _, raw in texts]), strict=True):
            n, names, span, lone = len(at), np.zeros(len(at), np.uint64), np.zeros(len(at), np.int32), np.zeros(len(at), bool)
            if len(raw) >= LENGTH:
                places = at.tolist()
                names[:-1] = [name(raw[a : b + GRAM]) for a, b in zip(places, places[1:], strict=False)]
                span[:-1] = np.diff(at)
                lone[:-1] = np.r_[begins[2:], len(raw) - WINDOW + 1] - begins[:-1] > LAST
            parts.append((np.full(n, row, np.int64), np.arange(n, dtype=np.int32), begins.astype(np.int32), np.r_[begins[1:], len(raw) - WINDOW + 1].astype(np.int32), span, lone, grams.view(np.int64), names.view(np.int64)))
        if parts:
            columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PHRASES.split(", ")])


def _keyed(rows: DataFrame, different: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a table of different keys. That side is the one to hash, so that the rows needn't be sorted; no
    key of it is large, and a hot key's rows may be split."""
    return rows.join(different.hint("shuffle_hash"), keys, how)


def _repeated(named: DataFrame, *names: str) -> DataFrame:
    """The rows whose name occurs twice. Counts are aggregated before the shuffle; the repeated names are a table, so that
    the join has two plain sides and a hot name's rows may be split."""
    twice = materialized(named.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").select(*names))
    return _keyed(named, twice, list(names), "left_semi")


def _reranked(level: DataFrame, offset: int, mark: str, *keys: str) -> DataFrame:
    """The rows whose keys occur twice, with their keys' rank. The different repeated keys are sorted by ranges over all
    tasks; a rank is the place in that order. One more shuffle, by row, finds each row's pair: the rank and the span
    (then, more) of the position offset phrases further on, null if it has none, and the number g of the stretch of
    neighbouring marked indexes that the row falls in."""
    twice = level.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    ordered = twice.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranks = materialized(ordered.withColumn("place", F.monotonically_increasing_id()))
    ranked = _keyed(level, ranks, list(keys)).select("row", "i", "span", F.col("place").alias("rank"), F.expr(mark).alias("marked"))
    begun = W.partitionBy("row").orderBy("i")
    later = begun.rangeBetween(offset, offset)
    g = F.col("i") - F.sum(F.col("marked").cast("int")).over(begun)
    out = materialized(ranked.select("*", F.max("rank").over(later).alias("then"), F.max("span").over(later).alias("more"), g.alias("g")))
    discard(ranks)
    return out


def _stretches(kept: DataFrame, *by: str) -> DataFrame:
    """kept with `g`: the number of the stretch of neighbouring indexes i that a row falls in."""
    # Neighbouring indexes share i minus their place among the row's kept ones.
    place = F.row_number().over(W.partitionBy(*by).orderBy("i"))
    return kept.withColumn("g", F.col("i") - place)


def doubled(anchors: DataFrame) -> DataFrame:
    """row and the phrase ranges whose 1, 2, 4, ... phrases are repeated: [level, first, last, ...] by row."""
    tables = [_reranked(anchors.where((F.col("span") > 0) & (F.col("span") + GRAM <= LENGTH)), 1, "lone", "name")]
    while not tables[-1].isEmpty():
        span = F.col("span") + F.col("more")
        pairs = tables[-1].where(F.col("then").isNotNull() & (span + GRAM <= LENGTH)).select("row", "i", span.alias("span"), "rank", "then")
        tables.append(_reranked(pairs, 1 << len(tables), "true", "rank", "then"))
    # A row's positions lie together in its table, so that most of a stretch is one row before the shuffle.
    stretches = [
        table.where("marked").groupBy("row", F.lit(level).alias("level"), "g").agg(F.min("i").alias("a"), F.max("i").alias("b"))
        for level, table in enumerate(tables)
    ]
    runs = reduce(DataFrame.union, stretches)
    ranges = materialized(runs.groupBy("row").agg(F.flatten(F.collect_list(F.array("level", "a", "b"))).alias("ranges")))
    discard(*tables)
    return ranges


def _flags(ranges: list[int], n: int) -> np.ndarray:
    """By level, whether each of n phrases begins a repeated string of 2 ** level phrases."""
    out = np.zeros((max(ranges[::3], default=0) + 1, n), bool)
    for at in range(0, len(ranges), 3):
        out[ranges[at], ranges[at + 1] : ranges[at + 2] + 1] = True
    return out


RUNS = "row long, a int, b int, core long, whole long"


def _runs(batches) -> Iterator[pa.RecordBatch]:
    """Candidate runs: windows a to b of a row, the hashes of the run's core and of its whole string."""
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        texts = as_binary(batch.column(1))
        for row, raw, ranges, (at, begins, _) in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), _anchors(texts), strict=True):
            last = len(raw) - LENGTH
            level = _flags(ranges, len(at))
            # First and last anchor of each window change at these windows only.
            cuts = np.unique(np.r_[0, begins, begins - LAST, last + 1])
            cuts = cuts[(cuts >= 0) & (cuts <= last + 1)]
            i = np.searchsorted(begins, cuts[:-1], "right") - 1
            k = np.searchsorted(begins, cuts[:-1] + LAST, "right") - 1
            j = np.frexp(np.maximum(1, k - i))[1] - 1  # two strings of 2 ** j phrases cover those from i to k
            good = np.zeros(len(i), bool)
            for x in range(len(level)):
                own = j == x
                good[own] = level[x][i[own]] & level[x][k[own] - (1 << x)]
            r = np.flatnonzero(good)
            a, b = cuts[r], cuts[r + 1] - 1
            cores = [name(raw[x:y], 1) for x, y in zip(at[i[r]].tolist(), (at[k[r]] + GRAM).tolist(), strict=True)]
            wholes = [name(raw[x:y]) for x, y in zip(a.tolist(), (b + LENGTH).tolist(), strict=True)]
            parts.append((np.full(len(r), row, np.int64), a.astype(np.int32), b.astype(np.int32), _signed(cores), _signed(wholes)))
        if parts:
            yield _batch([np.concatenate(c) for c in zip(*parts, strict=True)], RUNS)


EDGES = "row long, a int, sure boolean, core long, whole long"


def _windows(batches) -> Iterator[pa.RecordBatch]:
    """The hash of each window of the runs at hand; sure: of a run that is repeated."""
    name = xxhash.xxh3_64_intdigest
    runs_: list[tuple] = []
    names: list[int] = []

    def made() -> pa.RecordBatch:
        row, a, n, sure, core = (np.array(c) for c in zip(*runs_, strict=True))
        place = np.arange(len(names)) - np.repeat(np.cumsum(n) - n, n)
        columns = [np.repeat(row, n), (place + np.repeat(a, n)).astype(np.int32), np.repeat(sure, n), np.repeat(core, n), _signed(names)]
        runs_.clear()
        names.clear()
        return _batch(columns, EDGES)

    for batch in batches:
        for row, raw, runs in zip(
            batch.column(0).to_pylist(), as_binary(batch.column(1)), batch.column(2).to_pylist(), strict=True
        ):
            for at in range(0, len(runs), 4):
                a, b, sure, core = runs[at : at + 4]
                runs_.append((row, a, b - a + 1, bool(sure), core))
                names += [name(raw[p : p + LENGTH]) for p in range(a, b + 1)]
                if len(names) >= BATCH:
                    yield made()
    if names:
        yield made()


def _signed(hashes: list[int]) -> np.ndarray:
    """Unsigned numbers of 64 bits in order as signed ones."""
    return (np.array(hashes, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in schema.split(", ")])


def _meet(texts: DataFrame, lists: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """texts with their list of whole numbers, broadcast if all lists together are small enough."""
    size = lists.agg(F.sum(F.size(column) * 8 + 40).alias("n")).first()["n"] or 0
    return texts.join(F.broadcast(lists) if size <= BROADCAST_BYTES else lists, "row", how)


def _listed(df: DataFrame, *columns: Column) -> DataFrame:
    return df.groupBy("row").agg(F.flatten(F.collect_list(F.array(*columns))).alias("list"))


def _merged(windows: DataFrame) -> DataFrame:
    """row, a, b: windows a to b of a row, those that touch merged."""
    ahead = W.partitionBy("row").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1)
    begun = W.partitionBy("row").orderBy("a", "b")
    starts = windows.withColumn("new", F.coalesce(F.col("a") > F.max("b").over(ahead) + 1, F.lit(True)).cast("int"))
    return starts.withColumn("g", F.sum("new").over(begun)).groupBy("row", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def repeated_windows(long: DataFrame, anchors: DataFrame) -> DataFrame:
    """long: (row, raw), texts of LENGTH bytes and more, no two alike. row and a list of [first, last] windows of LENGTH
    bytes that start elsewhere too."""
    ranges = doubled(anchors)
    runs = materialized(_meet(long, ranges, "ranges").select("row", "raw", "ranges").mapInArrow(_runs, RUNS))
    cores = materialized(runs.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    wholes = materialized(runs.groupBy("core", "whole").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("row", "a", "b")]))
    # Where n is 1, row, a and b are those of the only run; else row is that of the copy to compare with.
    left = materialized(_keyed(wholes.where("n = 1"), cores, ["core"], "left_semi").select("row", "a", "b", "core"))
    marks = materialized(left.select("core").distinct().withColumn("sure", F.lit(True)))
    twice = _keyed(wholes.where("n > 1").select("core", "whole", F.col("row").alias("one")), marks, ["core"], "left")
    copy = (F.col("row") == F.col("one")) & F.col("sure").isNotNull()
    known = materialized(_keyed(runs, twice, ["core", "whole"]).select("row", "a", "b", F.when(copy, F.col("core")).alias("core"), F.when(copy, F.col("whole")).alias("whole")))
    copies = known.where("core is not null").groupBy("row", "core", "whole").agg(F.min(F.struct("a", "b")).alias("run"))
    asked = left.withColumn("sure", F.lit(0)).unionByName(copies.select("row", "run.a", "run.b", "core", F.lit(1).alias("sure")))
    lists = materialized(_listed(asked, *[F.col(c).cast("long") for c in ("a", "b", "sure", "core")]))
    edges = materialized(_meet(long, lists, "list").select("row", "raw", "list").mapInArrow(_windows, EDGES))
    found = _repeated(edges, "core", "whole").where("not sure").select("row", "a", F.col("a").alias("b"))
    out = materialized(_listed(_merged(known.select("row", "a", "b").unionByName(found)), F.col("a"), F.col("b")))
    discard(ranges, runs, cores, wholes, left, marks, known, lists, edges)
    return out


SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PASSAGES = "row long, p int, name long"


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions, and those after the last, of the words `[^\\x20\\x09-\\x0D]+`."""
    edges = np.diff(np.r_[0, (~SPACE[data]).astype(np.int8), 0])
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _passages(batches) -> Iterator[pa.RecordBatch]:
    """The name of each string of PASSAGE words, of WINDOW bytes at least, all anchors of which are shared ones: it lies
    within one of the stretches at hand."""
    name = xxhash.xxh3_64_intdigest
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        for row, raw, spots in zip(
            batch.column(0).to_pylist(), as_binary(batch.column(1)), batch.column(2).to_pylist(), strict=True
        ):
            begin, end = word_bounds(np.frombuffer(raw, np.uint8))
            if len(begin) < PASSAGE:
                continue
            begin, end = begin[: len(begin) - PASSAGE + 1], end[PASSAGE - 1 :]
            first = np.searchsorted(begin, np.array(spots[::2]))
            last = np.searchsorted(end, np.array(spots[1::2]) + WINDOW - 1, "right")
            inside = np.zeros(len(begin) + 1, np.int64)
            np.add.at(inside, first, last > first)
            np.add.at(inside, last, -(last > first).astype(int))
            p = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & (end - begin >= WINDOW))
            names = [name(raw[a:b]) for a, b in zip(begin[p].tolist(), end[p].tolist(), strict=True)]
            parts.append((np.full(len(p), row, np.int64), p.astype(np.int32), np.array(names, np.uint64).view(np.int64)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["row", "p", "name"])


def shared_words(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """texts: (row, raw), no two alike. row and the number of its words in passages that another text has too."""
    stretches = _stretches(anchors.where("across"), "row").groupBy("row", "g").agg(F.min("since").alias("a"), F.max("until").alias("b"))
    lists = materialized(_listed(stretches, F.col("a"), F.col("b")))
    windows = materialized(_meet(texts, lists, "list").select("row", "raw", "list").mapInArrow(_passages, PASSAGES))
    names = windows.groupBy("name").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a < b").select("name")
    found = _keyed(windows, materialized(names), ["name"], "left_semi")
    ahead = F.lead("p").over(W.partitionBy("row").orderBy("p")) - F.col("p")
    covered = found.select("row", F.least(F.lit(PASSAGE), F.coalesce(ahead, F.lit(PASSAGE))).alias("n"))
    out = materialized(covered.groupBy("row").agg(F.sum("n").alias("shared")))
    discard(lists, windows)
    return out


def spans_of(windows: list[int] | None, size: int, copy: bool) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the windows cover; all bytes of a copy."""
    if copy:
        return [(0, size)] if size >= LENGTH else []
    out: list[list[int]] = []
    pairs = sorted(zip(windows[::2], windows[1::2], strict=True)) if windows else []
    for a, b in pairs:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + LENGTH)
        else:
            out.append([a, b + LENGTH])
    return [(a, b) for a, b in out]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for span in spans for x in span], len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _with_windows(docs: DataFrame, shared: bool = False) -> DataFrame:
    """Per document: doc_id, raw (the text's bytes), copy (another row has the same text), list (its repeated windows),
    shared (its words in passages of other documents, if asked for)."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    texts = materialized(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", raw.alias("raw")))
    keyed = texts.select("row", F.md5("raw").alias("key"), F.length("raw").alias("n"))
    classes = materialized(keyed.groupBy("key").agg(F.min("row").alias("first"), F.count("*").alias("many")).where("many > 1").select("key", "first"))
    members = materialized(keyed.join(classes, "key").select("row", (F.col("row") > F.col("first")).alias("later")))
    later = members.where("later").select("row", F.array(F.lit(1)).alias("list"))
    each = _meet(texts.where(F.length("raw") >= WINDOW), later, "list", "left_anti").select("row", "raw")
    phrases = materialized(each.mapInArrow(_phrases, PHRASES))
    twice = phrases.groupBy("gram").agg(F.count("*").alias("n"), F.min("row").alias("a"), F.max("row").alias("b")).where("n > 1")
    grams = materialized(twice.select("gram", (F.col("a") < F.col("b")).alias("across")))
    anchors = materialized(_keyed(phrases, grams, ["gram"]).drop("gram"))
    discard(phrases, grams, classes)
    lists = repeated_windows(each.where(F.length("raw") >= LENGTH), anchors)
    known = lists.join(members.select("row", F.lit(True).alias("copy")), "row", "full")
    if shared:
        known = known.join(shared_words(each, anchors), "row", "full")
    else:
        known = known.withColumn("shared", F.lit(0).cast("long"))
    known = materialized(known.select("row", F.coalesce("list", F.array().cast("array<int>")).alias("list"), F.coalesce("copy", F.lit(False)).alias("copy"), "shared"))
    discard(anchors, members, lists)
    return _meet(texts, known, "list", "left").select("doc_id", "raw", "list", F.coalesce("copy", F.lit(False)).alias("copy"), F.coalesce("shared", F.lit(0)).alias("shared"))


def removals(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words."""

    def measure(batches):
        for batch in batches:
            out = []
            for raw, windows, copy, shared in zip(as_binary(batch.column(1)), *[c.to_pylist() for c in batch.columns[2:]], strict=True):
                spans = spans_of(windows, len(raw), copy)
                kept = _cut(raw, spans) if spans else raw
                if copy and len(raw) >= WINDOW and (n := len(raw.split())) >= PASSAGE:
                    shared = n
                out.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), shared))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words"],
            )

    found = _with_windows(docs, shared=True)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(measure, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long")


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and the bytes that are left of each text."""

    def cut(batches):
        for batch in batches:
            cells = zip(as_binary(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            kept = [_cut(raw, spans_of(w, len(raw), copy)) for raw, w, copy in cells]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary())], ["doc_id", "kept"])

    found = _with_windows(docs)
    return found.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary")
