"""Cross-entropy difference: documents scored by two n-gram models, one of target text and one of the whole corpus.

Both models are matched: one vocabulary, one order and one smoothing. Each word of the corpus is a class of its own, and
words that only the target has are one more. A token's probability is interpolated from the bigram's and the word's:

    p(w | v) = (1 - L) c(v, w) / c(v) + L (c(w) + 1) / (c + V + 2)

with V different words in the corpus, and the unknown word and the start of a text besides. A text starts with a
boundary. A token's loss is -ln p; a document's score is the mean over its tokens of the background loss less the target
loss, so that text like the target scores higher.

The counts of words, of words as the first of a bigram, and of bigrams are of the whole corpus, without a cap, and no
process holds all of them. Documents are packed into chunks of about CHUNK_TOKENS tokens, a table of the shared folder
(`chunks_of`). A chunk's different cells (a cell is a word, a first word or a bigram, named by a 64-bit hash) are dealt by
their leading bits into buckets, as many as keep a bucket at about BUCKET_TOKENS tokens. A bucket's task adds up all
chunks' counts of its cells (`_total`) and sends each chunk the totals of the cells that it has; the chunk's task scores
its documents with them. So a frequent cell is one row for each chunk, however often it occurs. Only the numbers of
tokens and of different words reach the driver.

With `words` and `heads` given, the model is a smaller one: the `words` most frequent words and one unknown word, of which
the `heads` most frequent are classes of their own, the rest share one; a word's share of its class is a factor more:

    p(w | v) = [(1 - L) c(kv, kw) / c(kv) + L (c(kw) + 1) / (c + classes)] x (c(w) + 1) / (c(kw) + words of kw)

Its vocabulary and its class pairs are brought to the driver and broadcast.

Defined results: null and empty texts have no tokens, losses and score 0; without target documents the target model is
the uniform one; repeated rows count each; null ids are never target documents.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary, materialized, words_of

BACKOFF = 0.3
FLUSH = 200_000
CHUNK_TOKENS = 1_500_000
BUCKET_TOKENS = 2_000_000
LEVEL = 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), n: over all rows. A task sends its counts on whenever it holds FLUSH words."""

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for raw in as_binary(batch.column(0)):
                counts.update(words_of(raw))
                if len(counts) > FLUSH:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """ids: by word, from 1 up, the most frequent first; 0 is the unknown word. A word's class is its id up to HEADS,
    then heads + 1; class 0 is the start of a text."""

    ids: dict[bytes, int]
    heads: int

    @property
    def kind(self) -> str:
        """The numbers that encoded texts are kept in."""
        return "<u2" if len(self.ids) < 1 << 16 else "<u4"

    def encode(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.fromiter((ids.get(w, 0) for w in words), np.int64, len(words))

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return np.where((ids > 0) & (ids <= self.heads), ids, self.heads + 1)


def vocabulary(docs: DataFrame, words: int, heads: int) -> Vocabulary:
    top = word_counts(docs).orderBy(F.desc("n"), "word").limit(words).collect()
    return Vocabulary({bytes(r.word): i for i, r in enumerate(top, 1)}, min(heads, len(top)))


@dataclass
class Model:
    """pairs: class counts by the class before. word_loss: -ln of each word's share of its class."""

    pair_loss: np.ndarray
    word_loss: np.ndarray


def _model(vocab: Vocabulary, pairs: np.ndarray, words: np.ndarray) -> Model:
    classes = vocab.heads + 2
    after = pairs.sum(axis=1, keepdims=True)
    unigram = (pairs.sum(axis=0) + 1.0) / (pairs.sum() + classes)
    with np.errstate(divide="ignore", invalid="ignore"):
        bigram = np.where(after > 0, pairs / after, unigram)
    kinds = vocab.classes(np.arange(len(words)))
    in_class, members = np.bincount(kinds, words, classes), np.bincount(kinds, minlength=classes)
    share = (words + 1.0) / (in_class + members)[kinds]
    return Model((-np.log((1 - BACKOFF) * bigram + BACKOFF * unigram)).astype(np.float32), -np.log(share))


def encoded(docs: DataFrame, sent, key: str) -> DataFrame:
    """Columns of docs with the text replaced by its word ids (binary, little-endian)."""

    @arrow_udf("binary")
    def encode(text: pa.Array) -> pa.Array:
        vocab = _vocabulary(sent, key)
        return pa.array([vocab.encode(words_of(raw)).astype(vocab.kind).tobytes() for raw in as_binary(text)], pa.binary())

    return docs.select(*[c for c in docs.columns if c != "text"], encode.asNondeterministic()(F.col("text")).alias("ids"))


def _ids_of(cell: bytes, vocab: Vocabulary) -> np.ndarray:
    return np.frombuffer(cell, vocab.kind).astype(np.int64)


def _model_of(rows: DataFrame, vocab: Vocabulary, sent, key: str) -> Model:
    """Counts of class pairs and of words over all encoded rows. One row for each cell and task is shuffled."""
    classes = vocab.heads + 2

    def count(batches):
        vocab = _vocabulary(sent, key)
        pairs, words = np.zeros(classes * classes, np.int64), np.zeros(len(vocab.ids) + 1, np.int64)
        for batch in batches:
            for cell in as_binary(batch.column(0)):
                if len(ids := _ids_of(cell, vocab)):
                    kinds = vocab.classes(ids)
                    np.add.at(pairs, np.r_[0, kinds[:-1]] * classes + kinds, 1)
                    np.add.at(words, ids, 1)
        for offset, counts in ((0, pairs), (classes * classes, words)):
            own = np.flatnonzero(counts)
            for at in range(0, len(own), 1 << 16):
                some = own[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some + offset), pa.array(counts[some])], ["cell", "n"])

    sums = rows.select("ids").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    cells = np.zeros(classes * classes + len(vocab.ids) + 1, np.int64)
    got = sums.toArrow()
    cells[got["cell"].to_numpy()] = got["n"].to_numpy()
    return _model(vocab, cells[: classes * classes].reshape(classes, classes), cells[classes * classes :])


_vocabularies: dict[str, Vocabulary] = {}
_models: dict[str, tuple[Model, Model]] = {}


def _vocabulary(sent, key: str) -> Vocabulary:
    if key not in _vocabularies:  # a worker keeps one
        _vocabularies.clear()
        _vocabularies[key] = sent.value
    return _vocabularies[key]


def chunks_of(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. Chunks of documents: chunk (its name), doc_ids, sizes (tokens of each), ids (binary: each token's
    place among the chunk's different words, by `_planes`), words (binary: their hashes), n (tokens)."""
    kind = docs.schema["doc_id"].dataType
    schema = f"chunk long, doc_ids array<{kind.simpleString()}>, sizes array<int>, ids binary, words binary, n long"

    def chunk(batches):
        doc_ids, sizes, ids, places = [], [], [], {}
        n = 0

        def packed(type_of_id: pa.DataType) -> pa.RecordBatch:
            words = np.fromiter(map(xxhash.xxh64_intdigest, places), np.uint64, len(places))
            places_of = np.frombuffer(b"".join(ids), "<u4")
            cells = [uuid.uuid4().int >> 65], [doc_ids], [sizes], [_planes(places_of)], [words.tobytes()], [n]
            types = pa.int64(), pa.list_(type_of_id), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64()
            arrays = [pa.array(c, t) for c, t in zip(cells, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "doc_ids", "sizes", "ids", "words", "n"])

        found = None
        for batch in batches:
            found = batch.schema.field(0).type
            for doc_id, raw in zip(batch.column(0).to_pylist(), as_binary(batch.column(1)), strict=True):
                words = words_of(raw)
                for w in set(words).difference(places):
                    places[w] = len(places)
                ids.append(np.fromiter(map(places.__getitem__, words), "<u4", len(words)).tobytes())
                doc_ids.append(doc_id)
                sizes.append(len(words))
                n += len(words)
                if n >= CHUNK_TOKENS:
                    yield packed(found)
                    doc_ids, sizes, ids, places, n = [], [], [], {}, 0
        if doc_ids:
            yield packed(found)

    return docs.select("doc_id", "text").mapInArrow(chunk, schema)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MULTIPLIER
    return x ^ (x >> np.uint64(29))


@dataclass
class Cells:
    """keys: of a chunk's different cells, in ascending order; the last bit is set for words. word, first: by place of a
    token, its word's cell and the cell of what it follows. pair: its bigram's. counts: each cell's tokens."""

    keys: np.ndarray
    word: np.ndarray
    first: np.ndarray
    pair: np.ndarray

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """Of each cell among the marked tokens."""
        return sum(np.bincount(x[tokens], minlength=len(self.keys)) for x in (self.word, self.first, self.pair))


def _cells(ids: bytes, words: bytes, sizes: np.ndarray) -> Cells:
    own = _from_planes(ids, "<u4").astype(np.int64)
    names = np.r_[np.frombuffer(words, "<u8"), np.uint64(0)]  # the last is the start of a text
    before = np.r_[np.int64(0), own[:-1]][: len(own)]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(names) - 1
    pairs = before * len(names) + own
    order = np.argsort(pairs)
    new = np.diff(pairs[order], prepend=-1) != 0
    place = np.empty(len(own), np.int64)
    place[order] = np.cumsum(new) - 1
    a, b = np.divmod(pairs[order][new], len(names))
    one, even = np.uint64(1), ~np.uint64(1)
    singles = np.unique(before)  # what comes first in a bigram
    at = np.zeros(len(names), np.int64)
    at[singles] = np.arange(len(singles))
    n = len(names) - 1
    keys = np.concatenate([
        _mixed(names[:n] * MULTIPLIER + np.uint64(1)) | one,
        _mixed(names[singles] * MULTIPLIER + np.uint64(2)) & even,
        _mixed(_mixed(names[a] + np.uint64(3)) * MULTIPLIER + names[b]) & even,
    ])
    sort = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[sort] = np.arange(len(keys))
    return Cells(keys[sort], rank[own], rank[n + at[before]], rank[n + len(singles) + place])


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers, all first bytes before all second ones, compressed: high bytes are mostly zero, and most counts are small.
    A shuffle's own codec has no code for frequent bytes."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()
    return zstandard.ZstdCompressor(LEVEL).compress(planes)


def _from_planes(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _dealt(chunks: DataFrame, bits: int, own: bool) -> DataFrame:
    """The chunks' cells by bucket: bucket, chunk, own (whether the chunk wants the totals), keys (as differences),
    background and target counts. Chunks that are not own are target texts only; of the others `marks` are the places
    of target documents."""

    def deal(batches):
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.array(r["sizes"], np.int64)
                cells = _cells(r["ids"], r["words"], sizes)
                marked = np.zeros(len(sizes), bool)
                marked[np.array(r["marks"] or [], np.int64)] = True
                every = np.ones(r["n"], bool)
                background = cells.counts(every) if own else np.zeros(len(cells.keys), np.int64)
                target = cells.counts(np.repeat(marked, sizes) if own else every)
                cuts = [0, *np.searchsorted(cells.keys, edges).tolist(), len(cells.keys)]
                out = [
                    (i, r["chunk"], own, *(_planes(x) for x in (np.diff(cells.keys[a:b], prepend=np.uint64(0)), background[a:b], target[a:b])))
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b
                ]
                if out:
                    types = pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()
                    arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["bucket", "chunk", "own", "keys", "background", "target"])

    return chunks.select("chunk", "sizes", "ids", "words", "n", "marks").mapInArrow(
        deal, "bucket int, chunk long, own boolean, keys binary, background binary, target binary"
    )


def _total(group: pa.Table) -> pa.Table:
    """A bucket's totals for each chunk's cells. A row without a chunk has the numbers of different words of the corpus,
    and of tokens of both models."""
    keys = [np.cumsum(_from_planes(raw, "<u8"), dtype=np.uint64) for raw in group["keys"].to_pylist()]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    every = np.concatenate(keys)
    order = np.argsort(every)
    new = np.flatnonzero(np.r_[True, np.diff(every[order]) != 0])
    of = np.empty(len(every), np.int64)
    of[order] = np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(every)]))
    sums = []
    for name in ("background", "target"):
        n = np.concatenate([_from_planes(raw, "<i8") for raw in group[name].to_pylist()])
        sums.append(np.add.reduceat(n[order], new))
    word = (every[order][new] & np.uint64(1)) == 1
    split = [np.split(s[of], ends) for s in sums]
    rows = [
        (chunk, bucket, _planes(a), _planes(b), 0, 0, 0)
        for chunk, bucket, own, a, b in zip(*(group[c].to_pylist() for c in ("chunk", "bucket", "own")), *split, strict=True) if own
    ]
    rows.append((None, None, None, None, int((word & (sums[0] > 0)).sum()), int(sums[0][word].sum()), int(sums[1][word].sum())))
    types = pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.Table.from_arrays(arrays, ["chunk", "bucket", "background", "target", "words", "n_background", "n_target"])


def _whole_score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """`score` by the counts of all words and bigrams."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = materialized(chunks_of(docs))
    tokens = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, -(-tokens // BUCKET_TOKENS) - 1).bit_length()
    if "text" in target.columns:
        texts = target.select(F.lit(0).alias("doc_id"), "text")
        nothing = F.lit(None).cast("array<int>").alias("marks")
        dealt = _dealt(chunks.withColumn("marks", nothing), bits, True).unionByName(_dealt(chunks_of(texts).withColumn("marks", nothing), bits, False))
    else:  # ids may be as many as the corpus has, so they are not broadcast at any size
        ids = target.where("doc_id is not null").select("doc_id").distinct().hint("merge")
        places = chunks.select("chunk", F.posexplode("doc_ids").alias("at", "doc_id")).join(ids, "doc_id", "left_semi")
        marks = places.groupBy("chunk").agg(F.collect_list("at").alias("marks")).hint("merge")
        dealt = _dealt(chunks.join(marks, "chunk", "left"), bits, True)
    totals = materialized(
        dealt.groupBy("bucket").applyInArrow(_total, "chunk long, bucket int, background binary, target binary, words long, n_background long, n_target long")
    )
    size = totals.where("chunk is null").agg(F.sum("words"), F.sum("n_background"), F.sum("n_target")).first()
    different, *all_tokens = (x or 0 for x in size)

    def scores(chunk: pa.Table, found: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_tokens": [], "loss_target": [], "loss_background": []}
        found = found.sort_by("bucket")
        given = {c: np.concatenate([np.empty(0, np.int64), *(_from_planes(x, "<i8") for x in found[c].to_pylist())]) for c in ("background", "target")}
        for r in chunk.to_pylist():
            sizes = np.array(r["sizes"], np.int64)
            cells = _cells(r["ids"], r["words"], sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            out["doc_id"] += r["doc_ids"]
            out["n_tokens"].append(sizes)
            for name, n in zip(("background", "target"), all_tokens, strict=True):
                single = (given[name][cells.word] + 1.0) / (n + different + 2)
                first = given[name][cells.first]
                pair = np.where(first > 0, given[name][cells.pair] / np.maximum(first, 1), single)
                loss = -np.log((1 - BACKOFF) * pair + BACKOFF * single)
                out[f"loss_{name}"].append(np.bincount(owner, loss, len(sizes)) / np.maximum(sizes, 1))
        columns = [pa.array(out["doc_id"], chunk.schema.field("doc_ids").type.value_type)]
        columns += [pa.array(np.concatenate(out[c])) for c in ("n_tokens", "loss_target", "loss_background")]
        return pa.Table.from_arrays(columns, list(out))

    answers = totals.where("chunk is not null").select("chunk", "bucket", "background", "target")
    scored = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        scores, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double"
    )
    return scored.select("*", (F.col("loss_background") - F.col("loss_target")).alias("score"))


def score(docs: DataFrame, target: DataFrame, words: int | None = None, heads: int | None = None) -> DataFrame:
    """target: a table of texts (text), or of the ids of its documents among docs (doc_id), which spares reading their
    texts again. Per row of docs: doc_id, n_tokens, loss_target, loss_background, score. Without words and heads, by
    all words and bigrams."""
    if words is None or heads is None:
        return _whole_score(docs, target)
    context, key = docs.sparkSession.sparkContext, uuid.uuid4().hex
    vocab = vocabulary(docs, words, heads)
    sent = context.broadcast(vocab)
    # The table is about a third of the texts; the background model, the target model and the scores read it.
    rows = materialized(encoded(docs.select("doc_id", "text"), sent, key))
    if "text" in target.columns:
        marked = encoded(target.select("text"), sent, key)
    else:  # ids may be as many as the corpus has, so they are not broadcast at any size
        marked = rows.join(target.where("doc_id is not null").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    models = context.broadcast((_model_of(marked, vocab, sent, key), _model_of(rows, vocab, sent, key)))

    @arrow_udf("struct<n_tokens:bigint,loss_target:double,loss_background:double>")
    def losses(cells: pa.Array) -> pa.Array:
        vocab = _vocabulary(sent, key)
        if key not in _models:
            _models.clear()
            _models[key] = models.value
        out = []
        for cell in cells.to_pylist():
            ids = _ids_of(cell, vocab)
            if not len(ids):
                out.append((0, 0.0, 0.0))
                continue
            kinds = vocab.classes(ids)
            before = np.r_[0, kinds[:-1]]
            out.append((len(ids), *(float((m.pair_loss[before, kinds] + m.word_loss[ids]).mean()) for m in _models[key])))
        n, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64())],
            ["n_tokens", "loss_target", "loss_background"],
        )

    scored = rows.select("doc_id", losses.asNondeterministic()(F.col("ids")).alias("l"))
    return scored.select("doc_id", "l.*", (F.col("l.loss_background") - F.col("l.loss_target")).alias("score"))


def labelled_ids(labels: DataFrame) -> DataFrame:
    """The ids of the documents that labels.quality marks as good."""
    return labels.where("quality = 1").select("doc_id")


def labelled_target(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The texts of the documents that labels.quality marks as good."""
    good = labelled_ids(labels).where("doc_id is not null").distinct()
    return docs.select("doc_id", "text").join(good, "doc_id", "left_semi").select("text")
