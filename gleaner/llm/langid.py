"""Language identification of words by a linear-chain conditional random field.

Each word of a text is a position of the chain. Its features are affixes, character n-grams and lexicon cells (the
language that mostly has the word in the training sample, and how strongly), hashed into a fixed number of cells; the
transitions between the languages of neighbouring words are learned. Forward-backward gives each word's distribution
over the languages; a document's distribution is the mean over its words.

Training takes a bounded sample: `DOCS_PER_LANGUAGE` texts of each language, the first by a hash of the text. From
them segments of words are cut, and segments of different languages are spliced to code-switched sequences, so that
the transitions see switches at the rate `SWITCH_RATE`. The chain is fitted by AdaGrad on the exact gradient of the
conditional log-likelihood. Prediction uses whole texts; long ones are run in blocks whose transfer matrices are
chained, which gives the same result as one long pass. A run of letters longer than `WORD_CUT`, as in text without
spaces, is several positions of at most that many letters; no letter is left out, but n-grams do not span two positions.

Defined results: null texts and texts without a letter get `und` and score 0; without training rows every text does.
Rows without a language are never trained on. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import as_binary

UNDETERMINED = "und"
DOCS_PER_LANGUAGE = 300
SEGMENTS_PER_DOC = 4
SEGMENT_WORDS = 10
SEQUENCE_SEGMENTS = 4
SWITCH_RATE = 0.3
CELLS = 1 << 15
EPOCHS = 4
RATE = 0.3
DECAY = 1e-6
BLOCK = 64
#: Hashes are counted in 2 ** RANGE_BITS ranges a language.
RANGE_BITS = 12
#: Positions between two rescalings of the states within a block.
RESCALE = 4
CACHED_WORDS = 400_000
WORDS_AT_A_TIME = 10_000
WORD_CUT = 40
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

LETTER_WORD = re.compile(rf"[^\W\d_]{{1,{WORD_CUT}}}")


def letter_words(text: str | None) -> list[str]:
    """Runs of letters, in lower case; a run of more than WORD_CUT letters is as many words as it takes."""
    return LETTER_WORD.findall(text.lower()) if text else []


def surface_cells(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed cells of each word's affixes and n-grams, repeats included, and cell 0 for the bias; all in one array, word
    by word, and the number of each word's. Hashes of n letters grow from those of one less, for all words at once."""
    codes = np.frombuffer("".join([f"^{w[:WORD_CUT]}$" for w in words]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([min(len(w), WORD_CUT) + 2 for w in words])
    ends, each = np.cumsum(sizes), np.arange(len(words))
    owner = np.repeat(each, sizes)
    left = ends[owner] - np.arange(len(codes))  # letters from here to the word's end
    owners, hashes = [each], []
    grams = codes
    for n in (1, 2, 3, 4):
        if n > 1:
            grams = grams[:-1] * MULTIPLIER + codes[n - 1 :]
            inside = left[: len(grams)] >= n
            owners.append(owner[: len(grams)][inside])
            hashes.append(grams[inside] + np.uint64(n))
        if n < 4:
            long = np.flatnonzero(sizes - 2 >= n)
            owners += [long, long]
            hashes += [grams[(ends - sizes)[long] + 1] + np.uint64(10 + n), grams[ends[long] - 1 - n] + np.uint64(20 + n)]
    mixed = np.concatenate(hashes) * MULTIPLIER
    mixed = ((mixed ^ (mixed >> np.uint64(29))) * MULTIPLIER) >> np.uint64(32)
    cells = np.concatenate([np.zeros(len(words), np.int64), 1 + (mixed % np.uint64(CELLS - 1)).astype(np.int64)])
    owner = np.concatenate(owners)
    return cells[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))


@dataclass
class Chain:
    """languages: names by state. cells: weights by cell and state. lexicon: by word, its log-ratio row."""

    languages: list[str]
    cells: np.ndarray
    lexicon: dict[str, np.ndarray]
    lexicon_weight: np.ndarray
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of each word, at least one, by state."""
        cells, counts = surface_cells(words)
        out = np.add.reduceat(self.cells[cells], np.cumsum(counts) - counts, axis=0) / np.sqrt(counts)[:, None]
        for i, w in enumerate(words):
            if (known := self.lexicon.get(w)) is not None:
                out[i] += self.lexicon_weight * known
        return out


def _lexicon(docs: list[tuple[list[str], int]], k: int) -> dict[str, np.ndarray]:
    """Smoothed log-odds of each language for the words that at least three documents have."""
    by_word: dict[str, Counter] = {}
    for words, lang in docs:
        for w in set(words):
            by_word.setdefault(w, Counter())[lang] += 1
    size = np.maximum(1, np.bincount([lang for _, lang in docs], minlength=k))
    out = {}
    for w, by_lang in by_word.items():
        if by_lang.total() >= 3:
            share = (np.array([by_lang[j] for j in range(k)]) + 0.2) / size
            log = np.log(share)
            out[w] = log - log.mean()
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(emissions: np.ndarray, start: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """emissions: sequences x positions x states, all of one length. Posteriors of states, and sums over the positions
    of posteriors of transitions."""
    n, t, k = emissions.shape
    alpha, beta = np.empty((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = start + emissions[:, 0]
    for i in range(1, t):
        alpha[:, i] = _log_sum(alpha[:, i - 1, :, None] + transitions, 1) + emissions[:, i]
    for i in range(t - 2, -1, -1):
        beta[:, i] = _log_sum(transitions + (emissions[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    states = np.exp(alpha + beta - total[:, None, None])
    pairs = np.zeros((k, k))
    for i in range(1, t):
        pairs += np.exp(
            alpha[:, i - 1, :, None] + transitions + (emissions[:, i] + beta[:, i])[:, None, :] - total[:, None, None]
        ).sum(axis=0)
    return states, pairs


def fit(sample: list[tuple[str, str]], seed: int = 0) -> Chain | None:
    """sample: (text, language). The chain, or None if there is nothing to learn from."""
    languages = sorted({lang for _, lang in sample})
    index = {lang: j for j, lang in enumerate(languages)}
    k = len(languages)
    docs = [(words, index[lang]) for text, lang in sample if (words := letter_words(text))]
    if not docs:
        return None
    rng = np.random.default_rng(seed)
    lexicon = _lexicon(docs, k)
    length = SEGMENT_WORDS * SEQUENCE_SEGMENTS
    parts: list[list[list[str]]] = [[] for _ in languages]
    for words, lang in docs:
        for _ in range(SEGMENTS_PER_DOC):
            at = int(rng.integers(max(1, len(words) - SEGMENT_WORDS + 1)))
            segment = words[at : at + SEGMENT_WORDS]
            parts[lang].append((segment * SEGMENT_WORDS)[:SEGMENT_WORDS])
    have = [j for j in range(k) if parts[j]]
    sequences, golds = [], []
    for _ in range(sum(map(len, parts)) // 2 + 1):
        lang, words, gold = int(rng.choice(have)), [], []
        for _ in range(SEQUENCE_SEGMENTS):
            if rng.random() < SWITCH_RATE:
                lang = int(rng.choice(have))
            words += parts[lang][int(rng.integers(len(parts[lang])))]
            gold += [lang] * SEGMENT_WORDS
        sequences.append(words)
        golds.append(gold)
    vocabulary: dict[str, int] = {}
    ids = np.array([[vocabulary.setdefault(w, len(vocabulary)) for w in s] for s in sequences])
    gold = np.array(golds)
    flat, counts = surface_cells(list(vocabulary))
    value = np.repeat(1 / np.sqrt(counts), counts)
    known = np.array([lexicon.get(w, np.zeros(k)) for w in vocabulary])

    chain = Chain(languages, np.zeros((CELLS, k)), lexicon, np.full(k, 0.1), np.zeros((k, k)), np.zeros(k))
    squares = {name: np.full_like(getattr(chain, name), 1e-6) for name in ("cells", "lexicon_weight", "transitions", "start")}
    starts = np.r_[0, np.cumsum(counts)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            used, inverse = np.unique(ids[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), length)
            picked = np.concatenate([np.arange(starts[u], starts[u + 1]) for u in used])
            local = np.repeat(np.arange(len(used)), counts[used])
            score = np.zeros((len(used), k))
            np.add.at(score, local, chain.cells[flat[picked]] * value[picked][:, None])
            score += chain.lexicon_weight * known[used]
            states, pairs = forward_backward(score[inverse], chain.start, chain.transitions)
            truth = np.eye(k)[gold[rows]]
            wrong = truth - states
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, inverse.ravel(), wrong.reshape(-1, k))
            steps = {
                "cells": np.zeros_like(chain.cells),
                "lexicon_weight": (by_word * known[used]).sum(axis=0),
                "transitions": np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pairs,
                "start": wrong[:, 0].sum(axis=0),
            }
            np.add.at(steps["cells"], flat[picked], by_word[local] * value[picked][:, None])
            for name, step in steps.items():
                step = step / len(rows) - DECAY * getattr(chain, name)
                squares[name] += step * step
                getattr(chain, name)[...] += RATE * step / np.sqrt(squares[name])
    return chain


class Tagger:
    """Word posteriors for many texts at once. Rows of emissions are kept for a bounded number of words."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.k = len(chain.languages)
        self.step = np.exp(chain.transitions - chain.transitions.max())
        self.rows: dict[str, int] = {}
        self.table = np.empty((1024, self.k))

    def _ids(self, texts: list[list[str]]) -> np.ndarray:
        """The row of the table of each word, all texts in one array."""
        rows = self.rows
        if len(rows) > CACHED_WORDS:
            rows.clear()
        new = list(set(joined.from_iterable(texts)).difference(rows))
        more = len(rows) + len(new) - len(self.table)
        if more > 0:
            self.table = np.concatenate([self.table, np.empty((more + len(self.table), self.k))])
        for at in range(0, len(new), WORDS_AT_A_TIME):
            words = new[at : at + WORDS_AT_A_TIME]
            score = self.chain.emissions(words)
            self.table[len(rows) : len(rows) + len(words)] = np.exp(score - score.max(axis=1, keepdims=True))
            rows.update(zip(words, range(len(rows), len(rows) + len(words)), strict=True))
        return np.fromiter(map(rows.__getitem__, joined.from_iterable(texts)), np.int64, sum(map(len, texts)))

    def means(self, texts: list[list[str]]) -> np.ndarray:
        """Mean posterior over the words of each text; every text has words.

        Blocks are ordered by their length, the longest first, so that at each position those that go on are the first
        ones. Sums over states are products with `ones`; scales cancel out, so states are rescaled now and then only."""
        k, step = self.k, self.step
        ones = np.ones((k, k))
        lengths = np.array([len(t) for t in texts])
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.r_[0, np.cumsum(blocks)[:-1]]
        sizes = np.full(len(owner), BLOCK)
        sizes[first + blocks - 1] = lengths - (blocks - 1) * BLOCK
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        going = len(order) - np.searchsorted(np.sort(sizes), np.arange(BLOCK), "right")

        ids = self._ids(texts)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        e = np.empty((BLOCK, len(order), k))
        e[place % BLOCK, rank[np.repeat(first, lengths) + place // BLOCK]] = self.table[ids]
        opening = rank[first]

        # What a block does to the states: rows are the states before it.
        whole = np.broadcast_to(step, (len(order), k, k)).copy()
        whole[opening] = np.eye(k)
        for i, m in enumerate(going):
            own = whole[:m]
            if i:
                own = (own.reshape(-1, k) @ step).reshape(m, k, k)
            own = own * e[i, :m, None, :]
            if i % RESCALE == RESCALE - 1:
                own /= own.sum(axis=(1, 2), keepdims=True)
            whole[:m] = own
        whole /= whole.sum(axis=(1, 2), keepdims=True)

        before, after = np.empty((len(order), k)), np.ones((len(order), k))
        state = np.broadcast_to(np.exp(self.chain.start - self.chain.start.max()), (len(texts), k)).copy()
        back = np.ones((len(texts), k))
        for j in range(blocks.max()):
            on = np.flatnonzero(blocks > j)
            at = rank[first[on] + j]
            before[at] = state[on]
            moved = np.einsum("ni,nij->nj", state[on], whole[at])
            state[on] = moved / (moved @ ones)
        for j in range(blocks.max() - 1, -1, -1):
            on = np.flatnonzero(blocks > j)
            at = rank[first[on] + j]
            after[at] = back[on]
            moved = np.einsum("nij,nj->ni", whole[at], back[on])
            back[on] = moved / (moved @ ones)

        alpha = np.empty_like(e)
        state = before @ step
        state[opening] = before[opening]
        for i, m in enumerate(going):
            state = (state[:m] @ step if i else state) * e[i, :m]
            if i % RESCALE == RESCALE - 1:
                state /= state @ ones
            alpha[i, :m] = state
        sums = np.zeros((len(order), k))
        for i in range(BLOCK - 1, -1, -1):
            m = going[i]
            both = alpha[i, :m] * after[:m]
            sums[:m] += both / (both @ ones)
            back = (e[i, :m] * after[:m]) @ step.T
            if i % RESCALE == 0:
                back /= back @ ones
            after[:m] = back
        total = np.zeros((len(texts), k))
        np.add.at(total, owner, sums[rank])
        return total / lengths[:, None]


def training_sample(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most per_language different texts of each language, the first by a hash of the text, so that copies do not
    crowd out others (of two texts with one hash both are taken). A histogram of the hashes tells which of their ranges
    hold a language's first ones, so that only about as many are ranked in one task, whatever a language's share; texts
    are read once the bounded list of hashes is known."""
    known = docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    ranged = known.select("lang", "h").distinct().withColumn("range", F.shiftright("h", 64 - RANGE_BITS))
    before = F.sum("n").over(W.partitionBy("lang").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sizes = ranged.groupBy("lang", "range").agg(F.count("*").alias("n"))
    first = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < per_language).select("lang", "range")
    ranked = ranged.join(F.broadcast(first), ["lang", "range"]).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    chosen = ranked.where(F.col("r") <= per_language).select("lang", "h")
    texts = known.join(F.broadcast(chosen), ["lang", "h"]).select("text", "lang").distinct()
    return sorted((r.text, r.lang) for r in texts.toLocalIterator())


_taggers: dict[str, Tagger] = {}
WORDS_AT_ONCE = 200_000


def language_column(docs: DataFrame, training: DataFrame):
    """A column of struct<lang, score> for docs' text, by a chain fitted on `training` (text, lang)."""
    chain = fit(training_sample(training))
    if chain is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang"), F.lit(0.0).alias("score"))
    sent, key = docs.sparkSession.sparkContext.broadcast(chain), uuid.uuid4().hex

    @arrow_udf("struct<lang:string,score:double>")
    def identify(text: pa.Array) -> pa.Array:
        if key not in _taggers:  # a worker keeps one chain
            _taggers.clear()
            _taggers[key] = Tagger(sent.value)
        tagger = _taggers[key]
        cells = as_binary(text)
        langs, scores = [UNDETERMINED] * len(cells), [0.0] * len(cells)
        held: list[tuple[int, list[str]]] = []
        n = 0
        for i, raw in enumerate(cells):
            if words := letter_words(raw.decode("utf-8", "replace") if raw else None):
                held.append((i, words))
                n += len(words)
            if held and (n > WORDS_AT_ONCE or i == len(cells) - 1):
                for (at, _), mean in zip(held, tagger.means([w for _, w in held]), strict=True):
                    best = int(mean.argmax())
                    langs[at], scores[at] = tagger.chain.languages[best], min(1.0, float(mean[best]))
                held, n = [], 0
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return identify.asNondeterministic()(F.col("text"))


def identify_languages(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score for each row of docs."""
    own = docs.select("doc_id", "text")
    return own.withColumn("p", language_column(own, training)).select(
        "doc_id", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


def keep_identified(
    docs: DataFrame, training: DataFrame, languages: list[str] | None = None, least: float = 0.0, fill: bool = False
) -> DataFrame:
    """The documents whose predicted language is one of `languages` (all learned ones by default) with a score of at
    least `least`. Texts without a letter are rejected. fill: a null `lang` becomes the predicted language."""
    mark = "__language"
    marked = docs.withColumn(mark, language_column(docs, training))
    kept = marked.where((F.col(f"{mark}.lang") != UNDETERMINED) & (F.col(f"{mark}.score") >= least))
    if languages is not None:
        kept = kept.where(F.col(f"{mark}.lang").isin(languages))
    named = F.coalesce(F.col("lang"), F.col(f"{mark}.lang")).alias("lang") if fill else None
    return kept.select(*[named if fill and c == "lang" else F.col(f"`{c}`") for c in docs.columns])
