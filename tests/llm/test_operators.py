"""The operators against brute force on small tables, and their cases: nulls, empty and long texts, ties, repeats,
empty tables, clashing columns."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import decontaminate, fingerprints, html_extract, langid, lm_score, mixing, pii, quality_knn, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OTHER = ", ".join(f"{c} int" for c in ("row", "raw", "list", "fp", "found", "prefix", "component", "copy", "__x"))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, and columns with names that operators use inside."""
    passage = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "!!! 123 ...", None, "b"),
        (5, passage, "en", "b"), (5, passage, "en", "b"), (None, passage + " end", "fr", None), (None, None, None, None),
        (6, "x" * 5000, "de", "c"), (7, "one two", "de", "c"), (8, "the of and " * 3000, "en", "c"), (9, "ümläut straße \U0001f600 " * 9, "de", ""),
    ]
    data = [(i, t, lang, src, len(t) if t is not None else None, *[7] * 9) for i, t, lang, src in rows]
    return spark.createDataFrame(data, f"{SCHEMA}, {OTHER}")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- 1: decontamination


def brute_contamination(texts, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    patterns = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    for key, text in texts:
        w = words(text)
        hit, ids = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if found := patterns.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= found
        yield key, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_contamination(spark, docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "The of"), (901, "of"), (902, None), (902, ""), (None, "and the of")], items.schema)
    for chosen in (items, items.union(extra)):
        want = sorted(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id if r.item_id is not None else "", r.text) for r in chosen.collect()]))
        got = decontaminate.contamination(docs, chosen).drop("item_ids")
        assert sorted(map(tuple, got.collect())) == want
    found = decontaminate.with_occurrences(docs, items, "f", block_bytes=600)  # many blocks
    assert [tuple(r) for r in found.select("doc_id", F.size("f.items")).orderBy("doc_id").collect()] == [
        (r[0], r[3]) for r in sorted(brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    ]


def test_contamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(40, 50))), (2, "one TWO")], "item_id long, text string")
    got = decontaminate.contamination(odd, items).orderBy("doc_id").collect()
    assert [r.doc_id for r in got if r.contaminated] == [None, 5, 5, 7]
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns
    assert decontaminate.drop_contaminated(odd, items).count() == odd.count() - 4


def test_pattern_tables():
    """Against plain search, with few words so that windows repeat; the tables stay small."""
    import tracemalloc

    rng = np.random.default_rng(4)
    vocabulary = [b"a", b"b", b"cc", b"d"]
    text = lambda n: b" ".join(vocabulary[int(i)] for i in rng.integers(0, 4, n))
    for window in (1, 2, 3, 5):
        items = [(str(i), text(int(rng.integers(0, 12)))) for i in range(12)]
        search = decontaminate.Machines(items, window).search
        for n in (0, 1, 4, 60):
            words = text(n).split() + [b"other"] * int(rng.integers(0, 2)) + text(7).split()
            spans, ids = set(), set()
            for item, raw in items:
                own = raw.split()
                size = min(window, len(own))
                for i in range(len(own) - size + 1 if size else 0):
                    for j in range(len(words) - size + 1):
                        if words[j : j + size] == own[i : i + size]:
                            spans.add((j, j + size))
                            ids.add(item)
            got = search(words)
            assert set(got[0]) == spans and got[1] == ids
    many = [(str(i), b" ".join(b"w%d" % x for x in rng.integers(0, 50_000, 1000))) for i in range(150)]
    tracemalloc.start()
    machines = decontaminate.Machines(many, 10)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 60 * sum(len(raw) for _, raw in many) and machines.search(many[7][1].split())[1] == {"7"}


# --- 2: language identification


def test_languages_held_out(spark, docs):
    out = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    learn = docs.join(out.select("doc_id"), "doc_id", "left_anti")
    got = langid.identify_languages(out, learn).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_forward_backward_blocks():
    rng = np.random.default_rng(1)
    chain = langid.Chain(["a", "b", "c"], np.zeros((langid.CELLS, 3)), {}, np.zeros(3), rng.normal(size=(3, 3)), rng.normal(size=3))
    words = {f"w{chr(97 + i)}": rng.normal(size=3) for i in range(20)}
    chain.emissions = lambda ws: np.array([words[w] for w in ws])
    texts = [[f"w{chr(97 + int(rng.integers(20)))}" for _ in range(n)] for n in (1, 3, 64, 65, 200)]
    got = langid.Tagger(chain).means(texts)
    for text, mean in zip(texts, got, strict=True):
        states, _ = langid.forward_backward(np.array([[words[w] for w in text]]), chain.start, chain.transitions)
        assert np.allclose(states[0].mean(axis=0), mean)
    exact = np.zeros((3, 3))  # all paths of three words
    e = np.array([words[w] for w in texts[1]])
    for path in np.ndindex(3, 3, 3):
        p = np.exp(chain.start[path[0]] + sum(chain.transitions[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[i, s] for i, s in enumerate(path)))
        for i, s in enumerate(path):
            exact[i, s] += p
    assert np.allclose((exact / exact.sum(axis=1, keepdims=True)).mean(axis=0), got[1])


def test_predictions(docs):
    """lang_pred and score against the chain run over each whole text in one pass."""
    learn = docs.where("doc_id % 3 <> 0")
    chain = langid.fit(langid.training_sample(learn))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.identify_languages(docs.where("doc_id % 3 = 0"), learn).collect():
        words = langid.letter_words(texts[r.doc_id])
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        states, _ = langid.forward_backward(chain.emissions(words)[None], chain.start, chain.transitions)
        mean = states[0].mean(axis=0)
        assert r.lang_pred == chain.languages[int(mean.argmax())] and r.score == pytest.approx(mean.max(), abs=1e-6)


def test_languages_switch(docs):
    sample = [(r.text, r.lang) for r in docs.collect()]
    chain = langid.fit(sample)
    assert np.argmax(chain.transitions, axis=1).tolist() == list(range(len(chain.languages)))
    by_lang = {lang: [langid.letter_words(t) for t, x in sample if x == lang] for lang in ("en", "de")}
    half = max(by_lang["en"], key=len)[:50] + max(by_lang["de"], key=len)[:50]
    mean = langid.Tagger(chain).means([half])[0]
    assert abs(mean[chain.languages.index("en")] - 0.5) < 0.1 and abs(mean[chain.languages.index("de")] - 0.5) < 0.1


def test_surface_cells():
    """Equal words have equal cells in any company; the counts are those of the affixes, the n-grams and the bias."""
    words = ["a", "of", "straße", "x" * 5000, "of", "ümläut"]
    cells, counts = langid.surface_cells(words)
    parts = np.split(cells, np.cumsum(counts)[:-1])
    for w, part in zip(words, parts, strict=True):
        n = min(len(w), langid.WORD_CUT)
        assert len(part) == 1 + 2 * min(3, n) + sum(max(0, n + 3 - g) for g in (2, 3, 4))
        assert part.tolist() == langid.surface_cells([w])[0].tolist() and part[0] == 0 and part.max() < langid.CELLS
    affixes = langid.surface_cells(["abcx"])[0], langid.surface_cells(["abcyz"])[0]
    assert len(set(affixes[0]) & set(affixes[1])) >= 3


def test_long_runs():
    """No letter of a run without spaces is left out."""
    run = "etwas" * 9 + "word" * 500
    words = langid.letter_words(f"1{run.upper()}2 end")
    assert "".join(words[:-1]) == run and words[-1] == "end" and max(map(len, words)) <= langid.WORD_CUT
    one, other = (set(langid.surface_cells(langid.letter_words("a" * langid.WORD_CUT + tail))[0]) for tail in ("the", "und"))
    assert one - other and other - one


def test_languages_sample(spark, docs):
    by_lang = {}
    for r in docs.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("h")).collect():
        by_lang.setdefault(r.lang, {})[r.h] = r.text
    want = sorted((texts[h], lang) for lang, texts in by_lang.items() for h in sorted(texts)[:20])
    hot = docs.where("text is not null and lang is not null").limit(1)
    for _ in range(6):
        hot = hot.union(hot)
    assert langid.training_sample(docs, 20) == want == langid.training_sample(docs.union(hot), 20)
    odd = spark.createDataFrame([(None, "en"), ("a", None), ("b", "en"), ("b", "de"), ("b", "en"), ("", "fr")], "text string, lang string")
    assert langid.training_sample(odd) == [("", "fr"), ("b", "de"), ("b", "en")]
    assert langid.training_sample(odd.limit(0)) == []


def test_languages_odd(odd, empty, docs):
    got = {(r.doc_id, r.lang_pred) for r in langid.identify_languages(odd, docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "und")} <= got and (5, "und") not in got
    assert {r.lang_pred for r in langid.identify_languages(odd, empty).collect()} == {"und"}
    assert langid.identify_languages(empty, docs).count() == 0
    assert langid.keep_identified(odd, docs).columns == odd.columns


# --- 3: repeated passages


def brute_removals(texts, length=400):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        yield len(r), len(r) - len(kept), len(re.findall(b"\1+", gone)), hashlib.sha256(kept).hexdigest()


def brute_shared_words(texts, size=51, least=191):
    raws, having = [(t or "").encode() for t in texts], {}
    words = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)] for r in raws]
    strings = [[r[w[p][0] : w[p + size - 1][1]] for p in range(len(w) - size + 1)] for r, w in zip(raws, words, strict=True)]
    for i, own in enumerate(strings):
        for x in own:
            having.setdefault(x, set()).add(i)
    copies = Counter(raws)
    for r, w, own in zip(raws, words, strings, strict=True):
        hit = set()
        for p, x in enumerate(own):
            if len(x) >= least and len(having[x]) > 1:
                hit |= set(range(p, p + size))
        yield len(w) if copies[r] > 1 and len(w) >= size and len(r) >= least else len(hit)


def test_removals(spark, docs, odd, empty):
    rng = np.random.default_rng(5)
    shared = "".join(chr(97 + int(x)) for x in rng.integers(0, 4, 900))
    hard = [shared[:500], "z" + shared[:399] + "q", "y" + shared[100:500] + "p", shared[300:700] + shared[299:699], "ab" * 300, "ab" * 300 + "c",
            "e" * 399, "e" * 400, "é" * 250, shared[:450] + "X" + shared[450:]]
    said = ["".join(chr(97 + int(x)) for x in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(60)]
    hard += ["Here " + " ".join(said[:51]) + " ends", "There " + " ".join(said[:52]) + "\nstops", " ".join(said[3:53]) + " x", "a b " * 300, "a b " * 299 + "c"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000 + i, t) for i, t in enumerate(hard)] + [(r.doc_id, r.text) for r in odd.collect()]
    got = suffix_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    all_texts = [t for _, t in rows]
    want = [(i, *w, n) for (i, _), w, n in zip(rows, brute_removals(all_texts), brute_shared_words(all_texts), strict=True)]
    key = lambda r: (r[0] is not None, *[x if x is not None else 0 for x in r])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert suffix_dedup.removals(empty).count() == 0


# --- 4: fingerprints


def test_edited(docs, odd, empty):
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = set()
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        want.add((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    got = fingerprints.edit_report(docs).collect()
    assert {(r.doc_id, r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(rows)
    by_text = {}
    for r in got:
        assert by_text.setdefault(dict(rows)[r.doc_id], r.fingerprint) == r.fingerprint
    long = [r for r in got if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > np.mean([r.near_next for r in long]) + 0.2
    report = fingerprints.edit_report(odd).collect()
    assert len(report) == odd.count() and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in report)
    assert fingerprints.edit_report(empty).count() == 0


def test_fingerprint_votes(docs, texts, spark):
    some = {i: texts[i] for i in sorted(texts)[:20]}
    got = {r.doc_id: r.fingerprint for r in fingerprints.document_fingerprints(docs.where(F.col("doc_id").isin(*some))).collect()}
    shingles = []
    for i, text in some.items():
        w = [x for x in re.split(r"[\t\n\x0b\x0c\r ]", text.lower()) if x]
        shingles += [(i, *(w[j : j + 3] + [None, None])[:3]) for j in range(len(w))]
    df = spark.createDataFrame(shingles, "i long, a string, b string, c string")
    votes = {}
    for r in df.select("*", *[F.xxhash64(F.lit(s), "a", "b", "c").alias(f"h{s}") for s in (1, 2)]).collect():
        size = sum(len(x or "") for x in (r.a, r.b, r.c))
        weight = min(3, 1 + size // 9)
        for s in (1, 2):
            bits = np.array([(r[f"h{s}"] >> b) & 1 for b in range(64)])
            votes.setdefault((r.i, s), np.zeros(64))[:] += weight * (2 * bits - 1)
    for i in some:
        assert got[i] == "".join(f"{sum(1 << b for b in range(64) if votes[i, s][b] > 0):016x}" for s in (1, 2))


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    fps = [int(a) << 64 | int(b) for a, b in rng.integers(0, 2**63 - 1, (40, 2))]
    for x in fps[:20]:
        for k in (0, 1, 2, 3, 4):
            y = x
            for b in rng.choice(128, k, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    df = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(fps)], "doc_id long, fingerprint string")
    asked = df.where("doc_id % 3 = 0")
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(fps) for j, b in enumerate(fps) if i % 3 == 0 and (a ^ b).bit_count() <= 3}
    assert {tuple(r) for r in fingerprints.neighbours(df, asked, 3).collect()} == want
    n = {r.fingerprint: r.n for r in fingerprints.near_counts(df, asked, 3).collect()}
    assert n == {f"{fps[i]:032x}": sum(q == i for q, _, _ in want) for i in {q for q, _, _ in want}}


def test_near_documents(docs):
    """The report's links of documents against all pairs of fingerprints."""
    got = fingerprints.edit_report(docs, 12).collect()
    number = {r.doc_id: int(r.fingerprint, 16) for r in got}
    for r in got:
        near = sum((number[r.doc_id] ^ x).bit_count() <= 12 for i, x in number.items() if i != r.doc_id)
        assert r.n_near == (near if r.doc_id % 100 == 0 else None)


def test_next_ties(spark):
    """Of equal ids the lesser text comes first, for the edited text and for near_next."""
    rows = [(1, "b b b b"), (1, "a a a a"), (1, "b b b b"), (2, "c c c c"), (3, "d d d d"), (None, "e e")]
    got = fingerprints.edit_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = ["a a a a", "b b b b", "b b b b", "c c c c", "d d d d"]
    want = sorted(hashlib.sha256((t[:4] + u[:3]).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1], strict=True))
    assert sorted(r.edited_sha256 for r in got if r.doc_id is not None) == want
    assert sorted(r.near_next for r in got if r.doc_id == 1)[-1] == 1.0 and [r.near_next for r in got if r.doc_id is None] == [0.0]


def test_many_ranges(spark, docs):
    """Ten thousand partitions don't make a plan of as many expressions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10000")
    try:
        plan = fingerprints.bucketed(docs.select("doc_id"))
        assert len(plan._jdf.queryExecution().optimizedPlan().toString()) < 2_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    got = {r.doc_id: r.b for r in fingerprints.bucketed(docs.select("doc_id"), "b").collect()}
    assert [got[i] for i in ids] == sorted(got.values()) and len(set(got.values())) > 5


# --- 5: language-model scores


def test_lm_score(spark, docs, sf, odd, empty):
    target = lm_score.labelled_target(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    words, heads = 300, 40
    got = {r.doc_id: r for r in lm_score.score(docs, target, words, heads).collect()}
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    counts = Counter(w for ws in rows.values() for w in ws)
    top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:words]
    ids = {w: i for i, w in enumerate(top, 1)}
    kind = lambda i: i if 0 < i <= heads else heads + 1

    def model(many):
        pairs, uni, c = Counter(), Counter(), Counter()
        for ws in many:
            seq = [ids.get(w, 0) for w in ws]
            c.update(seq)
            ks = [0, *map(kind, seq)]
            pairs.update(zip(ks, ks[1:], strict=False))
            uni.update(ks[1:])
        before = Counter()
        for (a, _), n in pairs.items():
            before[a] += n
        in_class, members = Counter(), Counter(kind(i) for i in range(words + 1))
        for i, n in c.items():
            in_class[kind(i)] += n
        total = sum(uni.values())

        def loss(ws):
            seq = [ids.get(w, 0) for w in ws]
            ks, out = [0, *map(kind, seq)], 0
            for a, b, i in zip(ks, ks[1:], seq, strict=False):
                u = (uni[b] + 1) / (total + heads + 2)
                bi = pairs[a, b] / before[a] if before[a] else u
                out -= math.log((0.7 * bi + 0.3 * u) * (c[i] + 1) / (in_class[b] + members[b]))
            return out / len(seq) if seq else 0

        return loss

    good = [tokens(r.text) for r in target.collect()]
    a, b = model(good), model(rows.values())
    for i, ws in rows.items():
        assert got[i].n_tokens == len(ws)
        assert got[i].loss_target == pytest.approx(a(ws), rel=1e-5) and got[i].score == pytest.approx(b(ws) - a(ws), abs=1e-5)
    by_ids = lm_score.score(docs, lm_score.labelled_ids(spark.read.parquet(f"{sf}/labels.parquet")), words, heads)
    assert sorted(map(tuple, by_ids.collect())) == sorted(map(tuple, got.values()))
    assert lm_score.score(odd, odd.select("doc_id")).count() == odd.count()
    assert lm_score.score(empty, empty.select("doc_id")).count() == 0
    assert lm_score.score(odd, odd.select("text").limit(3)).count() == odd.count()
    assert lm_score.score(empty, empty.select("text")).count() == 0
    assert lm_score.score(docs, empty.select("text")).where("score is null").count() == 0


def test_lm_score_whole(spark, docs, sf, odd, empty, monkeypatch):
    """By default all words and bigrams of the corpus count, the rarest as well, however they are dealt."""
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", 5_000)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    target = lm_score.labelled_target(docs, labels)
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    different = len({w for ws in rows.values() for w in ws})

    def model(many):
        words, firsts, pairs = Counter(), Counter(), Counter()
        for ws in many:
            words.update(ws)
            firsts.update([None, *ws][: len(ws)])
            pairs.update(zip([None, *ws], ws, strict=False))

        def loss(ws):
            out = 0
            for a, b in zip([None, *ws], ws, strict=False):
                u = (words[b] + 1) / (words.total() + different + 2)
                out -= math.log(0.7 * (pairs[a, b] / firsts[a] if firsts[a] else u) + 0.3 * u)
            return out / len(ws) if ws else 0

        return loss

    a, b = model([tokens(r.text) for r in target.collect()]), model(rows.values())
    for aim in (target, lm_score.labelled_ids(labels)):
        got = lm_score.score(docs, aim).collect()
        assert len(got) == len(rows)
        for r in got:
            want = a(rows[r.doc_id]), b(rows[r.doc_id])
            assert r.n_tokens == len(rows[r.doc_id]) and (r.loss_target, r.loss_background) == pytest.approx(want)
    other = spark.createDataFrame([("never seen before, only here",), (None,)], "text string")
    seen = lm_score.score(docs, other).where("n_tokens > 0").first()
    assert seen.loss_target == pytest.approx(model([tokens("never seen before, only here")])(rows[seen.doc_id]))
    assert lm_score.score(odd, odd.select("doc_id")).count() == odd.count() == lm_score.score(odd, odd.select("text")).count()
    assert lm_score.score(empty, empty.select("doc_id")).count() == 0 == lm_score.score(empty, empty.select("text")).count()
    assert lm_score.score(docs, empty.select("text")).where("score is null").count() == 0


# --- 6: near-duplicates


def test_near_duplicates(docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[doc_id] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = simhash_dedup.near_duplicates(docs).collect()
    assert sorted(map(tuple, got)) == [(i, f"{prints[i]:016x}", find(i)) for i in ids]
    kept = simhash_dedup.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids}) and kept.columns == docs.columns
    assert simhash_dedup.near_duplicates(odd).count() == odd.count()
    zero = simhash_dedup.near_duplicates(odd).where("fingerprint = '0000000000000000'").collect()
    assert {r.component_id for r in zero} == {1}
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.where("doc_id = 5 or doc_id is null").collect()] == [5]
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_ball_links(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(2**62))
    fps = {centre}
    while len(fps) < 400:  # a dense cluster around one fingerprint, and lone ones
        x = centre
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 2**63 - 1, 300)}
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    label = {x: x for x in signed}
    changed = True
    near = {x: [y for y in signed if ((x ^ y) & (2**64 - 1)).bit_count() <= 4] for x in signed}
    while changed:
        changed = False
        for x in signed:
            low = min(label[y] for y in near[x])
            if low < label[x]:
                label[x], changed = low, True
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    with pytest.raises(ValueError):
        simhash_dedup.links(df, 3)
    for size in (2_000_000, 20_000):
        parts = simhash_dedup._classes(df, 4).collect() if size > 1e6 else None
        links = simhash_dedup.links(df, 4, size)
        from gleaner.llm.components import connected_components

        got = {r.node: r.component for r in connected_components(links).collect()}
        assert {x: got.get(x, x) for x in signed} == label
        if parts:
            assert len(parts) == len(signed)


# --- 7: quality


def test_quality(spark, docs, sf, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = quality_knn.quality_scores(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    right = {y: [(r.score >= 0.7) == bool(y) for r in got if r.quality == y] for y in (0, 1)}
    assert np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.95, {y: (np.mean(v), len(v)) for y, v in right.items()}
    scores = quality_knn.quality_scores(odd, labels.where("false")).collect()
    assert {r.score for r in scores} == {0.5} and len(scores) == odd.count()
    assert quality_knn.quality_scores(odd, spark.createDataFrame([(5, 1), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")).where("score is null").count() == 0
    assert quality_knn.quality_scores(empty, labels).count() == 0


def test_votes(docs):
    """The votes against plain nearest neighbours, one document at a time."""
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").limit(120).collect()] + [(-1, ""), (-2, "x" * 4000), (-3, "a b " * 2000)]
    sample = [(t, i % 2) for i, t in rows[:50]] + [(t, 1) for _, t in rows[50:60]]
    idf = np.linspace(0.1, 3, quality_knn.TERMS).astype(np.float32)
    model, terms = quality_knn.fit(sample, idf), quality_knn.Terms()

    def vector(text):
        w = np.zeros(quality_knn.TERMS)
        for c, n in zip(*terms.counts(text), strict=True):
            w[c] = (1 + math.log(n)) * idf[c]
        v = (w / np.linalg.norm(w)) @ model.projection
        return v / np.linalg.norm(v)

    labelled = [(vector(t), y) for t, y in sample]
    got = quality_knn.votes(model, [terms.counts(t) for _, t in rows])
    for (_, text), score in zip(rows, got, strict=True):
        own = vector(text)
        near = sorted(((float(own @ v), y) for v, y in labelled), key=lambda x: -x[0])
        limit = near[quality_knn.NEIGHBOURS - 1][0]
        if near[quality_knn.NEIGHBOURS][0] > limit - 1e-6:
            continue  # a tie at the last neighbour: either may vote
        weights = [(math.exp(quality_knn.SHARPNESS * (c - 1)), y) for c, y in near[: quality_knn.NEIGHBOURS]]
        want = (sum(w * y for w, y in weights) + 0.5e-3) / (sum(w for w, _ in weights) + 1e-3)
        assert score == pytest.approx(want, abs=1e-3)


def test_quality_odd(spark):
    """Repeated rows, long texts and ties score alike."""
    rows = [(i, t, 7) for i, t in enumerate(["good words here", "good words here", "BAD!!! " * 5000, "BAD!!! " * 5000, "", None, "\U0001f600"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (2, 1), (3, 0), (99, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_knn.quality_scores(docs, labels).collect()}
    assert len(got) == 7 and all(0 <= x <= 1 for x in got.values())
    assert all(got[i] == pytest.approx(got[i + 1], abs=1e-9) for i in (0, 2, 4))
    assert got[0] > got[2]


def test_long_tokens():
    """The whole token makes its word's and its shape's term."""
    start = "a" * 60
    assert quality_knn.shape(start + "9Z") == "a9A"
    counts = [quality_knn.Terms().counts(start + tail)[0].tolist() for tail in ("", "bc", "bd", "9Z")]
    assert len(set(map(tuple, counts))) == len(counts)


# --- 8: main text


def page(*blocks, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}<article>{''.join(blocks)}</article>{after}</body></html>"


def test_main_text():
    nav = '<nav><ul><li><a href="/a">Home</a></li></ul></nav><script>var t="</p>";x(0);</script><!-- ad --><div class="ad">Buy this now please.</div>'
    foot = "<aside>Read more of it here</aside><section id='comments'><p>First comment! So good.</p></section><footer>&copy; me</footer>"
    html = page("<h1>A &amp; B&#39;s</h1>", "<p><b>One\n two<br><p>three  <i>fo</i>ur.</p>", "<p>Ok.</p>", before=nav, after=foot)
    assert html_extract.main_text(html) == "A & B's\n\nOne two\n\nthree four.\n\nOk."
    plain = '<div id="menu"><a href=1>x</a></div><div><h2>Title</h2><p>' + "long text " * 20 + "</p><p>end</p></div><form>Name <input></form><div class=sidebar>side</div>"
    assert html_extract.main_text(plain) == "Title\n\n" + ("long text " * 20).strip() + "\n\nend"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<nav>a</nav>") == ""
    assert html_extract.main_text(page("<p>a < b && c</p>", "<p>open")) == "a < b && c\n\nopen"
    assert html_extract.main_text(page("<header><h1>H</h1></header><p>t</p><div class='cookie-notice'>We use cookies</div><p>u</p><article class='comment'>no</article>")) == "H\n\nt\n\nu"
    assert html_extract.main_text(page("<p>" + "w " * 200000 + "</p>")).count("w") == 200000


def test_article_parts():
    """Ids made of titles, formulas and links are text; furniture in an article is not."""
    html = page(
        '<h2 id="related-work">Related work</h2><p>One.</p><section id="search-algorithms"><p>Two.</p></section>',
        '<div id="social-history"><p>Three.</p></div><p>So <math><mi>x</mi></math> holds.</p>',
        '<div class="share-buttons">Tweet</div><div id="comments"><p>Nice!</p></div><ul class="related"><li>More</li></ul>',
        '<p><a href="/x">A last line that is one link</a></p>',
    )
    want = ["Related work", "One.", "Two.", "Three.", "So x holds.", "A last line that is one link"]
    assert html_extract.main_text(html) == "\n\n".join(want)
    assert html_extract.main_text("<p>1 < 2 and <b>so</b> <") == "1 < 2 and so <"
    assert html_extract.main_text("<p>a<!-- b") == html_extract.main_text("<p>a<script>b") == html_extract.main_text("<p>a<b c") == "a"
    assert html_extract.main_text("<p title='>'>a<p id=it's>b") == "a\n\nb"


def test_malformed_pages():
    """Time in proportion to the page, whatever is left open in it."""
    from time import process_time

    for part in ('<a "x ', "<div></b>", "<b><div>", "<svg>", "<a href='", "<!x", "</a", "<p><i>", "<", "<div class='a b'>", "&amp;<a>"):
        began = process_time()
        html_extract.main_text(part * (1_000_000 // len(part)))
        assert process_time() - began < 10, part


def test_varied_pages():
    """Articles put together from known blocks, with furniture around and between, against their own blocks."""
    rng = np.random.default_rng(8)
    words = [str(w) for w in ("river", "of", "stone", "&amp;", "light", "é", "a", "long", "winding", "x&lt;y")]
    from html import unescape

    for _ in range(60):
        blocks, body = [], []
        for _ in range(int(rng.integers(1, 12))):
            text = " ".join(rng.choice(words, int(rng.integers(1, 60))))
            tag = str(rng.choice(["p", "h2", "li", "blockquote", "pre", "td", "figcaption"]))
            inner = {"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(tag, f"<{tag} id='part-{len(blocks)}'>{{}}</{tag}>")
            body.append(inner.format(text.replace(" long ", "\n<em>long</em> ")))
            blocks.append(unescape(text))
            if rng.random() < 0.3:
                body.append(str(rng.choice(["<div class='ad'>Buy now</div>", "<aside>See also</aside>", "<script>a<b</script>", "<form>Mail <input></form>"])))
        html = page(*body, before="<header>Site</header><nav><a href=/>Home</a></nav>", after="<footer>Us</footer>")
        assert html_extract.main_text(html) == "\n\n".join(blocks)


def test_extract_odd(spark):
    rows = [(1, "u", None, 7), (1, "u", "", 7), (None, None, "<p>hello there</p>", 7), (None, None, "<p>hello there</p>", 7), (2, "v", "plain", None)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("hello there", 11), ("hello there", 11), ("plain", 5)]


def test_extract_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    from html import unescape

    for r, p in zip(html_extract.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*)</article>", p.html, re.DOTALL)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    assert html_extract.extract(pages.limit(0)).count() == 0


# --- 9: mixing


def test_mixing(spark, docs, odd, empty):
    weights = spark.createDataFrame([("src1", 3.0), ("src2", 1.0), ("none", 2.0), ("src3", 0.0)], "source string, weight double")
    copies = mixing.mix(docs, weights)
    assert {r.source for r in copies.select("source").distinct().collect()} <= {"src1", "src2"}
    n = Counter(r.source for r in docs.collect())
    total = sum(n.values())
    want = []
    for r in docs.collect():
        w = {"src1": 3, "src2": 1}.get(r.source, 0) / 4
        rate = w * total / n[r.source]
        u = (int(hashlib.md5(f"mix-1:{r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        k, term = 0, math.exp(-rate)
        cdf = term
        while w and cdf < u and k < 500:
            k += 1
            term *= rate / k
            cdf += term
        want += [(r.doc_id, k, i) for i in range(k)]
    assert sorted((r.doc_id, r.n_copies, r["copy"]) for r in copies.collect()) == sorted(want)
    assert abs(len(want) - total) < 5 * math.sqrt(total) + 60
    assert set(mixing.mix(odd).columns) == {*odd.columns, "n_copies"}
    assert mixing.mix(empty).count() == 0


def test_mixing_odd(spark, odd):
    """Null ids, texts and sources are repeated like others, and columns named like the operator's own stay."""
    heavy = odd.withColumns({c: F.lit(3) for c in ("rate", "cdf", "n", "w", "given", "n_copies", "__row")})
    got = mixing.mix(heavy)
    assert set(got.columns) == set(heavy.columns) and got.where("rate <> 3 or cdf <> 3 or w <> 3 or n <> 3").count() == 0
    rates = {None: 12 / 5 / 3, "a": 12 / 5 / 2, "b": 12 / 5 / 3, "c": 12 / 5 / 3, "": 12 / 5}
    want = Counter()
    for r in odd.collect():
        u = (int(hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        k, term = 0, math.exp(-rates[r.source])
        cdf = term
        while cdf < u:
            k += 1
            term *= rates[r.source] / k
            cdf += term
        want[r.doc_id, r.text, r.source] += k
    assert Counter((r.doc_id, r.text, r.source) for r in got.collect()) == +want
    assert any(t is None for _, t, _ in +want) and any(s is None for _, _, s in +want)


def test_mixing_rates(spark):
    """A rate of a million is drawn in parts, and its copies are all there."""
    rows = [(i, "rare" if i == 0 else "common", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights = spark.createDataFrame([("rare", 50_000.0), ("common", 1.0)], "source string, weight double")
    big = docs.union(docs.where("doc_id > 0").withColumn("doc_id", F.col("doc_id") + 100))
    copies = mixing.mix(big, weights).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("copy").alias("k"), F.max("n_copies").alias("m"))
    got = {r.doc_id: r for r in copies.collect()}
    assert got[0].n == got[0].k == got[0].m and abs(got[0].n - 79) < 60
    huge = spark.range(1).selectExpr("id AS doc_id", "'a' AS source", "'t' AS text").union(spark.range(1, 1001).selectExpr("id", "'b'", "'t'"))
    n = mixing.replicas(huge, spark.createDataFrame([("a", 999.0), ("b", 1.0)], "source string, weight double")).where("source = 'a'").count()
    assert abs(n - 1001 * 0.999) < 6 * math.sqrt(1001)
    rates = mixing.rates(spark.range(10**6).selectExpr("if(id = 0, 'a', 'b') AS source")).where("__mix_source = 'a'").first()
    assert rates["__mix_parts"] == 977 and abs(rates["__mix_cdf"][-1] - 1) < 1e-9


# --- 10: personal data


def brute_base(text):
    found, t = [], text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = digits(m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


HARD = [
    "a@b.c_x@d.e a@b c@d.e @x.y é\U0001f600é me@host.co.uk, 1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.255 4111 1111 1111 1111 4111-1111-1111-1112",
    "+1 (743) 555-3824 +12 +1-2 +49 30 1234567890123456 1+1 (743) 555-3824x. call 743-555-3824 now, version 743-555-3824",
    "mail john [at] site dot com and x(at)y.org; SSN 123-45-6789. Dear Mr. John Smith, 1234 5678 9012 3456 7890 1 0000-0000-0000",
    "7" * 30000 + "@" + "a" * 30000, "a@" * 3000, "a.b." * 5000, "1." * 9000, "+1" * 4000, "+" + "1 (" * 4000,
]


def test_base_spans(spark, docs, odd, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(9000 + i, t) for i, t in enumerate(HARD)]
    got = {r.doc_id: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        base = brute_base(text)
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)], doc_id
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), doc_id
        assert not base or set(line.split(",")) <= set(r.spans.split(",")), doc_id
        if doc_id < 9000:  # what the method adds are the planted secrets
            found = re.finditer(r"""(?<=password=)[0-9a-f]{18}\b|(?<=token = ")[0-9a-f]{40}(?=")|\bAKIA[0-9A-Z]{16}\b""", text)
            spans = sorted([*base, *[(m.start(), pii.KINDS.index("secret"), m.end()) for m in found]])
            assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans) and r.n_spans == len(spans)
    assert pii.report(odd).count() == odd.count() and pii.report(empty).count() == 0


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "é mail a@b.com or +1 (743) 555-3824!", 3), (2, None, None), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(df).collect()}
    assert got == {1: ("é mail [EMAIL] or [PHONE]!", 26), 2: (None, None), 3: ("clean", 5)}
    assert pii.redact(odd).columns == odd.columns


def test_name_candidates(spark):
    """A name of any script's capitals is a candidate without another one in the text."""
    texts = ["Frau Özdemir kam.", "Bonjour Mme Élodie Îlet", "Mr Smith", "Mr. smith, Herr"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.v for r in pii.candidates(df).select("doc_id", F.col("__pii_more.value").alias("v")).collect()}
    assert got == {0: ["Özdemir"], 1: ["Élodie Îlet"], 2: ["Smith"], 3: []}


def test_added_spans(spark):
    """Planted personal data of the added kinds among strings that look alike: found, with few others."""
    rng = np.random.default_rng(6)
    pick = lambda *options: str(options[int(rng.integers(len(options)))])
    hexes = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    digits = lambda n: "".join(pick(*"0123456789") for _ in range(n))
    name = lambda: pick("John", "Maria", "Özlem", "Peter", "Anna", "Luis") + " " + pick("Smith", "Okafor", "Müller", "García")
    true = {
        "email": lambda: f"{pick('mail', 'contact')} |{pick('ann', 'bob.x', 'j_doe')}{pick(' [at] ', '(at)', ' (at) ')}host{pick('.com', '.org', ' [dot] net')}| soon",
        "phone": lambda: f"{pick('call', 'tel', 'phone:')} |{digits(3)}-{pick('2', '5', '8')}{digits(2)}-{digits(4)}| now",
        "ssn": lambda: f"{pick('SSN', 'social security')} |{pick('1', '2', '5')}{digits(2)}-{pick('1', '4')}{pick('1', '7')}-{pick('3', '8')}{digits(3)}| is",
        "name": lambda: f"Dear {pick('Mr', 'Mrs.', 'Dr', 'Frau')} |{name()}|, hello",
        "secret": lambda: pick(f"password=|{hexes(18)}|", f'token = "|{hexes(40)}|"', f"use |AKIA{digits(4)}{pick('QX', 'ZB')}{digits(5)}{pick('K', 'T')}{digits(4)}| here"),
    }
    false = [lambda: f"version {digits(3)}-555-{digits(4)}", lambda: f"order {digits(3)}-11-{digits(4)}", lambda: f"commit {hexes(40)}", lambda: "see some_long_identifier_name2 there", lambda: f"file /usr/share/lib{digits(1)}/readme"]
    rows, want = [], {}
    for i in range(600):
        text, spans = "", set()
        for _ in range(int(rng.integers(1, 4))):
            kind = pick(*true, *["none"] * 3)
            line = true[kind]() if kind in true else false[int(rng.integers(len(false)))]()
            before, *rest = line.split("|")
            if rest:
                start = len(text) + len(before)
                spans.add(f"{kind}:{start}:{start + len(rest[0])}")
            text += line.replace("|", "") + " and then "
        rows.append((i, text, 1))
        want[i] = spans
    df = spark.createDataFrame(rows, "doc_id long, text string, __base int")
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.report(df).collect()}
    hit, told, real = sum(len(got[i] & want[i]) for i in want), sum(map(len, got.values())), sum(map(len, want.values()))
    by_kind = {k: [sum(x.startswith(k) for i in want for x in s(i)) for s in (lambda i: got[i] & want[i], lambda i: want[i])] for k in true}
    assert hit >= 0.9 * real and hit >= 0.9 * told and all(a >= 0.8 * b for a, b in by_kind.values()), (hit, told, real, by_kind)


def test_few_literals(spark):
    """Whatever symbols stand around spans, the classifier has few values of each feature."""
    rows = [(i, f"{chr(0x4E00 + i)}call 743-555-{i:04d}{chr(0x2600 + i)}") for i in range(500)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(pii.train(found).odds) < 300


def test_expectation_maximisation():
    rng = np.random.default_rng(0)
    counts = Counter()
    truth = rng.random(4000) < 0.4
    for t in truth:
        vote = [int(t) if rng.random() < p else int(not t) for p in (0.95, 0.9, 0.8)]
        counts[0, (*vote, None)] += 1
    model = pii.expectation_maximisation(counts)
    assert abs(model.prior[0] - truth.mean()) < 0.05
    assert abs(model.right[0, "form"][0] - 0.95) < 0.05 and abs(model.right[0, "context"][1] - 0.8) < 0.06
