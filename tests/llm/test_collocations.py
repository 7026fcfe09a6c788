"""Phrases against a brute-force version, and the passes against loops."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gleaner.llm import collocations as C

SCHEMA = "lang string, text string, key int, chunk int, n int, rank int, phrase string"


def brute(rows, least, most, percent, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {g: c for g, c in f.items() if len(g) > 2 and c >= least}
    out = {}
    for (lang, *w), a in frequent.items():
        longer = [c for (other, *v), c in frequent.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if any(100 * c >= percent * a for c in longer):
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, *w[:k]], f[lang, *w[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), a, left, right, n[lang], score))
    return sorted((lang, i, x[2].decode(), *x[3:]) for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top], 1))


def held(spark, rows, least=3, most=5, percent=100, top=2000, **work):
    docs = spark.createDataFrame([(*r, 7, 7, 7, 7, "p") for r in rows], SCHEMA)
    got = C.collocations(docs, least, most, percent, top, **work)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = brute(rows, least, most, percent, top)
    assert sorted(tuple(r) for r in got.collect()) == want
    return want


def sentences(seed, n, words=9):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(words)] + ["é\U0001f600", "Ab", "aB"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!? ", "\x0b"]
    return [(draw.choice(["en", "de", None, "und"]), "".join(draw.choice(names) + draw.choice(ends) for _ in range(draw.randrange(30)))) for _ in range(n)]


@pytest.mark.parametrize("most", [2, 3, 5])
def test_random_sentences(spark, most):
    assert held(spark, sentences(1, 120), most=most)


def test_parameters_and_small_chunks(spark):
    """Many chunks, and slices that end within texts."""
    rows = sentences(2, 150, 5)
    assert held(spark, rows, least=4, percent=60, chunk_bytes=200)
    assert held(spark, rows, least=4, percent=60, chunk_bytes=200, dictionary_bytes=0)
    assert len(held(spark, rows, least=2, top=3, chunk_bytes=30)) == 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert C.chunks_of(docs, 30).count() > C.chunks_of(docs, 200).count() > C.chunks_of(docs).count()


def test_odd_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " . , \t\n"), ("", "a b"), ("xx", "x" * 5000)] + [("en", "of the end")] * 5 + [("en", "a a a a a a a a")] + [("fr", "b " * 4000 + "c")]
    assert held(spark, rows)
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([("en", "one two")], "lang string, text string")).collect() == []
    with pytest.raises(ValueError):
        C.collocations(spark.createDataFrame(rows, "lang string, text string"), least=0)


def test_slices_and_runs():
    text = b"a b. c d, e f; g" * 50
    parts = list(C._slices(text, 40))
    assert b"".join(parts) == text and all(p[-1:] in b".,;" for p in parts[:-1]) and len(parts) > 10
    assert b"".join(C._slices(b"x" * 500, 40)) == b"x" * 500
    for ids in ([], [0], [5], [5, 6], [0, 5, 0, 6, 7, 0, 0, 8, 9, 0, 3], [1, 2, 0, 0, 3, 0]):
        got = C._runs(np.array(ids, np.uint32)).tolist()
        pairs = lambda x: [p for p in zip(x, x[1:], strict=False) if all(p)]
        assert pairs(got) == pairs(ids) and len(got) <= len(ids)


@pytest.mark.parametrize("batch", [2, 1000])
def test_run_lengths(spark, batch):
    """Keys whose ids hold zero bytes, in batches of two rows."""
    draw = random.Random(5)
    rows = [(bytes([0, 0, draw.randrange(3), draw.randrange(3), 0, 1, 0, 0]), draw.randrange(1, 4)) for _ in range(80)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = C.run_lengths(spark.createDataFrame(rows, "key binary, n long"), 20, 2).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    total = Counter()
    for k, n in rows:
        total[k] += n
    frequent = {k: n for k, n in total.items() if n >= 20}
    assert frequent and len(frequent) < len(total)
    assert {bytes(r.key): r.f for r in got} == frequent


@pytest.mark.parametrize("bits", [14, 6, 3])
def test_full_tables_lose_nothing(spark, bits):
    assert held(spark, sentences(4, 200, 30), least=2, bits=bits)
    assert held(spark, [("en", "to be or not to be. ") for _ in range(300)], least=300, bits=bits)


def test_sent_once_a_task(spark):
    """A task sends an n-gram of many chunks once, and hardly any n-gram that only shares a place with frequent ones."""
    draw = random.Random(6)
    often = [f"{a} {b}" for a in "abcdefgh" for b in "ijklmnop"] * 200
    rare = [f"w{draw.randrange(300)} w{draw.randrange(300)}" for _ in range(6000)]
    rows, least = [("en", x) for x in often + rare], 20
    chunks = C.materialized(C.chunks_of(spark.createDataFrame(rows, "lang string, text string").repartition(4), 200))
    ids = C.materialized(C.encoded(chunks, C.materialized(C.dictionary(chunks, least))))
    tables = [C._sketched(ids, range(2, 3), [], least, 11)]
    frequent = {x: c for x, c in Counter(rows).items() if c >= least}
    tasks = 2 * spark.sparkContext.defaultParallelism
    assert len(frequent) == 64 and chunks.count() > 20 * tasks
    assert len(frequent) <= C.grams_of(ids, 2, tables).count() <= 2 * tasks * len(frequent)


@pytest.mark.parametrize("work", [{"group_bytes": 40}, {"group_bytes": 40, "held_rows": 30}])
def test_groups_add_up(spark, work):
    rows = sentences(7, 150, 6)
    chunks = C.materialized(C.chunks_of(spark.createDataFrame(rows, "lang string, text string"), 60))
    ids = C.materialized(C.encoded(chunks, C.materialized(C.dictionary(chunks, 1))))
    each = {}
    for name, how in (("whole", {}), ("parts", work)):
        each[name] = Counter()
        for r in C.grams_of(ids, 4, [], **how).collect():
            each[name][bytes(r.key)] += r.n
    want = Counter()
    for r in ids.collect():
        own = np.frombuffer(r.ids, "<u4").tolist()
        for k in (2, 3, 4):
            want.update(tuple(own[i : i + k]) for i in range(len(own) - k + 1) if all(own[i : i + k]))
    assert want and each["whole"] == each["parts"] == {np.array(g + (0,) * (4 - len(g)), ">u4").tobytes(): n for g, n in want.items()}


def test_gaps():
    draw = np.random.default_rng(8)
    for places in ([], [0], [0, 0, 254, 254, 509, 1 << 20], np.sort(draw.integers(0, 5000, 3000)), np.sort(draw.integers(0, 1 << 32, 50))):
        places = np.array(places, np.uint32)
        assert C._from_gaps(C._gaps(places)).tolist() == places.tolist()


@pytest.mark.parametrize(("words", "bits"), [(0, 22), (1 << 27, 22), ((1 << 27) + 1, 23), (1_630_000_000, 26), (1 << 50, 32)])
def test_places_follow_the_words(spark, words, bits):
    assert C._bits(spark.createDataFrame([(words // 2,), (words - words // 2,)], "f long")) == bits


def test_tables_do_not_fill_up(spark, monkeypatch):
    """So many words that all of 64 places are full: with places for the words, hardly a rare pair is sent."""
    monkeypatch.setattr(C, "BITS", 6)
    draw = random.Random(9)
    rows = [("en", f"w{draw.randrange(200)} w{draw.randrange(200)}") for _ in range(30_000)] + [("en", "often seen")] * 60
    least = 60
    chunks = C.materialized(C.chunks_of(spark.createDataFrame(rows, "lang string, text string"), 2000))
    frequent = C.materialized(C.dictionary(chunks, least))
    ids = C.materialized(C.encoded(chunks, frequent))
    sent = {}
    for bits in (6, C._bits(frequent)):
        tables = [C._sketched(ids, range(2, 3), [], least, bits)]
        trimmed = C.materialized(C._trimmed(ids, tables, 400))
        whole = {bytes(r.key): r.f for r in C.run_lengths(C.grams_of(trimmed, 2, tables), least, 2).collect()}
        sent[bits] = C.grams_of(trimmed, 2, tables).select("key").distinct().count()
        assert list(whole.values()) == [60]
    assert sent[6] > 10_000 and sent[C._bits(frequent)] < 100


def test_groups_are_bounded():
    """A chunk larger than a group is cut, and at zeros only."""
    ids = np.array([i % 10 for i in range(5000)], "<u4")
    batch = C.pa.RecordBatch.from_arrays([C.pa.array([ids.tobytes(), ids[:20].tobytes()], C.pa.binary())], ["ids"])
    groups = [np.frombuffer(g, "<u4") for g in C._groups([batch], 400)]
    assert len(groups) > 40 and all(g.nbytes <= 2 * 400 for g in groups)
    assert np.concatenate(groups)[np.concatenate(groups) > 0].tolist() == [i for i in [*ids, *ids[:20]] if i]
    assert all((np.diff(g.astype(int))[g[:-1] > 0] % 10 == 1).all() for g in groups)
