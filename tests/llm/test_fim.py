"""Infilling against a brute-force version, row by row over code points."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.llm import fim

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def brute(doc_id, text, rate=50, spm_rate=80, seed=42, piece_bytes=0):
    text = text or ""
    units = UNIT.findall(text)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(drawn[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def held(spark, rows, **rates):
    docs = spark.createDataFrame(rows, "doc_id long, text string, form int, __other string")
    done = fim.transform(docs, **rates).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    out = sorted(done.collect(), key=str)
    want = sorted((str((r[0], r[1], *brute(r[0], r[1], **rates))) for r in rows))
    assert sorted(str((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in out) == want
    assert all(r.back == (r.text or "") for r in out)
    assert all(r["__other"] == "x" for r in out)
    return out


def test_odd_texts(spark):
    texts = [
        None, "", " ", "\t\n", "a", " a", "a ", "  a  b  ", "one two three four", "ümläut straße \U0001f600 é  x y ",
        "has <P> in it", "ends with <M>", "<S>", "<P", "<P <S", "P> a", "almost <X> <P", "x" * 5000, "\x00 \x1f a\x0b\x0cb\x85c", "<", "<<S", "a<S b<M c<P d",
    ]
    rows = [(i * 100 + k, t, 1, "x") for i, t in enumerate(texts) for k in range(12)] + [(None, "null id here twice", 1, "x")] * 2 + [(None, None, None, "x")]
    out = held(spark, rows, rate=100)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    held(spark, rows, rate=50, spm_rate=0, seed=7)


def test_random_texts_in_small_pieces(spark):
    """Pieces of a few bytes: cuts and sentinels don't cross documents."""
    draw = random.Random(3)
    rows = [(i, "".join(draw.choices("ab \n<>PSMé\U0001f600", k=draw.randrange(90))), 0, "x") for i in range(1500)]
    held(spark, rows, rate=90, piece_bytes=64)
    held(spark, rows[:300], rate=90, piece_bytes=1)


def test_long_text_and_empty_table(spark):
    rows = [(i, ("word é\n" * 400_000)[: 2_000_000 + i], 0, "x") for i in range(3)]
    held(spark, rows, rate=100)
    empty = fim.transform(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("seed", [42, 1])
def test_shares(spark, seed):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r.form: r["count"] for r in fim.transform(docs, seed=seed).groupBy("form").count().collect()}
    assert abs(n["plain"] - 2000) < 150 and abs(n["spm"] - 1600) < 150 and abs(n["psm"] - 400) < 80
