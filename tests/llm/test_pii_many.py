"""Documents with many spans: positions and redacted texts by loops, in time that doesn't grow with their square."""

import hashlib
import random
import re
import time

from gleaner.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_stretches_of_spans(spark):
    """Numbers of spans about the borders of stretches; text of several bytes a symbol between them."""
    draw = random.Random(6)
    texts = [" ".join(draw.choice(["é\U0001f600", "word", "at"]) + f" user{i}@mail{i % 7}.com" for i in range(n)) + draw.choice(["", " end é"]) for n in (0, 1, 127, 128, 129, 256, 300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    for i, text in enumerate(texts):
        want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(EMAIL, text))
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert clean[i] == re.sub(EMAIL, "[EMAIL]", text)


def test_many_spans_take_about_linear_time(spark):
    def took(n):
        docs = spark.createDataFrame([(1, " ".join(f"user{i}@mail{i % 7}.com wrote" for i in range(n)))], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.report(docs).first().n_email == n
        assert pii.redact(docs).first().text.count("[EMAIL]") == n
        return time.perf_counter() - began

    took(10)
    base = took(10)
    assert took(40_000) < base + 30
