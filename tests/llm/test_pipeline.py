"""The pipeline's stages against brute force, each on what the one before kept."""

import re

import pytest

import corpus_pipeline
from gleaner.llm import langid, simhash_dedup
from test_operators import brute_contamination


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = corpus_pipeline.materialized(stage(spark, docs, sf))
        out.append((name, docs.columns, docs.collect(), kept.columns, kept.collect()))
        docs = kept
    return {name: rest for name, *rest in out}


def test_stages(spark, sf, steps):
    assert list(steps) == ["language_id", "near_dedup", "decontamination", "pii", "mixing"]
    assert all(steps[name][0] == steps[name][2] for name in list(steps)[:-1])

    _, before, _, after = steps["language_id"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if langid.letter_words(r.text))

    _, before, _, after = steps["near_dedup"]
    prints = {r.doc_id: simhash_dedup.fingerprint_of(r.text.encode()) for r in before}
    kept, left = [], set(prints)
    while left:
        group, more = set(), {min(left)}
        while more:
            group |= more
            more = {j for j in left - group if any((prints[i] ^ prints[j]).bit_count() <= 4 for i in more)}
        kept.append(min(group))
        left -= group
    assert sorted(r.doc_id for r in after) == kept

    _, before, _, after = steps["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_contamination([(r.doc_id, r.text) for r in before], items) if r[-1]}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in bad)

    _, before, _, after = steps["pii"]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert any(email.search(r.text) for r in before) and not any(email.search(r.text) for r in after)

    _, before, _, after = steps["mixing"]
    texts = {r.doc_id: r.text for r in before}
    assert after and all(texts[r.doc_id] == r.text for r in after)
