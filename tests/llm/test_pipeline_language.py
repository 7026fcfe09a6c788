"""The pipeline's first stage on texts of no one language, and on texts without a label."""

from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import langid


def test_language_stage_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {x: [] for x in ("en", "de", "fr", "es")}
    for r in docs.orderBy("doc_id").collect():
        if len(words[r.lang]) < 200:
            words[r.lang] += langid.letter_words(r.text)
    mixed = " ".join(w for x in words.values() for w in x[:100])
    new = docs.limit(1).withColumn("new", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(t).alias("t")) for i, t in ((-1, mixed), (-2, " ".join(words["de"][:100])), (-3, "12 %"))])))
    kinds = dict(docs.dtypes)
    new = new.withColumns({"doc_id": F.col("new.i").cast(kinds["doc_id"]), "text": F.col("new.t"), "lang": F.lit(None).cast("string")}).select(docs.columns)
    kept = corpus_pipeline.identify_language(spark, docs.union(new), sf)
    assert kept.columns == docs.columns
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert got.get(-2) == "de" and -1 not in got and -3 not in got
    assert {i: x for i, x in got.items() if i >= 0} == {r.doc_id: r.lang for r in docs.collect() if langid.letter_words(r.text)}
