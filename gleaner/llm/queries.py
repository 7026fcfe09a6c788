"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, decontaminate, fim, fingerprints, html_extract, langid, lm_score, mixing, pii, quality_knn, simhash_dedup, suffix_dedup, warc,
)
from .common import read_table, remainder


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in documents."""
    found = decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("item_ids")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of documents, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    own = docs.select("doc_id", "text")
    marked = own.withColumn("p", langid.language_column(own, docs.where(~held_out)))
    return marked.select("doc_id", held_out.alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of documents without the passages of 400 bytes that occur twice."""
    return suffix_dedup.removals(read_table(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by how much more they are like those of good quality than like the corpus."""
    docs = read_table(spark, sf_dir, "documents")
    return lm_score.score(docs, lm_score.labelled_ids(read_table(spark, sf_dir, "labels")))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose fingerprints differ in four bits at most."""
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of documents, learned from labels that are not held out."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = quality_knn.quality_scores(docs, labels.where(~held_out))
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_knn.CUT).cast("int").alias("predicted")
    )


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of pages."""
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has the same share of the mixture."""
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    return pii.report(read_table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and put together for filling in the middle, and the texts rebuilt."""
    done = fim.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words come together most above chance."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives and read back."""
    return warc.round_trip(spark, read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_language_id, op3_suffix_dedup, op4_fingerprints, op5_lm_score, op6_simhash_dedup,
        op7_quality, op8_html_extract, op9_mixing, op10_pii, op11_fim, op12_collocations, op13_warc,
    )
}

_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH item AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
size AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
found AS (SELECT rid, i, n, item_id FROM dw JOIN iw USING (n, win)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS s
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)""",
    "op9_mixing": """
WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rate AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM n) * (SELECT sum(n) FROM n)::DOUBLE / n AS rate FROM n),
cdf AS (SELECT source, k, sum(CASE WHEN k = 0 THEN exp(-rate) ELSE exp(k * ln(rate) - rate - lgamma(k + 1)) END)
    OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 10 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rate)),
doc AS (SELECT row_number() OVER () AS rid, *,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u
  FROM documents),
cnt AS (SELECT rid, count(*) AS n_copies FROM doc JOIN cdf ON doc.source IS NOT DISTINCT FROM cdf.source AND c < u GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, n_copies::BIGINT AS n_copies, unnest(range(0, n_copies))::BIGINT AS copy
FROM doc JOIN cnt USING (rid)""",
    "op11_fim": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS d FROM t),
c AS (SELECT *, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS i, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS j,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
      WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM c)
SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k >= 2),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
    FROM (SELECT *, unnest(range(2, size)) AS m FROM c WHERE size > 2))),
held AS (SELECT lang, phrase, max(a) AS around FROM inner_ GROUP BY ALL),
cut AS (SELECT lang, phrase, a, k, l.f AS l, r.f AS r FROM (SELECT *, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
    FROM (SELECT *, unnest(range(1, size)) AS k FROM c)) c JOIN (SELECT lang, phrase AS lp, f FROM g) l USING (lang, lp) JOIN (SELECT lang, phrase AS rp, f FROM g) r USING (lang, rp)),
scored AS (SELECT *, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score FROM cut JOIN total USING (lang)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, phrase, a, l, r, n, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best LEFT JOIN held USING (lang, phrase) WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op13_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
r AS (SELECT *, row_number() OVER w AS i, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN i = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN i > 1 THEN first END AS refers_to
FROM r""",
}
