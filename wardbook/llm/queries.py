"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardbook.llm import (alignment, bpe, decontaminate, exact_dedup, jaccard, langid, licenses, periodic_runs, pii, quality,
                          simhash, substring_dedup, toxicity)
from wardbook.llm.common import fold, read_table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(4, 2)
    trees = quality.train(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    return quality.score(docs, trees).withColumn("held_out", held_out)


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op4_license_scans(spark, sf_dir):
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.find_identifiers(read_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontaminate.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_bpe(spark, sf_dir):
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold(5, 0)
    model, scorer = toxicity.train(docs, labels.where(~held_out).select("doc_id", F.col("toxic").alias("label")))
    return toxicity.score(docs, model, scorer).withColumn("held_out", held_out)


def op10_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold(3, 1)
    model = langid.train(docs.where(~held_out))
    return langid.identify(docs, model).withColumn("held_out", held_out)


def op11_alignment(spark, sf_dir):
    return alignment.align_documents(read_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.find_runs(periodic_runs.with_planted_periods(read_table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_quality_classifier, op3_substring_dedup, op4_license_scans, op5_pii,
    op6_simhash_near_dedup, op7_decontamination, op8_bpe,
    op9_toxicity, op10_language_id, op11_alignment, op12_jaccard_join, op13_periodic_runs,
)}

ORACLE = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size,
               d.doc_id IS NOT DISTINCT FROM g.keep_id
                   AND row_number() OVER (PARTITION BY d.text, d.doc_id) = 1 AS kept,
               sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)
    """,
    "op3_substring_dedup": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(
                       string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
        windows AS (SELECT r, doc_id, i, k
                    FROM (SELECT *, word || ' ' || {following} AS k FROM p WINDOW o AS (PARTITION BY r ORDER BY i))
                    WHERE i <= n - 12),
        earliest AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
        starts AS (SELECT r, i FROM windows JOIN earliest USING (k) WHERE first_id < doc_id),
        judged AS (SELECT p.r, p.i, p.word, count(starts.i) OVER (
                       PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) > 0 AS gone
                   FROM p LEFT JOIN starts ON starts.r = p.r AND starts.i = p.i),
        kept AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text
                 FROM judged GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (r)
    """.format(following=" || ' ' || ".join(f"lead(word, {j}) OVER o" for j in range(1, 13))),
    "op4_license_scans": licenses.oracle_sql(),
    "op7_decontamination": """
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        b AS (SELECT DISTINCT item_id, {words} AS w FROM benchmark),
        items AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS k
                  FROM b, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s(i) WHERE len(w) > 0),
        windows AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
                    FROM d, (SELECT DISTINCT n FROM items), unnest(generate_series(1, len(w) - n + 1)) AS s(i)),
        found AS (SELECT r, i, n, item_id FROM windows JOIN items USING (n, k)),
        hits AS (SELECT r, count(DISTINCT j) AS n_hit
                 FROM (SELECT DISTINCT r, i, n FROM found), unnest(generate_series(i, i + n - 1)) AS s(j) GROUP BY r),
        named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
                  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
    """.format(words="""list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"""),
}
