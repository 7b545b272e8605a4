"""The queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, credentials, fingerprints, jaccard, languages, lm, merkle, neighbours, packing, quality, sharding, wrappers

QUERIES = {
    "op1_lm_scoring": lm.query,
    "op2_html_extraction": wrappers.query,
    "op3_best_fit_packing": packing.query,
    "op4_sharding": sharding.query,
    "op5_language_id": languages.query,
    "op6_fingerprints": fingerprints.query,
    "op7_ngram_jaccard_join": jaccard.query,
    "op8_quality_classifier": quality.query,
    "op9_bpe_codec": bpe.query,
    "op10_nearest_neighbours": neighbours.query,
    "op11_secret_scans": credentials.query,
    "op12_collocations": collocations.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLES = {
    "op7_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s FROM words WHERE len(w) > 0
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, m.component_id
FROM documents d LEFT JOIN sets s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
""",
    "op12_collocations": collocations.ORACLE,
    "op13_merkle_manifest": merkle.oracle(),
}
