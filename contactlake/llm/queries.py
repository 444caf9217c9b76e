"""Queries of the training-data operators: op1 .. op13."""

from __future__ import annotations

from contactlake.llm import (bpe, common, decontaminate, hard_negatives, importance, line_dedup, lm_score, near_dedup, packing, pii, quality,
                             secret_scan, suffix_dedup, token_counts)
from contactlake.sources.tables import read_table


def op1_secrets(spark, sf_dir):
    return secret_scan.span_digest(read_table(spark, sf_dir, "documents"))


def op2_lm_score(spark, sf_dir):
    return lm_score.scores(read_table(spark, sf_dir, "documents"))


def op3_decontaminate(spark, sf_dir):
    docs = common.documents_of(read_table(spark, sf_dir, "documents"))
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark")).drop("text")


def op4_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = quality.judge(docs, drop=("text",))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                      "log_ppl")


def op9_pii(spark, sf_dir):
    return pii.span_digest(read_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.removal_report(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=2)


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(read_table(spark, sf_dir, "documents"), texts=False)


def op8_bpe_roundtrip(spark, sf_dir):
    return bpe.round_trip_digest(read_table(spark, sf_dir, "documents"))


def op10_edit_counts(spark, sf_dir):
    docs = common.documents_of(read_table(spark, sf_dir, "documents"))
    return token_counts.edited_counts(token_counts.mask_edits(docs))


def op11_pack(spark, sf_dir):
    return packing.packed_pieces(read_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark, sf_dir):
    return hard_negatives.mined(read_table(spark, sf_dir, "embeddings"))


def op13_resample(spark, sf_dir):
    target = common.documents_of(read_table(spark, sf_dir, "benchmark"), id_col="item_id")
    return importance.resampled(read_table(spark, sf_dir, "documents"), target)


QUERIES = {f.__name__: f for f in (op1_secrets, op2_lm_score, op3_decontaminate, op4_quality, op5_line_dedup, op6_near_dedup, op7_suffix_dedup,
                                   op8_bpe_roundtrip, op9_pii, op10_edit_counts, op11_pack, op12_hard_negatives, op13_resample)}
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = (f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}')")

#: DuckDB SQL of the queries that SQL can express.
SQL: dict[str, str] = {"op3_decontaminate": f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
ns AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n)),
occ AS (SELECT DISTINCT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND pos.k = win.k),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS sha
  FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id""", "op12_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS same, b.r AS br, b.vec_id AS vec_id,
    CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op13_resample": f"""
WITH crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)),
dw AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
df AS (SELECT r, unnest(w) AS f FROM dw),
bf AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
fb AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
    lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295)) % 10000 AS b
  FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)), crc),
s AS (SELECT b, count(*) AS n FROM df JOIN fb USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bf JOIN fb USING (f) GROUP BY b),
g AS (SELECT x.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT count(*) FROM df) + 10000)
    / CAST((coalesce(s.n, 0) + 1) * ((SELECT count(*) FROM bf) + 10000) AS DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS b) x LEFT JOIN s ON x.b = s.b LEFT JOIN t ON x.b = t.b),
w AS (SELECT r, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM df JOIN fb USING (f) JOIN g ON fb.b = g.b GROUP BY r),
sc AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM dw LEFT JOIN w USING (r)),
k AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM k) * 10 // 100 THEN rank END AS rank
FROM sc LEFT JOIN k USING (r)"""}
