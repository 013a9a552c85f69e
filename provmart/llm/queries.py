"""Queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

from .content_sort import op12_exact_dedup
from .decontaminate import op9_decontamination
from .html_wrapper import op6_html_wrapper
from .kd_shards import op5_kd_shards
from .language_id import op3_language_id
from .lm_score import op8_lm_score
from .merkle import op11_merkle_manifest
from .nearest import op10_nearest
from .ngram_jaccard import op2_ngram_jaccard
from .sentencepiece_codec import op1_sentencepiece
from .substring_dedup import op7_substring_dedup
from .term_audit import op13_source_audit
from .warc_index import op4_warc_index

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_ngram_jaccard, op3_language_id, op4_warc_index, op5_kd_shards, op6_html_wrapper, op7_substring_dedup, op8_lm_score, op9_decontamination, op10_nearest, op11_merkle_manifest, op12_exact_dedup, op13_source_audit)}

_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"


def _field(c: str) -> str:
    """A field as it enters a leaf of the manifest."""
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


SQL = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = w.doc_id""",
    "op4_warc_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, d, max(page_id) OVER (PARTITION BY d) AS largest FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(d, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31 AS INT), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to FROM q""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
v AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
k AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.j) AS kept, count(*) AS n FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.j = c.j GROUP BY t.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
    "op11_merkle_manifest": """
WITH RECURSIVE c AS (SELECT *, list_reduce(list_transform(split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)), lambda r, b:
    list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(r, b)), CAST(4294967295 AS BIGINT)) AS r FROM documents),
d AS (SELECT doc_id, source, xor(r, 4294967295) % 5 = 0 AS forged, text,
    concat_ws('', {doc_id}, {source}, {lang}, {n_chars}) AS head FROM c),
l AS (SELECT doc_id, source, sha256(concat(head, {text})) AS leaf, sha256(concat(head, {other})) AS other, forged,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d),
g AS (SELECT source, 0 AS level, idx, leaf AS h, n FROM l
    UNION ALL SELECT source, level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM g WHERE n > 1 GROUP BY source, level, idx // 16, n),
s AS (SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM g WHERE n = 1),
u AS (SELECT 0 AS level, idx, h, n FROM s
    UNION ALL SELECT level + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY level, idx // 16, n),
w AS (SELECT doc_id, source, 0 AS level, idx, n, CASE WHEN forged THEN other ELSE leaf END AS h, '' AS proof FROM l
    UNION ALL SELECT w.doc_id, w.source, w.level + 1, w.idx // 16, (w.n + 15) // 16, sha256(string_agg(CASE WHEN g.idx = w.idx THEN w.h ELSE g.h END, '' ORDER BY g.idx)),
      any_value(w.proof) || coalesce(string_agg(CASE WHEN g.idx <> w.idx THEN g.h END, '' ORDER BY g.idx), '')
    FROM w JOIN g ON g.source IS NOT DISTINCT FROM w.source AND g.level = w.level AND g.idx // 16 = w.idx // 16 WHERE w.n > 1 GROUP BY w.doc_id, w.source, w.level, w.idx, w.n),
v AS (SELECT w.doc_id, w.source, 0 AS level, s.idx, s.n, w.h, w.proof FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
    UNION ALL SELECT v.doc_id, v.source, v.level + 1, v.idx // 16, (v.n + 15) // 16, sha256(string_agg(CASE WHEN u.idx = v.idx THEN v.h ELSE u.h END, '' ORDER BY u.idx)),
      any_value(v.proof) || coalesce(string_agg(CASE WHEN u.idx <> v.idx THEN u.h END, '' ORDER BY u.idx), '')
    FROM v JOIN u ON u.level = v.level AND u.idx // 16 = v.idx // 16 WHERE v.n > 1 GROUP BY v.doc_id, v.source, v.level, v.idx, v.n),
r AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, r.root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = r.root AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN v ON v.doc_id = l.doc_id AND v.n = 1, r""".format(
        **{c: _field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}, other=_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")),
    "op12_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op13_source_audit": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY ALL),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (k.c + 2)) // (v.n + 2 * v.v) AS q
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM o WHERE part = 'pair' OR rank <= 10""",
}
