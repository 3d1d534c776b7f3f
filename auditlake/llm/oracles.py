"""SQL that gives the rows of the operators that it can express, written apart from their code."""

from __future__ import annotations

from .quality import SCORES, Risk, steps
from .secrets import RULES
from .substring_dedup import WINDOW as WORDS
from .suffix_dedup import PASSAGE, WINDOW
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE

_RISK = Risk()
_PATH = ", ".join(f"({k}, '{rule}', {cutoff})" for k, (rule, cutoff) in enumerate(steps()))
_SCORED = " UNION ALL ".join(f"SELECT doc_id, '{rule}' AS rule, {score} AS score FROM f" for rule, (score, _) in SCORES.items())

OP1 = r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
  SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)"""



def _spans(name: str, size: int) -> str:
    """CTEs whose last, named so, has the spans [a, z) that repeated strings of so many bytes cover."""
    return f"""{name}_w AS (SELECT doc_id, i, md5(b[i:i + {size - 1}]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {size - 2})) AS i FROM d)),
  {name}_hot AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM {name}_w) WHERE c > 1),
  {name}_r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + {size} THEN 0 ELSE 1 END AS fresh FROM {name}_hot WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
  {name}_g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM {name}_r), {name} AS (SELECT doc_id, span, min(i) AS a, max(i) + {size} AS z FROM {name}_g GROUP BY doc_id, span)"""


OP2 = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, octet_length(b) AS n FROM d),
  {_spans("s", WINDOW)}, {_spans("t", PASSAGE)},
  k AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM s UNION ALL SELECT n.doc_id, coalesce(m.z, 1), n.n + 1 FROM n LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) m USING (doc_id)),
  p AS (SELECT k.doc_id, string_agg(CASE WHEN k.z > k.a THEN hex(d.b[k.a:k.z - 1]) ELSE '' END, '' ORDER BY k.a) AS kept FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
  SELECT p.doc_id, CAST(n.n AS BIGINT) AS n_bytes, CAST(n.n - length(p.kept) // 2 AS BIGINT) AS n_removed, (SELECT count(*) FROM s WHERE s.doc_id = p.doc_id) AS n_spans, sha256(unhex(p.kept)) AS kept_sha256,
    CAST((SELECT coalesce(sum(z - a), 0) FROM t WHERE t.doc_id = p.doc_id) AS BIGINT) AS n_passage_bytes FROM p JOIN n USING (doc_id)"""

_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{r.kind}' AS kind, {k} AS place, {r.least} AS least, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found, regexp_extract_all(t, '{p}', {r.group}) AS valued FROM d WHERE regexp_matches(t, '{p}')"
    for k, r in enumerate(RULES)
    for p in [r.pattern.replace("'", "''")]
)
_SPELLED = "string_agg({0} concat(kind, ':', a, ':', z), ',' ORDER BY a, place) {1}"

#: Places are summed up from what lies between matches and the matches themselves.
OP4 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS ({_FOUND}), m AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM r),
  s AS (SELECT doc_id, kind, place, CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(found[k]) AS n FROM m WHERE length(valued[k]) >= least),
  e AS (SELECT *, a + n AS z FROM s)
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce({_SPELLED.format("", "FILTER (place < 3)")}, '')) AS base_sha256, coalesce({_SPELLED.format("", "FILTER (kind IS NOT NULL)")}, '') AS spans FROM d LEFT JOIN e USING (doc_id) GROUP BY doc_id"""

OP5 = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
  g AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM g"""

OP6 = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
  wn AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
  rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wn) WHERE c > 1), cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
  l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
  m AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
  f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m), x AS ({_SCORED}), path AS (SELECT * FROM (VALUES {_PATH}) v(k, rule, cutoff)),
  r AS (SELECT doc_id, min(k) AS first FROM x JOIN path USING (rule) WHERE score > cutoff GROUP BY doc_id), good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
  g AS (SELECT lang, first FROM f JOIN good USING (doc_id) LEFT JOIN r USING (doc_id) WHERE NOT base_failed), c AS (SELECT lang, k, count(*) AS n, count(*) FILTER (first <= k) AS bad FROM g, (SELECT k FROM path) GROUP BY lang, k),
  p AS (SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK.alpha}) + (n - i) * ln(1 - {_RISK.alpha}))) FROM (SELECT unnest(range(0, bad + 1)) AS i)) AS tail FROM c),
  ok AS (SELECT *, min(CASE WHEN tail <= {_RISK.delta} / (SELECT count(DISTINCT coalesce(lang, '')) FROM c) THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY k) AS passed FROM p), cut AS (SELECT lang, max(k) AS step FROM ok WHERE passed = 1 GROUP BY lang)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (step IS NULL OR first IS NULL OR first > step) AS kept FROM f LEFT JOIN r USING (doc_id) LEFT JOIN cut ON cut.lang IS NOT DISTINCT FROM f.lang"""

OP11 = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  p AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WORDS - 1}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WORDS - 2})) AS i FROM w)),
  later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM p) WHERE k > 1), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, (SELECT unnest(range(0, {WORDS})) AS k)),
  words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_DISTANCE = "CAST(list_sum(list_transform(part, lambda y, i: (y - c[i]) * (y - c[i]))) AS BIGINT)"
_ROUNDS = ", ".join(
    f"""a{k} AS (SELECT j, part, w, min(struct_pack(d := {_DISTANCE}, e := e)).e AS e FROM d JOIN b{k} USING (j) GROUP BY j, part, w), t{k} AS (SELECT j, e, i, sum(w * y) AS s, sum(w) AS n FROM (SELECT j, e, w, unnest(part) AS y, unnest(range(0, len(part))) AS i FROM a{k}) GROUP BY j, e, i),
  m{k} AS (SELECT j, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM t{k} GROUP BY j, e), b{k + 1} AS MATERIALIZED (SELECT j, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (j, e))"""
    for k in range(ROUNDS)
)
#: Vectors whose width is a multiple of the number of parts.
OP13 = f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * {SCALE}) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
  p AS (SELECT vec_id, label, j, x[j * (len(x) // {PARTS}) + 1:(j + 1) * (len(x) // {PARTS})] AS part FROM (SELECT *, unnest(range(0, {PARTS})) AS j FROM v)), d AS (SELECT j, part, count(*) AS w FROM p GROUP BY j, part),
  b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS e, part AS c FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {ENTRIES})),
  {_ROUNDS}, f AS (SELECT j, part, min(struct_pack(d := {_DISTANCE}, e := e)) AS best FROM d JOIN b{ROUNDS} USING (j) GROUP BY j, part),
  r AS (SELECT vec_id, label, string_agg(lower(lpad(hex(best.e), 2, '0')), '' ORDER BY j) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM p JOIN f USING (j, part) GROUP BY vec_id, label)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM r"""

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1, "op2_suffix_dedup": OP2, "op4_secrets": OP4, "op5_warc": OP5, "op6_quality_rules": OP6, "op11_substring_dedup": OP11, "op13_vector_codes": OP13}
