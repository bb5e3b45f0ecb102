"""DuckDB SQL for the queries, by name.  Texts are taken whole."""

from __future__ import annotations

M = "18446744073709551616::UHUGEINT"
_C1, _C2 = "9782798678568883157::UHUGEINT", "5545529020109919103::UHUGEINT"


def _mul(a: str, b: str) -> str:
    return f"(({a}) * {b}) % {M}"


def _rotl(x: str, n: int) -> str:
    return f"((({x}) * {1 << n}::UHUGEINT) % {M} + ({x}) // {1 << (64 - n)}::UHUGEINT)"


def _bytes(first: int) -> str:
    """Eight bytes of the shingle from ``first`` as a little-endian number."""
    digit = lambda i: f"(CASE WHEN {i} < n THEN (instr('0123456789ABCDEF', substr(x, {2 * i + 1}, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, {2 * i + 2}, 1)) - 1 ELSE 0 END)"
    return " + ".join(f"{digit(first + j)}::UHUGEINT * {1 << (8 * j)}::UHUGEINT" for j in range(8))


_SHINGLES = "unnest(CASE WHEN length(text) < 3 THEN [text] ELSE list_transform(range(1, length(text) - 1), lambda i: substr(text, i, 3)) END)"
_MIX = lambda h: f"xor({h}, {h} // 8589934592::UHUGEINT)"
#: Hashes of distinct shingles of at most 15 bytes, and from them the prints of texts(key, text).
_PRINTS = f"""
shingle_rows AS (SELECT key, s, count(*) AS n FROM (SELECT key, {_SHINGLES} AS s FROM texts) GROUP BY key, s),
m0 AS (SELECT s, hex(s) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM shingle_rows)),
m1 AS (SELECT s, n, {_bytes(0)} AS k1, {_bytes(8)} AS k2 FROM m0),
m2 AS (SELECT s, n, {_mul("k1", _C1)} AS k1, {_mul("k2", _C2)} AS k2 FROM m1),
m3 AS (SELECT s, n, {_rotl("k1", 31)} AS k1, {_rotl("k2", 33)} AS k2 FROM m2),
m4 AS (SELECT s, xor({_mul("k1", _C2)}, n::UHUGEINT) AS h1, xor({_mul("k2", _C1)}, n::UHUGEINT) AS h2 FROM m3),
m5 AS (SELECT s, (h1 + h2) % {M} AS h1, (h1 + h2 + h2) % {M} AS h2 FROM m4),
m6 AS (SELECT s, {_MIX("h1")} AS h1, {_MIX("h2")} AS h2 FROM m5),
m7 AS (SELECT s, {_mul("h1", "18397679294719823053::UHUGEINT")} AS h1, {_mul("h2", "18397679294719823053::UHUGEINT")} AS h2 FROM m6),
m8 AS (SELECT s, {_MIX("h1")} AS h1, {_MIX("h2")} AS h2 FROM m7),
m9 AS (SELECT s, {_mul("h1", "14181476777654086739::UHUGEINT")} AS h1, {_mul("h2", "14181476777654086739::UHUGEINT")} AS h2 FROM m8),
hashes AS (SELECT s, (({_MIX("h1")} + {_MIX("h2")}) % {M})::UBIGINT AS h FROM m9),
votes AS (SELECT key, sum(n) AS total, {", ".join(f"sum(n * ((h >> {i}) & 1)) AS b{i}" for i in range(64))} FROM shingle_rows JOIN hashes USING (s) GROUP BY key),
prints AS (SELECT key, ({" + ".join(f"(CASE WHEN 2 * b{i} > total THEN {(1 << i) if i < 63 else -(1 << 63)}::HUGEINT ELSE 0 END)" for i in range(64))})::BIGINT AS fp FROM votes)
"""
_DOCS = "texts AS (SELECT doc_id AS key, text FROM documents)"
_TRIM = r"regexp_replace(x, '^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$', '', 'g')"


def _lines(ctx: str) -> str:
    return f"""
raw AS (SELECT {ctx} AS ctx, doc_id AS pos, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
lines AS (SELECT ctx, row_number() OVER (PARTITION BY ctx ORDER BY pos, n) - 1 AS idx, {_TRIM} AS sentence, pos FROM raw WHERE strlen({_TRIM}) > 5)
"""


_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: strlen(w) > 2)"
_TF = f"tf AS (SELECT ctx, idx, term, count(*) AS tf FROM (SELECT ctx, idx, unnest({_TERMS.format('sentence')}) AS term FROM lines) GROUP BY ALL)"
_DF = "dfs AS (SELECT ctx, term, count(*) AS df FROM tf GROUP BY ctx, term)"
_IDF = f"{_DF}, sizes AS (SELECT ctx, count(*) AS n FROM lines GROUP BY ctx), idfs AS (SELECT ctx, term, ln(n / (1.0::DOUBLE + df)) AS idf FROM dfs JOIN sizes USING (ctx))"
_SCORES = f"""{_TF}, {_IDF},
summed AS (SELECT ctx, idx, sum(tf * idf) / greatest(ln(sum(tf)::DOUBLE), 1.0) AS score FROM tf JOIN idfs USING (ctx, term) GROUP BY ctx, idx),
scores AS (SELECT lines.ctx, lines.idx, sentence, coalesce(score, 0.0)::DOUBLE AS score FROM lines LEFT JOIN summed USING (ctx, idx))"""
_CAPPED = f"""{_SCORES},
capped AS (SELECT ctx, idx, sentence FROM (SELECT *, row_number() OVER (PARTITION BY ctx ORDER BY round(score, 9) DESC, idx) AS r FROM scores) WHERE r <= 300)"""
_EDGES = f"""
sets AS (SELECT ctx, idx, list_distinct({_TERMS.format("sentence")}) AS w FROM capped),
words AS (SELECT ctx, idx, len(w) AS size, unnest(w) AS w FROM sets),
half AS (SELECT a.ctx, a.idx AS i, b.idx AS j, count(*) / (log10(any_value(a.size)) + log10(any_value(b.size)) + 1.0) AS w FROM words a JOIN words b ON a.ctx = b.ctx AND a.w = b.w AND a.idx <> b.idx GROUP BY a.ctx, a.idx, b.idx)
"""
_ALL_LINES = "capped AS (SELECT ctx, idx, sentence FROM lines)"
_RANK = f"""{_EDGES},
places AS (SELECT ctx, idx, row_number() OVER (PARTITION BY ctx ORDER BY idx) AS p, count(*) OVER (PARTITION BY ctx) AS n FROM capped),
norm AS (SELECT ctx, i, j, w / sum(w) OVER (PARTITION BY ctx, i) AS w FROM half),
cells AS (SELECT a.ctx, a.p AS p, b.p AS q, coalesce(norm.w, 0.0)::DOUBLE AS w FROM places a JOIN places b ON a.ctx = b.ctx LEFT JOIN norm ON norm.ctx = a.ctx AND norm.i = a.idx AND norm.j = b.idx),
columns AS (SELECT ctx, q, list(w ORDER BY p) AS col FROM cells GROUP BY ctx, q),
matrix AS (SELECT ctx, count(*) AS n, list(col ORDER BY q) AS m FROM columns GROUP BY ctx),
steps AS (
  SELECT ctx, 0 AS step, n, m, list_transform(range(n), lambda i: 1.0::DOUBLE / n) AS r, 1.0::DOUBLE AS diff FROM matrix WHERE n > 1
  UNION ALL
  SELECT ctx, step + 1, n, m, nr, list_sum(list_transform(range(n), lambda i: abs(nr[i + 1] - r[i + 1]))) FROM (
    SELECT *, list_transform(m, lambda col: (1 - 0.85::DOUBLE) / n + 0.85::DOUBLE * list_dot_product(col, r)) AS nr FROM steps WHERE step < 100 AND diff >= 0.0001)
),
last AS (SELECT ctx, arg_max(r, step) AS r FROM steps GROUP BY ctx),
ranks AS (SELECT places.ctx, places.idx, CASE WHEN n = 1 THEN 1.0 ELSE r[p] END::DOUBLE AS score FROM places LEFT JOIN last USING (ctx))
"""
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(sentence, '[\s\p{Z}\x{85}]+'), lambda w: w <> ''))"
_PICKED = f"""
ordered AS (SELECT ctx, row_number() OVER (PARTITION BY ctx ORDER BY round(score, 9) DESC, ranks.idx) AS k, sentence, {_WORDS} AS w FROM ranks JOIN capped USING (ctx, idx)),
walk AS (
  SELECT DISTINCT ctx, 0::BIGINT AS k, 0::BIGINT AS used, []::VARCHAR[] AS picks, []::VARCHAR[][] AS sets FROM ordered
  UNION ALL
  SELECT ctx, k, CASE WHEN ok THEN used + strlen(sentence) ELSE used END, CASE WHEN ok THEN list_append(picks, sentence) ELSE picks END, CASE WHEN ok THEN list_append(sets, w) ELSE sets END FROM (
    SELECT walk.ctx, o.k, used, picks, sets, sentence, w, used + strlen(sentence) <= 1000 AND len(list_filter(sets, lambda s: len(list_intersect(s, w)) / greatest(least(len(s), len(w)), 1) > 0.8)) = 0 AS ok
    FROM walk JOIN ordered o ON o.ctx = walk.ctx AND o.k = walk.k + 1)
),
picked AS (SELECT ctx, arg_max(picks, k) AS picks FROM walk GROUP BY ctx)
"""


def _packed(expression: str) -> str:
    return f"WITH RECURSIVE {_lines('doc_id')}, {_CAPPED}, {_RANK}, {_PICKED} SELECT doc_id, coalesce(array_to_string({expression}, chr(10)), '') AS packed FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN picked ON picked.ctx = d.doc_id"


_U = "CASE WHEN len(picks) <= 2 THEN picks ELSE list_concat(picks[1:len(picks):2], list_reverse(picks[2:len(picks):2])) END"
_CACHE = "cache AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, fp, text, concat_ws(':', source, doc_id) AS data FROM documents JOIN prints ON prints.key = 's' || doc_id)"
_LOOKUP_TEXTS = """texts AS (
SELECT 'b' || item_id AS key, text FROM benchmark UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations
UNION ALL SELECT 'd' || doc_id, left(text, length(text) - 1) FROM documents UNION ALL SELECT 's' || doc_id, text FROM documents)"""
_LOOKUP = f"WITH {_LOOKUP_TEXTS}, {_PRINTS}, {_CACHE}"
_NEAR = "near AS (SELECT key, {pick} AS data FROM (SELECT key, id, data, bit_count(xor(prints.fp, cache.fp)) AS d FROM prints JOIN cache ON bit_count(xor(prints.fp, cache.fp)) <= 3) GROUP BY key)"
_FIRST, _CLOSEST = "arg_min(data, id)", "arg_min(data, (d, id))"
_EXACT = "exact AS (SELECT key, arg_min(data, id) AS data FROM prints JOIN cache USING (fp) GROUP BY key)"
_BLOCKS = """
turns AS (SELECT conv_id, text, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n, sum(strlen(text) + 2) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
blocks AS (SELECT conv_id, pos, (after - strlen(text) - 2)::BIGINT AS first_byte, (after - CASE WHEN pos = n - 1 THEN 2 ELSE 1 END)::BIGINT AS end_byte, n, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS tokens FROM turns),
whole AS (SELECT conv_id, encode(string_agg(text, chr(10) || chr(10) ORDER BY pos)) AS raw FROM turns GROUP BY conv_id)"""
_CUT = "decode(raw[a + 1:b])"
_CHUNK_BYTES = f"""
WITH RECURSIVE {_BLOCKS},
walk AS (
  SELECT conv_id, -1::BIGINT AS pos, 0::BIGINT AS start, 0::BIGINT AS safe, NULL::BIGINT AS a, NULL::BIGINT AS b FROM whole
  UNION ALL
  SELECT conv_id, pos, CASE WHEN over THEN cut ELSE start END, end_byte, CASE WHEN over THEN start END, CASE WHEN over THEN cut END FROM (
    SELECT b.conv_id, b.pos, start, end_byte, end_byte - start > 1000 AS over, CASE WHEN safe > start THEN safe ELSE end_byte END AS cut FROM walk JOIN blocks b ON b.conv_id = walk.conv_id AND b.pos = walk.pos + 1)
),
pieces AS (SELECT conv_id, a, b FROM walk WHERE a IS NOT NULL UNION ALL SELECT conv_id, s, octet_length(raw) FROM (SELECT conv_id, max(start) AS s FROM walk GROUP BY conv_id) JOIN whole USING (conv_id) WHERE s < octet_length(raw))
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY a) - 1)::INTEGER AS chunk_pos, {_CUT} AS chunk FROM pieces JOIN whole USING (conv_id)"""
_CHUNK_TOKENS = f"""
WITH RECURSIVE {_BLOCKS},
walk AS (
  SELECT conv_id, -1::BIGINT AS pos, 0::BIGINT AS start, 0::BIGINT AS stop, 0::BIGINT AS used, []::BIGINT[][] AS cuts FROM whole
  UNION ALL
  SELECT conv_id, pos,
    CASE WHEN used + tokens <= 150 THEN start WHEN tokens > 150 THEN end_byte ELSE first_byte END,
    CASE WHEN used + tokens > 150 AND tokens > 150 THEN stop ELSE end_byte END,
    CASE WHEN used + tokens <= 150 THEN used + tokens WHEN tokens > 150 THEN 0 ELSE tokens END,
    list_concat(cuts, CASE WHEN used + tokens > 150 AND used > 0 THEN [[start, stop]] ELSE [] END, CASE WHEN used + tokens > 150 AND tokens > 150 THEN [[first_byte, end_byte]] ELSE [] END)
  FROM (SELECT b.conv_id, b.pos, start, stop, used, cuts, tokens, first_byte, end_byte FROM walk JOIN blocks b ON b.conv_id = walk.conv_id AND b.pos = walk.pos + 1)
),
ends AS (SELECT conv_id, CASE WHEN used > 0 THEN list_append(cuts, [start, stop]) ELSE cuts END AS cuts FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
pieces AS (SELECT conv_id, unnest(range(len(cuts))) AS k, unnest(cuts) AS c FROM ends)
SELECT conv_id, k::INTEGER AS chunk_pos, decode(raw[c[1] + 1:c[2]]) AS chunk FROM pieces JOIN whole USING (conv_id)"""

#: By CommonMark, a block ends with its last line; a thematic break is none of its own.
_STRUCTURED = """
WITH parts AS (SELECT doc_id, unnest(range(10)) AS k, unnest(['# ' || source, '## ' || lang, '- ' || doc_id || chr(10) || '- ' || lang || chr(10) || chr(10) || '  more',
    '```text' || chr(10) || replace(text, '`', '') || chr(10) || '```', '> # ' || source || chr(10) || '> words' || chr(10) || 'lazy', '---',
    '<div>' || chr(10) || '# ' || doc_id || chr(10) || '</div>', source || chr(10) || '===', '    code ' || doc_id || chr(10) || chr(10) || '    # more', lang || chr(10) || 'last']) AS part FROM documents),
placed AS (SELECT doc_id, k, strlen(part) AS n, sum(strlen(part) + CASE WHEN k = 0 THEN 1 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY k) - strlen(part) - CASE WHEN k = 0 THEN 1 ELSE 2 END AS a FROM parts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS pos, a::BIGINT AS first_byte, (a + n + CASE WHEN k < 9 THEN 1 ELSE 0 END)::BIGINT AS end_byte FROM placed WHERE k <> 5"""

ORACLES = {
    "near_dup_documents": f"WITH {_DOCS}, {_PRINTS} SELECT a.key AS doc_id, a.fp AS fingerprint, count(*) - 1 AS n_near FROM prints a JOIN prints b ON bit_count(xor(a.fp, b.fp)) <= 3 GROUP BY a.key, a.fp",
    "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term",
    "doc_frequency": f"WITH {_lines('source')}, {_TF}, {_DF} SELECT ctx AS source, term, df FROM dfs",
    "idf": f"WITH {_lines('source')}, {_TF}, {_IDF} SELECT ctx AS source, term, round(idf, 6) AS idf FROM idfs",
    "sentence_lines": f"WITH {_lines('doc_id')} SELECT ctx AS doc_id, idx, sentence FROM lines",
    "tfidf_scores": f"WITH {_lines('source')}, {_SCORES} SELECT ctx AS source, idx, round(score, 6) AS score FROM scores",
    "tfidf_top300": f"WITH {_lines('source')}, {_CAPPED} SELECT ctx AS source, idx, sentence FROM capped",
    "sentence_similarity": f"WITH {_lines('doc_id')}, {_ALL_LINES}, {_EDGES} SELECT ctx AS doc_id, i, j, round(w, 6) AS w FROM half",
    "similarity_normalized": f"WITH {_lines('doc_id')}, {_ALL_LINES}, {_EDGES} SELECT ctx AS doc_id, i, j, round(w / sum(w) OVER (PARTITION BY ctx, i), 6) AS w FROM half",
    "textrank": f"WITH RECURSIVE {_lines('doc_id')}, {_CAPPED}, {_RANK} SELECT ctx AS doc_id, idx, round(score, 6) AS score FROM ranks",
    "overlap_pairs": f"WITH {_lines('doc_id')}, w AS (SELECT ctx, idx, {_WORDS} AS w FROM lines) SELECT a.ctx AS doc_id, a.idx AS i, b.idx AS j FROM w a JOIN w b ON a.ctx = b.ctx AND a.idx < b.idx WHERE len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)) > 0.8",
    "pack_ranked": _packed("picks"),
    "pack_u_shaped": _packed(_U),
    "shingle_counts": f"SELECT doc_id, s AS shingle, count(*) AS n FROM (SELECT doc_id, {_SHINGLES} AS s FROM documents) GROUP BY doc_id, s",
    "shingle_hash": f"WITH {_DOCS}, {_PRINTS} SELECT s AS shingle, CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END AS hash FROM hashes",
    "simhash": f"WITH {_DOCS}, {_PRINTS} SELECT key AS doc_id, fp AS fingerprint FROM prints",
    "bands_of_documents": f"WITH {_DOCS}, {_PRINTS} SELECT key AS doc_id, {', '.join(f'((fp >> {s}) & 65535)::INTEGER AS band_{b}' for b, s in zip('abcd', (48, 32, 16, 0), strict=True))} FROM prints",
    "hamming_pairs": f"WITH {_DOCS}, {_PRINTS}, d AS (SELECT DISTINCT fp FROM prints) SELECT a.fp AS l, b.fp AS r, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM d a JOIN d b ON a.fp < b.fp AND bit_count(xor(a.fp, b.fp)) <= 3",
    "cache_put": f"{_LOOKUP} SELECT id, fp AS fingerprint, {', '.join(f'((fp >> {s}) & 65535)::INTEGER AS band_{b}' for b, s in zip('abcd', (48, 32, 16, 0), strict=True))}, text AS input_text, data FROM cache",
    "cache_exact": f"{_LOOKUP}, {_EXACT} SELECT key, data FROM prints LEFT JOIN exact USING (key)",
    "cache_miss": f"{_LOOKUP} SELECT key FROM prints WHERE fp NOT IN (SELECT fp FROM cache)",
    "cache_near_first": f"{_LOOKUP}, {_NEAR.format(pick=_FIRST)} SELECT key, data FROM prints LEFT JOIN near USING (key)",
    "cache_near_closest": f"{_LOOKUP}, {_NEAR.format(pick=_CLOSEST)} SELECT key, data FROM prints LEFT JOIN near USING (key)",
    "cache_get": f"{_LOOKUP}, {_EXACT}, {_NEAR.format(pick=_FIRST)} SELECT key, coalesce(exact.data, near.data) AS data FROM prints LEFT JOIN exact USING (key) LEFT JOIN near USING (key)",
    "cache_get_batch": f"{_LOOKUP}, {_EXACT}, {_NEAR.format(pick=_CLOSEST)} SELECT key, coalesce(exact.data, near.data) AS data FROM prints LEFT JOIN exact USING (key) LEFT JOIN near USING (key)",
    "markdown_blocks": f"WITH {_BLOCKS} SELECT conv_id, pos::INTEGER AS pos, first_byte, end_byte FROM blocks",
    "markdown_structured": _STRUCTURED,
    "chunk_bytes": _CHUNK_BYTES,
    "chunk_tokens": _CHUNK_TOKENS,
}
