"""DuckDB SQL for the queries of this subpackage that SQL can express, by name.  Each runs over whole tables and texts."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LEADS = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, 13))
_OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM d),
windows AS (SELECT doc_id, k, CASE WHEN lead(w, 12) OVER o IS NOT NULL THEN concat_ws(' ', w, {_LEADS}) END AS win FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
first AS (SELECT win, min(doc_id) AS first_doc FROM windows WHERE win IS NOT NULL GROUP BY win),
gone AS (SELECT DISTINCT doc_id, k + unnest(range(13)) AS k FROM windows JOIN first USING (win) WHERE first_doc < doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY k) AS kept FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
spans AS (SELECT doc_id, count(*) AS n_spans FROM gone ANTI JOIN (SELECT doc_id, k + 1 AS k FROM gone) USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN spans USING (doc_id)
"""

_OP3_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_OP3_LEADS = ", ".join(f"lead(w, {i}) OVER o" for i in range(1, 8))
_OP3 = f"""
WITH d AS (SELECT doc_id, {_OP3_WORDS} AS ws FROM documents), b AS (SELECT item_id, {_OP3_WORDS} AS ws FROM benchmark),
phrases AS (SELECT DISTINCT item_id, len(p) AS width, array_to_string(p, ' ') AS win
    FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(ws) - 6, 2)), lambda i: list_slice(ws, i, i + 7))) AS p FROM b WHERE len(ws) > 0)),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM d),
runs AS (SELECT doc_id, k, n, [w, {_OP3_LEADS}] AS run FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY k)),
windows AS (SELECT doc_id, k, width, array_to_string(list_slice(run, 1, width), ' ') AS win FROM runs, (SELECT DISTINCT width FROM phrases) WHERE k + width - 1 <= n),
found AS (SELECT doc_id, k, width, item_id FROM windows JOIN phrases USING (width, win)),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, k + unnest(range(width)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP7 = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, q.row_no, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.row_no <> c.row_no)
SELECT query_id, (row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored QUALIFY rank <= 20
"""

_OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS win FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 49)) AS i FROM d)),
first AS (SELECT win, min(doc_id) AS first_doc FROM windows GROUP BY win),
hits AS (SELECT doc_id, i FROM windows JOIN first USING (win) WHERE first_doc < doc_id),
marked AS (SELECT doc_id, i, coalesce(i > lag(i) OVER o + 50, true) AS opens FROM hits WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked) GROUP BY doc_id, span),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER o, 0) AS a, a AS b FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, coalesce(last, 0), len(x) // 2 FROM d LEFT JOIN (SELECT doc_id, max(b) AS last FROM spans GROUP BY doc_id) USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
sizes AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""

_LEVELS = ("domain", "language", "source_name")


def _family(level: int) -> str:
    """Shares of the nodes of a level: of its parent's budget, by weight, what a child cannot use going to its siblings."""
    keys, parent = ", ".join(_LEVELS[: level + 1]), ", ".join(_LEVELS[:level])
    weight = "CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END" if level == 1 else "1"
    part = f"PARTITION BY {parent}" if parent else ""
    own = f"SELECT {keys}, sum(room) AS room, {weight} AS weight FROM leaves GROUP BY {keys}"
    given = f"SELECT *, share AS given FROM ({own}) JOIN (SELECT {parent}, share FROM s{level - 1}) USING ({parent})" if parent else f"SELECT *, least(sum(room) OVER (), (SELECT sum(size) FROM leaves)) AS given FROM ({own})"
    return f"""
g{level} AS ({given}),
f{level} AS (SELECT *, room * (sum(weight) OVER ({part}) - coalesce(sum(weight) OVER before, 0)) <= (given - coalesce(sum(room) OVER before, 0)) * weight AS filled FROM g{level}
    WINDOW before AS ({part} ORDER BY room::DOUBLE / weight, {_LEVELS[level]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s{level} AS (SELECT {keys}, CASE WHEN filled THEN room ELSE (given - coalesce(sum(room) FILTER (filled) OVER ({part}), 0)) * weight // sum(weight) FILTER (NOT filled) OVER ({part}) END AS share FROM f{level})"""


_OP6 = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(lang, '') AS language, coalesce(source, '') AS source_name, coalesce((strlen(text) + 3) // 4, 0) AS size FROM documents),
named AS (SELECT *, 'd' || (instr('0123456789abcdef', left(md5(source_name), 1)) - 1) % 4 AS domain FROM d),
leaves AS (SELECT domain, language, source_name, sum(size) AS size, 2 * sum(size) AS room FROM named GROUP BY ALL), {_family(0)}, {_family(1)}, {_family(2)},
plan AS (SELECT domain, language, source_name, CASE WHEN size > 0 THEN share // size ELSE 1 END AS whole, CASE WHEN size > 0 THEN share % size ELSE 0 END AS rest FROM leaves JOIN s2 USING (domain, language, source_name)),
placed AS (SELECT *, left(md5(concat_ws('|', '17', whole, coalesce(doc_id::VARCHAR, ''))), 15) AS u FROM named JOIN plan USING (domain, language, source_name))
SELECT doc_id, domain, lang, source, size::BIGINT AS n_tokens,
    (whole + (whole < 2 AND sum(size) OVER (PARTITION BY domain, language, source_name ORDER BY u, doc_id NULLS FIRST, size) <= rest)::INT)::BIGINT AS copies
FROM placed
"""

_M = "18446744073709551616::UHUGEINT"
#: The five primes of XXH64, fixed by its definition.
_P1, _P2, _P3, _P4, _P5 = (
    11400714785074694791,
    14029467366897019727,
    1609587929392839161,
    9650029242287828579,
    2870177450012600261,
)


def _times(x: str, prime: int) -> str:
    return f"(({x}) * {prime}::UHUGEINT) % {_M}"


def _turn(x: str, n: int) -> str:
    return f"((({x}) * {1 << n}::UHUGEINT) % {_M} + ({x}) // {1 << (64 - n)}::UHUGEINT)"


def _little(first: str, size: int) -> str:
    """``size`` bytes of a shingle as a little-endian number; x is its hex, ``first`` the first byte's place from 0."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({first}) + {2 * j + 1}, 2)" for j in reversed(range(size))) + ")::UBIGINT::UHUGEINT"


def _round(acc: str, lane: str) -> str:
    return _times(_turn(f"(({acc} + {lane} * {_P2}::UHUGEINT) % {_M})", 31), _P1)


_STARTS = [(42 + _P1 + _P2) % (1 << 64), 42 + _P2, 42, (42 - _P1) % (1 << 64)]
_ACCS = ", ".join(
    f"CASE WHEN n >= 32 THEN list_reduce(list_prepend({start}::UHUGEINT, list_transform(range(n // 32), lambda i: lanes[4 * i + {k + 1}])), lambda a, v: {_round('a', 'v')}) END AS v{k + 1}" for k, start in enumerate(_STARTS)
)
_JOIN = lambda h, v: f"({_times(f'xor({h}, {_round('0::UHUGEINT', v)})', _P1)} + {_P4}::UHUGEINT) % {_M}"
_OP10 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
shingles AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) <= 3 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2])) END) AS s FROM d),
x0 AS (SELECT s, hex(s) AS x, strlen(s) AS n FROM (SELECT DISTINCT s FROM shingles)),
x1 AS (SELECT s, x, n, list_transform(range(n // 8), lambda i: {_little("8 * i", 8)}) AS lanes FROM x0),
x2 AS (SELECT s, x, n, lanes, {_ACCS} FROM x1),
x3 AS (SELECT *, CASE WHEN n >= 32 THEN ({_turn("v1", 1)} + {_turn("v2", 7)} + {_turn("v3", 12)} + {_turn("v4", 18)}) % {_M} ELSE {42 + _P5}::UHUGEINT END AS h FROM x2),
x4 AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_JOIN("h", "v1")} ELSE h END AS h) FROM x3),
x5 AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_JOIN("h", "v2")} ELSE h END AS h) FROM x4),
x6 AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_JOIN("h", "v3")} ELSE h END AS h) FROM x5),
x7 AS (SELECT * REPLACE (CASE WHEN n >= 32 THEN {_JOIN("h", "v4")} ELSE h END AS h) FROM x6),
x8 AS (SELECT s, x, n, list_reduce(list_prepend((h + n::UHUGEINT) % {_M}, lanes[4 * (n // 32) + 1:]), lambda a, v: ({_times(_turn(f"xor(a, {_round('0::UHUGEINT', 'v')})", 27), _P1)} + {_P4}::UHUGEINT) % {_M}) AS h FROM x7),
x9 AS (SELECT s, x, n, CASE WHEN n % 8 >= 4 THEN ({_times(_turn(f"xor(h, {_times(_little('n - n % 8', 4), _P1)})", 23), _P2)} + {_P3}::UHUGEINT) % {_M} ELSE h END AS h FROM x8),
x10 AS (SELECT s, list_reduce(list_prepend(h, list_transform(range(n - n % 4, n), lambda i: {_little("i", 1)})), lambda a, v: {_times(_turn(f"xor(a, {_times('v', _P5)})", 11), _P1)}) AS h FROM x9),
x11 AS (SELECT s, {_times("xor(h, h // 8589934592::UHUGEINT)", _P2)} AS h FROM x10),
x12 AS (SELECT s, {_times("xor(h, h // 536870912::UHUGEINT)", _P3)} AS h FROM x11),
hashes AS (SELECT s, xor(h, h // 4294967296::UHUGEINT)::UBIGINT AS h FROM x12),
votes AS (SELECT doc_id, count(*) AS total, {", ".join(f"sum((h >> {i}) & 1) AS b{i}" for i in range(64))} FROM shingles JOIN hashes USING (s) GROUP BY doc_id),
prints AS (SELECT doc_id, coalesce({" + ".join(f"(CASE WHEN 2 * b{i} > total THEN {1 << i}::UHUGEINT ELSE 0 END)" for i in range(64))}, 0)::UBIGINT AS fp FROM d LEFT JOIN votes USING (doc_id)),
nodes AS (SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp),
edges AS (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach AS (SELECT fp, fp AS other FROM nodes UNION SELECT fp, b FROM reach JOIN edges ON other = a),
classes AS (SELECT reach.fp, min(least) AS component_id FROM reach JOIN nodes ON other = nodes.fp GROUP BY reach.fp)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN classes USING (fp)
"""

ORACLES = {"op1_substring_dedup": _OP1, "op3_decontaminate": _OP3, "op6_mix_sources": _OP6, "op7_topk_search": _OP7, "op9_suffix_dedup": _OP9, "op10_simhash_dedup": _OP10}
