"""DuckDB SQL for the queries that it can express.

op4, op8 and op10 need a tokenizer, byte windows and XXH64; op11 tries all periods of all stretches, op12 hashes all triplets
of bytes: these are held against brute force in tests.
"""

from __future__ import annotations

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents)"

OP1 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
 b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
 p AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS p FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
 x AS (SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS p FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT m FROM p))),
 h AS (SELECT doc_id, x.m, i, item_id FROM x JOIN p ON p.m = x.m AND p.p = x.p),
 c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS pos FROM h) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id"""

_METRICS = [("word_length", "100 * word_chars // greatest(n_words, 1)", 50, True), ("symbols", "10000 * n_symbols // greatest(n_words, 1)", 500, False), ("dup_lines", "10000 * n_dup_lines // greatest(n_lines, 1)", 1200, False), ("repeats", "10000 * n_repeat_words // greatest(n_words, 1)", 1000, False)]
_FLOOR = "CASE WHEN {0} < 64 THEN {0} ELSE ({0} >> (length(bin({0})) - 6)) << (length(bin({0})) - 6) END"
_QUARTILES = ", ".join(f"quantile_disc({n}_f, 0.25) AS {n}_1, quantile_disc({n}_f, 0.75) AS {n}_3" for n, *_ in _METRICS)
_PICK = ", ".join(f"CASE WHEN s.n >= 100 THEN s.{n}_{q} WHEN l.n >= 100 THEN l.{n}_{q} ELSE a.{n}_{q} END AS {n}_{q}" for n, *_ in _METRICS for q in (1, 3))
_KEPT = " AND ".join(
    part
    for n, _, least, low in _METRICS
    for part in (f"{n} <= {n}_3 + 3 * greatest({n}_3 - {n}_1, {least})", *([f"{n} >= {n}_1 - 3 * greatest({n}_3 - {n}_1, {least})"] if low else []))
)
OP2 = f"""WITH {_WORDS},
 t AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
 r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM r) GROUP BY doc_id),
 f AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(c.n, 0) AS n_repeat_words FROM d LEFT JOIN c ON c.doc_id = d.doc_id),
 g AS (SELECT *, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
 m AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e, *_ in _METRICS)} FROM g),
 v AS (SELECT lang, source, {", ".join(f"{_FLOOR.format(n)} AS {n}_f" for n, *_ in _METRICS)} FROM m WHERE NOT base_failed),
 s AS (SELECT lang, source, count(*) AS n, {_QUARTILES} FROM v GROUP BY ALL), l AS (SELECT lang, count(*) AS n, {_QUARTILES} FROM v GROUP BY ALL), a AS (SELECT {_QUARTILES} FROM v),
 k AS (SELECT s.lang, s.source, {_PICK} FROM s JOIN l ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({_KEPT}, true) AS kept
FROM m LEFT JOIN k ON k.lang IS NOT DISTINCT FROM m.lang AND k.source IS NOT DISTINCT FROM m.source"""

OP3 = f"""WITH {_WORDS},
 x AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
 r AS (SELECT doc_id, i FROM x QUALIFY min(doc_id) OVER (PARTITION BY h) < doc_id),
 g AS (SELECT doc_id, list(DISTINCT pos) AS gone FROM (SELECT doc_id, unnest(range(i, i + 50)) AS pos FROM r) GROUP BY doc_id),
 e AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) WHERE before IS NULL OR i > before + 50 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(e.n, 0) AS n_intervals,
 sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""

OP5 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS w FROM documents),
 t AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
 k AS (SELECT doc_id, i, before, count(*) OVER (PARTITION BY word) - count(*) OVER (PARTITION BY word, doc_id) AS c,
  count(*) OVER (PARTITION BY before, word) - count(*) OVER (PARTITION BY before, word, doc_id) AS cc, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n FROM t),
 s AS (SELECT doc_id, before IS NOT NULL AND cc > 0 AS seen, cc, c, n, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS cb FROM k)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (NOT seen) AS n_backoff,
 round(coalesce(sum(ln(CASE WHEN seen THEN cc / cb ELSE CAST(0.4 AS DOUBLE) * greatest(c, 1) / greatest(n, 1) END)), 0), 4) AS score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id, w"""

OP6 = """WITH l AS (SELECT doc_id, ln, line, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS word FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ln FROM documents)),
 q AS (SELECT *, sum(CAST(word AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS s FROM l),
 p AS (SELECT doc_id, s, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY s) AS two FROM q WHERE word),
 r AS (SELECT doc_id, s FROM p WHERE two IS NOT NULL QUALIFY row_number() OVER (PARTITION BY two ORDER BY doc_id, s) > 1),
 g AS (SELECT DISTINCT doc_id, unnest([s, s + 1]) AS s FROM r),
 e AS (SELECT q.doc_id, q.ln, q.line, q.word, q.s, q.word AND g.s IS NOT NULL AS gone FROM q LEFT JOIN g ON g.doc_id = q.doc_id AND g.s = q.s),
 u AS (SELECT doc_id, s - row_number() OVER (PARTITION BY doc_id ORDER BY s) AS run FROM g),
 j AS (SELECT a.doc_id, a.s, b.doc_id AS earlier, a.s - b.s AS apart FROM p a JOIN p b ON a.two = b.two AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.s < a.s))),
 k AS (SELECT *, s - row_number() OVER (PARTITION BY doc_id, earlier, apart ORDER BY s) AS common FROM j),
 m AS (SELECT doc_id, max(n) + 1 AS longest FROM (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id, earlier, apart, common) GROUP BY doc_id)
SELECT e.doc_id, count(*) FILTER (word) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(any_value(n.n), 0) AS n_runs,
 CASE WHEN any_value(m.longest) IS NULL THEN 0 ELSE CAST(1 AS BIGINT) << (length(bin(any_value(m.longest))) - 1) END AS longest_match, sha256(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT gone), '')) AS kept_sha256
FROM e LEFT JOIN (SELECT doc_id, count(DISTINCT run) AS n FROM u GROUP BY doc_id) n ON n.doc_id = e.doc_id LEFT JOIN m ON m.doc_id = e.doc_id GROUP BY e.doc_id"""

OP7 = f"""WITH {_WORDS}, z AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text), 1, 15) AS BIGINT) AS h FROM d),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
 n AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS k FROM n),
 y AS (SELECT a.k, a.cap / a.weight AS full_at, (1.5 * (SELECT sum(source_size) FROM s) - coalesce(sum(b.cap), 0)) / ((SELECT sum(weight) FROM n) - coalesce(sum(b.weight), 0)) AS level FROM o a LEFT JOIN o b ON b.k < a.k GROUP BY a.k, a.cap, a.weight),
 x AS (SELECT CAST(arg_min(level, k) AS DOUBLE) AS level FROM y WHERE level <= full_at),
 g AS (SELECT source, source_size, least(cap, coalesce(weight * level, cap)) AS target FROM o CROSS JOIN x),
 q AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM g),
 c AS (SELECT source, h, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM z GROUP BY source, h),
 e AS (SELECT c.source, c.h, upto <= target - whole * source_size OR (upto - own <= target - whole * source_size AND 2 * (target - whole * source_size - (upto - own)) >= own) AS extra FROM c JOIN q ON q.source IS NOT DISTINCT FROM c.source)
SELECT z.doc_id, z.size, q.source_size, q.target, z.size * (q.whole + CAST(e.extra AS BIGINT)) AS taken
FROM z JOIN q ON q.source IS NOT DISTINCT FROM z.source JOIN e ON e.source IS NOT DISTINCT FROM z.source AND e.h = z.h"""

OP9 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS largest FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM largest THEN largest END AS refers_to FROM m"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _tree(name: str, levels: int) -> str:
    """From {name}0 (grp, pos, node, n) the levels above, as long as a group has several nodes: {name}1 and so on, with the runs joined."""
    step = "SELECT grp, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node, (n + 7) // 8 AS n FROM {0} WHERE n > 1 GROUP BY grp, pos // 8, n UNION ALL SELECT grp, pos, node, n FROM {0} WHERE n = 1"
    return ",\n ".join(f"{name}{i} AS ({step.format(f'{name}{i - 1}')})" for i in range(1, levels + 1))


def _climb(name: str, start: str, grp: str, levels: int) -> str:
    """Each row of ``start`` level by level: what stands before and after it in its run, appended to proof and folded into x."""
    parts, last = [], start
    for i in range(levels):
        run = f"(SELECT grp, pos // 8 AS r, list(node ORDER BY pos) AS run FROM {name}{i} WHERE n > 1 GROUP BY grp, pos // 8)"
        before, after = "array_to_string(list_slice(run, 1, p % 8), '')", "array_to_string(list_slice(run, p % 8 + 2, 8), '')"
        parts.append(
            f"{start}_{i} AS (SELECT c.* EXCLUDE (p, x, proof), p // 8 AS p, CASE WHEN run IS NULL THEN x ELSE sha256({before} || x || {after}) END AS x, CASE WHEN run IS NULL THEN proof ELSE proof || {before} || {after} END AS proof"
            f" FROM {last} c LEFT JOIN {run} t ON t.grp IS NOT DISTINCT FROM c.{grp} AND t.r = c.p // 8)"
        )
        last = f"{start}_{i}"
    return ",\n ".join(parts)


#: CRC-32 of a decimal number: each digit's byte, then eight shifts (-1).
_CRC = "xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], list_transform(range(8), lambda z: CAST(-1 AS BIGINT)))))), lambda c, v: CASE WHEN v < 0 THEN xor(c >> 1, (c & 1) * 3988292384) ELSE xor(c, v) END), 4294967295)"
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_HEIGHT, _TOP = 9, 5

OP13 = f"""WITH a AS (SELECT doc_id, lang, sha256({_LEAF} || {_field("text")}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({_LEAF} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS bad FROM documents),
 l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM a),
 t0 AS (SELECT lang AS grp, pos, leaf AS node, n FROM l),
 {_tree("t", _HEIGHT)},
 s AS (SELECT grp AS lang, node, row_number() OVER (ORDER BY grp IS NOT NULL, encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM t{_HEIGHT}),
 u0 AS (SELECT 0 AS grp, pos, node, n FROM s),
 {_tree("u", _TOP)},
 c AS (SELECT l.doc_id, l.lang, l.leaf, s.node AS subroot, s.pos AS place, l.pos AS p, coalesce(bad, leaf) AS x, '' AS proof FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang),
 {_climb("t", "c", "lang", _HEIGHT)},
 d AS (SELECT * EXCLUDE (p, place), 0 AS grp, place AS p FROM c_{_HEIGHT - 1}),
 {_climb("u", "d", "grp", _TOP)}
SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.node AS verified FROM d_{_TOP - 1} CROSS JOIN u{_TOP} r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_quality": OP2, "op3_substring_dedup": OP3, "op5_lm_scores": OP5, "op6_line_dedup": OP6, "op7_mixing": OP7, "op9_warc": OP9, "op13_merkle_manifest": OP13}
