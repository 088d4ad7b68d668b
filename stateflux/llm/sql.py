"""SQL that DuckDB answers as the training-data queries do, where SQL can express them."""

from __future__ import annotations

from stateflux.llm import divergence, pii
from stateflux.llm.licenses import LEAST, TEMPLATES, bounds, table

SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM s WHERE score BETWEEN -9223372036854775808 AND 9223372036854775807)
SELECT query_id, "rank", vec_id, CAST(score AS BIGINT) AS score FROM r WHERE "rank" <= 5
""",
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n AS n, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
), l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (n - k)
), r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.c = l.a
), m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (
  SELECT page_id, h, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY h) AS last FROM p
)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM s
""",
}


def _licenses() -> str:
    """The template table as values; the coefficient over distinct bigrams of every unit, then of stretches as long as a template."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = table(TEMPLATES)
    values = ", ".join(f"({quoted(name)}, {k}, [{', '.join(map(quoted, grams))}], {bounds(len(grams), LEAST)[0]})" for name, k, grams in rows)
    fewest = min(bounds(len(grams), LEAST)[0] for _, _, grams in rows)
    return rf"""
WITH t(license, place, grams, low) AS (VALUES {values}),
p AS (SELECT doc_id, row_number() OVER () AS line, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS x FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, line, unnest(string_split(x, chr(10))) AS unit FROM p
  UNION ALL SELECT doc_id, line, replace(unnest(regexp_split_to_array(x, '\n ?\n')), chr(10), ' ') FROM p
  UNION ALL SELECT doc_id, line, replace(x, chr(10), ' ') FROM p
), w AS (SELECT DISTINCT doc_id, line, list_filter(string_split(unit, ' '), lambda a: a <> '') AS ws FROM u),
g AS (SELECT doc_id, line, ws, list_distinct(list_transform(list_zip(ws[:-2], ws[2:]), lambda a: a[1] || ' ' || a[2])) AS gs FROM w WHERE len(ws) >= 3),
m AS (SELECT doc_id, line, ws, license, 2.0 * len(list_intersect(gs, grams)) / (len(gs) + len(grams)) AS d FROM g, t),
b AS (SELECT doc_id, line, ws, arg_max(license, (d, license)) AS license, max(d) AS d FROM m WHERE d * 1000 >= {LEAST} GROUP BY doc_id, line, ws),
a AS (SELECT doc_id, line, list_filter(string_split(replace(x, chr(10), ' '), ' '), lambda a: a <> '') AS ws FROM p),
s AS (SELECT doc_id, line, list_transform(list_zip(ws[:-2], ws[2:]), lambda a: a[1] || ' ' || a[2]) AS gs FROM a WHERE len(ws) >= 2),
h AS (SELECT line, unnest(gs) AS gram, unnest(range(1, len(gs) + 1)) AS spot FROM s),
k AS (SELECT license, place, low, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS pos FROM t),
o AS (SELECT h.*, license, place, low, pos FROM h JOIN k USING (gram)),
e AS (SELECT line FROM o GROUP BY line HAVING count(DISTINCT spot) >= {fewest}),
r AS (SELECT line, license, place FROM o SEMI JOIN e USING (line) GROUP BY ALL HAVING count(DISTINCT gram) >= any_value(low)),
c AS (SELECT DISTINCT line, license, place, greatest(spot - pos + 1, 1) AS begins FROM o SEMI JOIN r USING (line, license, place)),
n AS (SELECT doc_id, line, c.license, begins, len(grams) AS size, grams, list_distinct(gs[begins:begins + len(grams) - 1]) AS own FROM c JOIN s USING (line) JOIN t USING (license, place)),
q AS (SELECT doc_id, line, license, begins, size, len(list_intersect(own, grams)) AS common, 2.0 * len(list_intersect(own, grams)) / (len(own) + size) AS d FROM n),
z AS (SELECT * FROM q WHERE d * 1000 >= {LEAST}),
alone AS (SELECT * FROM z ANTI JOIN z AS y ON z.line = y.line AND y.begins < z.begins + z.size AND z.begins < y.begins + y.size AND (y.common, y.d, y.license) > (z.common, z.d, z.license)),
found AS (SELECT doc_id, ws, license, d FROM b UNION ALL SELECT doc_id, NULL, license, d FROM alone ANTI JOIN b ON b.line = alone.line AND b.license = alone.license)
SELECT doc_id, license, greatest(count(DISTINCT ws), 1) AS n_units, round(max(d), 6) AS dice FROM found GROUP BY doc_id, license
"""


SQL["op9_licenses"] = _licenses()


#: The checksum of a short text, bit by bit: a byte comes in at every ninth step.
CRC = "xor(list_reduce(range(9 * length({x})), lambda c, i: CASE WHEN i % 9 = 0 THEN xor(c, CAST(ascii({x}[i // 9 + 1]) AS BIGINT)) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END, CAST(4294967295 AS BIGINT)), 4294967295)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _merkle() -> str:
    """Levels from the leaves up by recursion, then each leaf folded along its siblings."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"
    head = " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({head} || {field("text")}) AS leaf, CASE WHEN {CRC.format(x="CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN sha256({head} || {field(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed FROM documents
), l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, level, idx, h, n) AS (
  SELECT g, 0, r, leaf, n FROM l
  UNION ALL SELECT g, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM t WHERE n > 1 GROUP BY g, level, idx // 8
), s AS (SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS r, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, idx, h, n) AS (
  SELECT 0, r, subroot, n FROM s
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8) FROM u WHERE n > 1 GROUP BY level, idx // 8
), top AS (SELECT h AS root FROM u WHERE n = 1),
k AS (SELECT l.doc_id, l.g, t.level AS step, t.idx > l.r >> (3 * t.level) AS later, t.idx, t.h FROM l JOIN t ON t.g = l.g AND t.n > 1 AND t.idx // 8 = l.r >> (3 * t.level + 3) AND t.idx <> l.r >> (3 * t.level)
  UNION ALL SELECT l.doc_id, l.g, s.height + u.level, u.idx > s.r >> (3 * u.level), u.idx, u.h FROM l JOIN s ON s.g = l.g JOIN u ON u.n > 1 AND u.idx // 8 = s.r >> (3 * u.level + 3) AND u.idx <> s.r >> (3 * u.level)),
b AS (SELECT doc_id, step, coalesce(string_agg(h, '' ORDER BY idx) FILTER (NOT later), '') AS before, coalesce(string_agg(h, '' ORDER BY idx) FILTER (later), '') AS after FROM k GROUP BY doc_id, step),
p AS (SELECT doc_id, string_agg(before || after, '' ORDER BY step) AS siblings FROM b GROUP BY doc_id),
heights AS (SELECT s.g, s.height + (SELECT max(level) FROM u) AS steps FROM s),
f(doc_id, g, step, h) AS (
  SELECT doc_id, g, 0, coalesce(changed, leaf) FROM l
  UNION ALL SELECT f.doc_id, f.g, f.step + 1, sha256(coalesce(before, '') || f.h || coalesce(after, '')) FROM f JOIN heights USING (g) LEFT JOIN b ON b.doc_id = f.doc_id AND b.step = f.step WHERE f.step < steps
), folded AS (SELECT f.doc_id, f.h FROM f JOIN heights USING (g) WHERE f.step = steps)
SELECT l.doc_id, l.leaf, s.subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root AS verified
FROM l JOIN s USING (g) CROSS JOIN top JOIN folded ON folded.doc_id = l.doc_id LEFT JOIN p ON p.doc_id = l.doc_id
"""


def _pii() -> str:
    """Matches between marks, their places from the lengths before them; the same limits, checksums and words nearby."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    near = f"translate(substr(text, greatest(a - {pii.BEFORE}, 0) + 1, least(a, {pii.BEFORE})) || chr(10) || substr(text, b + 1, {pii.AFTER}), '{UPPER}', '{LOWER}')"
    matches = " UNION ALL ".join(f"SELECT doc_id, text, {i} AS i, string_split(regexp_replace(text, {quoted(pii.SPEC[k].pattern)}, chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS parts FROM t" for i, k in enumerate(pii.KINDS))
    words = lambda i, side: " OR ".join(f"contains(near, {quoted(w)})" for w in getattr(pii.SPEC[pii.KINDS[i]], side))
    moved = " ".join(f"WHEN {i} THEN {pii.SPEC[k].score} + {pii.STEP} * (CAST({words(i, 'raised_by')} AS INTEGER)) - {pii.STEP} * (CAST({words(i, 'lowered_by')} AS INTEGER))" for i, k in enumerate(pii.KINDS))
    names = ", ".join(quoted(k) for k in pii.KINDS)
    counts = ", ".join(f"count(*) FILTER (i = {i}) AS n_{k}" for i, k in enumerate(pii.BASE))
    listed = f"coalesce(string_agg(([{names}])[i + 1] || ':' || a || ':' || b, ',' ORDER BY a, i){{}}, '')"
    last = len(pii.BASE)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ({matches}),
e AS (SELECT doc_id, text, i, parts, unnest(range(2, len(parts) + 1, 2)) AS j FROM m),
c AS (SELECT doc_id, text, i, parts[j] AS x, CAST(list_sum(list_transform(parts[1:j - 1], lambda p: length(p))) AS BIGINT) AS a FROM e),
v AS (SELECT *, a + length(x) AS b, regexp_replace(x, '[^0-9]', '', 'g') AS ds, replace(x, ' ', '') AS account FROM c),
w AS (SELECT * FROM v WHERE CASE i WHEN 0 THEN true
  WHEN 1 THEN len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS DOUBLE) > 255)) = 0
  WHEN 2 THEN length(ds) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda p: CASE WHEN p % 2 = 1 THEN CAST(ds[-p] AS INTEGER) WHEN ds[-p] > '4' THEN 2 * CAST(ds[-p] AS INTEGER) - 9 ELSE 2 * CAST(ds[-p] AS INTEGER) END)) % 10 = 0
  WHEN 3 THEN length(ds) BETWEEN 10 AND 15
  WHEN 4 THEN length(account) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split(account[5:] || account[:4], ''), lambda p: CAST(CASE WHEN p >= 'A' THEN ascii(p) - 55 ELSE ascii(p) - 48 END AS BIGINT)), lambda r, p: (r * CASE WHEN p > 9 THEN 100 ELSE 10 END + p) % 97, CAST(0 AS BIGINT)) = 1
  WHEN 5 THEN x[:3] NOT IN ('000', '666') AND x[1] <> '9' AND x[5:6] <> '00' AND x[8:] <> '0000'
  ELSE x[1] NOT IN ('0', '1') AND x[5] NOT IN ('0', '1') END),
n AS (SELECT doc_id, i, a, b, {near} AS near FROM w), z AS (SELECT *, CASE i {moved} END AS score FROM n),
s AS (SELECT * FROM z WHERE i < {last} OR (score >= {pii.LEAST} AND NOT EXISTS (SELECT 1 FROM z AS y WHERE y.doc_id = z.doc_id AND y.i < {last} AND y.a < z.b AND z.a < y.b)))
SELECT t.doc_id, {counts}, sha256({listed.format(f" FILTER (i < {last})")}) AS base_sha256, {listed.format("")} AS spans FROM t LEFT JOIN s ON s.doc_id = t.doc_id GROUP BY t.doc_id
"""


SQL["op11_merkle"] = _merkle()
SQL["op12_pii"] = _pii()
SQL["op13_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{divergence.TERM}') AS ts FROM documents),
e AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM e GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
grp AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
size AS (SELECT lang, count(*) AS v, sum(total) AS nl FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, total, coalesce(n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
shares AS (
  SELECT dense.lang, source, term, n, 1 + CAST({divergence.SCALE} * (CAST(n AS HUGEINT) + 1) // (sum(n) OVER (PARTITION BY dense.lang, source) + v) AS BIGINT) AS p, 1 + CAST({divergence.SCALE} * (CAST(total AS HUGEINT) + 1) // (nl + v) AS BIGINT) AS q
  FROM dense JOIN size ON size.lang = dense.lang
), f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE n > 0 AND p > q
), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM r)
SELECT lang, source, part, item, value, "rank" FROM o WHERE part = 'pair' OR "rank" <= 200
"""
