"""DuckDB statements with the same rows and columns as the registered queries."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({column}, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"


JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {words('text')} AS t FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 5
      THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))
      WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, v.b FROM r JOIN both_ways v ON r.b = v.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.a = d.doc_id
"""

LINES = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, i - 1 AS pos, t[i] AS line, lower(trim(t[i], ' ')) AS k
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS t FROM documents), range(1, len(t) + 1) AS r(i)),
f AS (
  SELECT k, min(struct_pack(d := doc_id, p := pos)) AS first FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 8),
m AS (
  SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND f.first <> struct_pack(d := l.doc_id, p := l.pos) AS bad
  FROM l LEFT JOIN f ON l.k = f.k)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE
    coalesce(string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (WHERE NOT m.bad), '') END AS text,
  count(m.pos) AS n_lines, count(*) FILTER (WHERE m.bad) AS n_removed
FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id, d.text
"""

_MASKS = ((0, 1, 2, 4, 7, 8, 10), (0, 1, 3, 5, 6, 9, 10), (0, 2, 3, 6, 8, 9, 10))


def _seeds(table: str, key: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key} AS k, i - 1 AS pos, '{m}:' || concat_ws(' ', {', '.join(f't[i + {o}]' for o in mask)}) AS seed "
        f"FROM {table}, range(1, len(t) - 9) AS r(i) WHERE len(t) >= 11" for m, mask in enumerate(_MASKS))


_TOKENS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

SPACED = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS t FROM documents),
b AS (SELECT item_id, {_TOKENS} AS t FROM benchmark),
ds AS ({_seeds('d', 'doc_id')}),
bs AS ({_seeds('b', 'item_id')}
  UNION ALL SELECT item_id, 0, 'w' || len(t) || array_to_string(t, ' ') FROM b WHERE len(t) BETWEEN 5 AND 10),
dw AS (
  SELECT doc_id AS k, i - 1 AS pos, 'w' || n || array_to_string(t[i:i + n - 1], ' ') AS seed
  FROM d, (SELECT DISTINCT len(t) AS n FROM b WHERE len(t) BETWEEN 5 AND 10) AS z, range(1, len(t) - n + 2) AS r(i)),
h AS (
  SELECT DISTINCT x.k AS doc_id, y.k AS item_id, x.pos - y.pos AS off
  FROM (SELECT * FROM ds UNION ALL SELECT * FROM dw) x JOIN bs y ON x.seed = y.seed),
v AS (
  SELECT h.doc_id, item_id, off, len(b.t) AS n, j,
    CASE WHEN d.t[off + j] = b.t[j] THEN 1 ELSE -2 END AS worth
  FROM h JOIN d USING (doc_id) JOIN b USING (item_id), range(1, len(b.t) + 1) AS r(j)
  WHERE off + j BETWEEN 1 AND len(d.t)),
s AS (SELECT *, sum(worth) OVER (PARTITION BY doc_id, item_id, off ORDER BY j) AS p FROM v),
m AS (
  SELECT *, p - least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, off ORDER BY j
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS run FROM s),
g AS (SELECT doc_id, item_id, off, n, max(run) AS score FROM m GROUP BY doc_id, item_id, off, n)
SELECT doc_id, item_id, CAST(arg_max(off, score * 1000000000 - off) AS BIGINT) AS offset,
  CAST(max(score) AS BIGINT) AS score
FROM g WHERE score >= least(13, ceil(n * 4 / 5)) GROUP BY doc_id, item_id
"""

PREFERENCES = """
WITH l AS (
  SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id),
a AS (
  SELECT conv_id, last, max(coalesce(text, '')) AS ending FROM conversations JOIN l USING (conv_id)
  WHERE role = 'assistant' AND turn = last GROUP BY conv_id, last),
r AS (
  SELECT DISTINCT m.conv_id AS pair_id, c, turn, coalesce(role, 'user') AS role,
    CASE WHEN NOT c AND role = 'assistant' AND turn = a.last THEN coalesce(o.ending, '') ELSE coalesce(text, '') END AS text
  FROM conversations m LEFT JOIN a ON a.conv_id = m.conv_id LEFT JOIN a o ON o.conv_id = xor(m.conv_id, 1),
       (VALUES (true), (false)) AS v(c)
  WHERE m.conv_id IS NOT NULL AND turn IS NOT NULL),
s AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, text || '<|end|>' || chr(10) AS body FROM r),
t AS (
  SELECT pair_id, turn, string_agg(head || body, '' ORDER BY role, head, body) FILTER (WHERE c) AS x,
    string_agg(head || body, '' ORDER BY role, head, body) FILTER (WHERE NOT c) AS y FROM s GROUP BY pair_id, turn),
e AS (SELECT pair_id, min(turn) AS first FROM t WHERE x IS DISTINCT FROM y GROUP BY pair_id),
p AS (
  SELECT s.*, CASE WHEN e.first IS NULL OR turn < e.first THEN 'prompt' WHEN c THEN 'chosen' ELSE 'rejected' END AS part
  FROM s LEFT JOIN e USING (pair_id)),
q AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part, CAST(floor(turn / 256) AS BIGINT)
    ORDER BY turn, role, head, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS at_body
  FROM p WHERE c OR part <> 'prompt')
SELECT pair_id, part, CAST(floor(turn / 256) AS BIGINT) AS block, min(turn) AS first_turn,
  count(DISTINCT turn) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, head, body) AS text,
  CASE WHEN part = 'prompt' THEN '' ELSE coalesce(string_agg(CAST(at_body AS BIGINT) || ':' || length(body), ','
    ORDER BY turn, role, head, body) FILTER (WHERE role = 'assistant'), '') END AS mask
FROM q GROUP BY pair_id, part, CAST(floor(turn / 256) AS BIGINT)
"""

ORACLES = {
    "op3_preference_formatting": PREFERENCES,
    "op8_benchmark_decontamination": SPACED,
    "op7_line_dedup": LINES,
    "op9_ngram_jaccard_join": JACCARD,
}
