"""SQL twins of the registered queries, for an independent engine over the same tables."""

from __future__ import annotations

from ..functions import prompts
from .stand_ins import READERS, VARIANTS

# --- fragments ----------------------------------------------------------------------------------


def _lit(value: str) -> str:
    """SQL string literal; line breaks are spelled out."""
    quoted = value.replace("'", "''")
    return "'" + quoted.replace("\n", "' || chr(10) || '") + "'"


def _tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


ARTICLES = """articles AS (
  SELECT doc_id AS article_id, doc_id AS article_seq, split_part(text, chr(10), 1) AS title, text
  FROM documents)"""

PARAGRAPHS = """paragraphs AS (
  SELECT doc_id || '.' || (n - 1) AS paragraph_id, doc_id AS article_id, CAST(n - 1 AS INTEGER) AS paragraph_no,
         pieces[n] AS paragraph
  FROM (SELECT doc_id, string_split(text, chr(10)) AS pieces FROM documents),
       unnest(range(1, len(pieces) + 1)) AS u(n))"""

QUESTIONS = "questions AS (SELECT item_id AS qid, text AS question FROM benchmark)"

INDEX = f"""fields AS (
  SELECT 'title' AS field, article_id, {_tokens('title')} AS terms FROM articles
  UNION ALL SELECT 'text', article_id, {_tokens('text')} FROM articles),
occurrences AS (SELECT field, article_id, CAST(len(terms) AS BIGINT) AS dl, unnest(terms) AS term FROM fields),
postings AS (SELECT field, term, article_id, dl, count(*) AS tf FROM occurrences GROUP BY ALL),
doc_freq AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
stats AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM fields WHERE len(terms) > 0 GROUP BY field)"""

QUESTION_TERMS = f"""question_terms AS (
  SELECT DISTINCT qid, field, term
  FROM (SELECT qid, unnest({_tokens('question')}) AS term FROM questions), (VALUES ('title'), ('text')) AS f(field))"""


def _scores(terms: str = "question_terms") -> str:
    return f"""field_scores AS (
  SELECT q.qid, p.field, p.article_id,
         sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS raw
  FROM {terms} q JOIN postings p USING (field, term) JOIN doc_freq USING (field, term) JOIN stats USING (field)
  GROUP BY ALL)"""


_BEST = "max(CASE field WHEN 'title' THEN 3e0 ELSE 1e0 END * raw)"
_SUM = "sum(CASE field WHEN 'title' THEN 3e0 ELSE 1e0 END * raw)"


def _hits(k: int, combine: str = _BEST, where: str = "true") -> str:
    return f"""scored AS (
  SELECT qid, article_id, round({combine}, 6) AS score FROM field_scores WHERE {where} GROUP BY qid, article_id),
hits AS (
  SELECT qid, article_id, score, CAST(nth AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, article_id) AS nth FROM scored)
  WHERE nth <= {k})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _search(k: int, *, articles: str = ARTICLES, questions: str = QUESTIONS, combine: str = _BEST,
            where: str = "true") -> list[str]:
    return [articles, questions, INDEX, QUESTION_TERMS, _scores(), _hits(k, combine, where)]


# The other engine counts edits in bytes, so every letter outside ASCII is first mapped to one
# ASCII character that no term holds.
FUZZY = """foreign_letters AS (
  SELECT string_agg(letter, '' ORDER BY letter) AS letters
  FROM (SELECT DISTINCT unnest(string_split(term, '')) AS letter FROM doc_freq) WHERE letter > '~'),
folded AS (
  SELECT field, term, df, length(term) AS chars,
         translate(term, letters, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_`{|}~', 1, length(letters))) AS bytes
  FROM doc_freq, foreign_letters),
wanted AS (
  SELECT DISTINCT field, term AS query_term, length(term) AS chars,
         CASE WHEN length(term) < 3 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS edits,
         translate(term, letters, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_`{|}~', 1, length(letters))) AS bytes
  FROM question_terms, foreign_letters),
near AS (
  SELECT w.field, query_term, f.term, levenshtein(w.bytes, f.bytes) AS distance, df
  FROM wanted w JOIN folded f ON w.field = f.field AND f.chars BETWEEN w.chars - w.edits AND w.chars + w.edits
  WHERE levenshtein(w.bytes, f.bytes) <= w.edits),
expansions AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, query_term ORDER BY distance, df DESC, term) AS nth
                 FROM near)),
fuzzy_terms AS (
  SELECT DISTINCT q.qid, q.field, e.term
  FROM question_terms q JOIN expansions e ON e.field = q.field AND e.query_term = q.term)"""


def _fuzzy(k: int, combine: str, where: str) -> list[str]:
    return [ARTICLES, QUESTIONS, INDEX, QUESTION_TERMS, FUZZY, _scores("fuzzy_terms"), _hits(k, combine, where)]


def _hashed(name: str, source: str, key: str, text: str, dims: int = 384) -> str:
    """CTE ``name(key, dim, weight)``: nonzero entries of the hashed vectors."""
    return f"""{name}_buckets AS (
  SELECT {key}, CAST(h % {dims} AS INTEGER) AS dim, sum(CASE WHEN (h // {dims}) % 2 = 0 THEN 1 ELSE -1 END) AS total
  FROM (SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h
        FROM (SELECT {key}, unnest({_tokens(text)}) AS term FROM {source}))
  GROUP BY ALL),
{name} AS (
  SELECT {key}, dim, CASE WHEN total = 0 THEN 0 ELSE
         CAST(total / sqrt(CAST(sum(total * total) OVER (PARTITION BY {key}) AS DOUBLE)) AS FLOAT) END AS weight
  FROM {name}_buckets)"""


VALUES = """vector_values AS (
  SELECT vec_id AS id, CAST(n - 1 AS INTEGER) AS dim, CAST(embedding[n] AS DOUBLE) AS v
  FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(n))"""


def _calibration(name: str = "calibration", where: str = "true") -> str:
    return f"{name} AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM vector_values WHERE {where} GROUP BY dim)"


_LEVEL = ("CASE WHEN hi = lo THEN 0 ELSE "
          "CAST(trunc(greatest(-128e0, least(127e0, (v - lo) / ((hi - lo) / 255) - 128))) AS INTEGER) END")

QUANTIZED = f"""quantized AS (
  SELECT id, list(CAST({_LEVEL} AS DOUBLE) ORDER BY dim) AS qv
  FROM vector_values JOIN calibration USING (dim) GROUP BY id)"""

_KNN = """pairs AS (
  SELECT q.id AS qid, v.id, round(CASE WHEN q.norm * v.norm = 0 THEN 0
         ELSE list_dot_product(q.qv, v.qv) / (q.norm * v.norm) END, 9) AS score
  FROM (SELECT *, sqrt(list_dot_product(qv, qv)) AS norm FROM {queries}) q,
       (SELECT *, sqrt(list_dot_product(qv, qv)) AS norm FROM {vectors}) v),
neighbours AS (
  SELECT qid, id, score, CAST(nth AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS nth FROM pairs) WHERE nth <= {k})"""


def _knn(queries: str, vectors: str, k: int) -> str:
    return _KNN.format(queries=queries, vectors=vectors, k=k)


# Twenty sampled vectors as centroids; every vector lies in the two nearest lists, a query probes the
# nine nearest and more until they hold twice ten vectors.
INVERTED = """centroids AS (
  SELECT id AS cid, qv, norm, CAST(row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS INTEGER) AS list
  FROM vectors QUALIFY list < 20),
near AS (
  SELECT v.id, list, row_number() OVER (PARTITION BY v.id ORDER BY
           round(CASE WHEN v.norm * c.norm = 0 THEN 0 ELSE list_dot_product(v.qv, c.qv) / (v.norm * c.norm) END, 9) DESC, list) AS nth
  FROM vectors v, centroids c),
filed AS (SELECT id, list FROM near WHERE nth <= 2),
sizes AS (SELECT list, count(*) AS size FROM filed GROUP BY list),
probed AS (
  SELECT id AS qid, list FROM (
    SELECT *, sum(coalesce(size, 0)) OVER (PARTITION BY id ORDER BY nth ROWS UNBOUNDED PRECEDING) - coalesce(size, 0) AS before
    FROM near LEFT JOIN sizes USING (list)) WHERE nth <= 9 OR before < 20),
pairs AS (
  SELECT DISTINCT q.id AS qid, v.id, round(CASE WHEN q.norm * v.norm = 0 THEN 0
         ELSE list_dot_product(q.qv, v.qv) / (q.norm * v.norm) END, 9) AS score
  FROM probed p JOIN filed f USING (list) JOIN vectors q ON q.id = p.qid JOIN vectors v ON v.id = f.id),
neighbours AS (
  SELECT qid, id, score, CAST(nth AS INTEGER) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS nth FROM pairs) WHERE nth <= 10)"""


# Paragraph and question vectors, quantized with the ranges of the paragraphs.
SEMANTIC = ",\n".join([
    _hashed("paragraph_weights", "paragraphs", "paragraph_id", "paragraph"),
    _hashed("question_weights", "questions", "qid", "question"),
    """dims AS (SELECT CAST(unnest(range(384)) AS INTEGER) AS dim),
paragraph_values AS (
  SELECT paragraph_id AS id, dim, CAST(coalesce(weight, 0) AS DOUBLE) AS v
  FROM (SELECT paragraph_id, dim FROM paragraphs, dims) LEFT JOIN paragraph_weights USING (paragraph_id, dim)),
question_values AS (
  SELECT qid AS id, dim, CAST(coalesce(weight, 0) AS DOUBLE) AS v
  FROM (SELECT qid, dim FROM questions, dims) LEFT JOIN question_weights USING (qid, dim)),
ranges AS (SELECT dim, min(v) AS lo, max(v) AS hi FROM paragraph_values GROUP BY dim)""",
    f"""paragraph_vectors AS (
  SELECT id, list(CAST({_LEVEL} AS DOUBLE) ORDER BY dim) AS qv FROM paragraph_values JOIN ranges USING (dim) GROUP BY id),
question_vectors AS (
  SELECT id, list(CAST({_LEVEL} AS DOUBLE) ORDER BY dim) AS qv FROM question_values JOIN ranges USING (dim) GROUP BY id)""",
    _knn("question_vectors", "paragraph_vectors", 10),
])


def _render(template, *slots: str) -> str:
    out = [_lit(template[0])]
    for slot, piece in zip(slots, template[1:], strict=True):
        out += [f"coalesce(CAST({slot} AS VARCHAR), '')", _lit(piece)]
    return " || ".join(out)


def _template(text: str) -> prompts.Template:
    return prompts.DEFAULT_TOKENS.template(text)


_SETS = prompts.PromptSet()

LEXICAL_CONTEXT = """lexical_context AS (
  SELECT qid, string_agg(title || chr(10) || text, '' ORDER BY rank) AS context
  FROM hits JOIN articles USING (article_id) GROUP BY qid)"""


def _sentences(expr: str) -> str:
    return f"regexp_split_to_array({expr}, '[.!?\\n]+')"


RARE = """rare AS (
  SELECT qid, term, ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) AS idf,
         row_number() OVER (PARTITION BY qid ORDER BY ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) DESC, term) AS nth
  FROM question_terms JOIN doc_freq USING (field, term) JOIN stats USING (field) WHERE field = 'text')"""


def _best_spans(name: str, texts: str) -> str:
    """CTE ``name(qid, span, score)`` from ``qid, rank, body``."""
    return f"""{name}_spans AS (
  SELECT qid, rank, no, trim(pieces[no + 1], ' ') AS span, list_distinct({_tokens('pieces[no + 1]')}) AS words
  FROM (SELECT qid, rank, {_sentences('body')} AS pieces FROM ({texts})), unnest(range(0, len(pieces))) AS u(no)),
{name} AS (
  SELECT qid, span, score FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, no) AS best FROM (
      SELECT qid, rank, no, any_value(span) AS span, round(sum(idf), 6) AS score
      FROM (SELECT qid, rank, no, span, unnest(words) AS term FROM {name}_spans) JOIN rare USING (qid, term)
      GROUP BY qid, rank, no)) WHERE best = 1 AND score > 0)"""


def _reader(p: str, reader) -> list[str]:
    """CTE ``<p>_answers``: what a reader finds for every question."""
    limit = "" if reader.keywords is None else f"WHERE nth <= {reader.keywords}"
    hits = _hits(reader.articles).replace("hits AS", f"{p}_hits AS").replace("scored", f"{p}_scored")
    return [
        f"{p}_asked AS (SELECT qid, field, term FROM rare, (VALUES ('title'), ('text')) AS f(field) {limit})",
        _scores(f"{p}_asked").replace("field_scores", f"{p}_fields"), hits.replace("field_scores", f"{p}_fields"),
        _best_spans(f"{p}_left", f"SELECT qid, rank, text AS body FROM {p}_hits JOIN articles USING (article_id)"),
        _best_spans(f"{p}_right", "SELECT qid, rank, paragraph AS body FROM neighbours JOIN paragraphs ON paragraph_id = id "
                                  f"WHERE rank <= {reader.paragraphs}"),
        f"""{p}_answers AS (
  SELECT qid, question, lexical_answer, semantic_answer, combined_answer, 'Answer:' || chr(10) || ' ' || combined_answer AS output
  FROM (SELECT qid, question, coalesce(l.span, '') AS lexical_answer, coalesce(s.span, '') AS semantic_answer,
               coalesce(CASE WHEN coalesce(l.score, 0) >= coalesce(s.score, 0) THEN l.span ELSE s.span END, '') AS combined_answer
        FROM questions LEFT JOIN {p}_left l USING (qid) LEFT JOIN {p}_right s USING (qid)))"""]


READING = [ARTICLES, QUESTIONS, INDEX, QUESTION_TERMS, RARE, PARAGRAPHS, SEMANTIC]
_EVAL = [*READING, *(cte for i, r in enumerate(READERS) for cte in _reader(f"r{i}", r)), "graded AS (" + " UNION ALL ".join(f"""
  SELECT qid, '{r.name}' AS variant, output, contains(lower(output), lower(trim({_sentences('question')}[1], ' '))) AS pass
  FROM r{i}_answers""" for i, r in enumerate(READERS)) + ")"]

# Each article's words by weight.
TELLING = """telling AS (
  SELECT article_id, term, row_number() OVER (PARTITION BY article_id ORDER BY
           round(tf * ln(1 + (n - df + 0.5e0) / (df + 0.5e0)), 6) DESC, term) AS nth
  FROM postings JOIN doc_freq USING (field, term) JOIN stats USING (field) WHERE field = 'text')"""
_ALL_VARIANTS = "SELECT unnest(['default', " + ", ".join(f"'{v.name}'" for v in VARIANTS) + "]) AS variant"

# The model outputs of the line-repair queries, built as on the other side.
OUTPUT_LINES = """lines AS (
  SELECT doc_id, doc_id % 8 AS k, title, lang,
         CAST(to_json({'question': title, 'answer': lang}) AS VARCHAR) AS good,
         CAST(to_json({'article_id': doc_id, 'question': title}) AS VARCHAR) AS by_id
  FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM documents)),
repaired AS (
  SELECT doc_id, CAST(0 AS INTEGER) AS line_no, 'Here are the lines:' AS line FROM lines
  UNION ALL SELECT doc_id, 2, 'null' FROM lines
  UNION ALL SELECT doc_id, 1, CASE
    WHEN k IN (0, 1, 4) THEN good
    WHEN k = 2 THEN good || ' trailing'
    WHEN k = 3 THEN replace(good, '"question":', '"Question":')
    WHEN k = 5 THEN by_id
    WHEN k = 6 THEN substr(good, 1, length(good) - 1)
    ELSE '"' || replace(good, '"', '\\"') || '"' END FROM lines)"""

SHARDED = """sharded AS (
  SELECT article_id, article_seq, title,
         CAST(floor(article_seq / (SELECT greatest(ceil(count(*) / 28), 1) FROM articles)) AS INTEGER) AS shard
  FROM articles)"""

_WANTED = """wanted_ids AS (
  SELECT item_id AS qid, (item_id * 37) || '.' || (item_id % 7) AS paragraph_id, item_id * 37 AS article_id,
         CAST(item_id % 7 AS INTEGER) AS paragraph_no FROM benchmark)"""

_CHECKSUM = "CAST(coalesce(sum(CAST('0x' || substr(md5({row}), 1, 8) AS BIGINT)), 0) AS BIGINT)"


def _marked(*columns: str) -> str:
    return " || '|' || ".join(
        f"coalesce('=' || replace(replace(CAST({c} AS VARCHAR), '\\', '\\\\'), '|', '\\|'), '-')" for c in columns)


# --- twins --------------------------------------------------------------------------------------

ORACLES = {
    "scan_articles": _with(ARTICLES) + "SELECT article_id, title, length(text) AS chars FROM articles",
    "prefix_articles": _with(ARTICLES) +
        "SELECT article_id, article_seq, title FROM articles ORDER BY article_seq LIMIT 50",
    "prefix_percent": _with(ARTICLES) + """SELECT article_id, article_seq, title FROM articles
WHERE article_seq < (SELECT round(count(*) * 20 / 100) FROM articles)""",
    "range_articles": _with(ARTICLES) +
        "SELECT article_id, article_seq, title FROM articles WHERE article_seq >= 50 AND article_seq < 150",
    "assign_shards": _with(ARTICLES, SHARDED) + "SELECT article_id, article_seq, shard FROM sharded",
    "with_positions": "SELECT doc_id AS article_id, row_number() OVER (ORDER BY doc_id) - 1 AS article_seq FROM documents",
    "process_embeddings": _with(ARTICLES, SHARDED, PARAGRAPHS, _hashed("w", "paragraphs", "paragraph_id", "paragraph")) + """
SELECT shard, paragraph_id AS id, CAST(count(w.dim) FILTER (w.weight <> 0) AS INTEGER) AS entries
FROM paragraphs JOIN sharded USING (article_id) LEFT JOIN w USING (paragraph_id) GROUP BY shard, paragraph_id""",
    "union_shards": _with(ARTICLES, SHARDED) + "SELECT shard, article_id, title FROM sharded",
    "shards_pending": _with(ARTICLES, SHARDED) + "SELECT shard, article_id FROM sharded WHERE shard % 3 <> 0",
    "scan_embeddings": _with(VALUES) + "SELECT id, dim, v AS value FROM vector_values",
    "upsert_articles": """SELECT article_id, md5(text) AS text_md5 FROM (
  SELECT doc_id AS article_id, text FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)
  UNION ALL SELECT item_id, text || CASE WHEN item_id % 2 = 0 THEN ' (revised)' ELSE '' END FROM benchmark
  UNION ALL SELECT item_id + 1000000000, text FROM benchmark)""",
    "snapshot_manifest": _with(ARTICLES, INDEX) + f"""
SELECT 'nightly' AS snapshot, 'doc_freq' AS table_name, count(*) AS rows,
       {_CHECKSUM.format(row=_marked('field', 'term', 'df'))} AS checksum FROM doc_freq
UNION ALL SELECT 'nightly', 'articles', count(*),
       {_CHECKSUM.format(row=_marked('article_id', 'title', 'text'))} FROM articles""",
    "vector_index": _with(VALUES, _calibration(), QUANTIZED) + """
SELECT id, array_to_string(list_transform(qv, lambda x: CAST(x AS INTEGER)), ',') AS qv,
       round(sqrt(list_dot_product(qv, qv)), 6) AS norm FROM quantized""",

    "split_paragraphs": _with(PARAGRAPHS) + "SELECT * FROM paragraphs",
    "parse_paragraph_id": _with(PARAGRAPHS) + """
SELECT paragraph_id, split_part(paragraph_id, '.', 1) AS article_id,
       TRY_CAST(split_part(paragraph_id, '.', 2) AS INTEGER) AS paragraph_no FROM paragraphs""",
    "truncate_text": """SELECT doc_id AS article_id,
  length(substr(text, 1, 12000)) AS context_chars, md5(substr(text, 1, 12000)) AS context_md5,
  length(substr(text, 1, 14000)) AS article_chars, md5(substr(text, 1, 14000)) AS article_md5 FROM documents""",
    "paragraph_to_article": _with(ARTICLES, _WANTED) + """
SELECT paragraph_id, article_id, title, md5(text) AS text_md5 FROM wanted_ids JOIN articles USING (article_id)""",
    "paragraph_to_text": _with(PARAGRAPHS, _WANTED) + """
SELECT w.paragraph_id, w.paragraph_no, paragraph FROM wanted_ids w LEFT JOIN paragraphs p ON p.paragraph_id = w.paragraph_id""",
    "get_by_id": _with(ARTICLES, _WANTED) + """
SELECT w.article_id, title, a.article_id IS NOT NULL AS found FROM wanted_ids w LEFT JOIN articles a USING (article_id)""",

    "render_search_prompt": _with(QUESTIONS) +
        f"SELECT qid, {_render(_SETS.search, 'question')} AS prompt FROM questions",
    "render_context_prompt": f"""SELECT conv_id, turn,
  {_render(_SETS.context, "text", "role || ' {context} %s'")} AS prompt FROM conversations""",
    "render_answer_prompt": f"""SELECT conv_id, turn,
  {_render(_SETS.answer, "text", "role", "'question ' || turn")} AS prompt FROM conversations""",
    "render_retrieval_prompt": _with(ARTICLES) + f"""SELECT article_id,
  {_render(_template(prompts.RETRIEVAL_TEXT), "article_id", "title", "text")} AS prompt FROM articles""",
    "render_essay_prompt": _with(ARTICLES) + f"""SELECT article_id,
  {_render(_template(prompts.ESSAY_TEXT), *(("article_id", "title", "text") * 2))} AS prompt
FROM articles""",
    "render_chat": """SELECT conv_id, turn // 1024 AS block, count(*) AS turns,
  string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY turn) AS chat
FROM conversations GROUP BY ALL""",
    "prompt_variants": _with(QUESTIONS, f"variants AS ({_ALL_VARIANTS})") + f"""
SELECT qid, variant, CASE variant WHEN 'short' THEN {_render(VARIANTS[1].template, 'question')}
  ELSE {_render(_SETS.search, 'question')} END AS prompt FROM questions, variants""",

    "repair_json_lines": _with(OUTPUT_LINES) + "SELECT doc_id, line_no, line FROM repaired",
    "parse_questions": _with(OUTPUT_LINES) + """
SELECT doc_id, CAST(1 AS INTEGER) AS line_no, CASE WHEN k = 5 THEN CAST(doc_id AS VARCHAR) END AS article_id,
       title AS question, CASE WHEN k <> 5 THEN lang END AS answer FROM lines WHERE k IN (0, 1, 4, 5)""",
    "parse_quality": _with(OUTPUT_LINES) + """
SELECT 3 * count(*) AS total, count(*) FILTER (k IN (0, 1, 4, 5)) AS valid,
       3 * count(*) - count(*) FILTER (k IN (0, 1, 4, 5)) AS errors FROM lines""",
    "questions_jsonl": _with(OUTPUT_LINES) + """
SELECT CASE WHEN k = 5 THEN CAST(to_json({'article_id': CAST(doc_id AS VARCHAR), 'question': title}) AS VARCHAR) ELSE good END AS line
FROM lines WHERE k IN (0, 1, 4, 5)""",
    "read_questions": _with(OUTPUT_LINES) + """
SELECT CASE WHEN k = 5 THEN CAST(doc_id AS VARCHAR) END AS article_id, title AS question,
       CASE WHEN k <> 5 THEN lang END AS answer FROM lines WHERE k IN (0, 1, 4, 5)""",
    "retrieval_questions": _with(ARTICLES, INDEX, TELLING, f"""spans AS (
  SELECT article_id, term, no, {_tokens('pieces[no + 1]')} AS words
  FROM (SELECT article_id, term, {_sentences('text')} AS pieces FROM articles JOIN telling USING (article_id) WHERE nth = 1),
       unnest(range(0, len(pieces))) AS u(no))""") + f"""
SELECT article_id, array_to_string(list_transform(words, lambda w: CASE WHEN w = term THEN '____' ELSE w END), ' ') AS question,
       term AS answer
FROM spans WHERE list_contains(words, term) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY no) = 1""",
    "essay_questions": _with(ARTICLES, INDEX, TELLING) + """
SELECT article_id, 'How do ' || terms || ' belong together in ' || title || '?' AS question
FROM articles JOIN (SELECT article_id, string_agg(term, ', ' ORDER BY nth) AS terms FROM telling WHERE nth <= 3 GROUP BY article_id)
     USING (article_id)""",

    "tokenize": _with(ARTICLES, INDEX) + """
SELECT field, article_id, CAST(n - 1 AS INTEGER) AS position, terms[n] AS term
FROM fields, unnest(range(1, len(terms) + 1)) AS u(n)""",
    "postings": _with(ARTICLES, INDEX) + "SELECT field, term, article_id, dl, tf FROM postings",
    "doc_freq": _with(ARTICLES, INDEX) + "SELECT field, term, df FROM doc_freq",
    "corpus_stats": _with(ARTICLES, INDEX) + "SELECT field, n, round(avgdl, 6) AS avgdl FROM stats",
    "match_text": _with(*_search(10, combine="max(raw)", where="field = 'text'")) + "SELECT * FROM hits",
    "multi_match": _with(*_search(10)) + "SELECT * FROM hits",
    "fuzzy_match": _with(*_fuzzy(10, "max(raw)", "field = 'text'")) + "SELECT * FROM hits",
    "bool_should_fuzzy": _with(*_fuzzy(10, _SUM, "true")) + "SELECT * FROM hits",
    "lexical_top2": _with(*_search(2)) + "SELECT * FROM hits",
    "update_index": _with(*_search(2, articles=ARTICLES[:-1] + " WHERE doc_id % 11 <> 0)")) + "SELECT * FROM hits",
    "lexical_retrieve": _with(*_search(2, questions=(
        "questions AS (SELECT item_id AS qid, replace(text, ' ', ',') AS question FROM benchmark)"))) + """
SELECT qid, article_id, score, rank, title, md5(text) AS text_md5 FROM hits JOIN articles USING (article_id)""",

    "embed_hashed": _with(PARAGRAPHS, _hashed("w", "paragraphs", "paragraph_id", "paragraph")) +
        "SELECT paragraph_id, dim, round(CAST(weight AS DOUBLE), 6) AS weight FROM w WHERE weight <> 0",
    "embed_queries": _with(QUESTIONS, _hashed("w", "questions", "qid", "question")) +
        "SELECT qid, dim, round(CAST(weight AS DOUBLE), 6) AS weight FROM w WHERE weight <> 0",
    "calibrate_int8": _with(VALUES, _calibration()) + "SELECT dim, lo, hi FROM calibration",
    "quantize_int8": _with(VALUES, _calibration(), QUANTIZED) + """
SELECT id, array_to_string(list_transform(qv, lambda x: CAST(x AS INTEGER)), ',') AS qv FROM quantized""",
    "quantize_queries": _with(VALUES, _calibration(where="id % 2 = 0"), QUANTIZED) + """
SELECT id, array_to_string(list_transform(qv, lambda x: CAST(x AS INTEGER)), ',') AS qv FROM quantized
WHERE id % 2 = 1""",
    "validate_vectors": """SELECT CAST(64 AS INTEGER) AS dims, count(*) FILTER (vec_id % 3 <> 0 AND len(embedding) = 64) AS accepted,
  count(*) FILTER (vec_id % 3 = 0 OR len(embedding) <> 64) AS rejected FROM embeddings""",
    "knn_int8": _with(VALUES, _calibration(), QUANTIZED, _knn("quantized", "quantized", 10)) +
        "SELECT * FROM neighbours",
    "knn_exact_lists": _with(VALUES, _calibration(), QUANTIZED, _knn("quantized", "quantized", 10)) +
        "SELECT * FROM neighbours",
    "knn_ivf": _with(VALUES, _calibration(), QUANTIZED,
                     "vectors AS (SELECT *, sqrt(list_dot_product(qv, qv)) AS norm FROM quantized)", INVERTED) +
        "SELECT * FROM neighbours",
    "knn_self_check": _with(VALUES, _calibration(), QUANTIZED, _knn("quantized", "quantized", 1)) +
        "SELECT qid AS id, id AS nearest_id, score, score = 1 AS found FROM neighbours",
    "semantic_retrieve": _with(QUESTIONS, PARAGRAPHS, SEMANTIC) + """
SELECT qid, paragraph_id, score, rank, paragraph FROM neighbours JOIN paragraphs ON paragraph_id = id""",

    "build_context": _with(*_search(2), LEXICAL_CONTEXT) +
        "SELECT qid, length(context) AS chars, md5(context) AS context_md5 FROM lexical_context",
    "context_windows": _with(*_search(2), """windows AS (
  SELECT qid, rank, no, list_slice(pieces, no * 350 + 1, no * 350 + 400) AS part
  FROM (SELECT qid, rank, string_split(title || chr(10) || text, ' ') AS pieces FROM hits JOIN articles USING (article_id)),
       unnest(range(0, greatest(1, CAST(ceil((len(pieces) - 50) / 350) AS BIGINT)))) AS u(no))""") + """
SELECT qid, rank, CAST(no AS INTEGER) AS window_no, CAST(len(part) AS INTEGER) AS words,
       md5(array_to_string(part, ' ')) AS context_md5 FROM windows""",
    "pair_answers": """WITH keyed AS (SELECT conv_id || '-' || (turn // 2) AS qid, turn, role, text FROM conversations),
l AS (SELECT qid, string_agg(text, chr(10) ORDER BY turn, text) AS lexical_answer FROM keyed WHERE role = 'user' GROUP BY qid),
s AS (SELECT qid, string_agg(text, chr(10) ORDER BY turn, text) AS semantic_answer FROM keyed WHERE role = 'assistant' GROUP BY qid)
SELECT qid, coalesce(lexical_answer, '') AS lexical_answer, coalesce(semantic_answer, '') AS semantic_answer
FROM l FULL OUTER JOIN s USING (qid)""",
    "answer_questions": _with(*READING, *_reader("r", READERS[0])) +
        "SELECT qid, lexical_answer, semantic_answer, combined_answer, output FROM r_answers",
    "eval_cases": _with(QUESTIONS) + f"""
SELECT qid, question AS inquiry, 'icontains' AS type, trim({_sentences('question')}[1], ' ') AS value FROM questions""",
    "read_eval_cases": _with(QUESTIONS) + f"""
SELECT CAST(qid AS VARCHAR) AS qid, question AS inquiry, 'icontains' AS type, trim({_sentences('question')}[1], ' ') AS value
FROM questions""",
    "icontains": _with(*_search(2), LEXICAL_CONTEXT) + """
SELECT qid, coalesce(contains(lower(context), lower(question)), false) AS pass
FROM questions LEFT JOIN lexical_context USING (qid)""",
    "run_eval": _with(*_EVAL) + "SELECT qid, variant, output, pass FROM graded",
    "pass_rate": _with(*_EVAL) + """
SELECT variant, count(*) AS cases, count(*) FILTER (pass) AS passed,
       round(avg(CAST(pass AS INTEGER)), 6) AS rate FROM graded GROUP BY variant""",
    "stream_questions": _with(*_search(2, questions=(
        "questions AS (SELECT conv_id || '-' || turn AS qid, text AS question FROM conversations "
        "WHERE role = 'user')"))) + "SELECT * FROM hits",
}
