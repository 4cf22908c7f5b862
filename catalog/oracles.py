"""DuckDB SQL for the registered queries, written independently of the Spark code.

Long statements share common table expressions.  Two differences between the engines
matter here: lists of floats must be cast to DOUBLE[] before arithmetic, and DuckDB's
cast to integer rounds where Spark's truncates.
"""

from __future__ import annotations

from folioscope import constants as C

_BLANK = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||chr(133)||chr(160)"


def _strip(text: str) -> str:
    return f"trim({text}, {_BLANK})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_FILES = """files AS (
  SELECT doc_id, source || '-' || doc_id || '.txt' AS file_name, sha256(text) AS file_hash, text FROM documents)"""

_FIRST_FILES = """first_files AS (
  SELECT file_hash, min(file_name) AS file_name, any_value(text) AS text FROM files GROUP BY file_hash)"""


def _splitter(name: str, source: str, key: str, pieces: str, size: int, overlap: int, separator: str) -> list[str]:
    """CTEs that end in ``name(key, chunk_index, text)``: greedy runs over a list of pieces.

    The start of every run comes from prefix sums of the piece lengths, ``ends[i]`` being
    the length of the first i - 1 pieces with their separators.
    """
    gap = len(separator)
    glue = "||".join(f"chr({ord(c)})" for c in separator) or "''"
    return [
        f"{name}_pieces AS (SELECT {key}, {pieces} AS pieces FROM {source})",
        f"""{name}_units AS (
  SELECT {key}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM {name}_pieces)""",
        f"""{name}_sums AS (
  SELECT {key}, i, piece, (sum(length(piece) + {gap}) OVER (PARTITION BY {key} ORDER BY i))::BIGINT AS upto
  FROM {name}_units)""",
        f"""{name}_lists AS (
  SELECT {key}, list(piece ORDER BY i) AS pieces, list_prepend(0::BIGINT, list(upto ORDER BY i)) AS ends,
         count(*)::BIGINT AS n
  FROM {name}_sums GROUP BY {key})""",
        f"""{name}_runs AS (
  SELECT {key}, 1::BIGINT AS i, 1::BIGINT AS start, NULL::BIGINT AS first, NULL::BIGINT AS last FROM {name}_lists
  UNION ALL
  SELECT r.{key}, r.i + 1,
    CASE WHEN ends[r.i + 2] - ends[r.start] - {gap} > {size}
         THEN list_filter(range(r.start, r.i + 2), lambda x:
              x = r.i + 1 OR (ends[r.i + 1] - ends[x] - {gap} <= {overlap} AND ends[r.i + 2] - ends[x] - {gap} <= {size}))[1]
         ELSE r.start END,
    CASE WHEN ends[r.i + 2] - ends[r.start] - {gap} > {size} THEN r.start END,
    CASE WHEN ends[r.i + 2] - ends[r.start] - {gap} > {size} THEN r.i END
  FROM {name}_runs r JOIN {name}_lists USING ({key}) WHERE r.i < n)""",
        f"""{name}_ranges AS (
  SELECT {key}, first, last FROM {name}_runs WHERE first IS NOT NULL
  UNION ALL
  SELECT {key}, start, i FROM {name}_runs JOIN {name}_lists USING ({key}) WHERE i = n)""",
        f"""{name} AS (
  SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY last) - 1)::INT AS chunk_index, text
  FROM (SELECT {key}, last, {_strip(f"list_aggregate(pieces[first:last], 'string_agg', {glue})")} AS text
        FROM {name}_ranges JOIN {name}_lists USING ({key}))
  WHERE text <> '')""",
    ]


def _line_chunks(name: str) -> list[str]:
    pieces = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"
    return _splitter(name, "documents", "doc_id", pieces, C.LINE_CHUNK_SIZE, C.LINE_CHUNK_OVERLAP, "\n")


def _chars(text: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in text)


def _recursive_chunks(
    name: str, source: str, key: str, size: int = C.CHUNK_SIZE, overlap: int = C.CHUNK_OVERLAP
) -> list[str]:
    """Texts are cut at the coarsest separator they contain, and pieces of ``size`` or more
    again at finer ones.  Neighbouring short pieces of one cut form a group, and groups are
    what runs are made of; zero-padded paths keep the order.
    """
    separators = [s for s in C.CHUNK_SEPARATORS if s]
    level = "CASE " + " ".join(
        f"WHEN level <= {i} AND contains(text, {_chars(s)}) THEN {i}" for i, s in enumerate(separators)
    ) + f" ELSE {len(separators)} END"
    separator = "CASE cut " + " ".join(f"WHEN {i} THEN {_chars(s)}" for i, s in enumerate(separators)) + " END"
    pieces = f"""CASE WHEN cut = {len(separators)} THEN string_split(text, '')
      ELSE list_filter(list_transform(string_split(text, {separator}),
           lambda x, i: CASE WHEN i = 1 THEN x ELSE {separator} || x END), lambda x: x <> '') END"""
    return [
        f"""{name}_cuts AS (
  SELECT {key}, ''::VARCHAR AS parent, ''::VARCHAR AS path, text, 0 AS level, false AS short FROM {source}
  UNION ALL
  SELECT {key}, path, path || lpad(i::VARCHAR, 8, '0') || '/', piece, cut + 1, length(piece) < {size}
  FROM (SELECT {key}, path, cut, unnest(parts) AS piece, generate_subscripts(parts, 1) AS i
        FROM (SELECT {key}, path, cut, {pieces} AS parts
              FROM (SELECT {key}, path, text, {level} AS cut FROM {name}_cuts WHERE NOT short))))""",
        f"""{name}_grouped AS (
  SELECT {key}, parent, path, text, short,
         sum((NOT short)::INT) OVER (PARTITION BY {key}, parent ORDER BY path) AS run
  FROM {name}_cuts WHERE path <> '')""",
        f"""{name}_groups AS (
  SELECT {key}, {key} || '|' || parent || '|' || run AS grp, min(path) AS place, list(text ORDER BY path) AS parts
  FROM {name}_grouped WHERE short GROUP BY ALL)""",
        *_splitter(f"{name}_parts", f"{name}_groups", "grp", "parts", size, overlap, ""),
        f"""{name} AS (
  SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY place, p.chunk_index) - 1)::INT AS chunk_index, p.text
  FROM {name}_parts p JOIN {name}_groups USING (grp))""",
    ]


_POINTS = [
    _FILES,
    _FIRST_FILES,
    *_recursive_chunks("chunks", "first_files", "file_hash"),
    """points AS (
  SELECT sha256(file_hash || ':1:' || chunk_index) AS id, file_name, file_hash, chunk_index, c.text
  FROM chunks c JOIN first_files USING (file_hash))""",
]

_PAYLOAD = f"""file_name, file_hash, NULL::VARCHAR AS file_title, NULL::VARCHAR AS authors, NULL::VARCHAR AS keywords,
  NULL::VARCHAR AS creation_date, '1' AS page_number, text,
  substr(text, 1, {C.SUMMARY_CHARS}) || '{C.SUMMARY_SUFFIX}' AS summary"""


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"


def _embedded(name: str, source: str, key: str, text: str, size: int = C.VECTOR_SIZE) -> list[str]:
    """``name(key, bucket, weight)`` of non-zero elements, and ``name_norm(key, norm)``."""
    return [
        f"""{name} AS (
  SELECT {key}, ('0x' || substr(sha256(word), 1, 8))::BIGINT % {size} AS bucket, count(*)::DOUBLE AS weight
  FROM (SELECT {key}, unnest({_words(text)}) AS word FROM {source}) GROUP BY ALL)""",
        f"{name}_norm AS (SELECT {key}, sqrt(sum(weight * weight)) AS norm FROM {name} GROUP BY {key})",
    ]


_QUESTIONS = "questions AS (SELECT item_id AS question_id, text AS question FROM benchmark)"


def _hits(k: int, questions: str = "questions") -> list[str]:
    """``hits(question_id, id, score, rank)`` of questions against the points."""
    return [
        *_embedded("question_vectors", questions, "question_id", "question"),
        *_embedded("point_vectors", "points", "id", "text"),
        """dots AS (
  SELECT question_id, id, sum(q.weight * p.weight) AS dot
  FROM question_vectors q JOIN point_vectors p USING (bucket) GROUP BY ALL)""",
        f"""scores AS (
  SELECT question_id, id, round(coalesce(dot / (qn.norm * pn.norm), 0), 10) AS score
  FROM (SELECT question_id, id FROM {questions} CROSS JOIN points) every_pair
  LEFT JOIN dots USING (question_id, id)
  LEFT JOIN question_vectors_norm qn USING (question_id) LEFT JOIN point_vectors_norm pn USING (id))""",
        f"""hits AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM scores)
  WHERE rank <= {k})""",
    ]


_DOCUMENTS = """found AS (
  SELECT question_id, rank AS position, rank, id, score, file_name AS source, '1' AS page, text,
         '[' || rank || ']' AS reference_number, text || ' [' || rank || ']' AS page_content
  FROM hits JOIN points USING (id))"""


def _reranked(questions: str = "questions") -> list[str]:
    return [
        f"""rescored AS (
  SELECT f.* EXCLUDE (position), len(list_intersect(list_distinct({_words('question')}), {_words('f.text')}))
         / len(list_distinct({_words('question')})) AS rerank_score
  FROM found f JOIN {questions} USING (question_id))""",
        f"""best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, rank) AS position FROM rescored)
  WHERE position <= {C.RERANK_TOP_N})""",
    ]


def _assembled(source: str) -> str:
    return f"""assembled AS (
  SELECT question_id, string_agg(page_content, chr(10)||chr(10) ORDER BY position) AS context,
         string_agg('[' || position || '] ' || source || ', page ' || page, chr(10) ORDER BY position) AS "references"
  FROM {source} GROUP BY question_id)"""


_NAIVE = [*_POINTS, _QUESTIONS, *_hits(C.TOP_K), _DOCUMENTS]
_RERANKED = [*_POINTS, _QUESTIONS, *_hits(C.OVER_RETRIEVE_K), _DOCUMENTS, *_reranked()]
_RETRIEVED = "question_id, position::INT AS position, id, round(score, 6) AS score, source, page, reference_number, page_content"


def _prompt(template: str, values: dict[str, str]) -> str:
    sql = _quoted(template)
    for name, column in values.items():
        sql = sql.replace("{" + name + "}", f"' || {column} || '")
    return sql


def _embedding_search(k: int) -> str:
    return (
        _with(
            _QUESTIONS,
            *_embedded("sparse", "questions", "question_id", "question", 64),
            """slots AS (SELECT question_id, unnest(range(64)) AS bucket FROM questions)""",
            """dense AS (
  SELECT question_id, list(coalesce(weight, 0)::DOUBLE ORDER BY bucket) AS vector
  FROM slots LEFT JOIN sparse USING (question_id, bucket) GROUP BY question_id)""",
            """scores AS (
  SELECT question_id, vec_id AS id, round(list_cosine_similarity(vector, embedding::DOUBLE[]), 10) AS score
  FROM dense CROSS JOIN embeddings)""",
            """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id)::INT AS rank FROM scores)""",
        )
        + f"SELECT question_id, rank, id, round(score, 6) AS score FROM ranked WHERE rank <= {k}"
    )


_PAIRS = """pairs AS (
  SELECT conv_id, (position // 2)::BIGINT AS pair_index, text AS first_text, following AS second_text
  FROM (SELECT conv_id, text, row_number() OVER w - 1 AS position, lead(text) OVER w AS following
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE position % 2 = 0 AND following IS NOT NULL)"""

_ENTRY = "chr(10) || CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant' ELSE role END || ': ' || text"

_EARLIER = "ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

#: The earlier messages of the same page of three turns, and of the whole conversation.
_HISTORY = f"""SELECT conv_id, turn, (turn // 3)::BIGINT AS page, coalesce(string_agg({_ENTRY}, '') OVER (
  PARTITION BY conv_id, turn // 3 {_EARLIER}), '') AS history_tail FROM conversations"""
_WHOLE_HISTORY = f"""SELECT conv_id, turn, coalesce(string_agg({_ENTRY}, '') OVER (
  PARTITION BY conv_id {_EARLIER}), '') AS history FROM conversations"""


def _escaped(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = f"replace({text}, {_quoted(raw)}, {_quoted(safe)})"
    return text


def _html(escape: bool) -> str:
    cell = _escaped if escape else (lambda text: text)
    parts = [
        f"replace({_quoted(template)}, {_quoted(C.MESSAGE_SLOT)}, {cell(column)})"
        for template, column in ((C.USER_HTML, "first_text"), (C.BOT_HTML, "second_text"))
    ]
    return f"WITH {_PAIRS}\nSELECT conv_id, pair_index, {' || '.join(parts)} AS html FROM pairs"


_LEDGER = (
    _with(*_POINTS)
    + """SELECT f.file_hash, f.file_name, count(p.id) AS n_chunks, min(length(p.text))::INT AS min_length,
  max(length(p.text))::INT AS max_length, trunc(median(length(p.text)))::INT AS median_length
FROM first_files f LEFT JOIN points p USING (file_hash) GROUP BY ALL"""
)



def _session_questions(where: str) -> str:
    """The last message per conversation among those that ``where`` keeps, if it is the user's."""
    return f"""latest AS (SELECT conv_id, max(turn) AS turn FROM conversations {where} GROUP BY conv_id),
session_questions AS (
  SELECT conv_id, turn, text, conv_id AS question_id, text AS question
  FROM conversations JOIN latest USING (conv_id, turn) WHERE role = 'user')"""


_LATEST = _session_questions("WHERE role = 'user'")
_OPEN = _session_questions("")

_EVALUATION = [
    *_NAIVE,
    """evaluation AS (
  SELECT q.question_id, question, coalesce(b.text, question) AS ground_truth, coalesce(page_content, '') AS answer
  FROM questions q LEFT JOIN found f ON f.question_id = q.question_id AND position = 1
  LEFT JOIN benchmark b ON b.item_id = q.question_id + 1)""",
]

_RELEVANCY = [
    f"""generated AS (
  SELECT question_id, line, row_number() OVER () AS line_id
  FROM (SELECT question_id, unnest(list_transform(string_split(answer, chr(10)), lambda x: {_strip('x')})) AS line
        FROM evaluation) WHERE line <> '')""",
    *_embedded("line_vectors", "generated", "line_id", "line"),
    """line_scores AS (
  SELECT question_id, coalesce(dot / (qn.norm * ln.norm), 0) AS score
  FROM generated g
  LEFT JOIN (SELECT g2.line_id, sum(q.weight * l.weight) AS dot
             FROM generated g2 JOIN question_vectors q USING (question_id)
             JOIN line_vectors l ON l.line_id = g2.line_id AND l.bucket = q.bucket GROUP BY ALL) USING (line_id)
  LEFT JOIN question_vectors_norm qn USING (question_id) LEFT JOIN line_vectors_norm ln USING (line_id))""",
    "relevancy AS (SELECT question_id, avg(score) AS answer_relevancy FROM line_scores GROUP BY question_id)",
]

_FAITHFULNESS = [
    f"""known_words AS (
  SELECT question_id, flatten(list({_words('page_content')})) AS known FROM found GROUP BY question_id)""",
    f"""answer_lines AS (
  SELECT question_id, line FROM (
    SELECT question_id, unnest(list_transform(string_split(answer, chr(10)), lambda x: {_strip('x')})) AS line FROM evaluation)
  WHERE line <> '')""",
    f"""line_verdicts AS (
  SELECT question_id, len(list_filter({_words('line')}, lambda w: NOT list_contains(known, w))) = 0 AS supported
  FROM answer_lines JOIN known_words USING (question_id))""",
    """faithful AS (
  SELECT question_id, avg(supported::INT) AS faithfulness, count(*) AS n_statements FROM line_verdicts GROUP BY question_id)""",
]

_CORRECTNESS = [
    *_embedded("answer_vectors", "evaluation", "question_id", "answer"),
    *_embedded("truth_vectors", "evaluation", "question_id", "ground_truth"),
    f"""overlap AS (
  SELECT question_id, list_distinct({_words('answer')}) AS given, list_distinct({_words('ground_truth')}) AS wanted
  FROM evaluation)""",
    """counted AS (
  SELECT question_id, len(list_intersect(given, wanted)) AS tp, len(given) AS n_given, len(wanted) AS n_wanted
  FROM overlap)""",
    """factual AS (
  SELECT question_id, CASE WHEN tp > 0 THEN tp / (tp + (n_given - tp + n_wanted - tp) / 2) ELSE 0 END AS f1 FROM counted)""",
    """resembling AS (
  SELECT question_id, coalesce(dot / (qn.norm * an.norm), 0) AS similarity
  FROM evaluation
  LEFT JOIN (SELECT question_id, sum(q.weight * a.weight) AS dot
             FROM truth_vectors q JOIN answer_vectors a USING (question_id, bucket) GROUP BY ALL) USING (question_id)
  LEFT JOIN truth_vectors_norm qn USING (question_id) LEFT JOIN answer_vectors_norm an USING (question_id))""",
    f"""correctness AS (
  SELECT question_id, f1, similarity,
         {C.CORRECTNESS_WEIGHTS[0]}::DOUBLE * f1 + {C.CORRECTNESS_WEIGHTS[1]}::DOUBLE * similarity AS answer_correctness
  FROM factual JOIN resembling USING (question_id))""",
]

_PAYLOAD_MAPS = """payloads AS (
  SELECT doc_id, text, lang, lang <> 'de' AS has_source, CASE WHEN lang <> 'fr' THEN source END AS source,
         starts_with(source, 'src1') AS has_page, n_chars::VARCHAR AS page FROM documents)"""

_VERDICTS = "verdicts AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id))"

_REPLIES = """shaped AS (
  SELECT event_id, event_id % 8 AS kind, event_type AS word, props, '["' || event_type || '", "' || user_id || '"]' AS pair
  FROM events),
full_replies AS (SELECT *, '{"statements": ' || pair || ', "verdicts": ["yes", "' || word || '"]}' AS full_reply FROM shaped),
replies AS (
  SELECT event_id, CASE kind WHEN 0 THEN full_reply WHEN 1 THEN pair WHEN 2 THEN json_extract_string(props, '$.k')
    WHEN 3 THEN full_reply || chr(10) || 'Done. ' WHEN 4 THEN props
    WHEN 5 THEN '  ' || word || chr(10) || chr(10) || ' is ' || props || ' ' || chr(10)
    WHEN 6 THEN '{"statements": ' || pair || ', "verdicts": "none"}'
    ELSE '{"a": 1, "statements": ' || pair || ', "a": 2}' END AS reply FROM full_replies)"""


def oracles() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["content_hash"] = "SELECT doc_id, sha256(text) AS file_hash FROM documents"
    sql["dedup_first"] = (
        "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1"
    )
    sql["incremental_anti"] = """WITH hashed AS (SELECT doc_id, sha256(text) AS file_hash FROM documents)
SELECT file_hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM hashed
WHERE file_hash NOT IN (SELECT file_hash FROM hashed JOIN labels USING (doc_id)) GROUP BY file_hash"""
    sql["exists_probe"] = """WITH hashed AS (SELECT doc_id, sha256(text) AS file_hash FROM documents)
SELECT doc_id, file_hash IN (SELECT file_hash FROM hashed JOIN labels USING (doc_id)) AS already_indexed FROM hashed"""
    sql["ext_filter"] = "SELECT page_id, url FROM pages WHERE lower(url) LIKE '%.html'"
    sql["embed_endpoint"] = "SELECT page_id, rtrim(url, '/') || '/embed' AS endpoint FROM pages"
    sql["page_lines"] = f"""SELECT doc_id, page_number::INT AS page_number, text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) AS page_number FROM documents)
WHERE {_strip('text')} <> ''"""
    sql["stripped_lines"] = f"""WITH kept AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS l
  FROM documents)
SELECT doc_id, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS line_index FROM kept"""
    sql["folder_scan"] = f"""SELECT line, count(*) AS n FROM (
  SELECT unnest(list_transform(string_split(text, chr(10)), lambda x: {_strip('x')})) AS line FROM documents)
WHERE line <> '' GROUP BY line"""
    sql["joined_pages"] = "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents"

    sql["question_file"] = """SELECT text AS question,
  CASE WHEN item_id % 2 = 0 THEN 'first: ' ELSE 'second: ' END || text AS ground_truth FROM benchmark"""

    sql["chunk_naive"] = _with(*_line_chunks("chunks")) + "SELECT doc_id, chunk_index, text FROM chunks"
    sql["chunk_recursive"] = (
        _with(*_recursive_chunks("chunks", "documents", "doc_id")) + "SELECT doc_id, chunk_index, text FROM chunks"
    )
    sql["chunk_recursive_short"] = (
        _with(*_recursive_chunks("chunks", "documents", "doc_id", 60, 15)) + "SELECT doc_id, chunk_index, text FROM chunks"
    )
    sql["chunk_stats"] = (
        _with(*_line_chunks("chunks"))
        + """SELECT doc_id, count(*) AS n_chunks, min(length(text))::INT AS min_length, max(length(text))::INT AS max_length,
  trunc(median(length(text)))::INT AS median_length FROM chunks GROUP BY doc_id"""
    )
    cut = f"substr(text, 1, {C.SUMMARY_CHARS}) || '{C.SUMMARY_SUFFIX}'"
    sql["summary_fallback"] = f"SELECT doc_id, {cut} AS summary FROM documents"
    sql["summary_conditional"] = (
        f"SELECT doc_id, CASE WHEN length(text) > {C.SUMMARY_CHARS} THEN {cut} ELSE text END AS summary FROM documents"
    )
    all_chunks = _with(_FILES, *_recursive_chunks("chunks", "files", "doc_id"))
    for name, page, id_page in (("page_points", "'1'", "1"), ("document_points", "NULL::VARCHAR", "")):
        sql[name] = (
            all_chunks
            + f"""SELECT sha256(file_hash || ':{id_page}:' || chunk_index) AS id, file_name, file_hash,
  NULL::VARCHAR AS file_title, NULL::VARCHAR AS authors, NULL::VARCHAR AS keywords, NULL::VARCHAR AS creation_date,
  {page} AS page_number, c.text, substr(c.text, 1, {C.SUMMARY_CHARS}) || '{C.SUMMARY_SUFFIX}' AS summary
FROM chunks c JOIN files USING (doc_id)"""
        )
    sql["hash_embed"] = (
        _with(*_embedded("vectors", "documents", "doc_id", "text"))
        + "SELECT doc_id, bucket::INT AS element, weight FROM vectors"
    )
    sql["ingest_ledger"] = sql["stream_ingest"] = _LEDGER
    sql["ingested_points"] = _with(*_POINTS) + f"SELECT id, {C.VECTOR_SIZE}::INT AS vector_size, {_PAYLOAD} FROM points"
    sql["upsert_points"] = """SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, (quality + 100)::INT FROM labels"""

    sql["collection_info"] = (
        _with(*_POINTS) + "SELECT count(*) AS points_count, format('{:,}', count(*)) AS points_label FROM points"
    )
    sql["collection_properties"] = _with(*_POINTS) + (
        f"SELECT (SELECT count(*) FROM first_files) AS n_files, count(*) AS n_points, "
        f"{C.VECTOR_SIZE}::INT AS vector_size, '{C.VECTOR_METRIC}' AS metric FROM points"
    )
    sql["sample_file_names"] = _with(
        *_POINTS,
        f"""names AS (SELECT list_sort(list(DISTINCT file_name)) AS l
  FROM (SELECT file_name FROM points ORDER BY id LIMIT {C.SAMPLE_POINTS}))""",
    ) + (
        f"SELECT array_to_string(l[1:{C.SAMPLE_FILES}], ', ') AS sample, "
        f"greatest(len(l) - {C.SAMPLE_FILES}, 0)::INT AS n_more FROM names"
    )
    sql["keyword_filter"] = "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source = 'src1'"
    sql["collection_keyword"] = _with(*_POINTS) + f"SELECT id, {_PAYLOAD} FROM points ORDER BY id LIMIT 10"
    sql["scroll_limit"] = _with(*_POINTS) + f"SELECT id, {_PAYLOAD} FROM points ORDER BY id LIMIT 2"
    sql["scroll_pages"] = _with(*_POINTS) + (
        f"""SELECT page, min(id) AS first_id, max(id) AS last_id, count(*) AS n
FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // {C.SAMPLE_POINTS} AS page FROM points) GROUP BY page"""
    )
    sql["payload_index"] = _with(*_POINTS) + " UNION ALL ".join(
        f"SELECT '{f}' AS field, {f} AS value, count(*) AS n FROM (SELECT {_PAYLOAD} FROM points) WHERE {f} IS NOT NULL GROUP BY {f}"
        for f in C.KEYWORD_FIELDS
    )
    sql["upsert_collection"] = _with(
        *_POINTS,
        "verdicts AS (SELECT doc_id::VARCHAR AS doc, max(quality) AS quality FROM labels GROUP BY doc_id)",
    ) + r"""SELECT id, file_name, 'quality ' || quality AS keywords, NULL::VARCHAR AS keywords_before, TRUE AS was_there
FROM points LEFT JOIN verdicts ON doc = regexp_extract(file_name, '-([0-9]+)\.txt$', 1)"""
    sql["payload_defaults"] = f"""WITH {_PAYLOAD_MAPS}
SELECT doc_id, text, CASE WHEN has_source THEN source ELSE '{C.MISSING_SOURCE}' END AS source,
  CASE WHEN has_page THEN page ELSE '{C.MISSING_PAGE}' END AS page, has_source FROM payloads"""
    sql["metadata_minus_text"] = f"""WITH {_PAYLOAD_MAPS}
SELECT doc_id, 'lang' AS field, lang AS value FROM payloads
UNION ALL SELECT doc_id, 'source', source FROM payloads WHERE has_source
UNION ALL SELECT doc_id, 'page', page FROM payloads WHERE has_page"""

    sql["vector_topk5"] = _embedding_search(C.TOP_K)
    sql["ann_topk5_all_lists"] = sql["vector_topk5"]
    sql["ann_recall"] = f"""SELECT (SELECT count(*) FROM benchmark) * least({C.TOP_K}, (SELECT count(*) FROM embeddings)) AS n_exact,
  TRUE AS nine_tenths_found"""
    sql["vector_topk25"] = _embedding_search(C.OVER_RETRIEVE_K)
    sql["text_retrieval"] = _with(
        "points AS (SELECT conv_id || '-' || turn AS id, text, NULL::VARCHAR AS file_name FROM conversations)",
        _QUESTIONS,
        *_hits(C.TOP_K),
        _DOCUMENTS,
    ) + "SELECT question_id, position::INT AS position, id, round(score, 6) AS score, page_content FROM found"
    sql["naive_retrieval"] = _with(*_NAIVE) + f"SELECT {_RETRIEVED} FROM found"
    sql["hit_metadata"] = _with(
        *_NAIVE,
        """metadata AS (
  SELECT question_id, rank::INT AS rank, [{'f': 'file_name', 'v': source}, {'f': 'file_hash', 'v': file_hash},
    {'f': 'file_title', 'v': NULL}, {'f': 'authors', 'v': NULL}, {'f': 'keywords', 'v': NULL},
    {'f': 'creation_date', 'v': NULL}, {'f': 'page_number', 'v': '1'}, {'f': 'summary', 'v': summary},
    {'f': 'score', 'v': round(score, 6)::VARCHAR}] AS fields
  FROM found JOIN (SELECT id, file_hash, substr(text, 1, 200) || '...' AS summary FROM points) USING (id))""",
        "flat AS (SELECT question_id, rank, unnest(fields) AS e FROM metadata)",
    ) + "SELECT question_id, rank, e.f AS field, e.v AS value FROM flat"
    prefix = "'[Source: ' || source || ', page ' || page || ']' || chr(10) || text AS page_content"
    sql["citation_prefix"] = _with(*_NAIVE) + (
        f"SELECT {_RETRIEVED.removesuffix('page_content')} {prefix} FROM found"
    )
    sql["citation_defaults"] = _with(*_NAIVE) + (
        f"SELECT * REPLACE ('{C.MISSING_SOURCE}' AS source, '{C.MISSING_PAGE}' AS page) FROM (SELECT {_RETRIEVED} FROM found)"
    )
    sql["reranked_retrieval"] = _with(*_RERANKED) + f"SELECT {_RETRIEVED} FROM best"
    sql["context_assembly"] = _with(*_RERANKED, _assembled("best")) + "SELECT * FROM assembled"
    values = {
        "context": "coalesce(context, '')",
        "references": "coalesce(\"references\", '')",
        "chat_history": "''",
        "question": "question",
    }
    sql["prompt_render"] = _with(*_RERANKED, _assembled("best")) + (
        f"SELECT question_id, {_prompt(C.PROMPT_DEFAULT, values)} AS prompt FROM questions LEFT JOIN assembled USING (question_id)"
    )
    sql["prompt_with_references"] = _with(*_NAIVE, _assembled("found")) + (
        f"SELECT question_id, {_prompt(C.PROMPT_CITED_WITH_REFERENCES, values)} AS prompt "
        "FROM questions LEFT JOIN assembled USING (question_id)"
    )

    sql["message_positions"] = """SELECT conv_id, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations"""
    sql["qa_pairs"] = f"WITH {_PAIRS}\nSELECT * FROM pairs"
    sql["pairs_reversed"] = f"""WITH {_PAIRS}
SELECT conv_id, pair_index, row_number() OVER (PARTITION BY conv_id ORDER BY pair_index DESC) - 1 AS display_position
FROM pairs"""
    sql["render_html"] = _html(True)
    sql["render_raw_html"] = _html(False)
    sql["history_window"] = sql["stream_history"] = _HISTORY
    sql["history_pages"] = f"""SELECT conv_id, (turn // 3)::BIGINT AS page, count(*) AS n_messages,
  string_agg({_ENTRY}, '' ORDER BY turn) AS page_text FROM conversations GROUP BY ALL"""
    sql["latest_questions"] = f"WITH {_LATEST}\nSELECT conv_id, turn, text FROM session_questions"
    sql["open_questions"] = f"WITH {_OPEN}\nSELECT conv_id, turn, text FROM session_questions"
    values = {"context": "context", "chat_history": "history", "question": "question"}
    before, after = (_prompt(half, values) for half in C.PROMPT_DEFAULT.split("{chat_history}"))
    asked = _with(
        *_POINTS,
        _LATEST,
        *_hits(C.OVER_RETRIEVE_K, "session_questions"),
        _DOCUMENTS,
        *_reranked("session_questions"),
        _assembled("best"),
        f"pages AS ({sql['history_pages']})",
        f"tails AS ({_HISTORY})",
        f"history AS ({_WHOLE_HISTORY})",
        """asked AS (
  SELECT * FROM session_questions JOIN assembled USING (question_id) JOIN tails USING (conv_id, turn)
  JOIN history USING (conv_id, turn))""",
    )
    sql["chat_prompt_parts"] = asked + f"""SELECT conv_id, 0::BIGINT AS part,
  CASE WHEN page = 0 THEN {before} || history_tail || {after} ELSE {before} END AS text FROM asked
UNION ALL SELECT conv_id, page + 1, history_tail || {after} FROM asked WHERE page > 0
UNION ALL SELECT conv_id, p.page + 1, page_text FROM pages p JOIN asked a USING (conv_id) WHERE p.page < a.page"""
    sql["chat_whole_prompts"] = asked + f"SELECT conv_id, {_prompt(C.PROMPT_DEFAULT, values)} AS prompt FROM asked"

    sql["chat_turns"] = _with(
        *_POINTS,
        _OPEN,
        *_hits(C.OVER_RETRIEVE_K, "session_questions"),
        _DOCUMENTS,
        *_reranked("session_questions"),
    ) + """SELECT conv_id, o.turn + 1 AS turn, 'assistant' AS role,
  coalesce(page_content, '') AS text
FROM session_questions o LEFT JOIN best b ON b.question_id = o.question_id AND position = 1"""

    values = {"context": "answer", "chat_history": "history", "question": "question"}
    sql["replayed_chat"] = _with(
        *_POINTS,
        "session_questions AS (SELECT conv_id || '-' || turn AS question_id, conv_id, turn, text AS question FROM conversations WHERE role = 'user')",
        *_hits(1, "session_questions"),
        _DOCUMENTS,
        """replies AS (
  SELECT s.*, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, coalesce(page_content, '') AS answer
  FROM session_questions s LEFT JOIN found USING (question_id))""",
        """remembered AS (
  SELECT *, coalesce(string_agg(chr(10) || 'Human: ' || question || chr(10) || 'Assistant: ' || answer, '')
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM replies)""",
    ) + f"SELECT conv_id, turn, n AS question_number, sha256({_prompt(C.PROMPT_DEFAULT, values)}) AS prompt_hash, answer FROM remembered"
    sql["stored_calls"] = """WITH seen AS (
  SELECT 'documents' AS source, text, 1 AS turn FROM documents UNION ALL SELECT 'conversations', text, 2 FROM conversations)
SELECT source, count(text) AS n_vectors, count(DISTINCT text) AS n_distinct,
  (SELECT count(DISTINCT text) FROM seen b WHERE b.turn <= a.turn) AS calls,
  (SELECT count(DISTINCT text) FROM seen b WHERE b.turn <= a.turn) AS calls_after_rerun
FROM seen a GROUP BY source, a.turn"""
    judged = _with(
        *_RERANKED,
        "answered AS (SELECT q.question_id, q.question, coalesce(page_content, '') AS answer FROM questions q LEFT JOIN best b ON b.question_id = q.question_id AND position = 1)",
        f"""stated AS (
  SELECT question_id, question, list_filter(list_transform(string_split(answer, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS statements FROM answered)""",
        f"""verdicts AS (
  SELECT *, list_avg(list_transform(statements, lambda x: (len(list_intersect({_words('question')}, {_words('x')})) > 0)::INT)) AS score FROM stated)""",
        "judged AS (SELECT *, coalesce(score >= 0.5, FALSE) AS success FROM verdicts)",
    )
    sql["judge_answers"] = judged + """SELECT question_id, round(score, 6) AS score, success, len(statements)::INT AS n_statements,
  array_to_string(statements, chr(10)) AS statements FROM judged"""
    sql["judge_mean"] = judged + """SELECT round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE success) AS n_success, count(*) AS n_questions FROM judged"""
    renumbered = "'[Source: ' || source || ', page ' || page || ']' || chr(10) || text AS page_content"
    sql["reranked_renumbered"] = _with(*_RERANKED) + (
        f"SELECT * REPLACE ('[' || position || ']' AS reference_number) FROM (SELECT {_RETRIEVED.removesuffix('page_content')} {renumbered} FROM best)"
    )
    sql["eval_dataset"] = _with(*_EVALUATION) + """SELECT e.question_id, question, answer, ground_truth,
  (position - 1)::INT AS context_index, page_content AS context
FROM evaluation e LEFT JOIN found USING (question_id)"""
    sql["answer_relevancy"] = _with(*_EVALUATION, *_RELEVANCY) + (
        "SELECT question_id, round(answer_relevancy, 6) AS answer_relevancy FROM relevancy"
    )
    sql["answer_correctness"] = _with(*_EVALUATION, *_CORRECTNESS) + """SELECT question_id, round(f1, 6) AS f1,
  round(similarity, 6) AS similarity, round(answer_correctness, 6) AS answer_correctness FROM correctness"""
    sql["answer_faithfulness"] = _with(*_EVALUATION, *_FAITHFULNESS) + (
        "SELECT question_id, round(faithfulness, 6) AS faithfulness, n_statements FROM faithful"
    )
    sql["metric_suite"] = _with(*_EVALUATION, *_RELEVANCY, *_CORRECTNESS, *_FAITHFULNESS) + """SELECT
  round(avg(faithfulness), 6) AS faithfulness,
  round(avg(answer_relevancy), 6) AS answer_relevancy, round(avg(answer_correctness), 6) AS answer_correctness,
  count(*) AS n_questions
FROM evaluation LEFT JOIN relevancy USING (question_id) LEFT JOIN correctness USING (question_id)
LEFT JOIN faithful USING (question_id)"""
    sql["faithfulness"] = f"""WITH {_VERDICTS}
SELECT source, round(avg(quality), 6) AS faithfulness, count(*) AS n_statements FROM verdicts GROUP BY source"""
    sql["relevant_share"] = f"""WITH {_VERDICTS}
SELECT source, round(avg((toxic = 0)::INT), 6) AS answer_relevancy FROM verdicts GROUP BY source"""
    sql["statement_f1"] = f"""WITH {_VERDICTS}, counted AS (
  SELECT source, sum(quality)::BIGINT AS tp, sum(1 - quality)::BIGINT AS fp, sum(toxic)::BIGINT AS fn FROM verdicts GROUP BY source)
SELECT source, tp, fp, fn, round(CASE WHEN tp > 0 THEN tp / (tp + (fp + fn) / 2) ELSE 0 END, 6) AS f1 FROM counted"""
    sql["avg_score"] = """SELECT round(avg(quality), 6) AS mean_score, format('{:,.3f}', avg(quality)) AS mean_label,
  count(*) AS n_results FROM labels"""
    lines = f"list_filter(list_transform(string_split(output, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    parsed = f"""WITH {_REPLIES},
stripped AS (SELECT event_id, {_strip('reply')} AS output FROM replies),
typed AS (SELECT *, CASE WHEN json_valid(output) THEN json_type(output) ELSE 'TEXT' END AS shape FROM stripped),
parsed AS (
  SELECT event_id, output,
    CASE shape WHEN 'TEXT' THEN {lines}
      WHEN 'OBJECT' THEN CASE WHEN json_type(output, '$.statements') = 'ARRAY'
           THEN from_json(json_extract(output, '$.statements'), '["VARCHAR"]') ELSE [] END
      WHEN 'ARRAY' THEN from_json(output, '["VARCHAR"]') ELSE [] END AS statements,
    CASE WHEN shape = 'OBJECT' AND json_type(output, '$.verdicts') = 'ARRAY'
      THEN from_json(json_extract(output, '$.verdicts'), '["VARCHAR"]') ELSE [] END AS verdicts
  FROM typed)
"""
    sql["judged_evaluation"] = parsed + """, scored AS (
  SELECT item_id AS question_id, len(statements) AS n,
    CASE WHEN len(verdicts) > 0 THEN len(list_filter(verdicts, lambda v: lower(v) = 'yes')) / len(verdicts) END AS score
  FROM parsed JOIN benchmark ON item_id = event_id % (SELECT count(*) FROM benchmark))
SELECT question_id, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score >= 0.5) AS n_successes,
  sum(n)::BIGINT AS n_statements, count(*) AS n_replies FROM scored GROUP BY question_id"""
    sql["judge_json"] = parsed + """SELECT event_id, output, coalesce(array_to_string(statements, '|'), '') AS statements, len(statements)::INT AS n_statements,
  coalesce(array_to_string(verdicts, '|'), '') AS verdicts FROM parsed"""
    sql["service_replies"] = (
        "SELECT event_id, event_type AS content, round((value * 2)::FLOAT::DOUBLE, 6) AS second FROM events"
    )
    sql["first_success"] = """SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE value >= 50) AS first_working,
  count(*) FILTER (WHERE value < 50) AS n_failures FROM events GROUP BY user_id"""
    sql["cosine_pairs"] = """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)
  AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
    return sql
