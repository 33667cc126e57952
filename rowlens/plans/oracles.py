"""The registered queries in SQL, written apart from the DataFrame code."""

from __future__ import annotations

TOP_K = 5
PROBES = 6
HASH_DIM = 64

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"


def _strip(x: str) -> str:
    return f"trim({x}, {_BLANKS})"


def _text_member(name: str, x: str) -> str:
    return f"""'"{name}": ' || coalesce(to_json({_strip(x)})::VARCHAR, 'null')"""


def _plain_member(name: str, x: str) -> str:
    return f"""'"{name}": ' || coalesce('"' || ({x})::VARCHAR || '"', 'null')"""


def row_id(columns: dict[str, tuple[str, str]], type_text: str = "''") -> str:
    """Hash of ``{name: (expression, 't' for text | 'n' for the rest)}``."""
    members = [
        (_text_member if kind == "t" else _plain_member)(name, x) for name, (x, kind) in sorted(columns.items())
    ]
    body = " || ', ' || ".join(members)
    return f"sha256('{{' || {body} || '}}|' || {type_text})"


def _parts(columns: list[tuple[str, str]]) -> str:
    """``Label: value`` parts joined by `` | ``."""
    cells = ", ".join(
        f"CASE WHEN {_strip(f'({x})::VARCHAR')} <> '' THEN '{label}: ' || ({x})::VARCHAR END" for label, x in columns
    )
    return f"concat_ws(' | ', {cells})"


SHEETS = """
SELECT c_custkey AS cust_key, c_name AS title, c_nationkey AS nation_key, c_acctbal AS acct_bal,
       c_mktsegment AS dept, 'customer' AS source_sheet FROM customer
UNION ALL BY NAME
SELECT s_suppkey AS supp_key, s_name AS title, s_nationkey AS nation_key, s_acctbal AS acct_bal,
       'supplier' AS source_sheet FROM supplier
UNION ALL BY NAME
SELECT p_partkey AS part_key, p_name AS title, p_brand AS brand, p_type AS pub_type, p_size AS size,
       p_retailprice AS retail_price, 'part' AS source_sheet FROM part
"""

_SHEET_KINDS = {
    "cust_key": "n", "title": "t", "nation_key": "n", "acct_bal": "n", "dept": "t", "source_sheet": "t",
    "supp_key": "n", "part_key": "n", "brand": "t", "pub_type": "t", "size": "n", "retail_price": "n",
}
_SHEET_ID = row_id({c: (c, k) for c, k in _SHEET_KINDS.items()}, f"coalesce({_strip('pub_type')}, 'None')")
INGESTED = f"SELECT *, {_SHEET_ID} AS row_id FROM ({SHEETS})"
_SHEET_LABELS = [(c.replace("_", " ").title(), c) for c in _SHEET_KINDS]

_CUSTOMER_COLUMNS = ["cust_key", "title", "nation_key", "acct_bal", "dept", "source_sheet"]
_CUSTOMER_ID = row_id({c: (c, _SHEET_KINDS[c]) for c in _CUSTOMER_COLUMNS})
_CUSTOMER_SHEET = """SELECT c_custkey AS cust_key, c_name AS title, c_nationkey AS nation_key,
       c_acctbal AS acct_bal, c_mktsegment AS dept, 'customer' AS source_sheet FROM customer"""
CUSTOMERS = f"SELECT *, {_CUSTOMER_ID} AS row_id FROM ({_CUSTOMER_SHEET})"
_APPENDED_ID = row_id({c: (c, _SHEET_KINDS[c]) for c in [*_CUSTOMER_COLUMNS, "supp_key"]})

GAPPY = """
SELECT c_custkey AS cust_key,
       CASE WHEN c_mktsegment <> 'FURNITURE' THEN c_name END AS author,
       CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation,
       c_acctbal AS acct_bal,
       CASE WHEN c_mktsegment = 'BUILDING' THEN '  ' ELSE c_mktsegment END AS pub_type
FROM customer
"""

_TEXT_ID = row_id({"text": ("text", "t")})
BY_TEXT = f"SELECT *, {_TEXT_ID} AS row_id FROM documents"

ENTRIES = """
SELECT o_orderkey AS order_key,
       CASE WHEN starts_with(o_orderpriority, '5') THEN 'n/a'
            WHEN starts_with(o_orderpriority, '4') THEN '  '
            WHEN starts_with(o_orderpriority, '1') THEN (year(o_orderdate) + 300)::VARCHAR
            ELSE ' ' || year(o_orderdate)::VARCHAR END AS order_year,
       strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS note
FROM orders
"""
_YEAR = "TRY_CAST(trim(order_year) AS INTEGER)"
_YEAR_OK = f"(trim(order_year) = '' OR coalesce({_YEAR} BETWEEN 1900 AND 2100, false))"

LABELLED = "SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"
INDEX_STORE = f"SELECT doc_id::VARCHAR AS row_id, text, lang FROM ({LABELLED})"
INDEX_IDS = "SELECT vec_id::VARCHAR AS row_id, label FROM embeddings"


def _token_rows(source: str, key: str) -> str:
    split = r"string_split_regex(lower(text), '[^\p{L}\p{N}]+')"
    return f"SELECT {key}, t FROM (SELECT {key}, unnest({split}) AS t FROM {source}) WHERE t <> ''"


def _bucket(t: str = "t") -> str:
    return f"(('0x' || substr(md5({t}), 1, 6))::BIGINT % {HASH_DIM})"


def _entries(source: str, condition: str = "true") -> str:
    """Norm, first and last element of the hashed vector of ``source(row_id, text)``."""
    return f"""
WITH docs AS (SELECT row_id, text FROM ({source}) WHERE {_strip('text')} <> '' AND {condition}),
tok AS ({_token_rows('docs', 'row_id')}),
buckets AS (SELECT row_id, {_bucket()} AS b, count(*) AS n FROM tok GROUP BY ALL)
SELECT d.row_id, round(sqrt(coalesce(sum(n * n), 0)::DOUBLE), 6) AS norm,
       coalesce(sum(n) FILTER (b = 0), 0)::DOUBLE AS first,
       coalesce(sum(n) FILTER (b = {HASH_DIM - 1}), 0)::DOUBLE AS last
FROM docs d LEFT JOIN buckets USING (row_id) GROUP BY d.row_id
"""


_DISTANCE = "round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


def _centres(group: str) -> str:
    return f"""
SELECT cell, list(x ORDER BY i) AS embedding FROM (
  SELECT cell, i, avg(x) AS x FROM (
    SELECT {group} AS cell, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
  ) GROUP BY cell, i
) GROUP BY cell
"""


def _ranked(pairs: str, k: int) -> str:
    return f"""
SELECT query_id, rank::INTEGER AS rank, row_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM ({pairs})
) WHERE rank <= {k}
"""


KNN_BATCH = _ranked(
    f"SELECT a.vec_id AS query_id, b.vec_id AS row_id, {_DISTANCE} AS distance FROM embeddings a, embeddings b", TOP_K
)

KNN_METADATA = _ranked(
    f"""SELECT a.vec_id AS query_id, b.vec_id AS row_id, {_DISTANCE} AS distance
        FROM embeddings a, embeddings b WHERE b.label IN (2, 3, 5)""",
    TOP_K,
)

KNN_SINGLE = f"""
WITH a AS ({_centres('0')})
SELECT row_number() OVER (ORDER BY {_DISTANCE}, b.vec_id)::INTEGER AS rank, b.vec_id AS row_id, {_DISTANCE} AS distance
FROM a, embeddings b ORDER BY rank LIMIT {TOP_K}
"""

KNN_APPROX = f"""
WITH centres AS ({_centres('label')}),
near AS (
  SELECT a.vec_id, b.cell, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DISTANCE}, b.cell) AS place
  FROM embeddings a, centres b
),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS row_id, {_DISTANCE} AS distance
  FROM embeddings a
  JOIN near q ON q.vec_id = a.vec_id AND q.place <= {PROBES}
  JOIN near home ON home.cell = q.cell AND home.place = 1
  JOIN embeddings b ON b.vec_id = home.vec_id
)
{_ranked('SELECT * FROM pairs', TOP_K)}
"""

_QUESTIONS = "SELECT item_id AS query_id, text FROM benchmark"
_ASKED = f"""
{_QUESTIONS}
UNION ALL SELECT max(item_id) + 1, '  ' FROM benchmark
UNION ALL SELECT max(item_id) + 2, 'qqqqzzzzqqqq' FROM benchmark
"""


def _cosine_of_counts(questions: str, cell: str) -> str:
    """CTEs ending in ``pairs(query_id, row_id, distance)`` for vectors of counts per ``cell``."""
    return f"""
asked AS ({questions}), docs AS (SELECT doc_id AS row_id, text FROM documents),
qt AS (SELECT query_id, {cell} AS c, count(*)::DOUBLE AS n FROM ({_token_rows('asked', 'query_id')}) GROUP BY ALL),
dt AS (SELECT row_id, {cell} AS c, count(*)::DOUBLE AS n FROM ({_token_rows('docs', 'row_id')}) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS len FROM qt GROUP BY ALL),
dn AS (SELECT row_id, sqrt(sum(n * n)) AS len FROM dt GROUP BY ALL),
dots AS (SELECT query_id, row_id, sum(qt.n * dt.n) AS dot FROM qt JOIN dt USING (c) GROUP BY ALL),
pairs AS (
  SELECT query_id, row_id, round(1 - dot / (qn.len * dn.len), 9) AS distance
  FROM dots JOIN qn USING (query_id) JOIN dn USING (row_id)
)"""


LEXICAL = f"WITH {_cosine_of_counts(_QUESTIONS, 't')} {_ranked('SELECT * FROM pairs', TOP_K)}"

INDEX_SEARCH = f"""
WITH {_cosine_of_counts(_QUESTIONS, _bucket())},
hits AS ({_ranked('SELECT * FROM pairs', TOP_K)})
SELECT query_id, rank, row_id, distance, length(text)::INTEGER AS n_chars
FROM hits JOIN documents ON doc_id = row_id
"""

_CONTEXTS = f"""
WITH {_cosine_of_counts(_ASKED, 't')},
hits AS ({_ranked('SELECT * FROM pairs', TOP_K)}),
contexts AS (
  SELECT query_id,
         string_agg('[Result ' || rank || '] (Relevance: ' || printf('%.2f', 1 - distance) || ')' || chr(10) || text,
                    chr(10) || chr(10) ORDER BY rank) AS context,
         count(*)::INTEGER AS n_sources,
         first(text ORDER BY rank) AS top_text,
         first(row_id ORDER BY rank) AS top_row_id
  FROM hits JOIN documents ON doc_id = row_id GROUP BY query_id
)"""

CONTEXT_BUILD = f"{_CONTEXTS} SELECT query_id, context FROM contexts"

PROMPT_BUILD = f"""{_CONTEXTS}
SELECT query_id,
       'Context from the Excel dataset:' || chr(10) || coalesce(context, 'No relevant context found.')
       || chr(10) || chr(10) || 'Question: ' || a.text || chr(10) || chr(10)
       || 'Please answer the question based only on the above context.' AS prompt
FROM asked a LEFT JOIN contexts USING (query_id)
"""

SOURCE_LIST = f"""
WITH {_cosine_of_counts(_ASKED, 't')},
hits AS ({_ranked('SELECT * FROM pairs', TOP_K)})
SELECT query_id, rank, printf('%.2f', (1 - distance) * 100) || '%' AS relevance, row_id, text
FROM hits JOIN documents ON doc_id = row_id
"""

ANSWER_BATCH = f"""{_CONTEXTS}
SELECT query_id, a.text AS question,
       CASE WHEN {_strip('a.text')} = '' THEN 'Please provide a question.'
            WHEN top_text IS NULL THEN
              'I don''t know based on the uploaded data. No relevant information was found in the dataset.'
            ELSE top_text END AS answer,
       coalesce(context, '') AS context, coalesce(n_sources, 0)::INTEGER AS n_sources, top_row_id
FROM asked a LEFT JOIN contexts USING (query_id)
"""

_PROFILE = "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct,
       coalesce(substr(min({c}::VARCHAR), 1, 50), 'N/A') AS sample FROM orders"""
    for c, kind in {
        "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
    }.items()
)

_ORDER_COLUMNS = {
    "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "n",
    "o_orderpriority": "t",
}
_LINE_COLUMNS = {
    "l_orderkey": "n", "l_partkey": "n", "l_suppkey": "n", "l_linenumber": "n", "l_quantity": "n",
    "l_extendedprice": "n", "l_discount": "n", "l_tax": "n", "l_returnflag": "t", "l_linestatus": "t",
    "l_shipdate": "n",
}
_DOCUMENT_COLUMNS = {"text": "t", "lang": "t", "source": "t", "n_chars": "n"}


def _id_of(columns: dict[str, str]) -> str:
    return row_id({c: (c, k) for c, k in columns.items()})


def _metadata(columns: dict[str, str]) -> str:
    members = ", ".join(f"'{name}', {x}" for name, x in columns.items())
    return f"json_merge_patch('{{}}', json_object({members}))::VARCHAR"


ORACLES: dict[str, str] = {
    "sheets_union": SHEETS,
    "sheet_counts": f"SELECT source_sheet, count(*) AS rows FROM ({SHEETS}) GROUP BY source_sheet",
    "ingest": INGESTED,
    "row_id": f"SELECT doc_id, {_id_of(_DOCUMENT_COLUMNS)} AS row_id FROM documents",
    "row_id_typed": f"SELECT o_orderkey, {_id_of(_ORDER_COLUMNS)} AS row_id FROM orders",
    "row_id_lineitem": f"SELECT l_orderkey, l_linenumber, {_id_of(_LINE_COLUMNS)} AS row_id FROM lineitem",
    "row_dedup": f"""SELECT doc_id, text, lang, source, n_chars, row_id FROM (
        SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY doc_id) AS copy FROM ({BY_TEXT})) WHERE copy = 1""",
    "row_text": f"""SELECT cust_key, {_parts([
        ("Cust Key", "cust_key"), ("Co-Author Name", "author"), ("Nation", "nation"),
        ("Acct Bal", "acct_bal"), ("Pub Type", "pub_type")])} AS text FROM ({GAPPY})""",
    "row_metadata": f"""SELECT cust_key, {_metadata({
        "cust_key": "cust_key", "co-author_name": "author", "nation": "nation", "acct_bal": "acct_bal",
        "pub_type": "pub_type"})} AS metadata FROM ({GAPPY})""",
    "documents_view": f"""SELECT row_id, {_parts(_SHEET_LABELS)} AS text,
        {_metadata({c: c for c in [*_SHEET_KINDS, "row_id"]})} AS metadata FROM ({INGESTED})""",
    "store_upsert": f"""
        WITH stored AS (SELECT * EXCLUDE copy FROM (
               SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY doc_id) AS copy
               FROM ({BY_TEXT}) WHERE doc_id IN (SELECT doc_id FROM labels)) WHERE copy = 1),
        batch AS (SELECT * EXCLUDE copy FROM (
               SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY doc_id) AS copy FROM ({BY_TEXT})) WHERE copy = 1)
        SELECT * FROM stored
        UNION ALL BY NAME
        SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.row_id = b.row_id)""",
    "store_append": f"""{CUSTOMERS}
        UNION ALL BY NAME
        SELECT *, {_APPENDED_ID} AS row_id FROM (
          SELECT s_suppkey AS supp_key, s_name AS title, s_nationkey AS nation_key, s_acctbal AS acct_bal,
                 NULL::BIGINT AS cust_key, NULL::VARCHAR AS dept, NULL::VARCHAR AS source_sheet FROM supplier)""",
    "store_delete": f"""WITH rows AS ({CUSTOMERS}) SELECT * FROM rows
        WHERE row_id NOT IN (SELECT row_id FROM rows WHERE dept = 'BUILDING')""",
    "row_lookup": f"""WITH rows AS ({CUSTOMERS}) SELECT * FROM rows
        WHERE row_id = (SELECT min(row_id) FROM rows) OR row_id = (SELECT max(row_id) FROM rows)""",
    "store_stats": "SELECT count(*) AS rows FROM documents",
    "entry_coercion": f"""SELECT order_key, {_YEAR} AS order_year, order_date, nullif(trim(note), '') AS note
        FROM ({ENTRIES}) WHERE {_YEAR_OK}""",
    "entry_rejects": f"SELECT * FROM ({ENTRIES}) WHERE NOT {_YEAR_OK}",
    "search_column": "SELECT * FROM part WHERE contains(lower(p_name), 'red')",
    "search_all": """SELECT * FROM customer WHERE contains(lower(c_name), 'r#00000012')
        OR contains(c_custkey::VARCHAR, 'r#00000012') OR contains(c_nationkey::VARCHAR, 'r#00000012')
        OR contains(c_acctbal::VARCHAR, 'r#00000012') OR contains(lower(c_mktsegment), 'r#00000012')""",
    "search_regex": r"""SELECT doc_id, lang, source FROM documents
        WHERE regexp_matches(text, '(licen[cs]e|@[a-z]+\.com)', 'i')""",
    "column_profile": _PROFILE,
    # Estimates differ from exact counts within the sketches' error.
    "column_profile_stored": f'SELECT "column", type, non_null, sample, true AS within_error FROM ({_PROFILE})',
    "display_strings": """SELECT n_nationkey::VARCHAR AS n_nationkey, coalesce(n_name, '') AS n_name,
        CASE WHEN n_regionkey > 0 THEN n_regionkey::VARCHAR ELSE '' END AS n_regionkey FROM nation""",
    "preview": f"""SELECT {', '.join(f'{c}::VARCHAR AS {c}' for c in _ORDER_COLUMNS)}
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100)""",
    "knn_single": KNN_SINGLE,
    "knn_batch": KNN_BATCH,
    "knn_metadata": KNN_METADATA,
    "knn_approx": KNN_APPROX,
    # Recall depends on the data; the exact hits are counted, five for each question.
    "knn_quantised": """SELECT sum(least(5, n))::BIGINT AS hits, true AS "recall_at_least_0_9"
        FROM embeddings, (SELECT count(*) AS n FROM embeddings)""",
    "lexical_topk": LEXICAL,
    "lexical_stored": LEXICAL,
    "search_stored": """SELECT doc_id, lang, source, n_chars FROM documents
        WHERE contains(lower(text), 'licen') OR contains(lower(source), 'licen')""",
    "embed_blank": f"""SELECT conv_id, turn, 2 AS dim,
        CASE WHEN blank THEN 0 ELSE length(text) END::DOUBLE AS e0,
        CASE WHEN blank THEN 0 ELSE length(text) - length(replace(text, ' ', '')) END::DOUBLE AS e1
        FROM (SELECT *, role = 'system' OR text IS NULL OR {_strip('text')} = '' AS blank FROM conversations)""",
    "embed_once": f"""SELECT doc_id, CASE WHEN blank THEN 0 ELSE length(text) END::DOUBLE AS e0,
        CASE WHEN blank THEN 0 ELSE length(text) - length(replace(text, ' ', '')) END::DOUBLE AS e1, n_texts
        FROM (SELECT *, text IS NULL OR {_strip('text')} = '' AS blank FROM documents),
            (SELECT count(DISTINCT coalesce(text, '')) AS n_texts FROM documents)""",
    "index_incremental": _entries(INDEX_STORE, f"row_id NOT IN (SELECT row_id FROM ({INDEX_IDS}))"),
    "index_incremental_counts": f"""WITH s AS ({INDEX_STORE}), i AS ({INDEX_IDS})
        SELECT count(*) FILTER (row_id NOT IN (SELECT row_id FROM i)) AS added,
               count(*) FILTER (row_id IN (SELECT row_id FROM i)) AS skipped FROM s WHERE {_strip('text')} <> ''""",
    "index_rebuild": _entries("SELECT doc_id::VARCHAR AS row_id, text FROM documents WHERE lang <> 'de'"),
    "index_sync": f"""WITH s AS (SELECT row_id, max(lang <> 'de') AS texted FROM ({INDEX_STORE}) GROUP BY row_id),
        i AS (SELECT DISTINCT row_id FROM ({INDEX_IDS})),
        after AS (SELECT row_id FROM i WHERE row_id IN (SELECT row_id FROM s) UNION SELECT row_id FROM s WHERE texted)
        SELECT (SELECT count(*) FROM after WHERE row_id NOT IN (SELECT row_id FROM i)) AS added,
               (SELECT count(*) FROM i WHERE row_id NOT IN (SELECT row_id FROM after)) AS removed,
               (SELECT count(*) FROM s) AS total_in_store, (SELECT count(*) FROM after) AS total_in_index""",
    "index_delete": f"""SELECT * FROM ({INDEX_IDS}) WHERE row_id IN (SELECT row_id FROM ({INDEX_STORE}))""",
    "index_search": INDEX_SEARCH,
    "context_build": CONTEXT_BUILD,
    "prompt_build": PROMPT_BUILD,
    "answer_batch": ANSWER_BATCH,
    "source_list": SOURCE_LIST,
    "query_history": """SELECT conv_id, turn, question, answer FROM (
        SELECT u.conv_id, u.turn, u.text AS question, substr(a.text, 1, 200) AS answer
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant') ORDER BY conv_id DESC, turn DESC LIMIT 10""",
}
ORACLES["stream_upsert"] = ORACLES["row_dedup"]
_ORDER_ID = row_id({"o_orderkey": ("o_orderkey", "n"), "seen": ("strftime(seen, '%Y-%m-%d %H:%M:%S')", "n")})
_REPLY = """CASE WHEN query_id % 3 = 0 THEN 'Error generating answer: ValueError: refused'
                 ELSE length(text)::VARCHAR END"""
_EVENT_ID = row_id({"user_id": ("user_id", "n"), "event_type": ("event_type", "t")})
ORACLES |= {
    "stream_distinct": f"SELECT DISTINCT user_id, event_type, {_EVENT_ID} AS row_id FROM events",
    "row_id_timestamp": f"""SELECT o_orderkey, {_ORDER_ID} AS row_id
        FROM (SELECT o_orderkey, make_timestamp(o_orderkey * 1000000000) AS seen FROM orders)""",
    # Saved twice, labelled documents removed, customers-by-code added: what is left is a set of rows.
    "store_life": """SELECT doc_id, lang FROM documents WHERE lang <> 'de'
        UNION ALL SELECT doc_id, 'xx' AS lang FROM labels WHERE toxic = 1""",
    "original_sheets": """SELECT 'customer' AS source_sheet, count(*) AS rows FROM customer
        UNION ALL SELECT 'part', count(*) FROM part""",
    "sheet_folder": """SELECT doc_id::VARCHAR AS key, lang AS title, NULL AS author, 'documents' AS source_sheet FROM documents
        UNION ALL SELECT item_id::VARCHAR, NULL, length(text)::VARCHAR, 'benchmark' FROM benchmark""",
    "search_none": "SELECT * FROM nation",
    "find_row": f"""WITH rows AS ({CUSTOMERS}) SELECT * FROM rows WHERE row_id = (SELECT max(row_id) FROM rows)""",
    "index_clear": "SELECT row_id FROM (SELECT '' AS row_id) WHERE false",
    "index_empty": """SELECT item_id AS query_id,
        'I don''t know based on the uploaded data. No relevant information was found in the dataset.' AS answer FROM benchmark""",
    "index_stats": "SELECT 'documents' AS name, count(*) AS document_count FROM documents",
    "index_stored_sync": "SELECT doc_id::VARCHAR AS row_id FROM documents WHERE lang NOT IN ('de', 'es')",
    "history_log": """SELECT item_id::VARCHAR AS question, length(text)::VARCHAR AS answer FROM benchmark
        UNION ALL SELECT item_id::VARCHAR, length(text)::VARCHAR FROM benchmark""",
    "answer_model": f"""SELECT item_id AS query_id, {_REPLY.replace("query_id", "item_id")} AS answer,
        CASE WHEN item_id % 3 = 0 THEN 'ValueError: refused' END AS error FROM benchmark""",
    "answer_unsearched": """SELECT item_id AS query_id,
        CASE WHEN item_id % 3 = 0 THEN 'Error retrieving documents: ValueError: refused' ELSE 'answered' END AS answer,
        CASE WHEN item_id % 3 = 0 THEN 'ValueError: refused' END AS error,
        CASE WHEN item_id % 3 = 0 THEN 0 ELSE 5 END AS n_sources FROM benchmark""",
    "complete_prompts": """SELECT conv_id, turn, 'be brief: ' || upper(role) AS reply FROM conversations""",
}
