"""DuckDB SQL for the registered queries, and the literal rows that some of them read."""

from __future__ import annotations

from groundsearch.functions import text as T
from groundsearch.functions.versions import ARCHIVE_ROOT
from groundsearch.operators.grounding import FALLBACK, REFUSALS, SYSTEM_PROMPT, USER_PROMPT

SUFFIXES = ["i50", "h90", "j00", "f10", "g00", "k01", "900", "e20", "a00", "zzz"]
LISTINGS = [
    ("23.501", '<a href="x/23501-i50.zip">a</a> <A HREF="y/23501-h90.zip">b</a> <a href="z/23501-j0.zip">c</a> <a href="q/23501-i50.zip">d</a>'),
    ("33.501", '<a href="https://h/33501-h10.zip">a</a><a href="https://h/33501-h20.zip">b</a><a href="https://h/23501-k00.zip">c</a>'),
    ("38.300", "<p>nothing</p>"),
]
PRESENT = [("23.501", "i50"), ("33.501", "h10")]
RESPONSES = [
    (1, '{"data":[{"index":2,"embedding":[0.5,1.0]},{"index":0,"embedding":[1.5,-2.0]},{"index":1,"embedding":[0.25,0.0]}]}'),
    (2, '{"data":[{"index":0,"embedding":[3.0]}]}'),
]
ENVIRONMENT = {
    "PORT": " 8080 ", "HOST": " ", "LLM_PROVIDER": "OpenAI", "GEMINI_API_KEY": "k", "LLM_BASE_URL": "http://h/v1//", "LLM_TEMPERATURE": "0", "LLM_MAX_TOKENS": "-5",
    "EMBED_DIMS": "3072", "RETRIEVAL_TOP_K": "x", "RETRIEVAL_THRESHOLD": "", "RETRIEVAL_KEYWORD_WEIGHT": "0.5", "EMBEDDING_PROVIDER": "API",
}
SETTINGS = {
    "port": "8080", "host": "0.0.0.0", "llm_provider": "openai", "llm_api_key": "k", "llm_base_url": "http://h/v1", "llm_temperature": "0.0", "llm_max_tokens": "1024",
    "embedding_dims": "3072", "top_k": "6", "threshold": "0.0", "keyword_weight": "0.5", "embedding_provider": "api", "fusion_candidates": "20",
}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(rows: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def tokens(c: str) -> str:
    stop = "[" + ", ".join(map(q, T.STOP_WORDS)) + "]"
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{T.TOKEN}'), lambda w: length(w) > 1 AND NOT list_contains({stop}, w))"


def trim(c: str) -> str:
    return f"regexp_replace({c}, {q(rf'\A{T.SPACE}+|{T.SPACE}+\z')}, '', 'g')"


def found(c: str, pattern: str) -> str:
    return f"nullif(regexp_extract({c}, {q(pattern)}, 1), '')"


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {q(pattern)})"


def is_heading(c: str) -> str:
    return f"({matches(c, T.ANNEX_HEADING)} OR ({matches(c, T.NUMBERED_HEADING)} AND length({c}) <= {T.MAX_HEADING} AND NOT {matches(c, r'[.;,:]\z')}))"


def section_of(c: str) -> str:
    annex = found(c, rf"(?i)^Annex{T.SPACE}+([A-Z])")
    return f"coalesce('Annex ' || {annex}, {found(c, f'^({T.NUMBER})')})"


def collapse(c: str) -> str:
    return f"regexp_replace({c}, {q(T.SPACE + '+')}, ' ', 'g')"


TF = f"tok AS (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
LEN = f"lens AS (SELECT doc_id, CAST(len({tokens('text')}) AS BIGINT) AS len FROM documents)"


def bm25(where: str = "") -> str:
    """CTEs up to bm(query_id, id, bm25) for questions in q0(query_id, query)."""
    return f"""{TF}, {LEN}, st AS (SELECT count(*) AS n, avg(len) AS a FROM lens), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    qt AS (SELECT query_id, unnest(list_distinct({tokens('query')})) AS term FROM q0),
    bm AS (
      SELECT query_id, tf.doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a)))) AS bm25
      FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN lens USING (doc_id) CROSS JOIN st GROUP BY ALL
    )"""


Q0 = "q0 AS (SELECT item_id AS query_id, text AS query, 6 AS top_k, 0.35 AS threshold, 0.3 AS kw, 20 AS cand FROM benchmark)"
Q0_OWN = "q0 AS (SELECT item_id AS query_id, text AS query, 1 + item_id % 6 AS top_k, (item_id % 5) / 10 AS threshold, (item_id % 4) / 4 AS kw, 5 + item_id % 20 AS cand FROM benchmark)"


def embedded(name: str, source: str, key: str, text: str) -> str:
    """name(key, place, v): hash vectors in long form, without zeros."""
    return f"""{name}_t AS (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}),
    {name}_p AS (SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS place, CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) < 8 THEN 1 ELSE -1 END AS s FROM {name}_t),
    {name}_s AS (SELECT {key}, place, CAST(sum(s) AS DOUBLE) AS v FROM {name}_p GROUP BY ALL),
    {name} AS (SELECT {key}, place, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS FLOAT) AS DOUBLE) AS v FROM {name}_s WHERE v <> 0)"""


CHUNKS = """chunks AS (
      SELECT doc_id AS id, source AS spec, CASE WHEN doc_id % 10 = 0 THEN '' ELSE (doc_id % 9 + 1) || '.' || (doc_id % 4 + 1) END AS section,
             CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Topic ' || (doc_id % 7) END AS heading, text FROM documents
    )"""


def hybrid(q0: str = Q0) -> str:
    """CTEs of a search: dn, sp (lists), hits, mm, sc (scores), top, ver, grd (guarded)."""
    return f"""WITH {q0}, {bm25()}, {CHUNKS}, {embedded('de', 'documents', 'doc_id', 'text')}, {embedded('qe', 'q0', 'query_id', 'query')},
    dnorm AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM de GROUP BY doc_id), qnorm AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qe GROUP BY query_id),
    dots AS (SELECT query_id, doc_id, sum(de.v * qe.v) AS dot FROM de JOIN qe USING (place) GROUP BY ALL),
    sims AS (SELECT query_id, doc_id AS id, coalesce(dot, 0) / (d.n * k.n) AS sim FROM dnorm d CROSS JOIN qnorm k LEFT JOIN dots USING (query_id, doc_id)),
    dn AS (SELECT query_id, id, sim AS dense_sim, dense_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, id) AS dense_rank FROM sims) JOIN q0 USING (query_id) WHERE dense_rank <= cand),
    sp AS (SELECT query_id, id, bm25, sparse_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS sparse_rank FROM bm WHERE bm25 > 0) JOIN q0 USING (query_id) WHERE sparse_rank <= cand),
    hits AS (SELECT query_id, id, dense_sim, dense_rank, bm25, sparse_rank FROM dn FULL JOIN sp USING (query_id, id)),
    mm AS (SELECT *, min(dense_sim) OVER k AS min_dense, max(dense_sim) OVER k AS max_dense, min(bm25) OVER k AS min_sparse, max(bm25) OVER k AS max_sparse FROM hits WINDOW k AS (PARTITION BY query_id)),
    sc AS (
      SELECT mm.*, (1 - kw) * CASE WHEN max_dense > min_dense THEN (coalesce(dense_sim, min_dense) - min_dense) / (max_dense - min_dense) ELSE 1 END
             + kw * CASE WHEN bm25 IS NULL THEN 0 WHEN max_sparse > min_sparse THEN (bm25 - min_sparse) / (max_sparse - min_sparse) ELSE 1 END AS hybrid
      FROM mm JOIN q0 USING (query_id)
    ),
    top AS (SELECT * FROM (SELECT sc.*, row_number() OVER (PARTITION BY query_id ORDER BY round(hybrid, 9) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS hybrid_rank FROM sc) JOIN q0 USING (query_id) WHERE hybrid_rank <= cand),
    ver AS (
      SELECT top.*, CASE WHEN dense_rank IS NULL THEN '' ELSE c.text END AS text, c.spec, c.section, c.heading,
             CASE WHEN dense_rank IS NOT NULL THEN sim END AS score
      FROM top JOIN chunks c USING (id) LEFT JOIN sims USING (query_id, id)
    ),
    pas AS (SELECT *, coalesce(score >= threshold, false) AS passed FROM ver),
    plc AS (SELECT *, sum(CAST(passed AS INT)) OVER (PARTITION BY query_id ORDER BY hybrid_rank ROWS UNBOUNDED PRECEDING) AS place FROM pas),
    grd AS (SELECT *, passed AND place <= top_k AS returned, CASE WHEN passed AND place <= top_k THEN place END AS rank FROM plc),
    cnt AS (SELECT query_id, count(id) AS n_candidates, count_if(coalesce(returned, false)) AS n_results, count(id) - count_if(coalesce(returned, false)) AS discarded FROM q0 LEFT JOIN grd USING (query_id) GROUP BY query_id),
    """


CONTEXT = """ctx AS (
      SELECT query_id, string_agg('[' || rank || '] TS ' || spec || ' §' || section || ' (' || CASE WHEN heading = '' THEN 'N/A' ELSE heading END || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context
      FROM grd WHERE returned GROUP BY query_id
    )"""
EXTRACTED = """ans AS (
      SELECT query_id, CASE WHEN section = '' THEN '' ELSE 'Per §' || section || ', ' END || substr(text, 1, 200) AS made FROM grd WHERE rank = 1
    ), secs AS (SELECT query_id, list(section) AS s, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids, list({'id': id, 'spec': spec, 'section': section} ORDER BY rank) AS cited FROM grd WHERE returned GROUP BY query_id)"""


def confident(c: str) -> str:
    return "NOT (" + " OR ".join(f"contains(lower({c}), {q(r)})" for r in REFUSALS) + ")"


def grounded(c: str, sections: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, '§([0-9.]+)', 1), lambda r: NOT list_contains(list_filter({sections}, lambda s: s <> ''), r))) = 0"


ANSWERED = f"""{EXTRACTED}, fin AS (
      SELECT query_id, coalesce(made, {q(FALLBACK)}) AS answer, coalesce(ids, '') AS citations, cited, discarded,
             coalesce({confident('made')} AND {grounded('made', 's')}, false) AS confident, made
      FROM cnt LEFT JOIN ans USING (query_id) LEFT JOIN secs USING (query_id)
    )"""

SPEC_LINE = """(CASE WHEN (i - 1) % 11 = 10 THEN chr(12) ELSE '' END || CASE
      WHEN (i - 1) % 7 = 0 THEN (doc_id % 9 + 1) || '.' || ((i - 1) // 7 + 1) || 'Section title ' || chr(CAST(65 + (i - 1) % 26 AS INT))
      WHEN (i - 1) % 7 = 3 THEN (doc_id % 9 + 1) || '.' || ((i - 1) // 7 + 1) || '.1 ' || l ELSE l END)"""
SPEC_TEXT = f"list_transform(str_split(text, chr(10)), lambda l, i: {SPEC_LINE})"
SPECS = f"specs AS (SELECT doc_id, source, lang, array_to_string({SPEC_TEXT}, chr(10)) AS text FROM documents)"


def lines(source: str) -> str:
    """ln(doc_id, pos, feeds, line, head, section, heading, paragraph)."""
    return f"""raw AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, chr(160), ' '), '\\r?\\n')) AS r, generate_subscripts(regexp_split_to_array(replace(text, chr(160), ' '), '\\r?\\n'), 1) - 1 AS pos FROM {source}),
    trm AS (SELECT doc_id, pos, length(r) - length(replace(r, chr(12), '')) AS feeds, {trim("replace(r, chr(12), ' ')")} AS line FROM raw),
    hd AS (SELECT *, {is_heading('line')} AS head FROM trm),
    ln AS (
      SELECT *, CASE WHEN head THEN {section_of('line')} END AS section, CASE WHEN head THEN {collapse('line')} END AS heading,
             CASE WHEN NOT head THEN {found('line', T.NUMBERED_PARAGRAPH)} END AS paragraph FROM hd
    )"""


def chunked(source: str, cte: str = "") -> str:
    """CTEs up to ch(doc_id, pos, section, paragraph, heading, page, text)."""
    return f"""WITH RECURSIVE {cte}{lines(source)},
    pg AS (SELECT *, CAST(1 + sum(feeds) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INT) AS page FROM ln),
    act AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM pg WHERE line <> ''),
    ends AS (SELECT doc_id, max(page) AS last_page, count_if(line <> '') AS n FROM pg GROUP BY doc_id),
    st AS (
      SELECT doc_id, CAST(0 AS BIGINT) AS k, '' AS open, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS paragraph, CAST(NULL AS VARCHAR) AS heading,
             CAST(NULL AS VARCHAR) AS e_section, CAST(NULL AS VARCHAR) AS e_paragraph, CAST(NULL AS VARCHAR) AS e_heading, CAST(NULL AS INT) AS e_page, CAST(NULL AS VARCHAR) AS e_text
      FROM ends
      UNION ALL
      SELECT doc_id, k, CASE WHEN head THEN l_heading WHEN full_ OR open = '' THEN line ELSE open || ' ' || line END,
             CASE WHEN head THEN l_section ELSE section END, CASE WHEN head THEN NULL ELSE par END, CASE WHEN head THEN l_heading ELSE heading END,
             CASE WHEN full_ THEN section END, CASE WHEN full_ THEN CASE WHEN head THEN paragraph ELSE par END END, CASE WHEN full_ THEN heading END,
             CASE WHEN full_ THEN page END, CASE WHEN full_ THEN open END
      FROM (
        SELECT st.doc_id, act.k, act.head, act.heading AS l_heading, act.section AS l_section, act.line, act.page, st.open, st.section, st.paragraph, st.heading,
               coalesce(act.paragraph, st.paragraph) AS par, st.open <> '' AND (act.head OR length(st.open) + 1 + length(act.line) > 900) AS full_
        FROM st JOIN act ON act.doc_id = st.doc_id AND act.k = st.k + 1
      )
    ),
    em AS (
      SELECT doc_id, k, e_section AS section, e_paragraph AS paragraph, e_heading AS heading, e_page AS page, e_text AS text FROM st WHERE e_text IS NOT NULL
      UNION ALL
      SELECT st.doc_id, st.k + 1, section, paragraph, heading, last_page, open FROM st JOIN ends ON ends.doc_id = st.doc_id AND ends.n = st.k WHERE open <> ''
    ),
    ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, section, paragraph, heading, page, text FROM em),
    ids AS (
      SELECT ch.*, d.source, ch.pos + coalesce(shift, 0) AS ordinal FROM ch JOIN documents d USING (doc_id)
      JOIN (SELECT doc_id, sum(n) OVER (ORDER BY source, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shift
            FROM (SELECT doc_id, source, count(*) AS n FROM ch JOIN documents d USING (doc_id) GROUP BY ALL)) USING (doc_id)
    )"""


def first(test: str) -> str:
    return f"nullif(coalesce(list_position(list_transform(ls, lambda x, i: {test}), true), 0), 0)"


A_ENDS = "[' No information here.', ' Per §5.2.1, yes.', ' See §9.9.9', ' Per §5.2.1.', '']"
ANSWERS = f"a AS (SELECT conv_id, turn, text || {A_ENDS}[CAST(conv_id % 5 + 1 AS INT)] AS answer FROM conversations WHERE role = 'assistant')"
SECTIONS = "['5.2.1', '5.3.2', '']"
TURNS = """t AS (SELECT conv_id * 1000 + turn AS query_id, text AS answer, [role] AS citations, turn AS discarded,
      regexp_extract_all(text, '[^ \\t\\n\\r]+[ \\t\\n\\r]*|[ \\t\\n\\r]+') AS toks FROM conversations WHERE role = 'assistant'),
    k AS (SELECT query_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS seq FROM t)"""
CATALOG = """c AS (SELECT * FROM (VALUES (0, '23.501', 'System architecture for the 5G System (5GS)'), (1, '23.502', 'Procedures for the 5G System (5GS)'),
      (2, '23.503', 'Policy and charging control framework for the 5G System'), (3, '33.501', 'Security architecture and procedures for 5G System'),
      (4, '38.300', 'NR and NG-RAN Overall Description'), (5, '38.331', 'NR; Radio Resource Control (RRC) protocol specification')) v(pos, number, title))"""
RELEASE = "CASE substr(suffix, 1, 1) WHEN 'f' THEN 15 WHEN 'g' THEN 16 WHEN 'h' THEN 17 WHEN 'i' THEN 18 WHEN 'j' THEN 19 WHEN 'k' THEN 20 END"
DIGIT = "(strpos('0123456789abcdefghijklmnopqrstuvwxyz', substr(lower(suffix), {}, 1)) - 1)"
KEY = f"CAST({DIGIT.format(1)} * 1296 + {DIGIT.format(2)} * 36 + {DIGIT.format(3)} AS INT)"
FILES = f"""l AS (SELECT * FROM ({values(LISTINGS)}) v(number, html)),
    u AS (SELECT number, regexp_extract_all(html, '(?i)href="([^"]+?/' || replace(number, '.', '') || '-([0-9a-z]{{3}})\\.zip)"', 1) AS urls,
                 regexp_extract_all(html, '(?i)href="([^"]+?/' || replace(number, '.', '') || '-([0-9a-z]{{3}})\\.zip)"', 2) AS sufs FROM l),
    f0 AS (SELECT number, generate_subscripts(urls, 1) - 1 AS pos, unnest(urls) AS url, unnest(sufs) AS suffix FROM u),
    f AS (SELECT number, pos, url, replace(number, '.', '') || '-' || suffix || '.zip' AS filename, suffix, {KEY} AS key, {RELEASE} AS release FROM f0)"""
BEST = "SELECT *, row_number() OVER (PARTITION BY number ORDER BY key DESC, pos) AS place FROM f"
EMB = "SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings"
XML = "html || '&#' || (page_id % 5000 + 60) || ';&#x41;&#X1F642;&#38;lt;&quot;&apos;&amp;lt;&none;&'"

QUERIES: dict[str, str] = {
    "tokenize": f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents",
    "term_freq": f"WITH {TF} SELECT * FROM tf",
    "doc_freq": f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term",
    "doc_len": f"WITH {LEN} SELECT * FROM lens",
    "corpus_stats": f"WITH {LEN} SELECT count(*) AS n_docs, round(avg(len), 6) AS avg_len FROM lens",
    "bm25_scores": f"WITH {Q0}, {bm25()} SELECT query_id, id, round(bm25, 6) AS bm25 FROM bm",
    "bm25_topk": f"WITH {Q0}, {bm25()} SELECT query_id, id, round(bm25, 6) AS bm25, r AS sparse_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, id) AS r FROM bm WHERE bm25 > 0) WHERE r <= 20",
    "cosine_pairs": f"WITH v AS ({EMB}) SELECT v.vec_id, round(list_cosine_similarity(v.e, f.e), 6) AS cosine FROM v JOIN (SELECT label, arg_min(e, vec_id) AS e FROM v GROUP BY label) f USING (label)",
    "dense_topk": f"WITH v AS ({EMB}), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.e, b.e) AS s FROM v a, v b WHERE a.vec_id % 50 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS dense_rank FROM s) SELECT query_id, id, round(s, 6) AS dense_sim, dense_rank FROM r WHERE dense_rank <= 20",
    "dims_check": "SELECT CAST(len(embedding) AS INT) AS dims, count(*) AS n_rows FROM embeddings GROUP BY ALL",
    "embed_hash": f"WITH {embedded('de', 'documents', 'doc_id', 'text')} SELECT doc_id, place, round(v, 6) AS v FROM de",
    "embed_reorder": "SELECT * FROM (VALUES (1, 0, '1.5,-2.0'), (1, 1, '0.25,0.0'), (1, 2, '0.5,1.0'), (2, 0, '3.0')) x(batch, place, v)",
    "fusion_outer": f"{hybrid()} x AS (SELECT 1) SELECT query_id, id, round(dense_sim, 6) AS dense_sim, dense_rank, round(bm25, 6) AS bm25, sparse_rank FROM hits",
    "fusion_minmax": f"{hybrid()} x AS (SELECT 1) SELECT DISTINCT query_id, round(min_dense, 6) AS min_dense, round(max_dense, 6) AS max_dense, round(min_sparse, 6) AS min_sparse, round(max_sparse, 6) AS max_sparse FROM mm",
    "fusion_scores": f"{hybrid()} x AS (SELECT 1) SELECT query_id, id, round(hybrid, 6) AS hybrid FROM sc",
    "fusion_topk": f"{hybrid()} x AS (SELECT 1) SELECT query_id, id, round(hybrid, 6) AS hybrid, hybrid_rank FROM top",
    "verify_candidates": f"{hybrid()} x AS (SELECT 1) SELECT query_id, id, CAST(length(text) AS BIGINT) AS n_text, round(score, 6) AS score FROM ver",
    "threshold_guard": f"{hybrid()} x AS (SELECT 1) SELECT query_id, id, passed, returned, rank FROM grd",
    "discarded_counts": f"{hybrid()} x AS (SELECT 1) SELECT query_id, n_candidates, n_results, discarded FROM cnt",
    "hybrid_search": f"{hybrid()} x AS (SELECT 1) SELECT query_id, rank, id, spec, section, heading, round(score, 6) AS score, round(dense_sim, 6) AS dense_sim, round(bm25, 6) AS bm25, round(hybrid, 6) AS hybrid FROM grd WHERE returned",
    "hybrid_params": f"{hybrid(Q0_OWN)} x AS (SELECT 1) SELECT query_id, rank, id, round(score, 6) AS score, round(hybrid, 6) AS hybrid FROM grd WHERE returned",
    "heading_flags": f"WITH {SPECS}, {lines('specs')} SELECT doc_id, pos, line, head AS is_heading, section, heading, paragraph FROM ln",
    "page_numbers": f"WITH {SPECS}, {lines('specs')} SELECT doc_id, pos, CAST(1 + sum(feeds) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS INT) AS page FROM ln",
    "chunk_documents": f"{chunked('documents')} SELECT doc_id, pos, section, paragraph, heading, page, text FROM ch",
    "chunk_specs": f"{chunked('specs', SPECS + ', ')} SELECT doc_id, pos, section, paragraph, heading, page, text FROM ch",
    "chunk_ids": f"{chunked('specs', SPECS + ', ')} SELECT doc_id, pos, CAST(ordinal AS BIGINT) AS ordinal, source || '-' || CAST(ordinal AS BIGINT) AS id FROM ids",
    "ingest_chunks": f"{chunked('specs', SPECS + ', ')} SELECT source || '-' || CAST(ordinal AS BIGINT) AS id, right(lpad(doc_id::VARCHAR, 8, '0'), 3) AS version, coalesce(section, '') AS section, coalesce(paragraph, '') AS paragraph, coalesce(heading, '') AS heading, page, text FROM ids",
    "extract_body": f"""WITH {SPECS}, fr AS (
      SELECT doc_id, 'Cover' || chr(10) || '1Scope' || chr(9) || '7' || chr(10) || '1Scope' || chr(10) || text || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'Annex B (informative): Change history' || chr(10) || 'last row' ELSE '' END AS text FROM specs
    ), sp AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: {trim('x')}) AS ls FROM fr),
    s AS (SELECT *, coalesce({first(matches('x', T.SCOPE_LINE) + ' AND NOT ' + matches('x', '[0-9]$'))}, {first(matches('x', T.NUMBERED_HEADING) + ' AND NOT ' + matches('x', '[0-9]$'))}, 1) AS b FROM sp),
    e AS (SELECT *, coalesce({first('i >= b AND ' + matches('x', T.CHANGE_ANNEX))}, {first('i >= b AND ' + matches('x', T.CHANGE_HEADING))}, len(ls) + 1) AS e FROM s)
    SELECT doc_id, array_to_string(list_filter(ls[b:e - 1], lambda x: x <> ''), chr(10)) AS body FROM e""",
    "xml_decode": f"SELECT page_id, replace(replace(replace(replace(replace({XML}, '&#' || (page_id % 5000 + 60) || ';&#x41;&#X1F642;&#38;lt;&quot;&apos;&amp;lt;', '<<HERE>>'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&'), '<<HERE>>', chr(CAST(page_id % 5000 + 60 AS INT)) || 'A🙂<\"''&lt;') AS text FROM pages",
    "catalog_inline": f"WITH {CATALOG} SELECT 18 AS release, pos, number, title FROM c",
    "spec_urls": f"WITH {CATALOG} SELECT number, split_part(number, '.', 1) || '_series' AS series, '{ARCHIVE_ROOT}/' || split_part(number, '.', 1) || '_series/' || number || '/' AS folder, replace(number, '.', '') AS compact, '{ARCHIVE_ROOT}/' || split_part(number, '.', 1) || '_series/' || number || '/' || replace(number, '.', '') || '-i50.zip' AS file FROM c",
    "version_key": f"SELECT suffix, {KEY} AS key, {RELEASE} AS release FROM (VALUES {', '.join(f'({q(s)})' for s in SUFFIXES)}) v(suffix)",
    "listing_parse": f"WITH {FILES} SELECT * FROM f",
    "pick_best": f"WITH {FILES} SELECT NULL AS asked, number, filename, key FROM ({BEST}) WHERE place = 1 UNION ALL SELECT 17, number, filename, key FROM ({BEST} WHERE release = 17) WHERE place = 1",
    "incremental_anti": f"WITH {FILES} SELECT number, suffix FROM ({BEST}) WHERE place = 1 AND (number, suffix) NOT IN ({values(PRESENT)})",
    "docx_extract": f"SELECT doc_id, array_to_string(list_transform(str_split(text, chr(10)), lambda l: {trim('regexp_replace(l, ' + q('[\t ]+') + ', ' + q(' ') + ', ' + q('g') + ')')}), chr(10)) AS text, NULL AS error FROM documents",
    "store_count": "SELECT count(*) AS n FROM embeddings",
    "store_scan": "SELECT vec_id::VARCHAR AS id, label AS page FROM embeddings",
    "store_roundtrip": "SELECT vec_id::VARCHAR AS id, label AS page, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "validate_queries": f"SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR turn % 5 = 0 OR {trim('coalesce(text, chr(32))')} = '' THEN 400 ELSE 200 END AS status FROM conversations",
    "build_context": f"{hybrid()} {CONTEXT} SELECT query_id, coalesce(context, '') AS context FROM q0 LEFT JOIN ctx USING (query_id)",
    "build_messages": f"{hybrid()} {CONTEXT} SELECT query_id, 0 AS pos, 'system' AS role, {q(SYSTEM_PROMPT)} AS content FROM q0 UNION ALL SELECT query_id, 1, 'user', {q(USER_PROMPT[0])} || coalesce(context, '') || {q(USER_PROMPT[1])} || query FROM q0 LEFT JOIN ctx USING (query_id)",
    "refusal_detect": f"WITH {ANSWERS} SELECT conv_id, turn, {confident('answer')} AS confident FROM a",
    "grounding_check": f"WITH {ANSWERS} SELECT conv_id, turn, {grounded('answer', SECTIONS)} AS grounded FROM a",
    "answer_confidence": f"WITH {ANSWERS} SELECT conv_id, turn, {confident('answer')} AND {grounded('answer', SECTIONS)} AS confident FROM a",
    "fallback_answers": f"{hybrid()} {ANSWERED} SELECT query_id, answer, discarded, confident FROM fin WHERE citations = ''",
    "answer_extractive": f"{hybrid()} {ANSWERED} SELECT query_id, answer FROM fin WHERE citations <> ''",
    "rag_answers": f"{hybrid()} {ANSWERED} SELECT query_id, answer, citations, discarded, confident FROM fin",
    "answer_json": f"{hybrid()} {ANSWERED} SELECT query_id, CAST(to_json({{'answer': answer, 'citations': coalesce(cited, []), 'discarded': discarded, 'confident': confident}}) AS VARCHAR) AS body FROM fin",
    "citation_label": f"{hybrid()} x AS (SELECT 1) SELECT query_id, rank, '[' || rank || '] TS ' || spec || ' §' || section || ' — sim ' || CAST(round(round(score, 9) * 100) AS INT) || '%' AS label FROM grd WHERE returned",
    "token_stream": f"WITH {TURNS} SELECT query_id, seq, token FROM k",
    "token_fold": f"WITH {TURNS} SELECT query_id, string_agg(token, '' ORDER BY seq) AS answer FROM k GROUP BY query_id",
    "sse_encode": f"""WITH {TURNS}, e AS (
      SELECT query_id, 0 AS seq, 'meta' AS type, CAST(to_json({{'type': 'meta', 'citations': citations, 'discarded': discarded}}) AS VARCHAR) AS payload FROM t
      UNION ALL SELECT query_id, seq + 1, 'token', CAST(to_json({{'type': 'token', 'content': token}}) AS VARCHAR) FROM k
      UNION ALL SELECT query_id, len(toks) + 1, 'done', '{{"type":"done"}}' FROM t
    ) SELECT query_id, seq, type, payload, 'data: ' || payload || chr(10) || chr(10) AS frame FROM e""",
    "sse_decode": f"WITH {TURNS} SELECT query_id, seq, token AS content FROM k",
}
QUERIES["zip_member_pick"] = """SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id || CASE WHEN doc_id % 2 = 1 THEN '.PDF' ELSE '.docx' END END AS name,
  CASE WHEN doc_id % 7 <> 0 THEN text END AS text, CASE WHEN doc_id % 7 = 0 THEN 'no document in the archive' END AS error FROM documents"""
QUERIES["stream_retrieval"] = QUERIES["bm25_topk"]
QUERIES["stored_search"] = QUERIES["hybrid_search"]
QUERIES["stream_answers"] = QUERIES["rag_answers"]
QUERIES["events_decode"] = QUERIES["sse_encode"].replace("SELECT query_id, seq, type, payload, 'data: ' || payload || chr(10) || chr(10) AS frame FROM e", "SELECT query_id, seq, type, payload FROM e")
QUERIES["citation_summary"] = f"""{hybrid()} lab AS (
      SELECT query_id, rank, '[' || rank || '] TS ' || spec || ' §' || section || ' — sim ' || CAST(round(round(score, 9) * 100) AS INT) || '%' AS label FROM grd WHERE returned
    ), summed AS (
      SELECT query_id, string_agg(label, chr(10) ORDER BY rank) FILTER (WHERE rank <= 4) || CASE WHEN count(*) > 4 THEN chr(10) || '+' || (count(*) - 4) || ' more' ELSE '' END AS summary FROM lab GROUP BY query_id
    ) SELECT query_id, coalesce(summary, '') AS summary FROM q0 LEFT JOIN summed USING (query_id)"""
QUERIES["health"] = "SELECT 'ok' AS status"
QUERIES["config_values"] = f"SELECT * FROM ({values(list(SETTINGS.items()))}) v(name, value)"
QUERIES["store_exists"] = "SELECT true AS there, false AS none, CAST(0 AS BIGINT) AS n_none"
QUERIES["model_completion"] = f"SELECT item_id AS query_id, 'gpt-4o-mini 0.2 1024 2 ' || (length(text) + {len(USER_PROMPT[0] + USER_PROMPT[1])}) AS answer FROM benchmark"
QUERIES["download_archives"] = f"""WITH {CATALOG}, {FILES}, b AS (SELECT * FROM ({BEST}) WHERE place = 1)
  SELECT number, suffix, CASE WHEN number = '23.501' THEN '23501-' || suffix || '.docx' END AS name,
         CASE WHEN number = '23.501' THEN '{ARCHIVE_ROOT}/23_series/23.501/23501-' || suffix || '.zip' END AS text,
         CASE WHEN number = '23.501' THEN 'saved' ELSE 'failed' END AS status,
         CASE WHEN number = '38.300' THEN 'no archive in the listing' WHEN number = '33.501' THEN 'BadZipFile' WHEN suffix IS NULL THEN 'FileNotFoundError' END AS error
  FROM c LEFT JOIN b USING (number)"""
# A line is shown in two strings, each of which may hold white space at its ends.
QUERIES["pdf_extract"] = r"""SELECT doc_id, array_to_string(list_transform(str_split(text, chr(10)), lambda l:
  trim(regexp_replace(l[:length(l) // 2] || ' ' || l[length(l) // 2 + 1:], '[\t ]+', ' ', 'g'))), chr(12)) AS text, NULL AS error FROM documents"""
