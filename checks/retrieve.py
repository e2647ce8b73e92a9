"""Chunks, retrieval and chat prompts."""

from __future__ import annotations

from checks.explore import SUMMARY_LINES_SQL
from checks.registry import query
from meterlight.functions.text import STOPWORDS
from meterlight.operators import retrieval

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


@query("chunk_text", "SELECT doc_id, source, chunk_ord, content FROM chunks")
def chunk_text(ws):
    return retrieval.chunk_text(ws.documents)


# Paragraphs one by one; a chunk is given out when the next paragraph would overfill it.
LINES_SQL = f"""WITH RECURSIVE
paragraphs AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS p, length(text) > 800 AS long, text FROM documents),
walk AS (
  SELECT doc_id, p, 0 AS i, CAST('' AS VARCHAR) AS open, CAST(NULL AS VARCHAR) AS given, 0 AS ord FROM paragraphs WHERE long
  UNION ALL
  SELECT doc_id, p, i + 1,
    CASE WHEN i >= len(p) THEN '' WHEN length(open) + length(p[i + 1]) > 800 AND open <> ''
      THEN right(open, 100) || chr(10) || p[i + 1] ELSE open || chr(10) || p[i + 1] END,
    CASE WHEN i >= len(p) THEN CASE WHEN {stripped('open')} <> '' THEN {stripped('open')} END
      WHEN length(open) + length(p[i + 1]) > 800 AND open <> '' THEN {stripped('open')} END,
    i + 1
  FROM walk WHERE i <= len(p))
SELECT w.doc_id, d.source, CAST(row_number() OVER (PARTITION BY w.doc_id ORDER BY w.ord) - 1 AS INTEGER) AS chunk_ord, w.given AS content
FROM walk w JOIN documents d ON d.doc_id = w.doc_id WHERE w.given IS NOT NULL
UNION ALL SELECT doc_id, source, CAST(0 AS INTEGER), {stripped('text')} FROM paragraphs WHERE NOT long"""


@query("chunk_text_lines", LINES_SQL)
def chunk_text_lines(ws):
    """Lines as paragraphs: these documents have no blank lines, so this packs many chunks."""
    return retrieval.chunk_text(ws.documents, paragraph_mark="\n")


@query(
    "knowledge_base",
    f"""SELECT doc_id, source, chunk_ord, content FROM chunks
UNION ALL SELECT 9223372036854775807, 'Live Data Summary', CAST(0 AS INTEGER), string_agg(line, chr(10) ORDER BY line_no)
FROM ({SUMMARY_LINES_SQL})""",
)
def knowledge_base(ws):
    return retrieval.knowledge_base(ws.chunks, retrieval.live_summary(ws.features))


ONE_QUESTION = "What is the ther ing of ment tion and der verb?"
ONE_WORDS = [w for w in ONE_QUESTION.lower().split() if w not in STOPWORDS]
ONE_SCORE = (
    " + ".join(
        f"(length(b) - length(replace(b, '{w}', ''))) // {len(w)} + CASE WHEN contains(b, '{w}') THEN 2 ELSE 0 END"
        for w in ONE_WORDS
    )
    + f" + CASE WHEN contains(b, '{ONE_QUESTION.lower()}') THEN 10 ELSE 0 END"
)
ONE_SQL = f"""SELECT doc_id, source, chunk_ord, content, CAST({ONE_SCORE} AS BIGINT) AS score
FROM (SELECT *, lower(content) AS b FROM chunks)"""


@query("keyword_score", ONE_SQL)
def keyword_score(ws):
    return retrieval.keyword_score(ws.chunks, ONE_QUESTION)


@query(
    "retrieve_one_question",
    f"SELECT * FROM ({ONE_SQL}) WHERE score > 0 ORDER BY score DESC, doc_id, chunk_ord LIMIT 4",
)
def retrieve_one_question(ws):
    return retrieval.retrieve_top_k(ws.chunks, ONE_QUESTION)


@query("keyword_score_table", "SELECT question_id, doc_id, chunk_ord, score FROM scores")
def keyword_score_table(ws):
    return retrieval.keyword_scores(ws.chunks, ws.questions)


@query(
    "retrieve_top_k",
    "SELECT question_id, rank, doc_id, chunk_ord, source, content, score FROM retrieved",
)
def retrieve_top_k(ws):
    return retrieval.retrieve(ws.chunks, ws.questions)


@query("build_context", "SELECT question_id, context FROM contexts")
def build_context(ws):
    return retrieval.build_context(ws.retrieved)


@query(
    "chat_window",
    """SELECT conv_id, turn, role, text AS content FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations) WHERE age <= 6""",
)
def chat_window(ws):
    return retrieval.chat_window(ws.messages)


@query(
    "chat_messages",
    f"""WITH h AS (SELECT conv_id AS question_id, turn, role, text AS content FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations)
    WHERE age <= 6 AND conv_id IN (SELECT item_id FROM benchmark)),
  a AS (SELECT question_id, -1 AS turn, 'system' AS role, '{retrieval.DEFAULT_SYSTEM_PROMPT}' AS content FROM asked
    UNION ALL SELECT * FROM h
    UNION ALL SELECT question_id, 9223372036854775807, 'user', 'Context from knowledge base:' || chr(10) || chr(10) || context ||
      chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'User question: ' || question
    FROM asked JOIN contexts USING (question_id))
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY turn) - 1 AS INTEGER) AS position, role, content FROM a""",
)
def chat_messages(ws):
    contexts = retrieval.build_context(ws.retrieved)
    return retrieval.chat_messages(ws.messages, ws.questions, contexts)


