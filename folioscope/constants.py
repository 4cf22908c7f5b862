"""Sizes, defaults, wordings and field names that results depend on.

These are data, not logic.  They must keep exactly these values for results to
be comparable with other producers of the same index.
"""

from __future__ import annotations

# --- chunking -------------------------------------------------------------
CHUNK_SIZE = 10000
CHUNK_OVERLAP = 2000
CHUNK_SEPARATORS = ("\n\n", "\n", ".", "!", "?", ",", " ", "")

LINE_CHUNK_SIZE = 1000
LINE_CHUNK_OVERLAP = 200
LINE_SEPARATOR = "\n"

SUMMARY_CHARS = 200
SUMMARY_SUFFIX = "..."

# --- index ----------------------------------------------------------------
VECTOR_SIZE = 384
VECTOR_METRIC = "cosine"
DEFAULT_COLLECTION = "test_collection2"
KEYWORD_FIELDS = (
    "file_hash",
    "file_name",
    "file_title",
    "authors",
    "keywords",
    "creation_date",
    "page_number",
)
PAYLOAD_FIELDS = (
    "file_name",
    "file_hash",
    "file_title",
    "authors",
    "keywords",
    "creation_date",
    "page_number",
    "text",
    "summary",
)
FILE_SUFFIX = ".pdf"

# --- retrieval ------------------------------------------------------------
TOP_K = 5
OVER_RETRIEVE_K = 25
RERANK_TOP_N = 5
MISSING_SOURCE = "Unknown source"
MISSING_PAGE = "n/a"
REFERENCE_MISSING_SOURCE = "Unknown Source"
REFERENCE_MISSING_PAGE = "N/A"

# --- collection report ----------------------------------------------------
SAMPLE_POINTS = 10
SAMPLE_FILES = 5

# --- models ---------------------------------------------------------------
EMBED_TIMEOUT_S = 10
CHAT_TIMEOUT_S = 60
ANSWER_MODEL = "llama-3.3-70b-versatile"
ANSWER_TEMPERATURE = 0.5
SUMMARY_TEMPERATURE = 0.3
SUMMARY_MAX_TOKENS = 256
JUDGE_TEMPERATURE = 0.0
JUDGE_MAX_TOKENS = 2048
SUMMARY_SYSTEM_MESSAGE = "You are a helpful assistant that summarizes academic documents."
SUMMARY_USER_PREFIX = "Summarize the following chunk:\n\n"
EMBEDDING_MODELS = (
    "sentence-transformers/clip-ViT-B-32",
    "laion/CLIP-ViT-B-32-laion2B-s34B-b79K",
    "openai/clip-vit-base-patch32",
    "Salesforce/blip-image-captioning-base",
    "sentence-transformers/all-MiniLM-L6-v2",
)

# --- evaluation -----------------------------------------------------------
CORRECTNESS_WEIGHTS = (0.75, 0.25)

# --- prompts --------------------------------------------------------------
PROMPT_DEFAULT = """
    You are a helpful assistant. Use only the following pieces of context to answer the question.

    Please attempt to answer the question based on the context provided. If the context does not contain enough information to answer the question, you can mention that you don't know the answer based on the context.    
    
    --- 
    Context:
    {context}
    ---
    Chat history:
    {chat_history}
    ---
    Question: {question}
    Answer:
    """

PROMPT_CITED = """
You are a helpful AI assistant answering questions based on context from PDF documents.

If you don't know the answer based on the context, say, you can mention this first and then you can generate a concise answer based on your internal knowledge.
When answering, if the answer is based on the context, cite the sources using the academic style [1], [2], etc. Use the reference list provided below, which includes metadata (e.g., file name and page number).

---

CONTEXT:
{context}

---

CHAT HISTORY:
{chat_history}

---

QUESTION:
{question}

---

ANSWER:
"""

PROMPT_CITED_WITH_REFERENCES = """
You are a helpful AI assistant answering questions based on context from PDF documents.

If you don't know the answer based on the context, say, you can mention this first and then you can generate a concise answer based on your internal knowledge.
When answering, if the answer is based on the context, cite the sources using the academic style [1], [2], etc. Use the reference list provided below, which includes metadata (e.g., file name and page number).

---

CONTEXT:
{context}

---

REFERENCES:
{references}

---

CHAT HISTORY:
{chat_history}

---

QUESTION:
{question}

---

ANSWER:
"""

# --- chat page ------------------------------------------------------------
MESSAGE_SLOT = "{{MSG}}"
USER_HTML = '<div class="chat-message user"><div class="message">{{MSG}}</div></div>'
BOT_HTML = '<div class="chat-message bot"><div class="message">{{MSG}}</div></div>'

#: Messages of a missing connection and of a collection that does not exist.
NO_CONNECTION = "Database connection not configured"
NO_COLLECTION = "Collection '{name}' not found in database"
