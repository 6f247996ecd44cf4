"""Tables of a documentation index, and the constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 7

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("file_path", T.StringType()), T.StructField("title", T.StringType()), T.StructField("content_hash", T.StringType()), T.StructField("last_modified", T.LongType()), T.StructField("mtime_ns", T.LongType()), T.StructField("vector_format", T.IntegerType()), T.StructField("weights_revision", T.StringType())])
SECTION = T.StructType([T.StructField("section_id", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("heading_title", T.StringType()), T.StructField("heading_level", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("base_path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("start_line", T.IntegerType()), T.StructField("end_line", T.IntegerType()), T.StructField("part_index", T.IntegerType())])
PASSAGE = T.StructType([T.StructField("section_id", T.LongType()), T.StructField("ordinal", T.IntegerType()), T.StructField("content", T.StringType()), T.StructField("line0", T.IntegerType()), T.StructField("line1", T.IntegerType()), T.StructField("table_line", T.IntegerType()), T.StructField("list0", T.IntegerType()), T.StructField("list1", T.IntegerType())])
VECTOR = T.StructType([T.StructField("owner_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType(), False))])
POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("section_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("position", T.IntegerType())])
FAILURE = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("message", T.StringType())])
COVERAGE = T.StructType([T.StructField("root", T.StringType()), T.StructField("verified", T.BooleanType()), T.StructField("gitignore", T.StringType())])

# Fixed values of ranking.
RRF_K = 60
CANDIDATES = 20
LIMIT_MOST = 50
MAX_QUERY_TERMS = 32
GATE_SHARE = 0.5
RARE_SECTIONS, RARE_SHARE = 3, 0.05
LITERAL_CANDIDATES = 200
PASSAGES_PER_CANDIDATE = 10
FIELD_WEIGHTS = {"heading_title": 5.0, "heading_path": 3.0, "content": 1.0}
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6

# Fixed values of parsing.
MAX_SECTION_CHARS, MAX_UNIT_CHARS = 3200, 600
PREVIEW_CHARS = 100
PATH_SEPARATOR = " > "
PREAMBLE_TITLE = "[Overview / Preamble]"
UNTITLED = "(untitled)"
MAX_FILE_BYTES = 10 * 1024 * 1024
DEGENERATE_NORM = 1e-6
# Directories that are never searched for documents.
PRUNED = (".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", ".mypy_cache", ".ruff_cache", ".pytest_cache", ".tox", "site-packages")
SUFFIXES = (".md", ".markdown")

# Function words without topical signal.
STOPWORDS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "both", "but",
    "by", "can", "could", "did", "do", "does", "doing", "each", "for", "from", "had", "has", "have", "having", "he", "her", "here", "him", "his",
    "how", "i", "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no", "nor", "not", "of", "on", "once", "only", "or", "other",
    "our", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these",
    "they", "this", "those", "through", "to", "too", "under", "until", "up", "us", "very", "was", "we", "were", "what", "when", "where", "which",
    "while", "who", "whom", "why", "will", "with", "would", "you", "your",
)
