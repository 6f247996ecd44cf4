"""Queries of the keyword and vector lanes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as X
from lectern.operators import keyword as K
from lectern.operators import vector as N
from lectern.operators.incremental import placed
from lectern.plans.corpus import PASSAGES_SQL, QUESTIONS_SQL, SECTIONS_SQL, lexicon, passages, questions, section_vectors, sections, table
from lectern.plans.registering import area
from lectern.session import kept
from lectern.schema import STOPWORDS

QUERIES, ORACLE_SQL, query = area()

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_PUNCT = r"""["''()\[\]{}<>?!.,;:]+"""


def _tok(x: str) -> str:
    return f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{X.ACCENTED}', '{X.PLAIN}'), '[\\p{{L}}\\p{{N}}]+')"


# The driver's texts hold no calls, marks or quotes in the words that queries are made of, so the SQL needs no rewriting of calls.
TERMS_SQL = f"""
questions AS ({QUESTIONS_SQL}),
pieces AS (SELECT query_id, unnest(string_split(query, ' ')) AS term, unnest(range(len(string_split(query, ' ')))) AS i FROM questions),
worded AS (SELECT *, regexp_replace(term, '^{_PUNCT}|{_PUNCT}$', '', 'g') AS word FROM pieces WHERE regexp_matches(term, '[\\p{{L}}\\p{{N}}]')),
judged AS (SELECT *, regexp_full_match(word, '\\p{{L}}+') AND NOT (length(word) > 1 AND upper(word) = word AND lower(word) <> word) AND lower(word) IN ({_STOP}) AS stop FROM worded),
chosen AS (SELECT * FROM judged j WHERE NOT stop OR NOT EXISTS (SELECT 1 FROM judged k WHERE k.query_id = j.query_id AND NOT k.stop)),
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, lower(term) ORDER BY i) AS again FROM chosen),
terms AS (SELECT query_id, term, (row_number() OVER (PARTITION BY query_id ORDER BY i) - 1)::INT AS term_id,
                 regexp_matches(trim(term, '"''`'), '[_./\\\\:@#$=\\p{{N}}].') OR starts_with(trim(term, '"''`'), '-') OR (length(term) > 1 AND upper(term) = term AND lower(term) <> term) OR regexp_matches(term, '\\p{{Ll}}\\p{{Lu}}') AS identifier
          FROM firsts WHERE again = 1)"""

FOUND_SQL = f"""
sections AS ({SECTIONS_SQL}),
phrases AS (SELECT query_id, term_id, identifier, {_tok("term")} AS toks FROM terms),
wanted AS (SELECT query_id, term_id, identifier, len(toks) AS k, unnest(toks) AS token, unnest(range(len(toks))) AS ord FROM phrases),
fields AS (SELECT section_id, 5.0::DOUBLE AS weight, {_tok("heading_title")} AS toks FROM sections UNION ALL SELECT section_id, 3.0, {_tok("heading_path")} FROM sections UNION ALL SELECT section_id, 1.0, {_tok("content")} FROM sections),
spread AS (SELECT section_id, weight, unnest(toks) AS token, unnest(range(len(toks))) AS position FROM fields),
runs AS (SELECT query_id, term_id, section_id, weight, position - ord AS start, count(*) AS n, any_value(k) AS k FROM spread JOIN wanted USING (token) GROUP BY ALL),
found AS (SELECT query_id, term_id, section_id, sum(weight) AS weight FROM (SELECT * FROM runs WHERE n = k) GROUP BY ALL),
sized AS (SELECT section_id, sum(len(toks))::BIGINT AS length FROM fields GROUP BY section_id)"""

# The runs above are grouped without their count and size; GROUP BY ALL takes the other columns.
BM25_SQL = """
whole AS (SELECT count(*) AS total, avg(length) AS average FROM sized),
df AS (SELECT query_id, term_id, count(*) AS df FROM found GROUP BY ALL),
idf AS (SELECT query_id, term_id, average, CASE WHEN ln((total - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((total - df + 0.5) / (df + 0.5)) END AS idf FROM df, whole),
scored AS (SELECT query_id, section_id, round(sum(idf * weight * 2.2 / (weight + 1.2 * (0.25 + 0.75 * length / average))), 6) AS score FROM found JOIN idf USING (query_id, term_id) JOIN sized USING (section_id) GROUP BY ALL)"""

GATE_SQL = """
total AS (SELECT count(*) AS total FROM sections),
freq AS (SELECT t.query_id, t.term_id, t.identifier, total, coalesce(d.df, 0) AS df FROM terms t LEFT JOIN (SELECT query_id, term_id, count(*) AS df FROM found GROUP BY ALL) d ON t.query_id = d.query_id AND t.term_id = d.term_id, total),
mass AS (SELECT query_id, term_id, ln(1 + (total - df + 0.5) / (df + 0.5)) AS mass, identifier AND df > 0 AND df <= greatest(3, floor(total * 0.05)) AS rare FROM freq),
asked AS (SELECT query_id, sum(mass) AS whole, count(*) AS n_terms FROM mass GROUP BY ALL),
gated AS (SELECT f.query_id, f.section_id, round(sum(mass) / any_value(CASE WHEN whole = 0 THEN 1 ELSE whole END), 6) AS share, any_value(n_terms) < 2 OR round(sum(mass) / any_value(CASE WHEN whole = 0 THEN 1 ELSE whole END), 6) >= 0.5 OR bool_or(rare) AS passed
          FROM found f JOIN mass m ON f.query_id = m.query_id AND f.term_id = m.term_id JOIN asked a ON a.query_id = f.query_id GROUP BY ALL)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.term_table(questions(spark, sf_dir))


@query(f"WITH {TERMS_SQL} SELECT query_id, term_id, term, identifier FROM terms")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", "term_id", "term", "identifier")


@query(f"WITH {TERMS_SQL}, {FOUND_SQL}, {BM25_SQL}, ranked AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC)::INT AS rank FROM scored) SELECT query_id, section_id, score, rank FROM ranked WHERE rank <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_ties(K.bm25(lexicon(spark, sf_dir), _asked(spark, sf_dir)), 20).select("query_id", "section_id", "score", "rank")


@query(f"WITH {TERMS_SQL}, {FOUND_SQL} SELECT query_id, term_id, section_id, weight FROM found")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.occurrences(lexicon(spark, sf_dir), _asked(spark, sf_dir))


@query(f"WITH {TERMS_SQL}, {FOUND_SQL}, {GATE_SQL} SELECT query_id, section_id, share, passed FROM gated")
def idf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _asked(spark, sf_dir)
    return K.gate(sections(spark, sf_dir), terms, K.occurrences(lexicon(spark, sf_dir), terms))


@query(f"""WITH {TERMS_SQL}, {FOUND_SQL}, {GATE_SQL}
SELECT q.query_id, CASE WHEN any_value(a.n_terms) IS NULL THEN 'no_terms' WHEN count(g.section_id) = 0 THEN 'no_match' WHEN count(*) FILTER (WHERE g.passed) = 0 THEN 'filtered' ELSE 'matched' END AS keyword_match
FROM questions q LEFT JOIN asked a ON a.query_id = q.query_id LEFT JOIN gated g ON g.query_id = q.query_id GROUP BY q.query_id""")
def keyword_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _asked(spark, sf_dir)
    return K.keyword_states(questions(spark, sf_dir), terms, K.gate(sections(spark, sf_dir), terms, K.occurrences(lexicon(spark, sf_dir), terms)))


WALK_SQL = "list_reduce(list_prepend('', list_transform(string_split(file_path, '/')[1:-2], lambda p: '1' || (CASE WHEN starts_with(p, '.') THEN '1' ELSE '0' END) || p || chr(1))), lambda a, b: a || b) || '00' || string_split(file_path, '/')[-1]"


@query(f"WITH sections AS ({SECTIONS_SQL}) SELECT section_id, {WALK_SQL} AS walk, row_number() OVER (ORDER BY {WALK_SQL})::INT AS position FROM sections")
def walk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = sections(spark, sf_dir).select("section_id", X.walk_key(F.col("file_path")).alias("walk"))
    return placed(keyed, [F.col("walk")], "place").select("section_id", "walk", (F.col("place") + 1).cast("int").alias("position"))


@query(f"""WITH {TERMS_SQL}, {FOUND_SQL}, {BM25_SQL}, placed AS (SELECT s.*, {WALK_SQL} AS walk FROM scored s JOIN sections USING (section_id))
SELECT query_id, section_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, walk, section_id)::INT AS position FROM placed QUALIFY position <= 20""")
def keyword_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sections(spark, sf_dir)
    return K.in_order(K.bm25(lexicon(spark, sf_dir), _asked(spark, sf_dir)), own).filter("position <= 20").select("query_id", "section_id", "score", "position")


@query(f"WITH {TERMS_SQL}, {FOUND_SQL}, {BM25_SQL} SELECT query_id, section_id, score FROM scored JOIN sections USING (section_id) WHERE starts_with(file_path, 'de/')")
def scoped_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.bm25(lexicon(spark, sf_dir), _asked(spark, sf_dir), sections(spark, sf_dir).filter(F.col("file_path").startswith("de/")))


# Parts as documents of three fields.
_PARTS = "SELECT p_partkey AS section_id, p_name AS heading_title, p_type AS heading_path, p_brand AS content FROM part"


@query(f"WITH q AS (SELECT p_partkey AS query_id, p_name || ' ' || p_brand AS query FROM part), terms AS (SELECT query_id, unnest(string_split(query, ' ')) AS term, (unnest(range(len(string_split(query, ' ')))))::INT AS term_id, true AS identifier FROM q), {FOUND_SQL.replace(SECTIONS_SQL, _PARTS)}, {BM25_SQL} SELECT query_id, section_id, score FROM scored QUALIFY rank() OVER (PARTITION BY query_id ORDER BY score DESC) <= 5")
def bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    own = part.select(F.col("p_partkey").alias("section_id"), F.col("p_name").alias("heading_title"), F.col("p_type").alias("heading_path"), F.col("p_brand").alias("content"))
    asked = part.select(F.col("p_partkey").alias("query_id"), F.posexplode(F.split(F.concat_ws(" ", "p_name", "p_brand"), " ")).alias("term_id", "term"))
    asked = asked.select("query_id", "term_id", "term", X.tokens(F.col("term")).alias("tokens"), F.lit(True).alias("identifier"))
    return K.best_alike(own, asked, 5)


@query(r"""WITH hits AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_matches(url, '(^|[^A-Za-z0-9_\-])example\.com([^A-Za-z0-9_\-.]|\.($|[^A-Za-z0-9_])|$)', 'i') AS loose, regexp_matches(url, '(^|[^A-Za-z0-9_\-])example\.com([^A-Za-z0-9_\-.]|\.($|[^A-Za-z0-9_])|$)') AS exact FROM pages)
SELECT page_id, loose, exact FROM hits WHERE loose""")
def literal_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = X.literal_pattern("example.com")
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.regexp_like("url", F.lit("(?i)" + pattern)).alias("loose"), F.regexp_like("url", F.lit(pattern)).alias("exact")).filter("loose")


@query(r"""SELECT doc_id, w AS term, starts_with(w, '-') OR regexp_matches(w, '(?s)[_./\\:@#$=\p{N}].') OR (length(w) > 1 AND upper(w) = w AND lower(w) <> w) OR regexp_matches(w, '\p{Ll}\p{Lu}') AS identifier
FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[^\s"''`]+')) AS w FROM documents) WHERE NOT regexp_matches(w, '\(\)')""")
def identifier_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\t-\r\f \"'`]+"), F.lit(0))).alias("term")).distinct()
    return words.filter(~F.col("term").contains("()")).select("doc_id", "term", X.is_identifier(F.col("term")).alias("identifier"))


@query("SELECT lang, count(*)::BIGINT AS total, greatest(3, floor(count(*) * 0.05))::BIGINT AS rare FROM documents GROUP BY lang")
def rarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total")).select("lang", "total", K.rare(F.col("total")).alias("rare"))


_KNN = "SELECT q.vec_id AS query_id, v.vec_id AS owner_id, v.label, round(list_cosine_distance(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0"


@query(f"WITH d AS ({_KNN}) SELECT query_id, owner_id, distance, rank() OVER (PARTITION BY query_id ORDER BY distance)::INT AS rank FROM d QUALIFY rank <= 20")
def knn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    return N.nearest(own.withColumnRenamed("vec_id", "owner_id"), own.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 20)


_MAXSIM = f"""d AS ({_KNN}), hits AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY distance) AS r FROM d QUALIFY r <= 200),
pooled AS (SELECT label, list(m ORDER BY place) AS v FROM (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS place FROM embeddings) GROUP BY ALL) GROUP BY label),
centre AS (SELECT q.vec_id AS query_id, p.label AS section_id, round(list_cosine_distance(p.v, q.embedding::DOUBLE[]), 6) AS distance FROM pooled p, embeddings q WHERE q.vec_id % 50 = 0),
near AS (SELECT * FROM centre QUALIFY rank() OVER (PARTITION BY query_id ORDER BY distance) <= 20),
best AS (SELECT query_id, label AS section_id, min(distance) AS distance, arg_min(owner_id, (distance, owner_id)) AS ordinal FROM hits GROUP BY ALL),
joined AS (SELECT coalesce(n.query_id, b.query_id) AS query_id, coalesce(n.section_id, b.section_id) AS section_id, least(n.distance, b.distance) AS distance, b.ordinal FROM near n FULL JOIN best b ON n.query_id = b.query_id AND n.section_id = b.section_id)"""


@query("SELECT label AS owner_id, place::INT AS at, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 6) AS x FROM (SELECT label, place, avg(x) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(64)) AS place FROM embeddings) GROUP BY ALL)")
def pool_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.col("label").alias("owner_id"), F.col("vec_id").alias("ordinal"), "embedding")
    return N.pooled(own).select("owner_id", F.posexplode("embedding").alias("at", "x")).select("owner_id", "at", F.round("x", 6).alias("x"))


def _max_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings")
    asked = own.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    centres = N.pooled(own.select(F.col("label").alias("owner_id"), F.col("vec_id").alias("ordinal"), "embedding"))
    near = N.nearest(centres, asked, 20).withColumnRenamed("owner_id", "section_id")
    hits = N.nearest(own.withColumnRenamed("vec_id", "owner_id"), asked, 200).join(own.select(F.col("vec_id").alias("owner_id"), "label"), "owner_id")
    return N.max_similarity(near, hits.select("query_id", F.col("label").alias("section_id"), F.col("owner_id").alias("ordinal"), "distance"))


@query(f"WITH {_MAXSIM} SELECT query_id, section_id, distance, ordinal FROM joined")
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _max_similarity(spark, sf_dir)


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), c AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM w GROUP BY ALL),
s AS (SELECT doc_id, place, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM c)
SELECT doc_id, place::INT AS at, round(x, 6) AS x FROM s UNION ALL SELECT doc_id, 0, 1.0 FROM documents WHERE len({_WORDS}) = 0""")
def hashed_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = N.hashed_embeddings(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner_id"), "text"))
    return own.select(F.col("owner_id").alias("doc_id"), F.posexplode("embedding").alias("at", "x")).filter("x <> 0").select("doc_id", "at", F.round("x", 6).alias("x"))


_HYBRID = f"""{TERMS_SQL}, {FOUND_SQL}, {BM25_SQL}, {GATE_SQL},
kept AS (SELECT s.query_id, s.section_id, s.score, {WALK_SQL} AS walk FROM scored s JOIN gated g ON g.query_id = s.query_id AND g.section_id = s.section_id AND g.passed JOIN sections x ON x.section_id = s.section_id),
lane1 AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, walk, section_id) AS position FROM kept QUALIFY position <= 20),
qw AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM questions), qv AS (SELECT query_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM qw GROUP BY ALL),
sw AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents), sv AS (SELECT doc_id, ('0x' || substr(sha256(w), 1, 8))::BIGINT % 64 AS place, count(*)::DOUBLE AS n FROM sw GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(n * n)) AS norm FROM qv GROUP BY ALL), sn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM sv GROUP BY ALL),
dots AS (SELECT query_id, doc_id AS section_id, sum(a.n * b.n) AS dot FROM qv a JOIN sv b USING (place) GROUP BY ALL),
dist AS (SELECT d.query_id, d.section_id, round(1 - dot / (qn.norm * sn.norm), 6) AS distance FROM dots d JOIN qn ON qn.query_id = d.query_id JOIN sn ON sn.doc_id = d.section_id),
lane2 AS (SELECT query_id, section_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, {WALK_SQL}, section_id) AS position FROM dist JOIN sections USING (section_id) QUALIFY position <= 20),
fused AS (SELECT query_id, section_id, round(sum(1.0::DOUBLE / (60 + position)), 9) AS score FROM (SELECT * FROM lane1 UNION ALL SELECT * FROM lane2) GROUP BY ALL)"""


@query(f"WITH {_HYBRID} SELECT query_id, section_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id)::INT AS position FROM fused QUALIFY position <= 5")
def hybrid_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes for a batch of queries, fused: the engine's flagship."""
    return pages(spark, sf_dir, questions(spark, sf_dir))


def pages(spark: SparkSession, sf_dir: str, asked: DataFrame) -> DataFrame:
    """The first five sections of each query (query_id, query), by the index of a folder's sections."""
    own, words = sections(spark, sf_dir), lexicon(spark, sf_dir)
    terms = K.term_table(asked)
    found = kept(K.occurrences(words, terms))
    passed = K.gate(own, terms, found).filter("passed").select("query_id", "section_id")
    lexical = K.in_order(K.bm25(words, terms, found=found).join(passed, ["query_id", "section_id"], "left_semi"), own).filter("position <= 20")
    vectors = section_vectors(spark, sf_dir)
    wanted = N.hashed_embeddings(asked.select(F.col("query_id").alias("owner_id"), F.col("query").alias("text"))).withColumnRenamed("owner_id", "query_id")
    near = N.nearest(vectors, wanted, 20).withColumnRenamed("owner_id", "section_id")
    semantic = K.in_order(near.select("query_id", "section_id", "distance"), own, "distance", descending=False).filter("position <= 20")
    lanes = lexical.select("query_id", F.col("section_id").alias("item"), "position").unionByName(semantic.select("query_id", F.col("section_id").alias("item"), "position"))
    return N.page(N.fuse(lanes), own.select("section_id"), 5).select("query_id", F.col("item").alias("section_id"), "score", "position")


@query("WITH lanes AS (SELECT c_nationkey AS query_id, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer UNION ALL SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) FROM customer) SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + position)), 9) AS score FROM lanes WHERE position <= 20 GROUP BY ALL")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("item"), "c_acctbal", "c_name")
    lanes = [own.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter("position <= 20").select("query_id", "item", "position") for order in ((F.col("c_acctbal").desc(), "item"), ("c_name", "item"))]
    return N.fuse(lanes[0].unionByName(lanes[1]))


@query("WITH r AS (SELECT p_size AS query_id, p_partkey, round(p_retailprice, 0) AS score FROM part) SELECT query_id, p_partkey, score, rank() OVER (PARTITION BY query_id ORDER BY score DESC)::INT AS rank FROM r QUALIFY rank <= 3")
def fts_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.with_ties(table(spark, sf_dir, "part").select(F.col("p_size").alias("query_id"), "p_partkey", F.round("p_retailprice", 0).alias("score")), 3)


@query(f"SELECT section_id, ordinal, length(content)::BIGINT AS chars, (CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, ceil(length(content) / 4.0)) END)::BIGINT AS token_estimate FROM ({PASSAGES_SQL})")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("section_id", "ordinal", F.length("content").cast("long").alias("chars"), X.token_estimate(F.col("content")).alias("token_estimate"))


@query(f"SELECT section_id, ordinal, trim(regexp_replace(replace(content, '|', ' '), '\\s+', ' ', 'g')) AS content FROM ({PASSAGES_SQL})")
def text_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("section_id", "ordinal", X.normalised(F.col("content")).alias("content"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '<[^>]+>', '', 'g') AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.without_html(F.col("html")).alias("text"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), c AS (SELECT doc_id, t, regexp_extract(substr(t, 1, 101), '^(.*)\s\S*$', 1) AS cut FROM f)
SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE (CASE WHEN length(cut) > 0 THEN rtrim(cut) ELSE substr(t, 1, 100) END) || '…' END AS preview FROM c""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(f"WITH s AS ({SECTIONS_SQL}) SELECT section_id, file_path, starts_with(file_path, 'en/src1/') AS below, ends_with(file_path, '/doc-7.md') AS same_name, substr(file_path, 4) AS relative FROM s WHERE starts_with(file_path, 'en/')")
def scope_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sections(spark, sf_dir).filter(F.col("file_path").startswith("en/"))
    return own.select("section_id", "file_path", F.col("file_path").startswith("en/src1/").alias("below"), F.col("file_path").endswith("/doc-7.md").alias("same_name"), F.substr("file_path", F.lit(4)).alias("relative"))


@query(f"WITH s AS ({SECTIONS_SQL}), w AS (SELECT 'doc-' || (item_id * 3) || '.md' AS name FROM benchmark), m AS (SELECT name, count(section_id)::BIGINT AS matches, min(file_path) AS file_path FROM w LEFT JOIN s ON ends_with(file_path, '/' || name) GROUP BY name) SELECT name, matches, CASE WHEN matches = 1 THEN file_path END AS file_path FROM m")
def suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relative name stands for the one path that ends with it. Joined on the last component, not on suffixes."""
    own = sections(spark, sf_dir).select("file_path", F.substring_index("file_path", "/", -1).alias("last"))
    names = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc-"), (F.col("item_id") * 3).cast("string"), F.lit(".md")).alias("name"))
    met = names.withColumn("last", F.substring_index("name", "/", -1)).join(own, "last", "left").filter(F.col("file_path").isNull() | F.col("file_path").endswith(F.concat(F.lit("/"), F.col("name"))))
    counted = met.groupBy("name").agg(F.count("file_path").alias("matches"), F.min("file_path").alias("file_path"))
    return counted.select("name", "matches", F.when(F.col("matches") == 1, F.col("file_path")).alias("file_path"))


@query(f"WITH s AS ({SECTIONS_SQL}) SELECT section_id, file_path, regexp_full_match(file_path, '(de/src[0-4](/.*)?)') OR len(list_filter(string_split(file_path, '/'), lambda p: p = 'src7' OR regexp_full_match(p, 'doc-1.\\.md'))) > 0 AS excluded, len(list_filter(string_split(file_path, '/')[1:-2], lambda p: p IN ('venv', 'node_modules'))) > 0 AS pruned FROM s")
def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("file_path")
    return sections(spark, sf_dir).select("section_id", "file_path", X.is_excluded(path, ["de/src[0-4]", "src7", "doc-1?.md"]).alias("excluded"), X.is_pruned(path).alias("pruned"))
