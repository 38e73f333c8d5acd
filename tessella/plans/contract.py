"""Queries of the driver contract that belong to the engine itself, each with its SQL where SQL can say it.

Inputs that the tables do not have (paths, identifiers, two states of a tree, block kinds) are made from their columns by
expressions that both dialects share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import vocab
from tessella.functions import predicates as P
from tessella.functions import text as X
from tessella.operators import ann, chunks, diff, extract, lexical, rank, report, semantic
from tessella.sources import files as sources

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# --- shared inputs, in both dialects ---

#: documents as files with odd names
PATH = """CASE WHEN doc_id % 11 = 0 THEN concat(source, '/.h', CAST(doc_id AS STRING), '.txt') ELSE concat(source, '/d', CAST(doc_id AS STRING),
  CASE doc_id % 9 WHEN 0 THEN '.txt' WHEN 1 THEN '.SVG' WHEN 2 THEN '.py' WHEN 3 THEN '-lock.json' WHEN 4 THEN '.lock' WHEN 5 THEN '.md' WHEN 6 THEN ''
  WHEN 7 THEN '.tar.gz' ELSE '.rs' END) END"""
KIND = "CASE doc_id % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'text' WHEN 3 THEN 'section' WHEN 4 THEN 'method' ELSE 'code' END"
NAME = "CASE doc_id % 3 WHEN 0 THEN 'parseHeader' WHEN 1 THEN concat('the_', lang) ELSE concat('Reader.read', CAST(doc_id AS STRING)) END"
IDENT = "concat(event_type, 'Handler_', CAST(user_id AS STRING), ' HTTPSConnection get', upper(substring(event_type, 1, 1)), substring(event_type, 2), 'Id of ', event_type, ' x_io')"
V1 = f"SELECT {PATH} AS rel_path, text AS content, doc_id AS mtime FROM documents WHERE doc_id % 10 <> 0"
V2 = f"""SELECT {PATH} AS rel_path, CASE WHEN doc_id % 13 = 0 THEN concat(text, ' changed') ELSE text END AS content,
  CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 WHEN doc_id % 17 = 0 THEN 0 ELSE doc_id END AS mtime FROM documents WHERE doc_id % 7 <> 0"""
BLOCKS = f"""SELECT doc_id, source AS file, {KIND} AS type, {NAME} AS name, CAST(doc_id % 50 AS INT) AS start_line,
  CAST(doc_id % 50 + doc_id % 7 AS INT) AS end_line, text AS content FROM documents"""
HASH = "substr(sha256(coalesce({0}, '')), 1, 16)"


def shared(spark: SparkSession, sf_dir: str, sql: str, name: str = "documents") -> DataFrame:
    sql = sql.replace("concat(", "concat_ws('', ")  # as SQL has it: what is null is left out
    return spark.sql(sql.replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


def state(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return shared(spark, sf_dir, sql).withColumn("hash", X.content_hash(F.coalesce("content", F.lit(""))))


# --- scans and files ---


@query(
    f"""SELECT rel_path, NOT (starts_with(base, '.') OR ends_with(base, '-lock.json')
      OR coalesce(list_contains({listed(vocab.BINARY_EXTENSIONS)}, lower(regexp_extract(base, '[^.].*?(\\.[^.]*)$', 1))), false)) AND strlen(text) <= 1000000 AS eligible
    FROM (SELECT {PATH} AS rel_path, regexp_extract({PATH}, '([^/]*)$', 1) AS base, text FROM documents)"""
)
def scan_eligible(spark, sf_dir):
    rows = shared(spark, sf_dir, f"SELECT {PATH} AS rel_path, text FROM documents")
    return rows.select("rel_path", P.eligible(F.col("rel_path"), F.col("text"), F.octet_length("text")).alias("eligible"))


@query(f"SELECT doc_id, {HASH.format('text')} AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query(
    f"""SELECT rel_path, lower(regexp_extract(rel_path, '[^/.][^/]*?(\\.[^./]*)$', 1)) AS ext, regexp_extract(rel_path, '([^/]*)$', 1) AS base,
      CASE WHEN starts_with(rel_path, 'src1/') THEN substr(rel_path, 6) ELSE rel_path END AS relative, concat('/data/', rel_path) AS absolute,
      concat(rel_path, ':', doc_id % 50, ':', {NAME}) AS block_id FROM (SELECT *, {PATH} AS rel_path FROM documents)"""
)
def path_functions(spark, sf_dir):
    rows = shared(spark, sf_dir, f"SELECT {PATH} AS rel_path, doc_id % 50 AS line, {NAME} AS name FROM documents")
    p = F.col("rel_path")
    return rows.select(
        p, X.extension(p).alias("ext"), X.base_name(p).alias("base"), X.relative_path(p, "src1").alias("relative"),
        X.absolute_path(p, "/data").alias("absolute"), X.block_id(p, F.col("line"), F.col("name")).alias("block_id"),
    )


DIFF_SQL = f"""SELECT coalesce(n.rel_path, o.rel_path) AS rel_path, CASE WHEN n.rel_path IS NULL THEN 'deleted' WHEN o.rel_path IS NULL THEN 'new'
  WHEN {HASH.format('n.content')} = {HASH.format('o.content')} THEN 'unchanged' ELSE 'changed' END AS status FROM ({V2}) n FULL JOIN ({V1}) o ON n.rel_path = o.rel_path"""


def _diff(spark, sf_dir):
    return diff.by_hash(state(spark, sf_dir, V2), state(spark, sf_dir, V1))


@query(DIFF_SQL)
def stale_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query(f"SELECT count(*) FILTER (status <> 'unchanged') AS stale FROM ({DIFF_SQL})")
def stale_count(spark, sf_dir):
    return diff.stale_count(_diff(spark, sf_dir))


@query(f"SELECT rel_path FROM ({V1}) o WHERE NOT EXISTS (SELECT 1 FROM ({V2}) n WHERE n.rel_path = o.rel_path)")
def deleted_files(spark, sf_dir):
    return diff.deleted(state(spark, sf_dir, V2), state(spark, sf_dir, V1)).select("rel_path")


@query(f"SELECT n.rel_path, coalesce(n.mtime = o.mtime AND n.mtime > 0, false) AS fresh FROM ({V2}) n LEFT JOIN ({V1}) o ON n.rel_path = o.rel_path")
def mtime_prefilter(spark, sf_dir):
    return diff.by_mtime(shared(spark, sf_dir, V2), shared(spark, sf_dir, V1))


@query(
    f"""SELECT count(*) FILTER (status <> 'deleted') AS files, count(*) FILTER (status IN ('new', 'changed')) AS changed,
      count(*) FILTER (status = 'deleted') AS deleted, (SELECT sum(1 + mtime % 3) FROM ({V1}))::BIGINT AS blocks FROM ({DIFF_SQL})"""
)
def status_report(spark, sf_dir):
    manifest = state(spark, sf_dir, V1).withColumn("blocks", F.array_repeat(F.lit("b"), (1 + F.col("mtime") % 3).cast("int")))
    return diff.status(diff.by_hash(state(spark, sf_dir, V2), manifest), manifest)


@query(f"SELECT rel_path FROM (SELECT {PATH} AS rel_path FROM documents) WHERE NOT (rel_path = 'src1' OR starts_with(rel_path, 'src1/'))")
def remove_prefix(spark, sf_dir):
    return diff.without_prefix(shared(spark, sf_dir, f"SELECT {PATH} AS rel_path FROM documents"), "src1")


@query(f"SELECT rel_path FROM (SELECT {PATH} AS rel_path FROM documents) WHERE rel_path = 'src1' OR starts_with(rel_path, 'src1/')")
def scope_filter(spark, sf_dir):
    return shared(spark, sf_dir, f"SELECT {PATH} AS rel_path FROM documents").filter(P.in_scope(F.col("rel_path"), "src1"))


@query(
    f"""WITH o AS (SELECT rel_path, {HASH.format('content')} AS hash, mtime FROM ({V1})), n AS (SELECT rel_path, {HASH.format('content')} AS hash, mtime FROM ({V2}))
    SELECT * FROM o WHERE rel_path NOT IN (SELECT rel_path FROM n) UNION ALL SELECT * FROM n"""
)
def upsert_manifest(spark, sf_dir):
    columns = ["rel_path", "hash", "mtime"]
    old, new = state(spark, sf_dir, V1).select(*columns), state(spark, sf_dir, V2).select(*columns)
    return diff.upsert(old, new, new, "rel_path")


@query(f"SELECT n.rel_path, n.content FROM ({V2}) n JOIN ({DIFF_SQL}) d ON n.rel_path = d.rel_path WHERE d.status IN ('new', 'changed')")
def changed_contents(spark, sf_dir):
    work = _diff(spark, sf_dir).filter(F.col("status").isin("new", "changed")).select("rel_path")
    return state(spark, sf_dir, V2).join(work, "rel_path", "left_semi").select("rel_path", "content")


EVALUATION = "SELECT CASE WHEN lang = 'en' THEN 'test' ELSE 'train' END AS partition, substring(text, 1, 40) AS docstring, text AS code FROM documents"


@query(
    f"""SELECT printf('%06d.py', row_number() OVER (ORDER BY o, code) - 1) AS rel_path, code AS content, docstring AS query FROM (
      SELECT *, sha256('42|' || code) AS o FROM ({EVALUATION}) WHERE partition = 'test' AND trim(docstring) <> '' AND trim(code) <> '' ORDER BY o, code LIMIT 50)"""
)
def evaluation_corpus(spark, sf_dir):
    return sources.evaluation_corpus(shared(spark, sf_dir, EVALUATION), 50)


# --- text functions ---

IDS_RE = "[a-zA-Z][a-zA-Z0-9_]*[a-zA-Z0-9]"


def parts_sql(w: str) -> str:
    spaced = f"regexp_replace(regexp_replace({w}, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return f"list_transform(list_filter(regexp_split_to_array({spaced}, '[_ ]'), lambda p: strlen(p) >= 2), lambda p: lower(p))"


PARTS = parts_sql("w")
TERMS = f"""list_sort(list_distinct(list_concat(
  flatten(list_transform(regexp_extract_all(t, '{IDS_RE}'), lambda w: CASE WHEN len({PARTS}) > 1 THEN {PARTS} ELSE [lower(w)] END)),
  list_transform(list_filter(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '' AND strlen(w) < 3), lambda w: lower(w)))))"""
KNOWN = listed(vocab.KEYWORDS)
EVENTS = f"SELECT event_id, {IDENT} AS t FROM events"


@query(
    f"""SELECT event_id, CASE WHEN len(x) > 0 THEN t || ' ' || array_to_string(x, ' ') ELSE t END AS body FROM (SELECT event_id, t,
      list_filter(flatten(list_transform(list_filter(regexp_extract_all(t, '{IDS_RE}'), lambda w: strlen(w) >= 4 AND NOT list_contains({KNOWN}, lower(w))),
      lambda w: CASE WHEN len({PARTS}) > 1 THEN {PARTS} ELSE [] END)), lambda p: NOT list_contains({KNOWN}, p)) AS x FROM ({EVENTS}))"""
)
def identifier_split(spark, sf_dir):
    return shared(spark, sf_dir, EVENTS, "events").select("event_id", X.split_identifiers(F.col("t")).alias("body"))


@query(f"SELECT event_id, array_to_string({TERMS}, ' ') AS terms FROM ({EVENTS})")
def extract_terms(spark, sf_dir):
    return shared(spark, sf_dir, EVENTS, "events").select("event_id", F.array_join(X.terms(F.col("t")), " ").alias("terms"))


@query(
    f"""SELECT event_id, array_to_string(list_filter({TERMS}, lambda x: strlen(x) >= 3 OR list_contains({listed(vocab.SHORT_TERMS)}, x)), ' ') AS terms,
      regexp_matches(t, '_|[a-z][A-Z]') AS code FROM ({EVENTS})"""
)
def query_term_set(spark, sf_dir):
    rows = shared(spark, sf_dir, EVENTS, "events")
    return rows.select("event_id", F.array_join(X.query_terms(F.col("t")), " ").alias("terms"), X.is_code_query(F.col("t")).alias("code"))


_SYN_ROWS = [(k, s, i) for k, v in vocab.SYNONYMS.items() for i, s in enumerate(v)]
SYN_VALUES = ", ".join(f"('{k}', '{s}', {i})" for k, s, i in _SYN_ROWS)
EXPANDED_SQL = f"""WITH s(term, synonym, ord) AS (VALUES {SYN_VALUES}), e AS (SELECT event_id, t, {TERMS} AS terms FROM ({EVENTS})),
  m AS (SELECT event_id, synonym, min((i, ord)) AS o FROM (SELECT event_id, t, terms[i] AS term, i FROM e, unnest(range(1, len(terms) + 1)) x(i)) JOIN s USING (term)
        WHERE NOT contains(lower(t), synonym) GROUP BY event_id, synonym),
  l AS (SELECT event_id, string_agg(synonym, ' ' ORDER BY o) AS more FROM m GROUP BY event_id)
  SELECT e.event_id, CASE WHEN more IS NULL THEN t ELSE t || ' ' || more END AS q FROM e LEFT JOIN l USING (event_id)"""


@query(EXPANDED_SQL)
def synonym_expand(spark, sf_dir):
    return shared(spark, sf_dir, EVENTS, "events").select("event_id", X.expand_query(F.col("t")).alias("q"))


@query(EXPANDED_SQL)
def synonym_join(spark, sf_dir):
    synonyms = F.broadcast(spark.createDataFrame(_SYN_ROWS, "term string, synonym string, ord int"))  # the driver's own list
    return lexical.expand_queries(shared(spark, sf_dir, EVENTS, "events"), "event_id", "t", synonyms).select("event_id", F.col("t").alias("q"))


@query("SELECT doc_id, greatest(1, strlen(text) // 4)::INT AS tokens, strlen(text) // 4 >= 30 AS kept FROM documents")
def token_estimate(spark, sf_dir):
    n = X.estimated_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), (n >= vocab.MIN_CHUNK_TOKENS).alias("kept"))


LINES = "string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n$', ''), chr(10))"


@query(
    f"""SELECT concat(p, ':0:', regexp_extract(p, '([^/]*)$', 1)) AS block_id, p AS file, 'file' AS type, regexp_extract(p, '([^/]*)$', 1) AS name, 0 AS start_line,
      least(len(l), 50)::INT - 1 AS end_line, array_to_string(l[1:50], chr(10)) AS content FROM (SELECT {PATH} AS p, {LINES} AS l FROM documents)"""
)
def fallback_head(spark, sf_dir):
    return extract.head_blocks(shared(spark, sf_dir, f"SELECT {PATH} AS rel_path, text AS content FROM documents"))


@query(f"SELECT doc_id, array_to_string(list_filter({LINES}, lambda x: trim(x) <> '')[1:5], chr(10)) AS preview FROM documents")
def preview_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.preview(F.col("text"), 5), "\n").alias("preview"))


@query(
    f"""WITH r AS (SELECT doc_id, i - 1 AS idx, l[i] AS line FROM (SELECT doc_id, {LINES} AS l FROM documents), unnest(range(1, len(l) + 1)) x(i) WHERE trim(l[i]) <> ''),
    o AS (SELECT doc_id, idx, line, lag(line) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM r),
    c AS (SELECT doc_id, idx, CASE WHEN before IS NULL THEN line ELSE array_to_string(list_filter(regexp_split_to_array(before, '\\s+'), lambda w: w <> '')[-50:], ' ') || ' ' || line END AS chunk FROM o),
    k AS (SELECT * FROM c WHERE greatest(1, strlen(chunk) // 4) >= 30)
    SELECT doc_id, idx::INT AS idx, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INT AS start_line, greatest(1, strlen(chunk) // 4)::INT AS tokens, chunk FROM k"""
)
def line_chunks(spark, sf_dir):
    return chunks.line_chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def text_blocks(spark, sf_dir):
    """Recursive chunks of all documents."""
    return extract.blocks(sources.documents_as_files(table(spark, sf_dir, "documents")))


@query()
def markdown_blocks(spark, sf_dir):
    return extract.blocks(sources.conversations_as_files(table(spark, sf_dir, "conversations")))


@query()
def html_elements(spark, sf_dir):
    return extract.blocks(sources.pages_as_files(table(spark, sf_dir, "pages")))


@query("SELECT concat('conversations/', conv_id, '.md') AS rel_path, string_agg('# ' || role || chr(10) || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id")
def conversations_as_files(spark, sf_dir):
    return sources.conversations_as_files(table(spark, sf_dir, "conversations")).select("rel_path", "content")


SPANS = """SELECT o_custkey AS file, 'class' AS type, CAST(o_orderkey % 400 AS INT) AS start_line, CAST(o_orderkey % 400 + 25 AS INT) AS end_line, o_orderkey AS n FROM orders
  UNION ALL SELECT o_custkey AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'function' ELSE 'block' END AS type, CAST(o_orderkey % 400 + 2 AS INT) AS start_line,
  CAST(o_orderkey % 400 + 2 + o_orderkey % 40 AS INT) AS end_line, o_orderkey AS n FROM orders"""


@query(
    f"""WITH b AS ({SPANS}) SELECT * FROM b p WHERE NOT (p.type IN ('class', 'struct', 'module', 'impl', 'trait', 'enum', 'interface', 'block') AND EXISTS (
      SELECT 1 FROM b c WHERE c.file = p.file AND c.start_line >= p.start_line AND c.end_line <= p.end_line AND NOT (c.start_line = p.start_line AND c.end_line = p.end_line)))"""
)
def container_drop(spark, sf_dir):
    return extract.without_containers(shared(spark, sf_dir, SPANS, "orders"))


# --- lexical ---

WORDS = "unnest(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
POSTINGS_SQL = f"SELECT key, term, count(*) AS tf FROM (SELECT doc_id AS key, {WORDS.format('text')} AS term FROM documents) GROUP BY key, term"
BM25_CTES = f"""p AS MATERIALIZED ({POSTINGS_SQL}), l AS (SELECT doc_id AS key, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS dl FROM documents),
  s AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avgdl FROM l), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term),
  q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {WORDS.format('text')} AS term FROM benchmark) GROUP BY item_id, term),
  b AS (SELECT item_id, key, round(sum(qtf * ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM q JOIN d USING (term) JOIN p USING (term) JOIN l USING (key), s GROUP BY item_id, key),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS rank FROM b)"""


@query(POSTINGS_SQL)
def postings(spark, sf_dir):
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) GROUP BY term")
def term_statistics(spark, sf_dir):
    return lexical.statistics(lexical.postings(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _bm25(spark, sf_dir, k=10):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    terms = lexical.query_words(items, "item_id", "text")
    return lexical.bm25_best(terms, docs, "doc_id", "text", k, "item_id")


@query(f"WITH {BM25_CTES} SELECT item_id, key, score, rank::INT AS rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(
    f"""WITH {BM25_CTES}, i AS (SELECT b.*, row_number() OVER (PARTITION BY item_id ORDER BY b.score DESC, b.key) AS n FROM b JOIN documents ON doc_id = key WHERE source = 'src1')
    SELECT item_id, key, score, n::INT AS rank FROM i WHERE n <= 5"""
)
def scoped_bm25(spark, sf_dir):
    """The scope is a filter before the top k, so a narrow one loses no hits."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    terms = lexical.query_words(items, "item_id", "text")
    return lexical.bm25_best(terms, docs, "doc_id", "text", 5, "item_id", P.in_scope(F.col("source"), "src1"))


@query(
    f"""WITH {BM25_CTES}, g AS (SELECT b.item_id, d.doc_id AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
      h AS (SELECT g.item_id, min(rank) AS rank FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 10) r ON r.item_id = g.item_id AND r.key = g.key GROUP BY g.item_id)
    SELECT count(*) AS n_queries, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce(rank <= 1, false)::INT), 6) AS recall_1,
      round(avg(coalesce(rank <= 5, false)::INT), 6) AS recall_5, round(avg(coalesce(rank <= 10, false)::INT), 6) AS recall_k FROM h"""
)
def eval_metrics(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("t")).join(F.broadcast(items), F.contains("t", "text")).select("item_id", "key")
    out = report.evaluate(_bm25(spark, sf_dir), gold, 10, "item_id")
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


# --- semantic ---

VECTORS = "SELECT vec_id // 8 AS key, (vec_id % 8)::INT AS pos, embedding AS vec FROM embeddings"
DOT = "list_inner_product({0}::DOUBLE[], {1}::DOUBLE[])"
#: Queries are the blocks whose key is divisible by 50.
MAXSIM_CTES = f"""v AS ({VECTORS}), q AS (SELECT key AS query_id, pos AS qpos, vec AS qvec FROM v WHERE key % 50 = 0),
  m AS (SELECT query_id, key, qpos, max({DOT.format('qvec', 'vec')}) AS best FROM q, v GROUP BY query_id, key, qpos),
  s AS (SELECT query_id, key, round(sum(best), 6) AS score FROM m GROUP BY query_id, key),
  t AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank FROM s)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("key"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("embedding").alias("vec"))


def _token_lists(spark, sf_dir):
    lists = F.transform(F.array_sort(F.collect_list(F.struct("pos", "vec"))), lambda x: x["vec"])
    return _vectors(spark, sf_dir).groupBy("key").agg(lists.alias("tokens"))


def _asking(blocks: DataFrame) -> DataFrame:
    return blocks.filter("key % 50 = 0").withColumnRenamed("key", "query_id")


@query(f"SELECT vec_id, round(sqrt({DOT.format('u', 'u')}), 6) AS norm, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({DOT.format('embedding', 'embedding')})) AS u FROM embeddings)")
def l2_normalise(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", semantic.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(F.sqrt(semantic.dot(F.col("u"), F.col("u"))), 6).alias("norm"), F.round(F.col("u")[0], 6).alias("first"))


@query(
    f"""SELECT key, pos2 AS pos, list(CASE WHEN round(x, 5) = 0 THEN 0.0 ELSE round(x, 5) END ORDER BY d) AS vec FROM (SELECT key, (pos // 2)::INT AS pos2, d, avg(vec[d]::DOUBLE) AS x FROM ({VECTORS}), unnest(range(1, len(vec) + 1)) y(d)
      GROUP BY key, pos2, d) GROUP BY key, pos2"""
)
def token_pool(spark, sf_dir):
    out = semantic.pool_pairs(_vectors(spark, sf_dir), "key", "pos", "vec")
    return out.select("key", "pos", F.transform("vec", lambda x: F.when(F.round(x, 5) == 0, 0.0).otherwise(F.round(x, 5))).alias("vec"))  # no negative zeros


@query(f"WITH {MAXSIM_CTES} SELECT query_id, key, score FROM s")
def maxsim_join(spark, sf_dir):
    blocks = _token_lists(spark, sf_dir)
    return semantic.maxsim_many(_asking(blocks), blocks)


@query(f"WITH {MAXSIM_CTES} SELECT query_id, key, score, rank FROM t WHERE rank <= 10")
def maxsim_topk(spark, sf_dir):
    blocks = _token_lists(spark, sf_dir)
    return semantic.maxsim_many(_asking(blocks), blocks, 10)


@query(f"WITH {MAXSIM_CTES} SELECT query_id, key, score, rank FROM t WHERE rank <= 10")
def ann_topk(spark, sf_dir):
    """The best ten of every query by codes; blocks that the codes cannot rule out are scored too, so none is missed."""
    vectors, encoder = _token_lists(spark, sf_dir), ann.Encoder(64)
    return ann.search_many(ann.codes(vectors, encoder), vectors, encoder, _asking(vectors), 10, 60)


@query(
    f"""WITH {MAXSIM_CTES}, a AS (SELECT (doc_id % 5) * 50 AS query_id, doc_id AS key, round((doc_id % 97) / 10.0::DOUBLE, 6) AS score FROM documents),
      b AS (SELECT query_id, key, score FROM t WHERE rank <= 100), u AS (SELECT query_id, key, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY query_id, key)
    SELECT query_id, key, score, n::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS n FROM u) WHERE n <= 20"""
)
def hybrid_merge(spark, sf_dir):
    """Candidates by words (here all documents, with a made-up score) and by vectors, merged for every query."""
    a = table(spark, sf_dir, "documents").select(((F.col("doc_id") % 5) * 50).alias("query_id"), F.col("doc_id").alias("key"), F.round((F.col("doc_id") % 97) / 10.0, 6).alias("score"))
    blocks = _token_lists(spark, sf_dir)
    return lexical.top_k(rank.merge(a, semantic.maxsim_many(_asking(blocks), blocks, 100), "query_id", "key"), 20)


@query(
    f"""WITH {MAXSIM_CTES}, k AS (SELECT doc_id AS key, source AS file, {KIND} AS type FROM documents),
      o AS (SELECT s.*, k.file, k.type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.key) AS n FROM s JOIN k USING (key) JOIN k own ON own.key = s.query_id
        WHERE k.file <> own.file AND k.type NOT IN ('text', 'section'))
    SELECT query_id, key, file, type, score FROM o WHERE n <= 10"""
)
def similar_blocks(spark, sf_dir):
    """For every query block the most similar blocks of other files, without text and sections."""
    blocks = shared(spark, sf_dir, f"SELECT doc_id AS key, source AS file, {KIND} AS type FROM documents")
    lists = _token_lists(spark, sf_dir).join(blocks, "key").withColumn("apart", F.col("file"))
    found = semantic.maxsim_many(_asking(lists), lists.filter(~P.is_doc(F.col("type"))), 10)
    return found.join(blocks, "key").select("query_id", "key", "file", "type", "score")


# --- ranking and filters ---


def boost_sql(q: str) -> str:
    """The boost in SQL for one fixed query."""
    names = TERMS.replace("(t, ", "(name, ")
    terms = f"list_filter({TERMS.replace('(t, ', f'({q}, ')}, lambda x: strlen(x) >= 3 OR list_contains({listed(vocab.SHORT_TERMS)}, x))"
    wants = lambda words: f"list_has_any(qt, {listed(words)})"
    fits = f"({wants(vocab.CLASS_WORDS)} AND type IN ('class', 'struct')) OR ({wants(vocab.FUNCTION_WORDS)} AND type IN ('function', 'method'))"
    kind = f"""CASE WHEN {fits} THEN 1.5 WHEN NOT {wants(vocab.CLASS_WORDS)} AND NOT {wants(vocab.FUNCTION_WORDS)} THEN CASE WHEN type IN ('function', 'method') THEN 1.3
      WHEN type IN ('class', 'struct') THEN 1.2 WHEN type IN ('interface', 'type', 'trait', 'enum') THEN 1.1 ELSE 1.0 END ELSE 1.0 END::DOUBLE"""
    name = f"(CASE WHEN name <> '' AND list_contains(qt, lower(name)) THEN 2.5 ELSE 1.0::DOUBLE + 0.3::DOUBLE * len(list_intersect(qt, {names})) END)::DOUBLE"
    path = "(CASE WHEN len(list_filter(qt, lambda x: strlen(x) >= 3 AND contains(lower(file), x))) > 0 THEN 1.15 ELSE 1.0 END)::DOUBLE"
    content = "(CASE WHEN len(qt) > 0 THEN 1.0::DOUBLE + len(list_filter(qt, lambda x: contains(lower(content), x)))::DOUBLE / len(qt) ELSE 1.0 END)::DOUBLE"
    return f"""WITH b AS ({BLOCKS}), f AS (SELECT *, {terms} AS qt FROM b), g AS (SELECT *, least(4.0::DOUBLE, {kind} * CASE WHEN regexp_matches({q}, '_|[a-z][A-Z]') THEN {name} * {path}
      ELSE {content} END) AS boost, ((doc_id % 21) - 10)::DOUBLE AS raw FROM f)
      SELECT doc_id, round(boost, 6) AS boost, round(CASE WHEN raw < 0 THEN raw / boost ELSE raw * boost END, 6) AS score FROM g"""


def _boosted(spark, sf_dir, q):
    rows = shared(spark, sf_dir, BLOCKS)
    factor = rank.boost(F.lit(q), F.col("type"), F.col("name"), F.col("content"), F.col("file"))
    raw = ((F.col("doc_id") % 21) - 10).cast("double")
    return rows.select("doc_id", F.round(factor, 6).alias("boost"), F.round(rank.boosted(raw, factor), 6).alias("score"))


@query(boost_sql("'the function of the header'"))
def boost_text_query(spark, sf_dir):
    return _boosted(spark, sf_dir, "the function of the header")


@query(boost_sql("'parseHeader src1_en'"))
def boost_code_query(spark, sf_dir):
    return _boosted(spark, sf_dir, "parseHeader src1_en")


@query(boost_sql("'and that with'"))
def boost_plain_query(spark, sf_dir):
    return _boosted(spark, sf_dir, "and that with")


@query(
    f"""SELECT rel_path, name FROM (SELECT {PATH} AS rel_path, {NAME} AS name, text, doc_id FROM documents) WHERE (ends_with(rel_path, '.py') OR ends_with(rel_path, '.pyi') OR ends_with(rel_path, '.rs')
      OR ends_with(rel_path, '.txt')) AND NOT (ends_with(rel_path, '9.rs') OR contains(rel_path, 'src3')) AND (doc_id % 100) / 100.0 >= 0.25 AND (regexp_matches(text, 'th[aeiou]') OR regexp_matches(name, 'th[aeiou]'))"""
)
def post_filters(spark, sf_dir):
    rows = shared(spark, sf_dir, f"SELECT {PATH} AS rel_path, {NAME} AS name, text, doc_id FROM documents")
    keep = P.of_types(F.col("rel_path"), "py, rs, txt") & ~P.excluded(F.col("rel_path"), ["*9.rs", "src3"])
    keep = keep & P.passes((F.col("doc_id") % 100) / 100.0, 0.25) & P.matches(F.col("text"), F.col("name"), "th[aeiou]")
    return rows.filter(keep).select("rel_path", "name")


@query(f"SELECT rel_path FROM (SELECT {PATH} AS rel_path FROM documents) WHERE NOT (ends_with(rel_path, '.md') OR ends_with(rel_path, '.txt'))")
def code_only(spark, sf_dir):
    return shared(spark, sf_dir, f"SELECT {PATH} AS rel_path FROM documents").filter(P.is_code(F.col("rel_path")))


@query(f"SELECT file, name, start_line FROM ({BLOCKS}) WHERE 20 BETWEEN start_line AND end_line AND (name = 'read20' OR ends_with(name, '.read20') OR name = 'parseHeader')")
def block_lookup(spark, sf_dir):
    rows = shared(spark, sf_dir, BLOCKS)
    name = P.has_name(F.col("name"), "read20") | P.has_name(F.col("name"), "parseHeader")
    return rows.filter(P.holds_line(F.col("start_line"), F.col("end_line"), 20) & name).select("file", "name", "start_line")


@query(
    f"""SELECT file, line, (SELECT min((start_line, doc_id)) FROM ({BLOCKS}) b WHERE b.file = q.file AND q.line BETWEEN start_line AND end_line)[2] AS hit,
      (SELECT min((start_line, doc_id)) FROM ({BLOCKS}) b WHERE b.file = q.file)[2] AS first FROM (SELECT DISTINCT file, x AS line FROM ({BLOCKS}), (VALUES (3), (20), (90)) v(x)) q"""
)
def line_resolution(spark, sf_dir):
    """For lines of every file the first block that holds it, and the file's first block, which stands in without one."""
    rows = shared(spark, sf_dir, BLOCKS)
    place = F.struct("start_line", "doc_id")
    firsts = rows.groupBy("file").agg(F.min(place)["doc_id"].alias("first"), *[F.min(F.when(P.holds_line(F.col("start_line"), F.col("end_line"), n), place))["doc_id"].alias(f"l{n}") for n in (3, 20, 90)])
    lines = F.array(*[F.struct(F.lit(n).alias("line"), F.col(f"l{n}").alias("hit")) for n in (3, 20, 90)])
    return firsts.select("file", "first", F.inline(lines)).select("file", "line", "hit", "first")


# --- reports ---

RANKED = f"SELECT *, CAST(doc_id AS INT) AS rank, CAST(doc_id % 7 AS DOUBLE) AS score FROM ({BLOCKS})"


@query(f"SELECT file, min(rank) AS rank FROM ({RANKED}) GROUP BY file")
def files_only(spark, sf_dir):
    return report.files_only(shared(spark, sf_dir, RANKED))


@query(
    f"""SELECT rank, concat(file, ':', start_line, ' ', type, ' ', name, chr(10), array_to_string(list_filter(string_split(regexp_replace(content, '\\n$', ''), chr(10)), lambda x: trim(x) <> '')[1:3], chr(10))) AS text
    FROM ({RANKED})"""
)
def result_lines(spark, sf_dir):
    return report.as_lines(shared(spark, sf_dir, RANKED), 3)


@query(
    f"""SELECT rank, concat('## ', file, ':', start_line, ' (', name, ', score: ', printf('%.2f', score), ')', chr(10), '```', chr(10), content, chr(10), '```') AS markdown
    FROM ({RANKED})"""
)
def result_markdown(spark, sf_dir):
    return report.markdown_parts(shared(spark, sf_dir, RANKED))


@query(f"SELECT rank, json_object('file', file, 'type', type, 'name', name, 'start_line', start_line, 'end_line', end_line)::VARCHAR AS json FROM ({RANKED})")
def result_json(spark, sf_dir):
    rows = shared(spark, sf_dir, RANKED).select("file", "type", "name", "start_line", "end_line", "content", "rank")
    return report.as_json(rows, content=False)


@query(f"SELECT file, string_agg(concat(start_line, '-', end_line, ' ', type, ' ', name), ';' ORDER BY start_line, end_line, type, name) AS blocks FROM ({BLOCKS}) GROUP BY file")
def outline(spark, sf_dir):
    line = lambda b: F.concat(b["start_line"].cast("string"), F.lit("-"), b["end_line"].cast("string"), F.lit(" "), b["type"], F.lit(" "), b["name"])
    return report.outline(shared(spark, sf_dir, BLOCKS)).select("file", F.array_join(F.transform("blocks", line), ";").alias("blocks"))


@query(f"SELECT file, count(*) AS blocks, count(DISTINCT type) AS types, max(end_line) AS last_line FROM ({BLOCKS}) GROUP BY file")
def block_counts(spark, sf_dir):
    return shared(spark, sf_dir, BLOCKS).groupBy("file").agg(F.count("*").alias("blocks"), F.countDistinct("type").alias("types"), F.max("end_line").alias("last_line"))


# --- end to end ---


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the documents under one source, ranked for a text query by BM25 and boosted."""
    text = "the passage that is of interest"
    files = sources.documents_as_files(table(spark, sf_dir, "documents")).filter(P.in_scope(F.col("rel_path"), "src1"))
    blocks = extract.blocks(files)
    body = blocks.select("block_id", X.split_identifiers(X.embedding_text(F.col("type"), F.col("name"), F.col("content"))).alias("body"))
    words = spark.range(1).select(F.lit(0).alias("query_id"), X.expand_query(F.lit(text)).alias("q"))
    scored = lexical.bm25(lexical.query_words(words, "query_id", "q"), lexical.postings(body, "block_id", "body"), lexical.lengths(body, "block_id", "body"))
    best = scored.orderBy(F.desc("score"), "key").limit(10).withColumnRenamed("key", "block_id")
    found = rank.apply_boost(blocks.join(F.broadcast(best), "block_id"), text)  # ten rows
    return found.select("block_id", "file", "type", "name", "start_line", "end_line", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "block_id")


@query()
def chunk_search(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def index_search(spark, sf_dir):
    """A whole index of the documents in the shared folder, brought from one state to the next, and a hybrid search."""
    import uuid

    from tessella.plans.index import Index
    from tessella.session import shared_folder

    folder = shared_folder(spark)
    index = Index(spark, f"{folder}/index-{uuid.uuid4().hex}", embedder=semantic.HashEmbedder(), pool=2)
    index.build(state(spark, sf_dir, V1).withColumn("rel_path", F.regexp_replace("rel_path", r"\.[^./]*$", ".txt")))
    index.update(state(spark, sf_dir, V2).withColumn("rel_path", F.regexp_replace("rel_path", r"\.[^./]*$", ".txt")))
    return index.search("the passage that is of interest", 10).withColumn("score", F.round("score", 4))


TXT = r"regexp_replace(rel_path, '\.[^./]*$', '.txt')"


@query(f"SELECT {TXT} AS rel_path, {HASH.format('content')} AS hash, mtime, CAST(0 AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra FROM ({V2})")
def incremental_equals_full(spark, sf_dir):
    """The manifest of an index brought from one state to the next, and how many of each file's blocks (with their postings
    and lengths) differ from those of an index built of the next state alone."""
    import uuid

    from tessella.plans.index import Index
    from tessella.session import shared_folder

    old, new = (state(spark, sf_dir, v).withColumn("rel_path", F.regexp_replace("rel_path", r"\.[^./]*$", ".txt")) for v in (V1, V2))
    changed, full = (Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}") for _ in range(2))
    changed.build(old)
    changed.update(new)
    full.build(new)

    def rows(index: Index) -> DataFrame:
        """Of every block its file and a digest of all that the index holds of it; texts stay where they are."""
        words = index.store.table("postings").groupBy("key").agg(F.count("*").alias("terms"), F.sum(F.xxhash64("term", "tf").cast("decimal(38,0)")).alias("words"))
        digest = lambda *columns: F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))
        blocks = index.blocks()
        blocks = blocks.select("key", "file", digest(*blocks.columns).alias("d")).join(words, "key", "left").join(index.store.table("lengths"), "key", "left")
        return blocks.select("file", digest("d", "terms", "words", "dl").alias("d"))

    def per_file(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col("file").alias("rel_path")).agg(F.count("*").alias(name))

    got, want = rows(changed), rows(full)
    missing, extra = per_file(want.exceptAll(got), "n_missing"), per_file(got.exceptAll(want), "n_extra")
    files = changed.store.table("manifest").select("rel_path", "hash", "mtime").join(missing, "rel_path", "full").join(extra, "rel_path", "full")
    return files.select("rel_path", "hash", "mtime", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_missing", "n_extra")])


@query(f"SELECT rel_path, {HASH.format('content')} AS hash, mtime FROM (SELECT {TXT} AS rel_path, content, mtime FROM ({V1})) WHERE NOT starts_with(rel_path, 'src1/')")
def index_after_removal(spark, sf_dir):
    """The manifest of an index from which a directory was removed."""
    import uuid

    from tessella.plans.index import Index
    from tessella.session import shared_folder

    index = Index(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.build(state(spark, sf_dir, V1).withColumn("rel_path", F.regexp_replace("rel_path", r"\.[^./]*$", ".txt")))
    index.remove_prefix("src1")
    return index.store.table("manifest").select("rel_path", "hash", "mtime")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
