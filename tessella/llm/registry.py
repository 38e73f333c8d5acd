"""The queries of this folder for the driver contract, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, decontamination, html_text, license_scan, quality, simhash, substring_dedup, token_counts, toxicity, url_filter
from tessella.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


_NOTICES = ", ".join(f"('{label}', '{text}')" for label, texts in license_scan.TEMPLATES.items() for text in texts)
_PHRASE_WORDS = ", ".join(f"('{label}', {phrase.split(' ')})" for phrase, label in license_scan.PHRASES.items())
OP2_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT k, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d
), p(label, phrase) AS (VALUES {_PHRASE_WORDS}
), h AS (
  SELECT k, label, i FROM w, p, unnest(range(1, len(words) + 1)) x(i) WHERE words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase
), b AS (
  SELECT k, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS found FROM h GROUP BY k
), n(label, notice) AS (VALUES {_NOTICES}
), l AS (
  SELECT DISTINCT k, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS line FROM d, unnest(string_split(t, chr(10))) x(line)
), t AS (
  SELECT label, list_distinct(string_split(notice, ' ')) AS tw, (5 * len(string_split(notice, ' ')) + 3) // 4 AS run FROM n
), c AS (
  SELECT k, words, label, tw, run FROM w, t WHERE len(list_intersect(tw, words)) >= 0.8 * len(tw)
), s AS (
  SELECT k, label, len(list_intersect(line, tw)) / len(tw) AS share FROM l, t
  UNION ALL
  SELECT k, label, len(list_intersect(tw, words[i : i + run - 1])) / len(tw) AS share FROM c, unnest(range(1, len(words) + 1)) x(i) WHERE list_contains(tw, words[i])
), m AS (
  SELECT k, list(DISTINCT label) AS more, max(share) AS share FROM s WHERE share >= 0.8 GROUP BY k
)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(found), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (k) LEFT JOIN m USING (k)
"""


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they give again, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE, decode_too=True, keep=400_000, forget=False)  # alone in its job, memory is free for it
    return bpe_digests(out)


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("_items", lambda x: x["item"]))
    return out.select("doc_id", (F.size("_items") > 0).alias("contaminated"), F.size("_items").cast("long").alias("n_items"), items.alias("items"))


#: Fixed by the query's contract.
BASE_RULES = (url_filter.RuleList(("org/", "com/fr/"), "allow"), url_filter.RuleList(("example.org/es/", "example.org/en/1", "com/de/"), "block"))
#: The method's own list, asked where no base rule fits: hosts of adverts, trackers, adult pages and betting, made from
#: name patterns. A list from a file or table goes in its place as another RuleList.
OWN_KINDS = ("ads", "adserver", "banner", "tracker", "pixel", "popunder", "adult", "xxx", "casino", "poker", "betting", "slots")
OWN_FORMS = ("{}-track.example", "{}-x.example", "free-{}.example", "{}1.example", "{}2.example", "my{}.example", "{}-net.example", "{}-hub.example", "top-{}.example", "{}-cdn.example")
OWN_ENDS = ("com", "net", "org", "info", "biz", "io", "co", "site")
OWN_RULES = url_filter.RuleList(tuple(f"{form.format(kind)}.{end}/" for kind in OWN_KINDS for form in OWN_FORMS for end in OWN_ENDS), "block", tier=1)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict for the url of every page."""
    out = url_filter.judge(table(spark, sf_dir, "pages"), [*BASE_RULES, OWN_RULES])
    base = F.col("rule").isin([r for x in BASE_RULES for r in x.rules])
    return out.select("page_id", "host", "path", F.when(base, F.col("rule")).alias("rule"), "verdict")


OP6_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), own(host) AS (
  SELECT replace(f, '{}', k) || '.' || e FROM (VALUES <kinds>) x(k), (VALUES <forms>) y(f), (VALUES <ends>) z(e)
), best AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
  FROM h, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT h.page_id, h.host, h.path, best.rule,
       coalesce(best.verdict, CASE WHEN starts_with(h.path, '/') AND list_has_any((SELECT list(host) FROM own), [array_to_string(string_split(h.host, '.')[-3:], '.')]) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON h.page_id = best.page_id
"""
for _name, _values in (("kinds", OWN_KINDS), ("forms", OWN_FORMS), ("ends", OWN_ENDS)):
    OP6_SQL = OP6_SQL.replace(f"<{_name}>", ", ".join(f"('{v}')" for v in _values))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document; labels are learnt only from rows that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = toxicity.score(docs, toxicity.fit(docs, labels.filter(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)
    return out.withColumn("over_limit", F.col("n_tokens") > 1024)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {"pipeline": pipeline, "op1_html_text": op1_html_text, "op2_license_scan": op2_license_scan, "op3_quality_rules": op3_quality_rules, "op4_bpe": op4_bpe, "op5_decontamination": op5_decontamination, "op6_url_filter": op6_url_filter, "op7_toxicity": op7_toxicity, "op8_substring_dedup": op8_substring_dedup, "op9_simhash": op9_simhash, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    """Ops 1, 3, 4, 5, 7, 8, 9, 10 and the pipeline are tested against brute force, round trips or held-out labels."""
    return {"op2_license_scan": OP2_SQL, "op6_url_filter": OP6_SQL}
