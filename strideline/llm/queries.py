"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideline.llm import ann, bpe, langid, line_dedup, lm_score, mixing, near_dup, runs, secret_scan, token_store, url_filter, vector_join
from strideline.llm.scratch import fresh_path

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("block", "com", "/de/"),
]
#: What the list of unwanted hosts names under each of its domains; their subdomains' pages are unwanted too.
BLOCKED_NAMES, BLOCKED_DOMAINS = ["ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets"], ["example.com", "example.net", "example.org"]
#: First hex digits of the md5 of the hosts, and of the pages (host and path), that stand for the rest of a list of production size.
LISTED_HOSTS, LISTED_PAGES = "01", "0"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Digests of a table's texts with the production vocabulary."""
    return bpe.digests(docs, tokenizer_path())


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = mixing.mix_sources(read_table(spark, sf_dir, "documents")).documents
    return docs.select("doc_id", "size", "source_size", "target", "taken")


def blocked_hosts() -> list[str]:
    """The named hosts of the list."""
    return [f"{n}.{d}" for n in BLOCKED_NAMES for d in BLOCKED_DOMAINS]


def url_list(pages: DataFrame) -> DataFrame:
    """The list (key) that the production cascade encodes: the named hosts, and hosts and pages of the corpus by their md5."""
    rows = url_filter.split_urls(pages).where("host != ''").select("host", "path", F.concat("host", "path").alias("page"))
    first = lambda c: F.substring(F.md5(c), 1, 1)
    hosts = rows.select(F.col("host").alias("key")).where(first("key").isin(*LISTED_HOSTS))
    single = rows.where("path != ''").select(F.col("page").alias("key")).where(first("key").isin(*LISTED_PAGES))
    named = pages.sparkSession.createDataFrame([(h,) for h in blocked_hosts()], "key string")
    return named.union(hosts).union(single).distinct()


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = read_table(spark, sf_dir, "pages")
    return url_filter.judge_urls(pages, URL_RULES, url_list(pages))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checksums read back from a token store of all documents."""
    path = fresh_path(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    return token_store.read_checksums(spark, path)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicates of every document."""
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents")).documents.select("doc_id", "class_id", "class_size", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))
    base, every = secret_scan.joined(F.col("base")), secret_scan.joined(F.col("all"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector whose id is divisible by 20."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and decoded text."""
    return bpe_digests(read_table(spark, sf_dir, "documents"))


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return vector_join.near_vectors(read_table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated-line removal leaves of every document."""
    return line_dedup.digests(read_table(spark, sf_dir, "documents"))


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document."""
    return lm_score.score_documents(read_table(spark, sf_dir, "documents"))


def rewritten(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, a tenth of the documents made periodic from some word on; a null doc_id leaves them."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or n == 0:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words."""
    return runs.digests(runs.text_runs(read_table(spark, sf_dir, "documents"), rewritten))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query of the subpackage by name."""
    own = [op1_mixing, op2_url_filter, op3_token_store, op4_language_id, op5_near_dedup, op6_secret_scan, op7_nearest, op8_bpe, op9_vector_join, op10_line_dedup, op11_lm_score, op12_periodic_runs, pipeline]
    return {f.__name__: f for f in own}


_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

MIXING_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM sized GROUP BY source
), weighed AS (
  SELECT *, ((sid - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM per_source
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), planned AS (
  SELECT *, least(cap::DOUBLE, max(CASE WHEN cap::DOUBLE / weight >= level THEN level END) OVER () * weight) AS target FROM levels
), laid AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, floor(p.target + 0.5)::BIGINT AS quota,
    (sum(s.size) OVER (PARTITION BY p.sid ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS begin_at
  FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (quota // source_size) * size + greatest(0, least(size, quota % source_size - begin_at)) END::BIGINT AS taken
FROM laid
"""

URL_SQL = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosted AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), named AS (
  SELECT page_id, translate(raw_host, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, path FROM hosted
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM named
), listed AS (
  SELECT DISTINCT host AS key FROM named WHERE host <> '' AND md5(host)[1] IN ({", ".join(f"'{c}'" for c in LISTED_HOSTS)})
  UNION SELECT unnest([{", ".join(f"'{h}'" for h in blocked_hosts())}])
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN host <> '' AND path <> '' AND md5(host || path)[1] IN ({", ".join(f"'{c}'" for c in LISTED_PAGES)}) THEN 'block'
  WHEN EXISTS (SELECT 1 FROM listed WHERE host = key OR ends_with(host, '.' || key)) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nth
  FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, {_BLANK}), '{url_filter.UPPER}', '{url_filter.LOWER}') AS line_key FROM lines
), firsts AS (
  SELECT line_key, min(doc_id) AS first_id FROM keyed WHERE length(line_key) >= 10 GROUP BY line_key
), judged AS (
  SELECT k.*, coalesce(f.first_id < k.doc_id, false) AS gone FROM keyed k LEFT JOIN firsts f ON k.line_key = f.line_key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY row_id, doc_id
"""


VECTORS_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
  WHERE len(embedding) = (SELECT len(embedding) FROM embeddings WHERE len(embedding) > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), reached AS (
  SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.vec_id
), least AS (
  SELECT vec_id, min(root) AS component_id FROM reached GROUP BY vec_id
)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least USING (vec_id)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op1_mixing": MIXING_SQL, "op2_url_filter": URL_SQL, "op9_vector_join": VECTORS_SQL, "op10_line_dedup": LINES_SQL}
