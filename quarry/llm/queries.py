"""Bound queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality_rules as rules
from quarry.llm import url_filter as url
from quarry.llm.bpe import bpe_round_trip, public_vocabulary
from quarry.llm.centroid_clustering import cluster_centroids
from quarry.llm.decontamination import decontaminate
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.language_id import fit_dictionaries, identify_language
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.lm_score import public_pieces, score_documents
from quarry.llm.quality_classifier import classify_quality, fit_classifier
from quarry.llm.sharding import assign_shards
from quarry.llm.voronoi_knn import voronoi_topk
from quarry.llm.whitening import whiten_vectors
from quarry.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form; tested against the tokenizers library."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_round_trip(docs, public_vocabulary(), keep_text=False)
    return coded.select(
        "doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = rules.fit_rules(docs, read_table(spark, sf_dir, "labels"))
    return rules.quality_rules(docs, trees).select(
        "doc_id", *rules.BASE, "base_failed", "kept", "score")


_WORDS = """regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

OP3_SQL = f"""
WITH item AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark
              WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
doc AS (SELECT doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, pos.n, i, item_id FROM pos JOIN win ON pos.k = win.k AND pos.n = win.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


@query("op3_decontamination", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark")).drop("text")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = """
WITH line AS (SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
              FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i
                    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= 20
           GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT line.*, last IS NOT NULL AND doc_id <> last AS gone FROM line LEFT JOIN common USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form that is no all-pairs join; tested against brute force."""
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The host rules of the query, in front of the method's own patterns.
HOST_RULES = [url.host_rule("allow", "org", "/"), url.host_rule("block", "example.org", "/es/"),
              url.host_rule("block", "example.org", "/en/1"), url.host_rule("allow", "com", "/fr/"),
              url.host_rule("block", "com", "/de/")]

OP2_SQL = f"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path,
         lower(coalesce(regexp_extract(url, '://[^?#]*([?][^#]*)', 1), '')) AS query FROM pages),
rules(rule_host, rule_path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
SELECT page_id, host, path,
       (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
        WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
       coalesce((SELECT max_by(action, length(rule_host || rule_path)) FROM rules
                 WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
                CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(url.UNWANTED_WORDS)})($|[.-])')
                       OR regexp_matches(lower(path), '[/._-]({"|".join(url.UNWANTED_PATH_WORDS)})($|[/._-])')
                       OR regexp_matches(query, '[?&]({"|".join(url.UNWANTED_PARAMETERS)})=')
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM parts"""


@query("op2_url_filter", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url.filter_urls(pages, HOST_RULES + url.UNWANTED).select("page_id", "host", "path", "rule", "verdict")


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no CRC-32; tested against brute force."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    return assign_shards(docs, "doc_id", [1.0] * 8, [1.0] * 9, ["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def remainder(id_col: str, n: int):
    """crc32 of the id as text (null: empty), modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op10_lm_score")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DuckDB has no CRC-32; tested against brute force."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_documents(docs, remainder("doc_id", 10) != 0, public_pieces())
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form; tested by held-out accuracy."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_classifier(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    held = docs.withColumn("held_out", remainder("doc_id", 3) == 1)
    return classify_quality(held, model).select("doc_id", "held_out", "score", "predicted")


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form; tested by held-out accuracy."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = fit_dictionaries(docs, remainder("doc_id", 3) != 1)
    held = docs.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "text")
    return identify_language(held, learned).select("doc_id", "held_out", "lang_pred", "score", "rejected")


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
_INTS = "list_transform(embedding, lambda c: floor(256 * c::DOUBLE))"

OP11_SQL = f"""
WITH vec AS (SELECT row_number() OVER () AS uid, vec_id, {_INTS} AS x FROM embeddings WHERE {_FINITE}),
pair AS (SELECT q.uid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
         FROM vec q JOIN vec c ON q.uid <> c.uid WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pair)
WHERE rank <= 5"""


@query("op11_voronoi_topk", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi_topk(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5,
                        lambda c: F.pmod(c, F.lit(50)) == 0)


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL form (eigenvectors); tested against a dense eigendecomposition."""
    return whiten_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def _op13_sql(rounds: int) -> str:
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT uid, min_by(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT v.uid, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM vec v CROSS JOIN c{i} k) GROUP BY uid)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.x, k.x) AS x FROM c{i} k LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM (
    SELECT a.c, p, sum(v.x[p])::BIGINT AS s, count(*) AS n
    FROM a{i} a JOIN vec v USING (uid) CROSS JOIN range(1, 65) r(p) GROUP BY a.c, p) GROUP BY c) m ON m.c = k.c)"""

    steps = ",\n".join(f"{assigned(i)},\n{moved(i)}" for i in range(rounds)) + f",\n{assigned(rounds)}"
    return f"""
WITH vec AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform({_INTS}, lambda c: c::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS c, x FROM (
  SELECT sha256('2:' || vec_id) AS h, x FROM vec ORDER BY h, x LIMIT 40)),
{steps}
SELECT vec_id, a.c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM vec JOIN a{rounds} a USING (uid) JOIN c{rounds} k ON k.c = a.c"""


OP13_SQL = _op13_sql(5)


@query("op13_centroid_clustering", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_centroids(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
