"""Bound UDF / UDTF / aggregate queries (ops 126-129) and SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import udf as U
from quarry.functions.embed import DIMS
from quarry.functions.text import sql_tokens
from quarry.operators import retrieval as R
from quarry.operators.windows import seq_index
from quarry.plans import bindings as B
from quarry.plans.q_relational import CENTROIDS_SQL
from quarry.plans.q_retrieval import CHUNK_SQL, DOC_EMB, bm25_ctes
from quarry.plans.q_scalars import PLANTED_SQL, planted
from quarry.plans.q_windows import EMA_ORDER, EMA_SQL, month_segment
from quarry.plans.registry import register
from quarry.sources.tables import Tables


@register("udf_scorer", "WITH " + bm25_ctes(20) + f"""
SELECT b.item_id, b.doc_id,
       round(len(list_intersect(list_distinct({sql_tokens('q.text')}), list_distinct({sql_tokens('d.text')})))
             / sqrt(len(list_distinct({sql_tokens('q.text')}))) - 3.0, 6) AS raw
FROM b_top b JOIN benchmark q USING (item_id) JOIN documents d USING (doc_id)""")
def q_scorer(spark, root):
    t = Tables(spark, root)
    pairs = (R.bm25(t.benchmark, t.documents, k=20, cluster=["lang"]).select("item_id", "doc_id")
             .join(t.benchmark.select("item_id", F.col("text").alias("q")), "item_id")
             .join(t.documents.select("doc_id", F.col("text").alias("d")), "doc_id"))
    scorer = U.make_pair_scorer()
    return pairs.select("item_id", "doc_id", F.round(scorer("q", "d"), 6).alias("raw"))


@register("udf_embedder", "WITH " + DOC_EMB + """
SELECT doc_id, list_transform(vector, lambda x: round(x, 6)) AS vector FROM demb""")
def q_embedder(spark, root):
    d = Tables(spark, root).documents
    d = d.filter(F.size(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"),
                                 lambda x: x != F.lit(""))) > 0)
    emb = U.make_embedder()
    return d.select("doc_id", F.transform(emb("text"), lambda x: F.round(x, 6)).alias("vector"))


def _check_rule(row: dict) -> tuple[str, str]:
    if row["severity"] == "CRITICAL":
        return "FAIL", "critical issue"
    if row["confidence"] < 0.91:
        raise ValueError("low confidence")
    return "PASS", "ok"


@register("udf_checker", B.with_sql(B.CHECKS_SQL) + """
SELECT change_id, agent_no,
       CASE WHEN severity = 'CRITICAL' THEN 'FAIL' WHEN confidence < 0.91 THEN 'ERROR' ELSE 'PASS' END
         AS verdict,
       CASE WHEN severity = 'CRITICAL' THEN 'critical issue'
            WHEN confidence < 0.91 THEN 'ValueError: low confidence' ELSE 'ok' END AS rationale
FROM checks""")
def q_checker(spark, root):
    c = B.checks(Tables(spark, root))
    chk = U.make_checker(_check_rule)
    out = c.select("change_id", "agent_no", chk(F.struct("severity", "confidence")).alias("r"))
    return out.select("change_id", "agent_no", "r.verdict", "r.rationale")


@register("chunk_udtf", CHUNK_SQL)
def q_chunk_udtf(spark, root):
    U.register_udtfs(spark)
    view = _view(Tables(spark, root).documents, "documents", root)
    return spark.sql("SELECT d.doc_id, c.chunk_idx, c.n_tokens, c.text "
                     f"FROM {view} d, LATERAL chunk_udtf(d.text, 1024) c")


def _view(df, name: str, root: str) -> str:
    """A session temp view named after the table and its folder."""
    import hashlib
    v = f"quarry_{name}_{hashlib.md5(root.encode()).hexdigest()[:8]}"
    df.createOrReplaceTempView(v)
    return v


@register("refs_udtf", """
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, refs[pos] AS ref
FROM (SELECT page_id, refs, generate_subscripts(refs, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS refs FROM pages))""")
def q_refs_udtf(spark, root):
    U.register_udtfs(spark)
    view = _view(Tables(spark, root).pages, "pages", root)
    return spark.sql(f"SELECT p.page_id, r.pos, r.ref FROM {view} p, "
                     "LATERAL refs_udtf(p.html, 'href=\"([^\"]*)\"') r")


@register("centroid_udaf", B.with_sql(PLANTED_SQL, CENTROIDS_SQL) + """
SELECT label, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM cent""")
def q_centroid(spark, root):
    p = planted(Tables(spark, root))
    g = p.groupBy("label").agg(U.centroid_agg("vector", DIMS).alias("centroid"))
    return g.select("label", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@register("ema_udaf", B.with_sql(B.AUDITS_SQL, B.JOBS_SQL, EMA_SQL) + """
SELECT category, round(ema, 6) AS ema
FROM (SELECT e.category, e.ema, f.i, max(f.i) OVER (PARTITION BY e.category) AS mi
      FROM ema e JOIN fraud f USING (node, job_id, l_linenumber, l_partkey))
WHERE i = mi""")
def q_ema_udaf(spark, root):
    t = Tables(spark, root)
    a = B.audits(t).join(B.jobs(t).select("job_id", "category"), "job_id")
    a = a.withColumn("x", F.when(F.col("pass"), 0.0).otherwise(1.0))
    idx = seq_index(a, "category", EMA_ORDER, month_segment("audit_ts"), "pos")
    last = idx.groupBy("category").agg(F.max("pos").alias("last"))
    g = idx.join(last, "category").groupBy("category").agg(U.ema_agg("pos", "x", "last", 1000).alias("ema"))
    return g.select("category", F.round("ema", 6).alias("ema"))

