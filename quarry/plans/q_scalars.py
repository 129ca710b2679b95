"""Bound scalar queries (ops 13-34) and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import scalars as S
from quarry.plans import bindings as B
from quarry.plans.registry import register
from quarry.sources.tables import Tables


def r6(c):
    return F.round(c, 6)


def vec6(c):
    return F.transform(c, lambda x: F.round(x, 6))


# ------------------------------------------------------------------ planted vectors
def planted_raw(t: Tables):
    e = t.embeddings
    lab = F.col("label")

    def bump(x, i):
        return (F.lit(0.3) * x.cast("double")
                + F.when(i == F.floor(lab / 5), 1.0).otherwise(0.0)
                + F.when(i == F.lit(10) + F.floor(lab / 2), 0.5).otherwise(0.0)
                + F.when(i == F.lit(20) + lab, 0.35).otherwise(0.0))

    return e.select("vec_id", "label", F.transform("embedding", bump).alias("v"))


def planted(t: Tables):
    """FIXTURES planted vectors: clustered by label, unit norm."""
    return planted_raw(t).select("vec_id", "label", S.l2_normalize("v").alias("vector"))


PLANTED_RAW_SQL = """planted_raw AS (
  SELECT vec_id, label,
         list_transform(embedding, lambda x, i: 0.3 * CAST(x AS DOUBLE)
            + CASE WHEN i - 1 = label // 5 THEN 1.0 ELSE 0.0 END
            + CASE WHEN i - 1 = 10 + label // 2 THEN 0.5 ELSE 0.0 END
            + CASE WHEN i - 1 = 20 + label THEN 0.35 ELSE 0.0 END) AS v
  FROM embeddings)"""

PLANTED_SQL = PLANTED_RAW_SQL + """,
planted AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / nrm) AS vector
  FROM (SELECT *, CASE WHEN sqrt(list_sum(list_transform(v, lambda x: x * x))) = 0 THEN 1.0
                       ELSE sqrt(list_sum(list_transform(v, lambda x: x * x))) END AS nrm
        FROM planted_raw))"""


@register("l2_normalize", B.with_sql(PLANTED_SQL) +
          "SELECT vec_id, list_transform(vector, lambda x: round(x, 6)) AS vector FROM planted")
def q_l2(spark, root):
    return planted(Tables(spark, root)).select("vec_id", vec6(F.col("vector")).alias("vector"))


@register("truncate_dims", B.with_sql(PLANTED_SQL) + """
SELECT vec_id, list_transform(list_transform(v16, lambda x: x / n16), lambda x: round(x, 6)) AS vector
FROM (SELECT vec_id, vector[1:16] AS v16,
             CASE WHEN sqrt(list_sum(list_transform(vector[1:16], lambda x: x * x))) = 0 THEN 1.0
                  ELSE sqrt(list_sum(list_transform(vector[1:16], lambda x: x * x))) END AS n16
      FROM planted)""")
def q_trunc(spark, root):
    p = planted(Tables(spark, root))
    return p.select("vec_id", vec6(S.truncate_dims("vector", 16)).alias("vector"))


@register("cosine", """
SELECT a.vec_id AS a_id, b.vec_id AS b_id,
       round(list_sum(list_transform(list_zip(a.embedding, b.embedding),
                                     lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))
             / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
                * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6)
         AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def q_cosine(spark, root):
    e = Tables(spark, root).embeddings
    a = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("ea"))
    b = e.select((F.col("vec_id") - 1).alias("a_id"), F.col("vec_id").alias("b_id"),
                 F.col("embedding").alias("eb"))
    return a.join(b, "a_id").select("a_id", "b_id", r6(S.cosine("ea", "eb")).alias("cosine"))


TAU_SQL = """
WITH items AS (
  SELECT l_orderkey, l_extendedprice AS a, l_quantity AS b,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i
  FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n_items FROM items GROUP BY 1),
p AS (SELECT x.l_orderkey, sum(sign(x.a - y.a) * sign(x.b - y.b)) AS s
      FROM items x JOIN items y ON x.l_orderkey = y.l_orderkey AND x.i < y.i GROUP BY 1)
SELECT n.l_orderkey, n.n_items,
       CASE WHEN n.n_items < 2 THEN 'nan'::DOUBLE
            ELSE round(coalesce(p.s, 0) / (n.n_items * (n.n_items - 1) / 2.0), 6) END AS tau
FROM n LEFT JOIN p USING (l_orderkey)"""


@register("kendall_tau", TAU_SQL)
def q_tau(spark, root):
    li = Tables(spark, root).lineitem
    lists = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))).alias("xs"))
    a = F.transform("xs", lambda s: s["l_extendedprice"])
    b = F.transform("xs", lambda s: s["l_quantity"])
    return lists.select("l_orderkey", F.size("xs").cast("long").alias("n_items"),
                        r6(S.kendall_tau(a, b)).alias("tau"))


@register("clip_text", """
SELECT doc_id, CAST(length(c) AS INTEGER) AS clipped_chars, md5(c) AS clipped_md5
FROM (SELECT doc_id, substring(text, 1, 32768) AS c FROM documents)""")
def q_clip(spark, root):
    d = Tables(spark, root).documents
    c = S.clip_text("text", 8192)
    return d.select("doc_id", F.length(c).alias("clipped_chars"), F.md5(c).alias("clipped_md5"))


@register("approx_tokens", """
SELECT doc_id, greatest(1, length(text) // 4)::BIGINT AS approx_tokens FROM documents""")
def q_approx(spark, root):
    d = Tables(spark, root).documents
    return d.select("doc_id", S.approx_tokens("text").alias("approx_tokens"))


@register("approx_tokens_batch", """
SELECT source, sum(greatest(1, length(text) // 4))::BIGINT AS usage_tokens, count(*) AS n_inputs
FROM documents GROUP BY source""")
def q_approx_batch(spark, root):
    d = Tables(spark, root).documents
    return d.groupBy("source").agg(F.sum(S.approx_tokens("text")).cast("long").alias("usage_tokens"),
                                   F.count(F.lit(1)).alias("n_inputs"))


MODEL_BY_CONV = ("CASE conv_id % 3 WHEN 0 THEN 'Qwen3-Embedding-0.6B' "
                 "WHEN 1 THEN 'BAAI/bge-m3' ELSE 'Octen-Embedding-8B' END")
_INSTR_SQL = S.QUERY_INSTRUCTION.replace("'", "''")


@register("query_prefix", f"""
SELECT conv_id, turn, length(p)::INTEGER AS n_chars, md5(p) AS text_md5
FROM (SELECT conv_id, turn,
             CASE WHEN role = 'user' AND (instr(lower({MODEL_BY_CONV}), 'qwen3') > 0
                                          OR instr(lower({MODEL_BY_CONV}), 'octen') > 0)
                  THEN '{_INSTR_SQL}' || text ELSE text END AS p
      FROM conversations)""")
def q_prefix(spark, root):
    c = Tables(spark, root).conversations
    model = F.expr(MODEL_BY_CONV)
    itype = F.when(F.col("role") == "user", "query").otherwise("passage")
    p = S.query_prefix("text", model, itype)
    return c.select("conv_id", "turn", F.length(p).alias("n_chars"), F.md5(p).alias("text_md5"))


@register("sigmoid", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(1.0 / (1.0 + exp(-(l_quantity / 10.0 - 2.5))), 6) AS score FROM lineitem""")
def q_sigmoid(spark, root):
    li = Tables(spark, root).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     r6(S.sigmoid(F.col("l_quantity") / 10.0 - 2.5)).alias("score"))


@register("gwei_wei", B.with_sql(B.JOBS_SQL) + """
SELECT job_id, wei, CAST(CAST(wei AS HUGEINT) // 1000000000 AS BIGINT) AS gwei,
       CAST(round(least(greatest(frac, 0.0), 1.0) * 10000) AS INTEGER) AS bps
FROM (SELECT job_id, CAST(value AS DECIMAL(38,0)) * CAST(1000000000 AS DECIMAL(38,0)) AS wei,
             (job_id % 97) / 96.0 AS frac FROM jobs)""")
def q_gwei(spark, root):
    j = B.jobs(Tables(spark, root))
    wei = S.gwei_to_wei("value")
    return j.select("job_id", wei.alias("wei"), S.wei_to_gwei(wei).alias("gwei"),
                    S.float_to_bps((F.col("job_id") % 97) / 96.0).alias("bps"))


@register("split_slash", B.with_sql(B.JOBS_SQL, B.JOB_WORKERS_SQL, B.AUDITS_SQL) + """,
outc AS (SELECT a.job_id, max(a.severity) AS severity
         FROM audits a JOIN job_workers w ON w.job_id = a.job_id AND w.worker = a.node GROUP BY 1),
f AS (SELECT j.job_id, j.value * 10 AS locked,
             CASE WHEN severity IS NULL OR severity <= 0 THEN 0.0 WHEN severity < 0.3 THEN severity
                  WHEN severity < 0.7 THEN 0.5 + severity / 2 ELSE 1.0 END AS fr
      FROM jobs j JOIN outc USING (job_id))
SELECT job_id, CAST(round(locked * fr) AS BIGINT) AS slashed,
       locked - CAST(round(locked * fr) AS BIGINT) AS returned FROM f""")
def q_slash(spark, root):
    """Stake (value x 10) of every job split by the slash fraction of its
    worst audit of the worker."""
    t = Tables(spark, root)
    w = B.job_workers(t).select("job_id", F.col("worker").alias("node"))
    outc = B.audits(t).join(w, ["job_id", "node"]).groupBy("job_id").agg(
        F.max("severity").alias("severity"))
    j = B.jobs(t).join(outc, "job_id").withColumn("locked", F.col("value") * 10)
    slashed, returned = S.split_slash("locked", S.slash_fraction("severity"))
    return j.select("job_id", slashed.alias("slashed"), returned.alias("returned"))


TAX_RATES = "(job_id % 5) * 0.01", "(job_id % 7) * 0.08"


@register("split_tax", B.with_sql(B.JOBS_SQL) + f"""
SELECT job_id, network_tax, pool_tax, value - network_tax - pool_tax AS paid,
       CASE WHEN nr + pr > 0.5 THEN 'tax_cap_exceeded'
            WHEN value - network_tax - pool_tax <= 0 THEN 'tax_rates_too_high' ELSE 'ok' END AS status
FROM (SELECT job_id, value, nr, pr, CAST(round(value * nr) AS BIGINT) AS network_tax,
             CAST(round(value * pr) AS BIGINT) AS pool_tax
      FROM (SELECT job_id, value, CAST({TAX_RATES[0]} AS DOUBLE) AS nr,
                   CAST({TAX_RATES[1]} AS DOUBLE) AS pr FROM jobs))""")
def q_tax(spark, root):
    j = B.jobs(Tables(spark, root))
    out = S.split_tax("value", F.expr(TAX_RATES[0]).cast("double"),
                      F.expr(TAX_RATES[1]).cast("double"))
    return j.select("job_id", *[v.alias(k) for k, v in out.items()])


@register("split_tax_bps", B.with_sql(B.JOBS_SQL) + """
SELECT job_id, tax, CAST(gross - tax AS DECIMAL(38,0)) AS net
FROM (SELECT job_id, gross,
             CAST(CAST(gross AS HUGEINT) * (job_id % 1000) // 10000 AS DECIMAL(38,0)) AS tax
      FROM (SELECT job_id, CAST(value AS DECIMAL(38,0)) * CAST(1000000000 AS DECIMAL(38,0)) AS gross
            FROM jobs))""")
def q_tax_bps(spark, root):
    j = B.jobs(Tables(spark, root))
    out = S.split_tax_bps(S.gwei_to_wei("value"), F.col("job_id") % 1000)
    return j.select("job_id", *[v.alias(k) for k, v in out.items()])


SIM_EXPR = "(1.0 - l_discount * l_tax * 10)"


@register("severity", B.with_sql(B.JOBS_SQL) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(greatest(0.0, (thr - sim) / thr), 6) AS severity
FROM (SELECT l.*, {SIM_EXPR} AS sim,
             CASE WHEN j.category = 'rerank' THEN 0.95 WHEN j.precision = 'fp32' THEN 0.9999
                  WHEN j.precision = 'fp16' THEN 0.999 ELSE 0.99 END AS thr
      FROM lineitem l JOIN jobs j ON j.job_id = l.l_orderkey)""")
def q_severity(spark, root):
    t = Tables(spark, root)
    j = B.jobs(t).select(F.col("job_id").alias("l_orderkey"), "category", "precision")
    li = t.lineitem.join(j, "l_orderkey")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     r6(S.severity(F.expr(SIM_EXPR), S.audit_threshold("category", "precision")))
                     .alias("severity"))


@register("slash_fraction", B.with_sql(B.AUDITS_SQL) + """
SELECT node, job_id, l_linenumber, l_partkey,
       round(CASE WHEN severity IS NULL OR severity <= 0 THEN 0.0 WHEN severity < 0.3 THEN severity
                  WHEN severity < 0.7 THEN 0.5 + severity / 2 ELSE 1.0 END, 6) AS fraction
FROM audits""")
def q_slash_fraction(spark, root):
    a = B.audits(Tables(spark, root))
    return a.select("node", "job_id", "l_linenumber", "l_partkey",
                    r6(S.slash_fraction("severity")).alias("fraction"))


@register("audit_threshold", B.with_sql(B.JOBS_SQL) + """
SELECT job_id, category, precision,
       CASE WHEN category = 'rerank' THEN 0.95::DOUBLE WHEN precision = 'fp32' THEN 0.9999::DOUBLE
            WHEN precision = 'fp16' THEN 0.999::DOUBLE WHEN precision = 'int8' THEN 0.99::DOUBLE
       END AS threshold
FROM jobs""")
def q_threshold(spark, root):
    j = B.jobs(Tables(spark, root))
    return j.select("job_id", "category", "precision",
                    S.audit_threshold("category", "precision").alias("threshold"))


HREF_RE = r'href="([^"]*)"'
EXT_CASE = "CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in S.EXT_LANGUAGE.items()) + " ELSE 'unknown' END"


# Changed files derived from part rows: a directory from the size (tests/,
# scripts/, systemd/ or the part type), a file name from the part name (main,
# Dockerfile, config, docker-compose, test_ prefixes and _test / .spec
# suffixes by size residues) and an extension cycling through the language
# table plus two unknown ones.  Plus the link targets and URL paths of pages.
_EXTS = list(S.EXT_LANGUAGE) + ["md", "txt"]
FILE_PATH_SQL = (
    "CASE p_size % 9 WHEN 0 THEN 'tests/' WHEN 1 THEN 'scripts/' WHEN 2 THEN 'systemd/' "
    "ELSE lower(p_type) || '/' END || "
    "CASE WHEN p_size % 17 = 0 THEN 'main.go' WHEN p_size % 19 = 0 THEN 'Dockerfile' "
    "WHEN p_size % 23 = 0 THEN 'config.yaml' WHEN p_size % 29 = 0 THEN 'docker-compose.yml' "
    "ELSE CASE WHEN p_partkey % 13 = 0 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') || "
    "CASE WHEN p_partkey % 7 = 0 THEN '_test' WHEN p_partkey % 11 = 0 THEN '.spec' ELSE '' END "
    f"|| '.' || list_extract([{', '.join(repr(x) for x in _EXTS)}], "
    f"CAST(p_partkey % {len(_EXTS)} AS INTEGER) + 1) END")


def file_path():
    """``FILE_PATH_SQL`` as a column over ``part``."""
    return F.expr(FILE_PATH_SQL.replace(
        f"list_extract([{', '.join(repr(x) for x in _EXTS)}], "
        f"CAST(p_partkey % {len(_EXTS)} AS INTEGER) + 1)",
        f"element_at(array({', '.join(repr(x) for x in _EXTS)}), "
        f"CAST(p_partkey % {len(_EXTS)} AS INT) + 1)"))


@register("classify_path", f"""
SELECT DISTINCT path, regexp_matches(path, '{S.TEST_FILE_RE}') AS is_test,
       regexp_matches(path, '{S.CRITICAL_FILE_RE}') AS is_critical, {EXT_CASE} AS language
FROM (SELECT {FILE_PATH_SQL} AS path FROM part
      UNION ALL SELECT unnest(regexp_extract_all(html, '{HREF_RE}', 1)) FROM pages
      UNION ALL SELECT regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) FROM pages)""")
def q_classify(spark, root):
    t = Tables(spark, root)
    p = t.pages
    files = t.part.select(file_path().alias("path"))
    paths = files.unionAll(p.select(F.explode(S.extract_refs("html", HREF_RE)).alias("path"))) \
        .unionAll(p.select(F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1).alias("path")))
    cls = S.classify_path("path")
    return paths.select("path", *[v.alias(k) for k, v in cls.items()]).distinct()


@register("complexity_level", B.with_sql(B.CHECKS_SQL) + """
SELECT change_id, score, CASE WHEN score < 50 THEN 1 WHEN score < 150 THEN 2
                              WHEN score < 300 THEN 3 ELSE 4 END AS level
FROM (SELECT change_id, CAST(sum(lines) + 5 * count(*) + 10 * count(*) FILTER (WHERE verdict = 'FAIL')
             AS BIGINT) AS score FROM checks GROUP BY change_id)""")
def q_complexity(spark, root):
    c = B.checks(Tables(spark, root))
    g = c.groupBy("change_id").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("files"),
                                   F.count_if(F.col("verdict") == "FAIL").alias("funcs"))
    return g.select("change_id", S.complexity_score("lines", "files", "funcs").alias("score"),
                    S.complexity_level("lines", "files", "funcs").alias("level"))


def verdict_text_spark(c):
    return F.concat(F.lit("VERDICT: "), c.verdict, F.lit("\nCONFIDENCE: "),
                    c.confidence.cast("string"), F.lit("\nSEVERITY: "), c.severity,
                    F.lit("\nRATIONALE: part "), c.l_partkey.cast("string"))


@register("parse_verdict", B.with_sql(B.CHECKS_SQL) + """
SELECT change_id, agent_no,
       upper(nullif(regexp_extract(t, '(?m)^\\s*VERDICT:\\s*([A-Za-z_]+)\\s*$', 1), '')) AS verdict,
       TRY_CAST(nullif(regexp_extract(t, '(?m)^\\s*CONFIDENCE:\\s*([0-9.]+)\\s*$', 1), '') AS DOUBLE)
         AS confidence,
       upper(nullif(regexp_extract(t, '(?m)^\\s*SEVERITY:\\s*([A-Za-z_]+)\\s*$', 1), '')) AS severity,
       nullif(regexp_extract(t, '(?m)^\\s*RATIONALE:\\s*(.*?)\\s*$', 1), '') AS rationale
FROM (SELECT change_id, agent_no, 'VERDICT: ' || verdict || chr(10) || 'CONFIDENCE: '
             || CAST(confidence AS VARCHAR) || chr(10) || 'SEVERITY: ' || severity || chr(10)
             || 'RATIONALE: part ' || CAST(l_partkey AS VARCHAR) AS t FROM checks)""")
def q_verdict(spark, root):
    c = B.checks(Tables(spark, root))
    t = verdict_text_spark(c)
    v = S.parse_verdict(t)
    return c.select("change_id", "agent_no", *[x.alias(k) for k, x in v.items()])


@register("image_tag", """
SELECT page_id, CASE WHEN url IS NULL OR url = '' THEN '' WHEN instr(url, ':') = 0 THEN '<no-tag>'
                     ELSE regexp_extract(url, '[^:]*$', 0) END AS tag FROM pages""")
def q_image_tag(spark, root):
    p = Tables(spark, root).pages
    return p.select("page_id", S.image_tag("url").alias("tag"))


@register("extract_refs", f"""
SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, refs[pos] AS ref
FROM (SELECT page_id, refs, generate_subscripts(refs, 1) AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '{HREF_RE}', 1) AS refs FROM pages))""")
def q_refs(spark, root):
    p = Tables(spark, root).pages
    return p.select("page_id", F.posexplode(S.extract_refs("html", HREF_RE)).alias("pos", "ref"))


@register("bib_key", f"""
SELECT doc_id,
       coalesce(CASE WHEN lower(trim(d)) <> '' THEN 'doi:' || lower(trim(d)) END,
                CASE WHEN lower(trim(a)) <> '' THEN 'arxiv:' || lower(trim(a)) END,
                {S.sql_title_key('title')}) AS bib_key
FROM (SELECT doc_id, split_part(text, chr(10), 1) AS title,
             regexp_extract(text, '{S.DOI_RE}', 1) AS d, regexp_extract(text, '{S.ARXIV_RE}', 1) AS a
      FROM documents)""")
def q_bib(spark, root):
    d = Tables(spark, root).documents
    title = F.substring_index("text", "\n", 1)
    key = S.bib_key(F.regexp_extract("text", S.DOI_RE, 1), F.regexp_extract("text", S.ARXIV_RE, 1),
                    title)
    return d.select("doc_id", key.alias("bib_key"))
