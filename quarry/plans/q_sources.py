"""Bound source / sink / state-merge queries (ops 2-12) and SQL twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quarry.functions.scalars import approx_tokens
from quarry.functions.text import sql_tokens, tokens
from quarry.operators.sets import split_by_tokens
from quarry.plans.registry import register
from quarry.sources import ops as O
from quarry.sources.tables import Tables

# ------------------------------------------------------------------ op 2
LOG_LINE_EXPR = ("CASE WHEN event_id % 97 = 0 THEN 'not json ' || props "
                 "ELSE '{\"ts\": ' || CAST(event_id AS STRING) || '.5, \"level\": \"' || upper(event_type) "
                 "|| '\", \"logger\": \"user' || CAST(user_id AS STRING) || '\", \"msg\": \"type ' "
                 "|| event_type || '\", \"exc\": null, ' || substr(props, 2) END")


@register("parse_json_logs", f"""
WITH l AS (SELECT event_id, {LOG_LINE_EXPR} AS line FROM events),
good AS (SELECT * FROM l WHERE left(line, 1) = '{{'),
bad AS (SELECT * FROM l WHERE left(line, 1) <> '{{')
SELECT event_id, TRUE AS ok, TRY_CAST(json_extract_string(line, '$.ts') AS DOUBLE) AS ts,
       json_extract_string(line, '$.level') AS level, json_extract_string(line, '$.logger') AS logger,
       json_extract_string(line, '$.msg') AS msg, json_extract_string(line, '$.exc') AS exc,
       list_sort(list_transform(
         list_filter(json_keys(line), lambda k: k NOT IN ('ts', 'level', 'logger', 'msg', 'exc')),
         lambda k: k || '=' || json_extract_string(line, '$."' || k || '"'))) AS extras
FROM good
UNION ALL
SELECT event_id, FALSE, NULL, NULL, NULL, NULL, NULL, NULL FROM bad""")
def q_logs(spark, root):
    e = Tables(spark, root).events.select("event_id", F.expr(LOG_LINE_EXPR).alias("line"))
    return O.parse_json_logs(e, "line")


BODY_EXPR = ("CASE event_id % 3 WHEN 0 THEN '[' || props || ', ' || props || ']' "
             "WHEN 1 THEN props ELSE '{\"error\": \"boom ' || event_type || '\"}' END")


@register("flatten_json_shapes", f"""
WITH b AS (SELECT event_id, {BODY_EXPR} AS body FROM events),
a AS (SELECT event_id, json_extract(body, '$[*]') AS objs FROM b WHERE left(trim(body), 1) = '['),
ae AS (SELECT event_id, generate_subscripts(objs, 1) - 1 AS pos, unnest(objs) AS o FROM a),
one AS (SELECT event_id, 0 AS pos, CAST(body AS JSON) AS o FROM b WHERE left(trim(body), 1) <> '['),
allo AS (SELECT * FROM ae UNION ALL SELECT * FROM one)
SELECT event_id, CAST(pos AS INTEGER) AS pos,
       CASE WHEN json_extract_string(o, '$.error') IS NOT NULL THEN 'error' ELSE 'ok' END AS status,
       json_extract_string(o, '$.error') AS error, json_extract_string(o, '$.k') AS k
FROM allo""")
def q_shapes(spark, root):
    e = Tables(spark, root).events.select("event_id", F.expr(BODY_EXPR).alias("body"))
    out = O.flatten_json_shapes(e, "body")
    return out.select("event_id", "pos", "status", "error",
                      F.element_at("object", F.lit("k")).alias("k"))


@register("read_blobs", """
SELECT 'lang=' || lang AS prefix, count(*) AS n_rows, count(DISTINCT md5(text)) AS n_texts,
       TRUE AS has_files, TRUE AS has_bytes
FROM documents GROUP BY lang""")
def q_blobs(spark, root):
    """Round trip through the key-prefixed store: documents written under
    ``lang=<x>/`` prefixes, listed back as blobs, and read back as rows.
    Per prefix: rows and distinct texts read back, and whether the blob
    listing found files and bytes there (file counts are Spark's choice)."""
    d = Tables(spark, root).documents.select("doc_id", "lang", "text")
    path = O.write_partitioned(d, O.scratch_path(spark, "documents-by-lang"), ["lang"])
    b = O.read_blobs(spark, path, "*.parquet").groupBy("prefix").agg(
        (F.count(F.lit(1)) > 0).alias("has_files"), (F.sum("length") > 0).alias("has_bytes"))
    back = spark.read.parquet(path).groupBy(F.concat(F.lit("lang="), F.col("lang")).alias("prefix")) \
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.md5("text")).alias("n_texts"))
    return back.join(b, "prefix", "left").select("prefix", "n_rows", "n_texts", "has_files",
                                                 "has_bytes")


# ------------------------------------------------------------------ ops 5, 6
CUTOFF = dt.datetime(2024, 1, 15)
STATUS_EXPR = ("CASE event_type WHEN 'error' THEN 'banned' WHEN 'signup' THEN 'maintenance' "
               "WHEN 'click' THEN 'draining' ELSE 'online' END")
HOST_EXPR = ("CASE WHEN value < 20 THEN '' WHEN value < 30 THEN '  ' "
             "ELSE 'host' || CAST(user_id % 17 AS STRING) END")


def _worker_rows(t):
    return t.events.select("user_id", "ts", F.expr(STATUS_EXPR).alias("status"),
                           F.expr(HOST_EXPR).alias("hostname"))


def _latest_before(t):
    w = _worker_rows(t).filter(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return w.groupBy("user_id").agg(F.max_by(F.struct("ts", "status", "hostname"), "ts").alias("_s")) \
        .select("user_id", "_s.*")


UPSERT_SQL = f"""w AS (SELECT user_id, ts, {STATUS_EXPR} AS status, {HOST_EXPR} AS hostname FROM events),
st AS (SELECT user_id, max(ts) AS ts, arg_max(status, ts) AS status, arg_max(hostname, ts) AS hostname
       FROM w WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
up AS (SELECT user_id, max(ts) AS ts, arg_max(status, ts) AS status, arg_max(hostname, ts) AS hostname
       FROM w WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1)"""


@register("upsert_latest", "WITH " + UPSERT_SQL + """
SELECT user_id, st2 AS status, h2 AS hostname, ts
FROM (SELECT coalesce(s.user_id, u.user_id) AS user_id,
             CASE WHEN s.status IN ('draining', 'maintenance', 'banned') THEN s.status
                  WHEN u.ts IS NOT NULL THEN u.status ELSE s.status END AS st2,
             CASE WHEN u.ts IS NOT NULL THEN nullif(u.hostname, '') ELSE s.hostname END AS h2,
             CASE WHEN u.ts IS NOT NULL THEN u.ts ELSE s.ts END AS ts
      FROM st s FULL OUTER JOIN up u ON s.user_id = u.user_id)""")
def q_upsert(spark, root):
    t = Tables(spark, root)
    state = _latest_before(t)
    upd = _worker_rows(t).filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz"))
    return O.upsert_latest(state, upd, "user_id", "ts", ["status", "hostname"],
                           blank_null=["hostname"]).select("user_id", "status", "hostname", "ts")


BEAT_EXPR = {"kind": "CASE WHEN event_type = 'error' THEN 'offline' ELSE 'beat' END",
             "cpu_pct": "CASE WHEN value > 300 THEN CAST('NaN' AS DOUBLE) ELSE value / 5 END",
             "ram_used_gb": "value / 10",
             "load_avg_1m": "CASE WHEN value < 1 THEN CAST('NaN' AS DOUBLE) ELSE value / 100 END"}


@register("apply_heartbeats", "WITH " + UPSERT_SQL + f""",
beats AS (SELECT user_id, ts, {BEAT_EXPR['kind']} AS kind, {BEAT_EXPR['cpu_pct']} AS cpu_pct,
                 {BEAT_EXPR['ram_used_gb']} AS ram_used_gb, {BEAT_EXPR['load_avg_1m']} AS load_avg_1m
          FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
lb AS (SELECT user_id, max(ts) AS ts, bool_or(kind = 'offline') AS off,
              arg_max(cpu_pct, ts) FILTER (WHERE kind = 'beat') AS cpu_pct,
              arg_max(ram_used_gb, ts) FILTER (WHERE kind = 'beat') AS ram_used_gb,
              arg_max(load_avg_1m, ts) FILTER (WHERE kind = 'beat') AS load_avg_1m
       FROM beats GROUP BY 1)
SELECT s.user_id, CASE WHEN lb.off THEN 'offline' ELSE s.status END AS status,
       coalesce(lb.ts, s.ts) AS last_seen,
       round(CASE WHEN isnan(lb.cpu_pct) THEN NULL ELSE lb.cpu_pct END, 6) AS cpu_pct,
       round(CASE WHEN isnan(lb.ram_used_gb) THEN NULL ELSE lb.ram_used_gb END, 6) AS ram_used_gb,
       round(CASE WHEN isnan(lb.load_avg_1m) THEN NULL ELSE lb.load_avg_1m END, 6) AS load_avg_1m
FROM st s LEFT JOIN lb USING (user_id)""")
def q_heartbeats(spark, root):
    t = Tables(spark, root)
    state = _latest_before(t).withColumnRenamed("ts", "last_seen")
    beats = t.events.filter(F.col("ts") >= F.lit(CUTOFF).cast("timestamp_ntz")).select(
        "user_id", "ts", *[F.expr(v).alias(k) for k, v in BEAT_EXPR.items()])
    out = O.apply_heartbeats(state, beats, "user_id", "ts", ["cpu_pct", "ram_used_gb", "load_avg_1m"])
    return out.select("user_id", "status", "last_seen", F.round("cpu_pct", 6).alias("cpu_pct"),
                      F.round("ram_used_gb", 6).alias("ram_used_gb"),
                      F.round("load_avg_1m", 6).alias("load_avg_1m"))


# ------------------------------------------------------------------ op 7
IMPORT_SQL = """t AS (SELECT o_orderkey, 'target' AS src, o_totalprice FROM orders
      WHERE o_orderdate < TIMESTAMP '1997-01-01'),
i AS (SELECT o_orderkey, 'incoming' AS src, o_totalprice + 1 AS o_totalprice FROM orders
      WHERE o_orderdate >= TIMESTAMP '1996-01-01')"""


def _import_sides(t):
    o = t.orders
    tgt = o.filter(F.col("o_orderdate") < F.lit(dt.datetime(1997, 1, 1)).cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("target").alias("src"), "o_totalprice")
    inc = o.filter(F.col("o_orderdate") >= F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz")).select(
        "o_orderkey", F.lit("incoming").alias("src"), (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return tgt, inc


@register("import_idempotent", "WITH " + IMPORT_SQL + """
SELECT * FROM t UNION ALL SELECT * FROM i WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)""")
def q_import(spark, root):
    tgt, inc = _import_sides(Tables(spark, root))
    return O.import_idempotent(tgt, inc, "o_orderkey", force=False)


@register("import_force", "WITH " + IMPORT_SQL + """
SELECT * FROM t WHERE o_orderkey NOT IN (SELECT o_orderkey FROM i) UNION ALL SELECT * FROM i""")
def q_import_force(spark, root):
    tgt, inc = _import_sides(Tables(spark, root))
    return O.import_idempotent(tgt, inc, "o_orderkey", force=True)


# ------------------------------------------------------------------ op 8
@register("write_manifest", f"""
WITH s AS (
  SELECT doc_id, {sql_tokens('text')} AS toks,
         CASE WHEN cum - tok < 5000 THEN 'test' WHEN cum - tok < 10000 THEN 'val' ELSE 'train' END AS split
  FROM (SELECT doc_id, text, greatest(1, length(text) // 4) AS tok,
               sum(greatest(1, length(text) // 4)) OVER (PARTITION BY source ORDER BY doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM documents)),
v AS (SELECT split, count(DISTINCT t) AS vocab_size FROM (SELECT split, unnest(toks) AS t FROM s) GROUP BY 1)
SELECT split, count(*) AS n_docs, CAST(sum(len(toks)) AS BIGINT) AS tokens,
       coalesce(any_value(v.vocab_size), 0) AS vocab_size
FROM s LEFT JOIN v USING (split) GROUP BY split""")
def q_manifest(spark, root):
    d = Tables(spark, root).documents.withColumn("tok", approx_tokens("text"))
    s = split_by_tokens(d.select("doc_id", "source", "tok"), "source", ["doc_id"], "tok", 5000, 5000)
    s = s.join(d.select("doc_id", tokens("text").alias("toks")), "doc_id")
    return O.write_manifest(s, "split", "toks")


# ------------------------------------------------------------------ op 10
@register("chunked_backfill", """
WITH b AS (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events),
w AS (SELECT unnest(generate_series(lo, hi, 1000)) AS window_start, lo FROM b),
e AS (SELECT (event_id - (SELECT lo FROM b)) // 1000 AS wi, count(*) AS n_events,
             min(event_id) AS first_height, max(event_id) AS last_height FROM events GROUP BY 1)
SELECT w.window_start, w.window_start + 999 AS window_end, coalesce(e.n_events, 0) AS n_events,
       e.first_height, e.last_height
FROM w LEFT JOIN e ON e.wi = (w.window_start - w.lo) // 1000""")
def q_backfill(spark, root):
    return O.chunked_backfill(Tables(spark, root).events, "event_id", 1000)


# ------------------------------------------------------------------ ops 11, 12
SNAP_SQL = """src AS (SELECT doc_id, source, text FROM documents),
dst AS (SELECT doc_id, source, CASE WHEN lang = 'de' THEN text || '!' ELSE text END AS text
        FROM documents WHERE source <> 'src3'
        UNION ALL SELECT item_id + 1000000000, 'benchmark', text FROM benchmark)"""


def _snapshots(t):
    d = t.documents
    src = d.select("doc_id", "source", "text")
    dst = d.filter(F.col("source") != "src3").select(
        "doc_id", "source", F.when(F.col("lang") == "de", F.concat("text", F.lit("!")))
        .otherwise(F.col("text")).alias("text"))
    dst = dst.unionByName(t.benchmark.select((F.col("item_id") + 1000000000).alias("doc_id"),
                                             F.lit("benchmark").alias("source"), "text"))
    return src, dst


@register("diff_snapshots", "WITH " + SNAP_SQL + """
SELECT coalesce(s.doc_id, d.doc_id) AS doc_id,
       CASE WHEN d.doc_id IS NULL THEN 'add' WHEN s.doc_id IS NULL THEN 'delete'
            WHEN md5(s.text) <> md5(d.text) THEN 'update' ELSE 'same' END AS action
FROM src s FULL OUTER JOIN dst d ON s.doc_id = d.doc_id""")
def q_diff(spark, root):
    src, dst = _snapshots(Tables(spark, root))
    fp = F.md5("text")
    return O.diff_snapshots(src.withColumn("fp", fp), dst.withColumn("fp", fp), "doc_id", "fp")


@register("copy_parity", "WITH " + SNAP_SQL + """,
a AS (SELECT source, count(*) AS n_src, CAST(sum(strlen(text)) AS BIGINT) AS bytes_src FROM src GROUP BY 1),
b AS (SELECT source, count(*) AS n_dst, CAST(sum(strlen(text)) AS BIGINT) AS bytes_dst FROM dst GROUP BY 1)
SELECT coalesce(a.source, b.source) AS source, n_src, bytes_src, n_dst, bytes_dst,
       n_src IS NOT DISTINCT FROM n_dst AND bytes_src IS NOT DISTINCT FROM bytes_dst AS parity
FROM a FULL OUTER JOIN b ON a.source = b.source""")
def q_parity(spark, root):
    src, dst = _snapshots(Tables(spark, root))
    size = F.octet_length("text").cast("long")
    return O.copy_parity(src.withColumn("size", size), dst.withColumn("size", size), "source", "size")
