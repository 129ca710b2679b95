"""Bound retrieval queries and their SQL twins (ops 91-104)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import sql_tokens
from quarry.operators import retrieval as R
from quarry.operators.topk import top_k
from quarry.plans.registry import register
from quarry.session import cut_lineage
from quarry.sources.tables import Tables

TOK_DOC = sql_tokens("text")

BM25_SQL = f"""
WITH doc_tok AS (SELECT doc_id, {TOK_DOC} AS toks FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM doc_tok),
q_terms AS (SELECT DISTINCT item_id, t AS term
            FROM (SELECT item_id, unnest({TOK_DOC}) AS t FROM benchmark)),
post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM doc_tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post
       WHERE term IN (SELECT term FROM q_terms) GROUP BY ALL),
dfreq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
scored AS (
  SELECT q.item_id, tf.doc_id,
         sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
             * (tf.tf * 2.2) / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / s.avgdl))) AS score
  FROM q_terms q JOIN dfreq d USING (term) JOIN tf USING (term) CROSS JOIN stats s
  GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id
                                         ORDER BY round(score, 9) DESC, doc_id) AS rank
           FROM scored)
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""


@register("read_table", """
SELECT l_orderkey, l_extendedprice, l_discount FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_returnflag = 'R'""")
def q_read_table(spark, root):
    """Op 1: a typed scan; the filter and the 3-column projection reach the
    Parquet reader (``PushedFilters``, ``ReadSchema`` in the plan)."""
    import datetime as dt
    from quarry.sources.tables import read_table
    li = read_table(spark, root, "lineitem")
    return (li.filter((F.col("l_shipdate") >= F.lit(dt.datetime(1995, 1, 1)).cast("timestamp_ntz"))
                      & (F.col("l_returnflag") == "R"))
            .select("l_orderkey", "l_extendedprice", "l_discount"))


@register("bm25_topk", BM25_SQL)
def q_bm25(spark, root):
    t = Tables(spark, root)
    return R.bm25(t.benchmark, t.documents, k=10, cluster=["lang"])


CHUNK_SQL = f"""
WITH d AS (SELECT doc_id, {TOK_DOC} AS toks FROM documents),
s AS (SELECT doc_id, toks, unnest(generate_series(0, len(toks) - 1, 1024)) AS start
      FROM d WHERE len(toks) > 0)
SELECT doc_id, CAST(start // 1024 AS INTEGER) AS chunk_idx,
       CAST(len(toks[start + 1 : start + 1024]) AS INTEGER) AS n_tokens,
       array_to_string(toks[start + 1 : start + 1024], ' ') AS text
FROM s
"""


@register("chunk", CHUNK_SQL)
def q_chunk(spark, root):
    return R.chunk(Tables(spark, root).documents, size=1024, overlap=0)


POSTINGS_SQL = f"""
WITH post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term
              FROM (SELECT doc_id, {TOK_DOC} AS toks FROM documents)),
tf AS (SELECT term, doc_id, CAST(dl AS INTEGER) AS dl, count(*) AS tf FROM post GROUP BY ALL)
SELECT tf.*, count(*) OVER (PARTITION BY term) AS df FROM tf
"""


@register("postings", POSTINGS_SQL)
def q_postings(spark, root):
    return R.postings(Tables(spark, root).documents)


# ------------------------------------------------------------------ shared CTEs
from quarry.functions.embed import embed_texts, sql_hash_embed  # noqa: E402
from quarry.functions.scalars import approx_tokens  # noqa: E402

DOC_EMB = sql_hash_embed("documents", "doc_id", "text", "demb")
Q_EMB = sql_hash_embed("benchmark", "item_id", "text", "qemb")
HREF_SQL = """'href="([^"]*)"'"""
LANG_RE = r"^[a-z]+://[^/]+/([a-z]{2})/"


def bm25_ctes(k: int, p: str = "b") -> str:
    """BM25 as CTEs ending in ``{p}_top(item_id, rank, doc_id, score)``."""
    return f"""{p}_doc_tok AS (SELECT doc_id, {TOK_DOC} AS toks FROM documents),
{p}_stats AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM {p}_doc_tok),
{p}_q AS (SELECT DISTINCT item_id, t AS term
          FROM (SELECT item_id, unnest({TOK_DOC}) AS t FROM benchmark)),
{p}_post AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}_doc_tok),
{p}_tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM {p}_post
           WHERE term IN (SELECT term FROM {p}_q) GROUP BY ALL),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY term),
{p}_scored AS (
  SELECT q.item_id, tf.doc_id,
         sum(ln(1 + (s.n_docs - d.df + 0.5) / (d.df + 0.5))
             * (tf.tf * 2.2) / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / s.avgdl))) AS score
  FROM {p}_q q JOIN {p}_df d USING (term) JOIN {p}_tf tf USING (term) CROSS JOIN {p}_stats s
  GROUP BY ALL),
{p}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                                     ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}_scored)
            WHERE rank <= {k})"""


def dense_ctes(k: int, p: str = "dn") -> str:
    """Exact cosine top-k of hashed document vectors per benchmark item."""
    return f"""{p}_all AS (
  SELECT q.item_id, d.doc_id,
         list_sum(list_transform(list_zip(q.vector, d.vector), lambda z: z[1] * z[2])) AS score
  FROM qemb q CROSS JOIN demb d),
{p}_top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                                     ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {p}_all)
            WHERE rank <= {k})"""


def _vecs(t: Tables, shared: bool = False):
    """Query and corpus vectors (row-local batched embedder).  With
    ``shared`` (several stages read them) they are written once to the
    shared checkpoint folder - an index table of 64 doubles per text."""
    from quarry.session import cut_lineage
    q = embed_texts(t.benchmark, "item_id", "text")
    d = embed_texts(t.documents, "doc_id", "text")
    return (q, cut_lineage(d)) if shared else (q, d)


@register("dense_topk", "WITH " + ",\n".join([Q_EMB, DOC_EMB, dense_ctes(10)]) + """
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM dn_top""")
def q_dense(spark, root):
    qv, dv = _vecs(Tables(spark, root))
    t = Tables(spark, root)
    out = R.dense_topk(qv, dv, "item_id", "vector", "doc_id", "vector", 10,
                       n_queries=t.benchmark.count(), n_corpus=t.documents.count())
    return out.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


TRIGRAM_SQL = r"""
WITH n AS (SELECT DISTINCT p_name AS name FROM part),
w AS (SELECT name, list_filter(string_split_regex(lower(name), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws
      FROM n),
g AS (SELECT name, list_distinct(flatten(list_transform(ws, lambda wd: list_transform(
               range(1, length('  ' || wd || ' ') - 1), lambda i: substr('  ' || wd || ' ', i, 3)))))
             AS tg FROM w),
g2 AS (SELECT * FROM g WHERE len(tg) > 0)
SELECT a.name AS a, b.name AS b,
       round(len(list_intersect(a.tg, b.tg)) / len(list_distinct(list_concat(a.tg, b.tg))), 6)
         AS similarity
FROM g2 a JOIN g2 b ON a.name < b.name
WHERE len(list_intersect(a.tg, b.tg)) / len(list_distinct(list_concat(a.tg, b.tg))) >= 0.3"""


@register("trigram_similarity", TRIGRAM_SQL)
def q_trigram(spark, root):
    names = Tables(spark, root).part.select("p_name").distinct()
    out = R.trigram_join(names, "p_name", "p_name", 0.3)
    return out.select("a", "b", F.round("similarity", 6).alias("similarity"))


RRF_SQL = "WITH " + ",\n".join([bm25_ctes(20), Q_EMB, DOC_EMB, dense_ctes(20)]) + """,
fused AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS rrf
          FROM (SELECT item_id, doc_id, rank FROM b_top UNION ALL
                SELECT item_id, doc_id, rank FROM dn_top) GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, doc_id) AS rank
       FROM fused)"""


@register("rrf", RRF_SQL + """
SELECT item_id, rank, doc_id, round(rrf, 9) AS rrf FROM fr WHERE rank <= 10""")
def q_rrf(spark, root):
    t = Tables(spark, root)
    qv, dv = _vecs(t)
    lex = R.bm25(t.benchmark, t.documents, k=20, cluster=["lang"])
    den = R.dense_topk(qv, dv, "item_id", "vector", "doc_id", "vector", 20,
                       n_queries=t.benchmark.count(), n_corpus=t.documents.count())
    fused = R.rrf([lex, den], "item_id", "doc_id", k=60)
    top = top_k(fused, "item_id", [F.round("rrf", 12).desc(), F.col("doc_id").asc()], 10)
    return top.select("item_id", "rank", "doc_id", F.round("rrf", 9).alias("rrf"))


@register("hybrid_search", RRF_SQL + f""",
pairs AS (
  SELECT fr.item_id, fr.doc_id, fr.rank AS idx,
         len(list_intersect(list_distinct({sql_tokens('b.text')}), list_distinct({sql_tokens('d.text')})))
           / sqrt(len(list_distinct({sql_tokens('b.text')}))) - 3.0 AS raw
  FROM fr JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE fr.rank <= 20),
s AS (SELECT *, 1.0 / (1.0 + exp(-raw)) AS score FROM pairs)
SELECT item_id, rank, doc_id, idx, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, idx) AS rank FROM s)
WHERE rank <= 5""")
def q_hybrid(spark, root):
    t = Tables(spark, root)
    qv, dv = _vecs(t)
    out = R.hybrid_search(t.benchmark, t.documents, qv, dv, k=5, depth=20)
    return out.select("item_id", "rank", "doc_id", "idx", F.round("score", 6).alias("score"))


@register("community_search", "WITH " + ",\n".join([bm25_ctes(10), Q_EMB, DOC_EMB]) + """,
mv AS (SELECT e.doc_id, d.source, e.vector FROM demb e JOIN documents d USING (doc_id)),
cents AS (SELECT source, list(a ORDER BY pos) AS centroid
          FROM (SELECT source, pos, avg(x) AS a
                FROM (SELECT source, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS pos FROM mv)
                GROUP BY ALL) GROUP BY source),
csim AS (SELECT q.item_id, c.source,
                list_sum(list_transform(list_zip(q.vector, c.centroid), lambda z: z[1] * z[2]))
                / sqrt(list_sum(list_transform(c.centroid, lambda x: x * x))) AS s
         FROM qemb q CROSS JOIN cents c),
topc AS (SELECT item_id, source FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                                      ORDER BY round(s, 9) DESC, source) AS r FROM csim) WHERE r <= 2),
msim AS (SELECT q.item_id, m.doc_id,
                list_sum(list_transform(list_zip(q.vector, m.vector), lambda z: z[1] * z[2])) AS s
         FROM qemb q JOIN topc t ON t.item_id = q.item_id JOIN mv m ON m.source = t.source),
down AS (SELECT item_id, doc_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id
                                      ORDER BY round(s, 9) DESC, doc_id) AS r FROM msim) WHERE r <= 10),
fused AS (SELECT item_id, doc_id, sum(1.0 / (60 + rank)) AS rrf
          FROM (SELECT item_id, doc_id, rank FROM b_top UNION ALL SELECT * FROM down) GROUP BY ALL)
SELECT item_id, rank, doc_id, round(rrf, 9) AS rrf
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf, 12) DESC, doc_id) AS rank
      FROM fused) WHERE rank <= 10""")
def q_community_search(spark, root):
    t = Tables(spark, root)
    qv, dv = _vecs(t, shared=True)
    return R.community_search(t.benchmark, t.documents, qv, dv, "source", k=10, m=2)


PACK_BUDGET = 4096


@register("pack_context", "WITH " + bm25_ctes(10) + f"""
SELECT item_id, rank, doc_id, cum_tokens FROM (
  SELECT b.item_id, b.rank, b.doc_id,
         CAST(sum(greatest(1, length(d.text) // 4)) OVER (PARTITION BY b.item_id ORDER BY b.rank
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens
  FROM b_top b JOIN documents d USING (doc_id))
WHERE cum_tokens <= {PACK_BUDGET}""")
def q_pack(spark, root):
    """Op 99: the ranking goes on until the budget ends it; at most
    ``PACK_BUDGET`` documents of an item reach the window (each costs a token
    or more)."""
    t = Tables(spark, root)
    tokens = approx_tokens("text")
    ranked = R.bm25(t.benchmark, t.documents, cost=tokens, budget=PACK_BUDGET).join(
        t.documents.select("doc_id", tokens.alias("tokens")), "doc_id")
    return R.pack_context(ranked, "item_id", "rank", "tokens", PACK_BUDGET).select(
        "item_id", "rank", "doc_id", "cum_tokens")


PAGE_EDGES_SQL = f"""e AS (SELECT 'page:' || page_id AS a,
                  'path:' || unnest(regexp_extract_all(html, {HREF_SQL}, 1)) AS b, 'href' AS k
           FROM pages),
u AS (SELECT a, b, k FROM e UNION ALL SELECT b, a, k FROM e)"""


def page_edges(t: Tables):
    from quarry.functions.scalars import extract_refs
    p = t.pages
    return p.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"),
                    F.explode(extract_refs("html", r'href="([^"]*)"')).alias("_h"),
                    F.lit("href").alias("kind")).select(
        "src", F.concat(F.lit("path:"), F.col("_h")).alias("dst"), "kind")


def page_lang(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("url", LANG_RE, 1).alias("lang"))


@register("graph_neighbors", "WITH " + PAGE_EDGES_SQL + f""",
seeds AS (SELECT 'page:' || min(page_id) AS node FROM pages
          GROUP BY regexp_extract(url, '{LANG_RE}', 1)),
bfs AS (WITH RECURSIVE r(node, hop) AS (
          SELECT node, 0 FROM seeds
          UNION
          SELECT u.b, r.hop + 1 FROM r JOIN u ON u.a = r.node WHERE r.hop < 2)
        SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node),
deg AS (SELECT a AS node, count(*) AS degree FROM u GROUP BY a)
SELECT node, hop, CASE WHEN hop = 0 THEN NULL ELSE 'href' END AS via, coalesce(degree, 0) AS degree
FROM bfs LEFT JOIN deg USING (node)""")
def q_graph_neighbors(spark, root):
    t = Tables(spark, root)
    seeds = page_lang(t).groupBy("lang").agg(F.min("page_id").alias("p")).select(
        F.concat(F.lit("page:"), F.col("p").cast("string")).alias("node"))
    return R.graph_neighbors(page_edges(t), seeds, 2)


@register("graph_vote", "WITH " + PAGE_EDGES_SQL + f""",
seeds AS (SELECT lang, 'page:' || page_id AS node, 1.0 / r AS score
          FROM (SELECT page_id, lang, row_number() OVER (PARTITION BY lang ORDER BY page_id) AS r
                FROM (SELECT page_id, regexp_extract(url, '{LANG_RE}', 1) AS lang FROM pages))
          WHERE r <= 3),
h1 AS (SELECT s.lang, u.b AS a, sum(s.score) AS s FROM seeds s JOIN u ON u.a = s.node GROUP BY ALL),
h2 AS (SELECT h1.lang, u.b AS node, sum(h1.s) AS votes FROM h1 JOIN u ON u.a = h1.a GROUP BY ALL),
c AS (SELECT * FROM h2 WHERE (lang, node) NOT IN (SELECT lang, node FROM seeds))
SELECT lang, rank, node, round(votes, 6) AS votes
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round(votes, 9) DESC, node) AS rank FROM c)
WHERE rank <= 10""")
def q_graph_vote(spark, root):
    t = Tables(spark, root)
    seeds = top_k(page_lang(t), "lang", [F.col("page_id")], 3, rank_col="r").select(
        "lang", F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("node"),
        (F.lit(1.0) / F.col("r")).alias("score"))
    out = R.graph_vote(seeds, page_edges(t), "lang", 10, hops=2)
    return out.select("lang", "rank", "node", F.round("votes", 6).alias("votes"))


#: An edge joins a document to a name that at most this many documents hold.
RARE_NAME = 5


def name_edges(t: Tables, of=None):
    """Edges document - rare capitalized word; with ``of`` those of its
    documents (``doc_id``) alone, rare among all documents."""
    words = F.regexp_extract_all("text", F.lit(r"(\p{L}+)"), 1)
    names = F.array_distinct(F.filter(words, lambda w: w.rlike(r"^\p{Lu}\p{Ll}+$")))

    def edges(docs):
        return docs.select(F.col("doc_id").cast("string").alias("src"), F.explode(names).alias("dst"))
    rare = edges(t.documents).groupBy("dst").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, RARE_NAME))
    docs = t.documents if of is None else t.documents.join(of, "doc_id", "left_semi")
    return edges(docs).join(rare.select("dst"), "dst", "left_semi")


@register("bridge_orphans", "WITH " + ",\n".join([bm25_ctes(10), DOC_EMB]) + r""",
hits AS (SELECT item_id, doc_id FROM b_top WHERE doc_id IN (SELECT doc_id FROM demb)),
names AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '(\p{L}+)', 1),
                 lambda w: regexp_full_match(w, '\p{Lu}\p{Ll}+')))) AS e FROM documents),
edges AS (SELECT doc_id, e FROM names
          WHERE e IN (SELECT e FROM names GROUP BY e HAVING count(*) BETWEEN 2 AND """ + str(RARE_NAME) + """)),
linked AS (SELECT DISTINCT h.item_id, h.doc_id FROM hits h JOIN edges a USING (doc_id)
           JOIN edges b ON b.e = a.e AND b.doc_id <> a.doc_id
           JOIN hits g ON g.doc_id = b.doc_id AND g.item_id = h.item_id),
orph AS (SELECT item_id, doc_id FROM hits EXCEPT SELECT item_id, doc_id FROM linked),
pairs AS (
  SELECT o.item_id, o.doc_id AS orphan, h.doc_id AS bridge,
         list_sum(list_transform(list_zip(eo.vector, eh.vector), lambda z: z[1] * z[2]))
         / (sqrt(list_sum(list_transform(eo.vector, lambda x: x * x)))
            * sqrt(list_sum(list_transform(eh.vector, lambda x: x * x)))) AS similarity
  FROM orph o JOIN hits h ON h.item_id = o.item_id AND h.doc_id <> o.doc_id
  JOIN demb eo ON eo.doc_id = o.doc_id JOIN demb eh ON eh.doc_id = h.doc_id)
SELECT item_id, orphan, bridge, round(similarity, 6) AS similarity
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, orphan
                                   ORDER BY round(similarity, 9) DESC, bridge) AS r FROM pairs)
WHERE r = 1""")
def q_bridge(spark, root):
    t = Tables(spark, root)
    hits = cut_lineage(R.bm25(t.benchmark, t.documents, k=10, cluster=["lang"]).select("item_id", "doc_id"))
    nodes = hits.select("item_id", F.col("doc_id").cast("string").alias("doc_id"))
    # only they are compared; ten ids a query at most, so the texts stay where they are
    met = F.broadcast(cut_lineage(hits.select("doc_id").distinct()))
    linked = R.linked_hits(nodes, name_edges(t, met), "item_id", "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    dv = embed_texts(t.documents.join(met, "doc_id", "left_semi"), "doc_id", "text")
    out = R.bridge_orphans(hits, linked, dv, "item_id", "doc_id", "vector")
    return out.select("item_id", "orphan", "bridge", F.round("similarity", 6).alias("similarity"))


ROLLUP_CHUNK = 64
ROLLUP_FANOUT = 4


@register("rollup_tree", f"""
WITH d AS (SELECT doc_id, {TOK_DOC} AS toks FROM documents),
ch AS (SELECT doc_id, CAST(start // {ROLLUP_CHUNK} AS BIGINT) AS chunk_idx,
              len(toks[start + 1 : start + {ROLLUP_CHUNK}]) AS n_tokens
       FROM (SELECT doc_id, toks, unnest(generate_series(0, len(toks) - 1, {ROLLUP_CHUNK})) AS start
             FROM d WHERE len(toks) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1),
lv AS (SELECT ch.*, CASE WHEN n.n <= 1 THEN 0
                         ELSE CAST(ceil(ln(n.n) / ln({float(ROLLUP_FANOUT)}) - 1e-9) AS INTEGER) END AS lmax
       FROM ch JOIN n USING (doc_id)),
x AS (SELECT doc_id, chunk_idx, n_tokens, CAST(unnest(generate_series(0, lmax)) AS INTEGER) AS level FROM lv)
SELECT doc_id, level, CAST(chunk_idx // CAST(pow({ROLLUP_FANOUT}, level) AS BIGINT) AS BIGINT) AS node,
       CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_leaves,
       count(DISTINCT CASE WHEN level > 0
                           THEN chunk_idx // CAST(pow({ROLLUP_FANOUT}, level - 1) AS BIGINT) END) AS n_children
FROM x GROUP BY ALL""")
def q_rollup(spark, root):
    ch = R.chunk(Tables(spark, root).documents, size=ROLLUP_CHUNK)
    return R.rollup_tree(ch, "doc_id", "chunk_idx", "n_tokens", ROLLUP_FANOUT)


@register("cooccurrence_edges", r"""
WITH w AS (SELECT doc_id AS doc, unnest(words) AS word, unnest(range(0, len(words))) AS pos
           FROM (SELECT doc_id, regexp_extract_all(text, '(\p{L}+)', 1) AS words FROM documents)),
ent AS (SELECT DISTINCT doc, pos // 64 AS chunk, word AS e FROM w
        WHERE regexp_full_match(word, '\p{Lu}\p{Ll}+')),
dfr AS (SELECT e, count(DISTINCT doc) AS df FROM ent GROUP BY e),
ok AS (SELECT e FROM dfr WHERE df >= 2),
ent2 AS (SELECT * FROM ent WHERE e IN (SELECT e FROM ok))
SELECT x.e AS a, y.e AS b, count(*) AS weight
FROM ent2 x JOIN ent2 y ON x.doc = y.doc AND x.chunk = y.chunk AND x.e < y.e GROUP BY ALL""")
def q_cooc(spark, root):
    return R.cooccurrence_edges(Tables(spark, root).documents, "doc_id", "text")
