"""Retrieval and RAG operators (ops 91-104).

Every operator keeps the corpus distributed: documents are tokenized and
exploded on the executors, statistics are partial aggregates, and per-query
top-k is a ``row_number`` filter whose partial ``WindowGroupLimit`` runs
before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.operators import lexical_index
from quarry.operators.adjacency import Adjacency
from quarry.operators.topk import positions, top_k
from quarry.sources.ops import scratch_path


# ---------------------------------------------------------------- chunking
def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          size: int = 1024, overlap: int = 0) -> DataFrame:
    """Op 91: documents -> ordered chunks of ``size`` word tokens.

    Consecutive chunks start ``size - overlap`` tokens apart.  A document
    with no token yields no chunk.  Runs row-locally (no shuffle).
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("need size > 0 and 0 <= overlap < size")
    step = size - overlap
    toks = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    n = F.size("toks")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    out = toks.select("doc_id", "toks", F.posexplode(starts).alias("chunk_idx", "start"))
    piece = F.slice("toks", F.col("start") + 1, size)
    return out.select("doc_id", "chunk_idx", F.size(piece).alias("n_tokens"),
                      F.array_join(piece, " ").alias("text"))


# ---------------------------------------------------------------- postings
def doc_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, term) one row per token occurrence; dl is the token count."""
    t = docs.select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("toks"))
    return t.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))


def corpus_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: number of documents and average token length."""
    from quarry.functions.text import token_count
    return docs.select(token_count(text_col).alias("dl")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Op 92: inverted index rows ``term, doc_id, tf, dl, df``.

    Taken from the block index: a term's postings of one document range are
    one row until the document frequency has joined, so a term that every
    document holds meets it in one row per block, not per document.
    """
    index = lexical_index.build_index(docs, id_col, text_col)
    head = F.explode(F.arrays_zip("terms", "counts")).alias("h")
    df_ = (index.select(head).groupBy(F.col("h.terms").alias("term"))
           .agg(F.sum("h.counts").alias("df")))
    rows = lexical_index.open_postings(index).join(df_, "term")
    return (rows.select("term", "df", F.explode(F.arrays_zip("ids", "tfs", "lens")).alias("p"))
            .select("term", F.col("p.ids").alias("doc_id"), F.col("p.lens").alias("dl"),
                    F.col("p.tfs").cast("long").alias("tf"), "df"))


# ---------------------------------------------------------------- BM25
def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75,
         qid_col: str = "item_id", qtext_col: str = "text",
         id_col: str = "doc_id", text_col: str = "text", cluster: Sequence[str] = (),
         cost: Column | None = None, budget: int | None = None) -> DataFrame:
    """Op 93: Okapi BM25 top-k documents per query, from a block index that
    skips blocks below the current k-th score
    (:mod:`quarry.operators.lexical_index`; ``cluster``: columns by which the
    documents are put in order for it).

    With ``cost`` (a whole number of at least 1 per document) and ``budget``
    the ranking is not cut at ``k``: it holds every document whose running
    cost, in rank order, is at most ``budget`` (and some that follow).

    idf = ln(1 + (N - df + 0.5) / (df + 0.5)); each distinct query term
    counts once.  Plan with a budget, where no k-th score bounds the ranking:
    1. postings restricted to the query vocabulary (a broadcast semi join
       right after the explode, so only those terms are aggregated and
       shuffled), tf per (doc, term) as a partial aggregate, df per term;
    2. doc-side weights tf(k1+1)/(tf + k1(1-b+b dl/avgdl)) and query-side
       weights idf(term);
    3. scoring as a blocked sparse matrix product (:func:`sparse_topk`) - a
       term shared by most queries and most documents ("the") is never
       expanded into all (query, document) pairs the way a join on the term
       would.
    Output: qid, rank, doc_id, score (score rounded to 6 digits, ranking on
    9 digits then doc_id so engines agree on ties).
    """
    if budget is None:
        index = lexical_index.build_index(docs, id_col, text_col, cluster)
        found = lexical_index.search(index, queries, k, k1, b, qid_col, qtext_col)
        return rank_scores(found, "qid", k).withColumnRenamed("qid", qid_col)
    qterms = (queries.select(F.col(qid_col).alias("qid"), F.explode(tokens(qtext_col)).alias("term"))
              .distinct())
    vocab = qterms.select("term").distinct()
    stats = corpus_stats(docs, id_col, text_col).select(F.struct("n_docs", "avgdl")).scalar()
    n_docs, avgdl = stats["n_docs"], stats["avgdl"]
    # postings of the query vocabulary, read by two consumers (df and the doc
    # weights): written once to the shared checkpoint folder (an index
    # table), so the corpus is tokenized once and a lost executor re-reads
    # the index instead of re-tokenizing
    from quarry.session import cut_lineage
    tf = cut_lineage(doc_terms(docs, id_col, text_col).join(vocab, "term", "left_semi")
                     .groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")))
    dfreq = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf_part = (F.col("tf") * (k1 + 1)) / (
        F.col("tf") + k1 * (F.lit(1.0 - b) + b * F.col("dl") / avgdl))
    qside = qterms.join(dfreq, "term").select("qid", "term", idf.alias("w"))
    dside = tf.select("doc_id", "term", tf_part.alias("w"))
    costs = None
    if budget is not None:
        costs = docs.select(F.col(id_col).alias("doc_id"), cost.alias("w"))
        k = budget  # every document costs at least 1, so none of a later rank fits
    scored = sparse_topk(qside, dside, "qid", "doc_id", k, n_queries=queries.count(),
                         n_docs=docs.count(), costs=costs, budget=budget)
    return rank_scores(scored, "qid", k).withColumnRenamed("qid", qid_col)


def sparse_topk(qside: DataFrame, dside: DataFrame, qid: str, did: str, k: int,
                n_queries: int, n_docs: int, query_block: int = 128,
                doc_block: int = 512, costs: DataFrame | None = None,
                budget: int | None = None) -> DataFrame:
    """Top-k of sum_t q(qid, t) * d(did, t) per query, exact, as a blocked
    sparse-dense matrix product.

    Queries are hashed into blocks of at most ``query_block`` and documents
    into blocks of at most ``doc_block``; each (query block, doc block)
    group is one ``applyInPandas`` task: it builds the two small weight
    matrices over the group's query terms, multiplies them (BLAS) and keeps
    the best k+2 documents per query.  Work per group is bounded whatever
    the data size or term skew (the document matrix is doc_block x the query
    block's vocabulary, about 26 MB for 128 queries of 50 terms), and no
    (query, document) pair is written out; the final per-query cut reads
    k+2 rows per document block.
    Only documents sharing a term with the query (positive score) count.

    With ``costs`` (``did``, ``w``) and ``budget`` a block keeps, in place of
    the best k+2, the documents whose better ones in the block cost at most
    ``budget`` together (:func:`block_fit`).
    """
    import numpy as np
    import pandas as pd

    bq = max(1, -(-n_queries // query_block))
    bd = max(1, -(-n_docs // doc_block))
    q = qside.select(F.col(qid).cast("long").alias("id"), "term", F.col("w").cast("double").alias("w"),
                     F.lit(0).alias("side"), F.pmod(F.xxhash64(qid), F.lit(bq)).cast("int").alias("qb"))
    q = q.withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(bd - 1))))
    d = dside.select(F.col(did).cast("long").alias("id"), "term", F.col("w").cast("double").alias("w"),
                     F.lit(1).alias("side"), F.pmod(F.xxhash64(did), F.lit(bd)).cast("int").alias("db"))
    d = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1))))
    keep = k + 2

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ds = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        vocab = pd.Index(pd.unique(qs["term"]))
        ds = ds[ds["term"].isin(vocab)]
        if len(qs) == 0 or len(ds) == 0:
            return pd.DataFrame({"qid": [], "did": [], "score": []})
        qids, qi = np.unique(qs["id"].to_numpy(), return_inverse=True)
        dids, di = np.unique(ds["id"].to_numpy(), return_inverse=True)
        Q = np.zeros((len(qids), len(vocab)))
        np.add.at(Q, (qi, vocab.get_indexer(qs["term"])), qs["w"].to_numpy())
        D = np.zeros((len(dids), len(vocab)))
        np.add.at(D, (di, vocab.get_indexer(ds["term"])), ds["w"].to_numpy())
        S = Q @ D.T
        S[S <= 0] = -np.inf  # only documents sharing a term with the query
        if budget is None:
            rows, cols = block_top(S, keep, largest=True)
        else:
            cs = pdf[pdf["side"] == 2]
            cost = cs.groupby("id")["w"].min().reindex(dids).to_numpy()
            if not (cost >= 1).all():
                raise ValueError("every document must cost at least 1")
            rows, cols = block_fit(S, cost, budget)
        return pd.DataFrame({"qid": qids[rows], "did": dids[cols], "score": S[rows, cols]})

    both = q.unionByName(d)
    if budget is not None:
        c = costs.select(F.col(did).cast("long").alias("id"), F.lit(None).cast("string").alias("term"),
                         F.col("w").cast("double").alias("w"), F.lit(2).alias("side"),
                         F.pmod(F.xxhash64(did), F.lit(bd)).cast("int").alias("db"))
        both = both.unionByName(c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(bq - 1)))))
    cand = both.groupBy("qb", "db").applyInPandas(fn, "qid long, did long, score double")
    return cand.select(F.col("qid").alias(qid), F.col("did").alias(did), "score")


def rank_scores(scored: DataFrame, qid: str, k: int, score: str = "score",
                item: str = "doc_id") -> DataFrame:
    """Top-k per query on a rounded score, ties by item id; score rounded to 6."""
    ranked = top_k(scored, qid, [F.round(score, 9).desc(), F.col(item).asc()], k)
    return ranked.select(qid, "rank", item, F.round(score, 6).alias(score))


# ---------------------------------------------------------------- block top-k
TIE_TOL = 2e-9  # final rankings compare scores rounded to 9 digits


def block_top(S, m: int, largest: bool = True):
    """Row and column indices of the ``m`` best entries of every row of
    ``S`` plus every entry tied with the m-th within TIE_TOL, so that the
    final ranking (rounded score, then id) sees every candidate that could
    make the cut.  Infinite / NaN entries are never returned."""
    import numpy as np
    if S.shape[1] == 0 or S.shape[0] == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = min(m, S.shape[1])
    key = -S if largest else S
    key = np.where(np.isfinite(key), key, np.inf)
    kth = np.partition(key, m - 1, axis=1)[:, m - 1]
    rows, cols = np.nonzero(key <= (kth + TIE_TOL)[:, None])
    ok = np.isfinite(key[rows, cols])
    return rows[ok], cols[ok]


def block_fit(S, cost, budget: float):
    """Row and column indices of every entry of ``S`` whose better entries of
    its row (by more than TIE_TOL) cost at most ``budget`` together.  An entry
    left out is over the budget in any ranking that holds the block, and so is
    all that follows it: the entries kept before it cost more than the budget
    already.  Infinite / NaN entries are never returned."""
    import numpy as np
    key = np.where(np.isfinite(S), -S, np.inf)
    order = np.argsort(key, axis=1, kind="stable")
    rows, cols = [], []
    for r in range(S.shape[0]):
        ks = key[r, order[r]]
        ahead = np.concatenate(([0.0], np.cumsum(cost[order[r]])))[np.searchsorted(ks, ks - TIE_TOL)]
        fit = order[r][(ahead <= budget) & np.isfinite(ks)]
        rows.append(np.full(len(fit), r, np.int64))
        cols.append(fit)
    return np.concatenate(rows), np.concatenate(cols)


# ---------------------------------------------------------------- dense top-k
def dense_topk(queries: DataFrame, corpus: DataFrame, qid: str, qvec: str, cid: str, cvec: str,
               k: int, block_rows: int = 4096, group_col: str | None = None,
               n_queries: int | None = None, n_corpus: int | None = None,
               within: bool = False) -> DataFrame:
    """Op 94: exact cosine top-k of corpus vectors per query vector (per
    query and corpus group when ``group_col`` is given).  ``within``: the
    queries have a group too (a query of several groups is several rows) and
    meet the vectors of that group only; blocks are cut inside the groups.

    Blocked matrix product: queries and corpus are hashed into blocks of at
    most ``block_rows`` rows; each (query block, corpus block) group is one
    ``applyInPandas`` task that multiplies the two normalized matrices and
    keeps the k best per query.  No pair is materialized as a row and no
    group exceeds 2 x ``block_rows`` vectors; the final per-query top-k
    reads at most k rows per corpus block.
    """
    import numpy as np
    import pandas as pd

    # block counts only need an upper bound of the row counts (callers that
    # know the source table size pass it and save a pass over the input)
    g = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    blocks = {c: F.ceil(F.col(c) / block_rows).cast("int") for c in ("bq", "bc")}
    if within:
        sizes = (queries.groupBy(group_col).agg(F.count(F.lit(1)).alias("bq"))
                 .join(corpus.groupBy(group_col).agg(F.count(F.lit(1)).alias("bc")), group_col)
                 .withColumns(blocks))
        queries, corpus = queries.join(sizes, group_col), corpus.join(sizes, group_col)
    else:
        nq = n_queries if n_queries is not None else queries.count()
        nc = n_corpus if n_corpus is not None else corpus.count()
        sizes = {"bq": F.lit(max(1, nq)), "bc": F.lit(max(1, nc))}
        queries, corpus = queries.withColumns(sizes).withColumns(blocks), corpus.withColumns(sizes).withColumns(blocks)
    q = queries.select(F.col(qid).cast("long").alias("id"), F.col(qvec).cast("array<double>").alias("v"),
                       F.lit(0).alias("side"), (g if within else F.lit(None).cast("string")).alias("g"),
                       F.pmod(F.xxhash64(qid), F.col("bq")).cast("int").alias("qb"),
                       F.explode(F.sequence(F.lit(0), F.col("bc") - 1)).alias("cb"))
    c = corpus.select(F.col(cid).cast("long").alias("id"), F.col(cvec).cast("array<double>").alias("v"),
                      F.lit(1).alias("side"), g.alias("g"),
                      F.pmod(F.xxhash64(cid), F.col("bc")).cast("int").alias("cb"),
                      F.explode(F.sequence(F.lit(0), F.col("bq") - 1)).alias("qb"))
    both = q.unionByName(c).withColumn("gb", F.col("g") if within else F.lit(None).cast("string"))
    keep = k + 2

    def best(qids, cids, s, gval):
        rows, cols = block_top(s, keep, largest=True)
        return pd.DataFrame({"qid": qids[rows], "cid": cids[cols], "score": s[rows, cols],
                             "g": gval})

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, cs = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if len(qs) == 0 or len(cs) == 0:
            return pd.DataFrame({"qid": [], "cid": [], "score": [], "g": []})
        qm = np.stack([np.asarray(x, dtype=np.float64) for x in qs["v"]])
        cm = np.stack([np.asarray(x, dtype=np.float64) for x in cs["v"]])
        qn = np.linalg.norm(qm, axis=1, keepdims=True)
        cn = np.linalg.norm(cm, axis=1, keepdims=True)
        qn[qn == 0] = 1.0
        cn[cn == 0] = 1.0
        s = (qm / qn) @ (cm / cn).T
        qids, cids = qs["id"].to_numpy(), cs["id"].to_numpy()
        if group_col is None:
            return best(qids, cids, s, None)
        gv = cs["g"].to_numpy()
        parts = [best(qids, cids[gv == x], s[:, gv == x], x) for x in pd.unique(gv)]
        return pd.concat(parts, ignore_index=True)

    cand = both.groupBy("gb", "qb", "cb").applyInPandas(fn, "qid long, cid long, score double, g string")
    by = ["qid", "g"] if group_col else "qid"
    ranked = top_k(cand, by, [F.round("score", 9).desc(), F.col("cid").asc()], k)
    cols = [F.col("qid").alias(qid), "rank", F.col("cid").alias(cid), "score"]
    if group_col:
        cols.append(F.col("g").alias(group_col))
    return ranked.select(*cols)


# ---------------------------------------------------------------- trigrams
def trigrams(text) -> Column:
    """pg_trgm trigram set of a text: lower-cased alphanumeric words, each
    padded with two leading blanks and one trailing blank."""
    words = F.filter(F.split(F.lower(text if isinstance(text, Column) else F.col(text)),
                             r"[^\p{L}\p{N}]+"), lambda w: w != F.lit(""))
    grams = F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(F.concat(F.lit("  "), w, F.lit(" "))) - 2),
        lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, 3)))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    """Op 95: |A n B| / |A u B| of the trigram sets (0 when both are empty)."""
    ta, tb = trigrams(a), trigrams(b)
    inter = F.size(F.array_intersect(ta, tb))
    union = F.size(F.array_union(ta, tb))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter / union)


def trigram_join(names: DataFrame, id_col: str, text_col: str, threshold: float = 0.3) -> DataFrame:
    """Op 95: all pairs (a < b) whose trigram similarity reaches ``threshold``.

    Exact set-similarity join with prefix filtering: trigrams are ordered
    globally rare-first; a pair with Jaccard >= t must share one of the first
    |A| - ceil(t |A|) + 1 trigrams of each side, so only those prefixes are
    joined.  Frequent trigrams sit at the end of the order and rarely enter
    a prefix, so no hot trigram enumerates all pairs of its group.
    Candidates are verified with the exact similarity.
    """
    g = names.select(F.col(id_col).alias("id"), trigrams(text_col).alias("tg")).filter(
        F.size("tg") > 0)
    ex = g.select("id", F.size("tg").alias("n"), F.explode("tg").alias("t"))
    freq = ex.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    ranked = ex.join(freq, "t")
    w = Window.partitionBy("id").orderBy("f", "t")  # one set per window: bounded
    ranked = ranked.withColumn("r", F.row_number().over(w))
    plen = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    pref = ranked.filter(F.col("r") <= plen).select("id", "t")
    cand = (pref.alias("x").join(pref.alias("y"), "t")
            .filter(F.col("x.id") < F.col("y.id"))
            .select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())
    ga, gb = g.select(F.col("id").alias("a"), F.col("tg").alias("ta")), g.select(
        F.col("id").alias("b"), F.col("tg").alias("tb"))
    v = cand.join(ga, "a").join(gb, "b")
    inter = F.size(F.array_intersect("ta", "tb"))
    sim = inter / F.size(F.array_union("ta", "tb"))
    return v.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)


# ---------------------------------------------------------------- fusion
def rrf(rankings: list[DataFrame], qid: str, item: str, rank: str = "rank",
        k: int = 60) -> DataFrame:
    """Op 96: reciprocal rank fusion, sum of 1/(k + rank) over the lists."""
    u = rankings[0].select(qid, item, rank)
    for r in rankings[1:]:
        u = u.unionByName(r.select(qid, item, rank))
    return u.groupBy(qid, item).agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col(rank))).alias("rrf"))


def pack_context(ranked: DataFrame, qid: str, rank: str, tokens_col: str, budget: int) -> DataFrame:
    """Op 99: take ranked items while the running token sum fits the budget;
    the first item that does not fit ends the block (prefix rule)."""
    w = Window.partitionBy(qid).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    d = ranked.withColumn("cum_tokens", F.sum(tokens_col).over(w))
    return d.filter(F.col("cum_tokens") <= budget)


# ---------------------------------------------------------------- graph
def graph_neighbors(edges: DataFrame, seeds: DataFrame, depth: int, src: str = "src",
                    dst: str = "dst", kind: str = "kind") -> DataFrame:
    """Op 100: nodes reachable from the seeds within ``depth`` hops over an
    undirected edge list, with their hop distance, degree and the kind of
    the edge that first reached them.  Breadth-first over stored adjacency
    lists of bounded length: the edges are read once, each round reads the
    lists of the new frontier only, drops visited nodes with an anti join, and
    is checkpointed."""
    from quarry.session import cut_lineage
    graph = Adjacency(edges, src, dst, kind)
    visited = seeds.select(F.col("node").alias("a")).distinct().withColumn("hop", F.lit(0)) \
        .withColumn("via", F.lit(None).cast("string"))
    frontier = visited.select("a")
    for h in range(1, depth + 1):
        nxt = graph.hop(frontier).groupBy(F.col("b").alias("a")).agg(F.min("kind").alias("via"))
        nxt = nxt.join(visited.select("a"), "a", "left_anti").withColumn("hop", F.lit(h))
        nxt = cut_lineage(nxt)
        visited = visited.unionByName(nxt.select("a", "hop", "via"))
        frontier = nxt.select("a")
    return (visited.join(graph.nodes.select("a", "degree"), "a", "left").fillna(0, ["degree"])
            .select(F.col("a").alias("node"), "hop", "via", "degree"))


def graph_vote(seeds: DataFrame, edges: DataFrame, group: str, k: int, src: str = "src",
               dst: str = "dst", hops: int = 1) -> DataFrame:
    """Op 101: every seed votes for its neighbours with its score; non-seed
    candidates are ranked per group by the sum of votes (ties by id).

    With ``hops = 2`` the votes flow through the intermediate nodes (e.g.
    page -> shared path -> page): the intermediate totals are aggregated
    first, so no node-to-node pair list is ever built.
    """
    graph = Adjacency(edges, src, dst, None)
    cur = seeds.select(group, F.col("node").alias("a"), F.col("score").alias("s"))
    for _ in range(hops):
        cur = (graph.hop(cur).groupBy(group, F.col("b").alias("a"))
               .agg(F.sum(F.col("s") * F.col("n")).alias("s")))
    votes = cur.select(group, F.col("a").alias("node"), F.col("s").alias("votes"))
    votes = votes.join(seeds.select(group, "node"), [group, "node"], "left_anti")
    return top_k(votes, group, [F.round("votes", 9).desc(), F.col("node").asc()], k)


def linked_hits(hits: DataFrame, edges: DataFrame, qid: str, item: str, src: str = "src",
                dst: str = "dst") -> DataFrame:
    """The hits (``qid``, ``item``) that an edge, or a node both have an edge
    to, joins to another hit of the same query.  A hit counts as a node of its
    own, so an edge between two hits is a common node; a node's hits are at
    most the query's."""
    own = hits.select(qid, item).distinct()
    reached = (Adjacency(edges, src, dst, None).hop(own, item).select(qid, item, F.col("b").alias("_n"))
               .unionByName(own.select(qid, item, F.col(item).alias("_n"))))
    shared = (reached.groupBy(qid, "_n").agg(F.min(item).alias("_lo"), F.max(item).alias("_hi"))
              .filter("_lo <> _hi").select(qid, "_n"))
    return reached.join(shared, [qid, "_n"], "left_semi").select(qid, item).distinct()


def overlap_raw(qtext, dtext) -> Column:
    """Default pair scorer (stand-in for a cross-encoder): shared distinct
    word tokens over sqrt of the query's distinct tokens, shifted by -3 so
    that the sigmoid of op 80 spreads over (0, 1)."""
    qt, dt = F.array_distinct(tokens(qtext)), F.array_distinct(tokens(dtext))
    return F.size(F.array_intersect(qt, dt)) / F.sqrt(F.size(qt)) - 3.0


def hybrid_search(queries: DataFrame, docs: DataFrame, qvecs: DataFrame, dvecs: DataFrame,
                  k: int = 5, depth: int = 20, rrf_k: int = 60) -> DataFrame:
    """Op 97: BM25 top-``depth`` and dense top-``depth`` fused by RRF; the
    fused top-``depth`` is reranked with the pair scorer and cut to k.
    Only ids and ranks travel between the stages; texts are joined back for
    the scorer on the ``depth`` candidates of each query."""
    from quarry.operators.topk import rerank
    lex = bm25(queries, docs, k=depth)
    den = dense_topk(qvecs, dvecs, "item_id", "vector", "doc_id", "vector", depth,
                     n_queries=queries.count(), n_corpus=docs.count())
    fused = rrf([lex, den], "item_id", "doc_id", k=rrf_k)
    cands = top_k(fused, "item_id", [F.round("rrf", 12).desc(), F.col("doc_id").asc()], depth)
    pairs = (cands.select("item_id", "doc_id", F.col("rank").alias("idx"))
             .join(queries.select("item_id", F.col("text").alias("qtext")), "item_id")
             .join(docs.select("doc_id", F.col("text").alias("dtext")), "doc_id"))
    out = rerank(pairs.withColumn("raw", overlap_raw("qtext", "dtext")), "raw", "item_id", "idx", k)
    return out.select("item_id", "rank", "doc_id", "idx", "score")


def community_search(queries: DataFrame, docs: DataFrame, qvecs: DataFrame, dvecs: DataFrame,
                     community: str = "source", k: int = 10, m: int = 2,
                     rrf_k: int = 60) -> DataFrame:
    """Op 98: two-stage retrieval.  Bottom-up: BM25 top-k items.  Top-down:
    the m communities whose centroid is nearest to the query, then their
    members nearest to the query.  Both lists are fused by RRF (top k)."""
    from quarry.operators.clustering import centroids
    lex = bm25(queries, docs, k=k)
    mv = dvecs.join(docs.select("doc_id", community), "doc_id")
    cents = centroids(mv, community, "vector")
    number = positions(cents.select(community), [community], "_cid")
    top_c = dense_topk(qvecs, cents.join(number, community), "item_id", "vector", "_cid", "centroid", m)
    top_c = top_c.join(number, "_cid").select("item_id", community)
    # a query meets the members of its communities and no others
    members = dense_topk(qvecs.join(top_c, "item_id"), mv, "item_id", "vector", "doc_id", "vector", k,
                         group_col=community, within=True)
    down = top_k(members, "item_id", [F.round("score", 9).desc(), F.col("doc_id").asc()], k)
    fused = rrf([lex, down], "item_id", "doc_id", k=rrf_k)
    ranked = top_k(fused, "item_id", [F.round("rrf", 12).desc(), F.col("doc_id").asc()], k)
    return ranked.select("item_id", "rank", "doc_id", F.round("rrf", 9).alias("rrf"))


def bridge_orphans(hits: DataFrame, linked: DataFrame, vectors: DataFrame, qid: str,
                   item: str, vec: str) -> DataFrame:
    """Op 102: a hit with no edge to another hit of the same query is linked
    to the most similar other hit (cosine of the vectors; ties by id).

    ``linked(qid, item)`` lists the hits that do have an edge.  Hit lists are
    top-k lists, so the comparison stays within k items per query.
    """
    from quarry.functions.scalars import cosine
    hv = hits.select(qid, item).join(vectors.select(F.col(item), F.col(vec)), item)
    orphans = hv.join(linked.select(qid, item), [qid, item], "left_anti")
    o = orphans.select(qid, F.col(item).alias("orphan"), F.col(vec).alias("_ov"))
    other = hv.select(qid, F.col(item).alias("bridge"), F.col(vec).alias("_bv"))
    pairs = o.join(other, qid).filter(F.col("orphan") != F.col("bridge"))
    pairs = pairs.withColumn("similarity", cosine("_ov", "_bv"))
    best = top_k(pairs, [qid, "orphan"], [F.round("similarity", 9).desc(), F.col("bridge").asc()], 1)
    return best.select(qid, "orphan", "bridge", "similarity")


def rollup_tree(chunks: DataFrame, doc: str, idx: str, tokens_col: str, fanout: int,
                vec: str | None = None, dims: int | None = None) -> DataFrame:
    """Op 103: hierarchical rollup; level l+1 groups ``fanout`` consecutive
    level-l nodes until one root per document.

    Closed form instead of a loop: the level-l node of chunk i is
    i div fanout^l, and a document needs levels 0..L with L the smallest l
    where ceil(n / fanout^l) = 1.  One explode and one aggregate build every
    level at once.
    """
    n = chunks.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    lv = F.when(F.col("_n") <= 1, F.lit(0)).otherwise(
        F.ceil(F.log(float(fanout), F.col("_n").cast("double")) - F.lit(1e-9)).cast("int"))
    c = chunks.join(n.withColumn("_L", lv), doc)
    c = c.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_L"))))
    p = F.pow(F.lit(fanout), F.col("level")).cast("long")
    c = c.withColumn("node", (F.col(idx) / p).cast("long")).withColumn(
        "_child", F.when(F.col("level") > 0, (F.col(idx) / (p / fanout)).cast("long")))
    aggs = [F.sum(tokens_col).alias("tokens"), F.count(F.lit(1)).alias("n_leaves"),
            F.count_distinct("_child").alias("n_children")]
    if vec is not None:
        # mean vector of the leaves under the node (one partial avg per dimension)
        from quarry.functions.udf import centroid_agg
        aggs.append(centroid_agg(vec, dims).alias("mean_vector"))
    return c.groupBy(doc, "level", "node").agg(*aggs)


def cooccurrence_edges(docs: DataFrame, id_col: str, text_col: str, window: int = 64,
                       min_df: int = 2, max_df_share: float | None = None) -> DataFrame:
    """Op 104: entity-entity edges weighted by the number of chunks that hold
    both.  An entity is a capitalized word whose document frequency is at
    least ``min_df`` (and at most ``max_df_share`` of the documents, where
    given); a chunk is a window of ``window`` words.  A
    chunk holds at most ``window`` entities, so its pair list is bounded.
    Entities are found and made distinct inside their row, kept in a stored
    table, and paired inside the list of their chunk."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(r"(\p{L}+)"), 1)
    placed = F.transform(words, lambda w, i: F.struct((i / window).cast("long").alias("chunk"), w.alias("e")))
    named = F.array_distinct(F.filter(placed, lambda x: x["e"].rlike(r"^\p{Lu}\p{Ll}+$")))
    path = scratch_path(docs.sparkSession, "entities")
    found = docs.select(F.col(id_col).alias("doc"), named.alias("ents"))
    found.write.parquet(path)
    found = docs.sparkSession.read.schema(found.schema).parquet(path)
    df_ = (found.select("doc", F.explode(F.array_distinct(F.col("ents.e"))).alias("e"))
           .groupBy("e").agg(F.count_distinct("doc").alias("_df")))
    ok = df_.filter(F.col("_df") >= min_df)
    if max_df_share is not None:
        ok = ok.filter(F.col("_df") <= docs.select(F.count(F.lit(1))).scalar() * max_df_share)
    chunks = (found.select("doc", F.inline("ents")).join(ok.select("e"), "e", "left_semi")
              .groupBy("doc", "chunk").agg(F.sort_array(F.collect_set("e")).alias("es")))
    later = F.flatten(F.transform("es", lambda x, i: F.transform(
        F.slice("es", i + 2, F.size("es")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = chunks.select(F.inline(later))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))
