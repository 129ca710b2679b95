"""Lexical index by document range, and BM25 top-k that skips blocks (ops 92, 93).

:func:`build_index` deals the documents into ranges (by ``cluster`` columns,
then id), tokenizes them once and packs every ``block_docs`` documents into one
row: the block's terms, its postings, and per term the largest frequency and
the shortest document, which bound any weight the term reaches in the block.
The index is a Parquet folder in the shared checkpoint folder; a scan for
counts reads the head columns only.  No posting is shuffled: a block is made
where its documents lie.

:func:`search` sends the queries to the index in chunks of bounded size (the
vocabulary of a chunk with them) and scans the blocks once per chunk.  A task keeps the k best documents of every query so far; a block is
scored for a query only if the sum of its terms' bounds reaches the query's
current k-th score.  Blocks of one Arrow batch are visited from the largest bound
down, so the k-th scores rise early.  Results are exact; ties at the k-th place
are kept for the final ranking.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import tokens
from quarry.session import arrow_rows, store
from quarry.sources.ops import scratch_path

BLOCK_DOCS = 128
CHUNK_QUERIES = 256
#: Documents, and blocks, that a task holds in Python at a time.
BATCH_DOCS = 512
BATCH_BLOCKS = 16
#: Bound on queries x terms of a chunk.
CELLS = 4_000_000
#: Rankings compare scores rounded to 9 digits.
TIE = 4e-9

_BLOCK = ("n_docs long, n_texts long, total_len long, terms array<string>, counts array<int>, most_tf array<int>, "
          "least_len array<int>, ids array<long>, lens array<int>, docs array<int>, tfs array<int>")


def _pack(ids: pa.Array, toks: pa.ListArray) -> list:
    """One block: terms in order, their postings, and the bounds per term."""
    lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = toks.flatten().dictionary_encode()
    names = words.dictionary
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lens)), lens)
    pair, tf = np.unique(code * len(lens) + doc, return_counts=True)
    term, doc = pair // max(1, len(lens)), pair % max(1, len(lens))
    first = np.searchsorted(term, np.arange(len(names)))
    counts = np.diff(np.append(first, len(term)))
    most = np.maximum.reduceat(tf, first) if len(term) else tf
    least = np.minimum.reduceat(lens[doc], first) if len(term) else tf
    return [len(ids), len(toks) - toks.null_count, int(lens.sum()), names.to_pylist(), counts, most, least,
            ids.to_pylist(), lens, doc, tf]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cluster: Sequence[str] = (),
                block_docs: int = BLOCK_DOCS, partitions: int | None = None) -> DataFrame:
    """The stored index of ``docs``.  Documents that agree on the columns
    ``cluster`` (a language, a source) come to lie in the same blocks, which
    sharpens the bounds.  ``partitions``: ranges, by default the session's
    ``spark.sql.shuffle.partitions``."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(c) for c in cluster], F.col(id_col)]
    rows = (docs.select(*order, F.col(text_col).alias("text"))
            .repartitionByRange(partitions, *order).sortWithinPartitions(*order)
            .select(F.col(id_col).cast("long").alias("id"), tokens("text").alias("toks")))

    def run(batches):
        names = [f.split(" ")[0] for f in _BLOCK.split(", ")]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.string())] + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.int64())] + [
            pa.list_(pa.int32())] * 3
        for b in batches:
            for a in range(0, b.num_rows, block_docs):
                part = b.slice(a, block_docs)
                row = _pack(part.column("id"), part.column("toks"))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=names)

    made = rows.mapInArrow(run, _BLOCK)
    path = scratch_path(spark, "lexical-index")
    with arrow_rows(spark, block_docs * max(1, BATCH_DOCS // block_docs)):
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def open_postings(index: DataFrame) -> DataFrame:
    """One row per block and term: ``term`` and the arrays ``ids``, ``tfs``
    and ``lens`` (document, frequency, document length)."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                get = {c: b.column(c)[r].values for c in ("terms", "counts", "ids", "lens", "docs", "tfs")}
                offsets = pa.array(np.concatenate([[0], np.cumsum(get["counts"].to_numpy())]), pa.int32())
                columns = [get["ids"].take(get["docs"]), get["tfs"], get["lens"].take(get["docs"])]
                yield pa.RecordBatch.from_arrays(
                    [get["terms"], *[pa.ListArray.from_arrays(offsets, c) for c in columns]],
                    names=["term", "ids", "tfs", "lens"])
    return (index.select("terms", "counts", "ids", "lens", "docs", "tfs")
            .mapInArrow(run, "term string, ids array<long>, tfs array<int>, lens array<int>"))


@dataclass
class Stats:
    """Documents, mean token length, and document frequencies of some terms."""
    n_docs: int
    mean_len: float
    df: np.ndarray


def term_stats(index: DataFrame, vocabulary: list[str]) -> Stats:
    """Counts from the head columns of the index; the driver gets one number
    per term of ``vocabulary``."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)
    totals = ["n_docs", "n_texts", "total_len"]

    def run(batches):
        words = pa.array(shared.value, pa.string())
        df = np.zeros(len(words) + len(totals), dtype=np.int64)     # the totals come last
        for b in batches:
            at = pc.index_in(b.column("terms").flatten(), value_set=words)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            count = b.column("counts").flatten().to_numpy()[known]
            df[:len(words)] += np.bincount(at.drop_null().to_numpy(), weights=count,
                                           minlength=len(words)).astype(np.int64)
            df[len(words):] += [pc.sum(b.column(c)).as_py() or 0 for c in totals]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "n"])

    with arrow_rows(index.sparkSession, BATCH_BLOCKS):
        got = (index.select("terms", "counts", *totals).mapInArrow(run, "at long, n long").groupBy("at")
               .agg(F.sum("n").alias("n")).toPandas())
    df = np.zeros(len(vocabulary) + len(totals), dtype=np.int64)
    df[got["at"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    n_docs, n_texts, length = df[len(vocabulary):].tolist()
    return Stats(n_docs, length / max(1, n_texts), df[:len(vocabulary)])


class _Best:
    """The k best documents of every query of a chunk so far, and what ties with
    the k-th; of copies (equal scores) the k smallest ids, which rank first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.kth = np.full(n, -np.inf)
        self.score = [np.zeros(0) for _ in range(n)]
        self.doc = [np.zeros(0, dtype=np.int64) for _ in range(n)]

    def add(self, query: int, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score[query], score]), np.concatenate([self.doc[query], doc])
        if len(score) >= self.k:
            kth = np.partition(score, len(score) - self.k)[len(score) - self.k]
            self.kth[query] = kth
            keep = score >= kth - TIE
            score, doc = score[keep], doc[keep]
        if len(score) > 4 * self.k:
            order = np.lexsort((doc, score))
            score, doc = score[order], doc[order]
            at = np.arange(len(score))
            place = at - np.maximum.accumulate(np.where(np.r_[True, score[1:] != score[:-1]], at, 0))
            score, doc = score[place < self.k], doc[place < self.k]
        self.score[query], self.doc[query] = score, doc


def _weights(tf, length, stats: Stats, k1: float, b: float):
    return (tf * (k1 + 1)) / (tf + k1 * (1.0 - b + b * length / (stats.mean_len or 1.0)))


def scan(batches, vocabulary: list[str], weight: np.ndarray, stats: Stats, k: int, k1: float, b: float):
    """The best documents of every query (a row of ``weight``: idf per term)
    in a task's blocks, and how many (query, block) pairs were met, and scored."""
    words = pa.array(vocabulary, pa.string())
    best = _Best(len(weight), k)
    met = scored = 0
    for batch in batches:
        blocks = []
        col = {c: batch.column(c) for c in batch.schema.names}
        for r in range(batch.num_rows):
            at = pc.index_in(col["terms"][r].values, value_set=words)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            if not len(known):
                continue
            term = at.drop_null().to_numpy().astype(np.int64)
            most, least = (col[c][r].values.to_numpy()[known] for c in ("most_tf", "least_len"))
            bound = weight[:, term] @ _weights(most, least, stats, k1, b)
            blocks.append((bound, r, known, term))
        for bound, r, known, term in sorted(blocks, key=lambda x: -x[0].max()):
            alive = bound > 0
            met += int(alive.sum())
            query = np.flatnonzero(alive & (bound * (1 + 1e-12) >= best.kth - TIE))
            scored += len(query)
            if not len(query):
                continue
            ids, lens, docs, tfs, counts = (col[c][r].values.to_numpy(zero_copy_only=False)
                                            for c in ("ids", "lens", "docs", "tfs", "counts"))
            end = np.cumsum(counts)
            size = counts[known]
            at = np.repeat(end[known] - np.cumsum(size), size) + np.arange(size.sum())
            d = docs[at]
            table = np.zeros((len(term), len(ids)))
            table[np.repeat(np.arange(len(term)), size), d] = _weights(tfs[at], lens[d], stats, k1, b)
            s = weight[np.ix_(query, term)] @ table
            for i, q in enumerate(query):
                hit = np.flatnonzero((s[i] > 0) & (s[i] >= best.kth[q] - TIE))
                if len(hit):
                    best.add(q, s[i][hit], ids[hit])
    return best, met, scored


def search(index: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, qid_col: str = "item_id",
           qtext_col: str = "text", chunk_queries: int = CHUNK_QUERIES, report: bool = False) -> DataFrame:
    """``qid``, ``doc_id`` and ``score`` of the best documents of every query:
    the k best and what ties with the k-th, per task of the scan, stored.  With
    ``report`` the (query, block) pairs instead: ``met`` (with a term in
    common) and ``scored``.  Rows that share an id are one query; queries
    without an id or a term have no result."""
    spark = index.sparkSession
    path = scratch_path(spark, "queries")
    (queries.select(F.col(qid_col).cast("long").alias("qid"), F.array_distinct(tokens(qtext_col)).alias("terms"))
     .filter(F.col("qid").isNotNull() & (F.size("terms") > 0)).groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
     .write.parquet(path))
    asked = spark.read.schema("qid long, terms array<string>").parquet(path)
    schema = "met long, scored long" if report else "qid long, doc_id long, score double"
    out = spark.createDataFrame([], schema)
    columns = [c for c in index.columns if c not in ("n_docs", "n_texts", "total_len")]

    for chunk in _chunks(asked, chunk_queries):
        vocabulary = sorted({t for r in chunk for t in r["terms"]})
        stats = term_stats(index, vocabulary)
        idf = np.log(1.0 + (stats.n_docs - stats.df + 0.5) / (stats.df + 0.5))
        place = {t: i for i, t in enumerate(vocabulary)}
        weight = np.zeros((len(chunk), len(vocabulary)))
        for i, r in enumerate(chunk):
            at = [place[t] for t in r["terms"]]
            weight[i, at] = idf[at]
        weight[:, stats.df == 0] = 0
        qids = np.array([r["qid"] for r in chunk], dtype=np.int64)
        shared = spark.sparkContext.broadcast((vocabulary, weight, stats, qids))

        def run(batches, shared=shared):
            vocabulary, weight, stats, qids = shared.value
            best, met, scored = scan(batches, vocabulary, weight, stats, k, k1, b)
            if report:
                yield pa.RecordBatch.from_arrays([pa.array([met]), pa.array([scored])], names=["met", "scored"])
                return
            n = [len(s) for s in best.score]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids, n)), pa.array(np.concatenate(best.doc)), pa.array(np.concatenate(best.score))],
                names=["qid", "doc_id", "score"])
        with arrow_rows(spark, BATCH_BLOCKS):
            out = out.unionByName(store(index.select(*columns).mapInArrow(run, schema)))
    return out


def _chunks(asked: DataFrame, limit: int):
    """The queries in lists of at most ``limit``, in order of their ids, whose
    weight matrix has at most ``CELLS`` cells (or a single query); the driver
    holds ``limit`` queries at a time."""
    last = None
    while True:
        rest = asked if last is None else asked.filter(F.col("qid") > last)
        rows = rest.orderBy("qid").limit(limit).collect()
        chunk, width = [], 0
        for r in rows:
            width += len(r["terms"])
            if chunk and (len(chunk) + 1) * width > CELLS:
                yield chunk
                chunk, width = [], len(r["terms"])
            chunk.append(r)
        if chunk:
            yield chunk
        if len(rows) < limit:
            return
        last = rows[-1]["qid"]
