"""The block index against brute force: postings, BM25, chunks, ties, edges."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical_index as L
from quarry.operators import retrieval as R


def toks(s):
    return re.findall(r"[^\W_]+", (s or "").lower())


def bm25_brute(queries, docs, k):
    bags = [(i, Counter(toks(t)), len(toks(t)), t is not None) for i, t in docs]
    mean = sum(n for _, _, n, _ in bags) / max(1, sum(f for *_, f in bags))
    df = Counter(w for _, c, _, _ in bags for w in c)
    asked = {}
    for q, t in queries:
        if q is not None:
            asked.setdefault(q, set()).update(toks(t))
    out = []
    for q, terms in asked.items():
        scored = []
        for i, c, n, _ in bags:
            s = sum(math.log(1 + (len(docs) - df[w] + .5) / (df[w] + .5)) * c[w] * 2.2
                    / (c[w] + 1.2 * (.25 + .75 * n / mean)) for w in terms if w in c)
            if s > 0:
                scored.append((-round(s, 9), i))
        out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def equal(got, want):
    """Same ranks; scores are sums of floats in some order."""
    got = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    return all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want))


@pytest.fixture(scope="module")
def corpus():
    """Three vocabularies (languages), a word that all documents hold, ties."""
    rng = random.Random(4)
    docs = []
    for i in range(400):
        own = [f"{'abc'[i % 3]}{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randint(1, 60))]
        docs.append((i, " ".join([*own, "The", "the"]), "abc"[i % 3]))
    docs += [(1000 + i, "the same TEXT, thrice-told", "a") for i in range(30)]
    docs += [(2000, None, "a"), (2001, "", "b"), (2002, " -- ", None), (2003, "the " * 5000, "c")]
    queries = [(i, f"{'abc'[i % 3]}{i} {'abc'[i % 3]}{i + 1} the {'abc'[i % 3]}2 {'abc'[i % 3]}2") for i in range(40)]
    queries += [(50, "same text thrice"), (51, ""), (52, None), (53, "nowhere"), (None, "the"), (50, "told")]
    return docs, queries


@pytest.mark.parametrize("kw", [{}, {"block_docs": 7, "chunk_queries": 5, "partitions": 3}])
@pytest.mark.parametrize("cluster", [(), ("lang",)])
def test_bm25_equals_brute_force(spark, corpus, kw, cluster):
    docs, queries = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = L.build_index(d, cluster=cluster, **{k: v for k, v in kw.items() if k != "chunk_queries"})
    found = L.search(index, q, 5, **{k: v for k, v in kw.items() if k == "chunk_queries"})
    got = R.rank_scores(found, "qid", 5)
    assert equal(got, bm25_brute(queries, [r[:2] for r in docs], 5))


def test_blocks_are_skipped(spark, corpus):
    """Bounds are sound (results equal above) and of use: in one task, with
    documents of a language side by side, most pairs are never scored."""
    docs, queries = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    q = spark.createDataFrame(queries, "item_id long, text string")
    index = L.build_index(d, cluster=("lang",), block_docs=16, partitions=1)
    met, scored = L.search(index, q, 3, report=True).agg(F.sum("met"), F.sum("scored")).first()
    assert 0 < scored < 0.6 * met


def test_wide_queries_are_split(spark, corpus, monkeypatch):
    docs, queries = corpus
    monkeypatch.setattr(L, "CELLS", 12)
    d = spark.createDataFrame(docs[:90], "doc_id long, text string, lang string")
    q = spark.createDataFrame(queries[:8], "item_id long, text string")
    got = R.rank_scores(L.search(L.build_index(d), q, 4), "qid", 4)
    assert equal(got, bm25_brute(queries[:8], [r[:2] for r in docs[:90]], 4))


def test_postings_equal_brute_force(spark, corpus):
    docs, _ = corpus
    got = R.postings(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    df = Counter(w for _, t, _ in docs for w in set(toks(t)))
    want = sorted((w, i, len(toks(t)), n, df[w]) for i, t, _ in docs for w, n in Counter(toks(t)).items())
    assert sorted(tuple(r) for r in got.select("term", "doc_id", "dl", "tf", "df").collect()) == want


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    one = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert R.bm25(q, none, 3).collect() == R.bm25(q.limit(0), one, 3).collect() == R.postings(none).collect() == []


def test_copies_do_not_pile_up():
    """of very many copies that tie with the k-th a task holds a few k, the smallest ids."""
    best = L._Best(1, 3)
    rng = random.Random(1)
    ids = rng.sample(range(10 ** 6), 4000)
    for a in range(0, len(ids), 100):
        part = L.np.array(ids[a:a + 100])
        best.add(0, L.np.where(part % 1000 == 7, 2.0, 1.5), part)
        assert len(best.doc[0]) <= 12 + 100
    score, doc = best.score[0], best.doc[0]
    got = sorted(zip(-score, doc))[:3]
    assert got == sorted((-(2.0 if i % 1000 == 7 else 1.5), i) for i in ids)[:3] and len(doc) <= 12


def test_python_holds_few_blocks_at_a_time(spark, monkeypatch):
    """a batch of the scan has at most BATCH_BLOCKS blocks, whatever the table's size."""
    seen = spark.sparkContext.accumulator(0)
    plain = L.scan

    def scan(batches, *rest):
        def watched():
            for b in batches:
                if b.num_rows > L.BATCH_BLOCKS:
                    seen.add(1)
                yield b
        return plain(watched(), *rest)

    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text"))
    index = L.build_index(docs, block_docs=4, partitions=1)
    assert index.count() == 150 > L.BATCH_BLOCKS
    monkeypatch.setattr(L, "scan", scan)
    queries = spark.createDataFrame([(1, "word w3"), (2, "w5")], "item_id long, text string")
    got = L.search(index, queries, 5)
    assert got.count() >= 10
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and seen.value == 0     # the scan has run, in small batches
