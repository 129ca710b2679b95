"""The five stages on a small corpus with planted cases."""

import random

import corpus_pipeline
from conftest import SF_SMALL


def text(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "to", "in"]) if rng.random() < 0.4
                    else "w" + "".join(rng.choice("aeiourstln") for _ in range(6)) for _ in range(n))


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    clean = {i: text(rng, 120) + ".\n" + text(rng, 80) + "." for i in range(20)}
    line = "A line of boilerplate that each of these documents carries."
    item = " ".join(clean[19].split()[10:40])
    rows = [(i, t + ("\n" + line if i < 6 else ""), "en", "s", len(t)) for i, t in clean.items()]
    rows += [(50, clean[7], "en", "s", 1), (51, clean[8] + " extra words", "en", "s", 1),
             (52, "too short", "en", "s", 1), (53, None, None, None, None), (None, text(rng, 90), "en", "s", 1)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, cols).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.createDataFrame(rows, cols)
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        left.append({r["doc_id"] for r in docs.collect()})
    assert left[0] == left[1] == set(range(20)) | {50, 51, None}
    assert left[2] == set(range(20)) | {None}
    assert left[3] == left[4] == set(range(19)) | {None}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == left[4]
    assert sum(r["n_tokens"] for r in got.values()) == sum(r["n_tokens"] for r in docs.collect())


def test_near_duplicates_with_repeated_ids(spark):
    """Texts that merely share an id are no copies; every family keeps a row."""
    rng = random.Random(2)
    a, b, c = (text(rng, 200) for _ in range(3))
    rows = [(1, a), (1, b), (2, b + " tail"), (3, c), (3, c), (None, c), (None, "short"), (None, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (1, b), (3, c), (None, "short"), (None, None), (4, ""), (5, "")],
                                          key=str)


def test_power_tables_are_bounded():
    from quarry.llm import textscan
    powers = textscan._Powers()
    up, down = powers.get(powers.KEEP + 5)
    assert len(up) == powers.KEEP + 5 and len(powers.up) == 1
    assert ((up * down) == 1).all() and (powers.get(100)[0] == up[:100]).all()


def test_empty_tables(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    sf = str(tmp_path)
    spark.createDataFrame([], cols).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_small_fixture_stays_clean(spark):
    from quarry.sources.tables import read_table
    docs = read_table(spark, SF_SMALL, "documents")
    good = read_table(spark, SF_SMALL, "labels").filter("quality = 1")
    kept = corpus_pipeline.quality(spark, docs, SF_SMALL)
    long = docs.filter("size(split(text, '\\\\s+')) >= 25").join(good, "doc_id")
    assert kept.join(long.select("doc_id"), "doc_id").count() >= 0.97 * long.count()
