"""Training-data operators against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontamination, url_filter
from quarry.llm import jaccard_join as jj
from quarry.llm import language_id as lid
from quarry.llm import lm_score as lm
from quarry.llm import quality_classifier as qc
from quarry.llm import quality_rules as qr
from quarry.llm.bpe import Decoder, Encoder, bpe_decode, bpe_encode, public_vocabulary
from quarry.llm.decontamination import decontaminate
from quarry.llm.line_dedup import LineRuns, dedup_lines, long_lines
from quarry.llm.queries import remainder
from quarry.llm.sharding import assign_shards
from quarry.llm.url_filter import UNWANTED_HOSTS, Rule, filter_urls, host_rule
from quarry.sources.ops import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(s):
    return (s or "").translate(LOW)


def words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def prose(rng, n, vocab=400):
    return " ".join("w%d" % int(rng.paretovariate(0.7) % vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows,
    copies, near copies, shared lines and passages, non-ASCII words."""
    rng = random.Random(5)
    line = "This very common line stands in Many documents."
    passage = prose(rng, 60)
    out = [(0, None, None, None, None), (1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 4),
           (3, "é", None, "s", 1), (4, "one two three", "en", None, 13), (5, "ONE two  three", "en", "s", 14),
           (None, "a null id\n" + line, "en", "s", None)]
    base = prose(rng, 300, 3000).split(" ")
    for i in range(20):
        near = list(base)
        near[7 * i] = f"changed{i}"
        out.append((100 + i, " ".join(near), "en", "s", None))
    for i in range(40):
        out.append((200 + i, prose(rng, rng.randint(1, 200), 5000) + "\n  " + line.upper() + "\t\n"
                    + (passage if i % 3 else "") + "\nÜber straße " * (i % 4), "de", "s", None))
    out.append((300, prose(rng, 60_000, 20_000), "fr", "s", None))
    out.append((301, "Und " * 3000, "de", "s", None))
    out.append((302, "x" * 50_000, "de", "s", None))
    out += [(310, "same text here and there again", "en", "s", 1)] * 3
    out += [(311, "same text here and there again", "en", "s", 1), (310, "another text under the same id", "en", "s", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 BPE ------------------------------------------------------------------

def test_bpe_equals_library(spark, docs, rows):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_vocabulary())
    texts = [r[1] or "" for r in rows] + ["a<|endoftext|> b<|endoftext|>", "  \u2028\x85 x\x1c y", "日本語 😀'll don't"]
    enc = Encoder(open(public_vocabulary(), "rb").read())
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == e.ids
    out = bpe_decode(bpe_encode(docs.withColumn("token_ids", F.lit(1)).withColumn("decoded", F.lit(2)),
                                public_vocabulary()), public_vocabulary())
    assert out.columns == [*docs.columns, "token_ids", "decoded"]
    got = out.select("text", "decoded").collect()
    assert len(got) == len(rows) and all((r["text"] or "") == r["decoded"] for r in got)


def test_bpe_query_digests(spark):
    """The query's rows on a whole table, from the library."""
    import hashlib

    from conftest import SF_SMALL
    from quarry.llm.queries import QUERIES
    from quarry.sources.tables import read_table
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_vocabulary())
    lib.no_truncation()
    lib.no_padding()
    want = {}
    for r in read_table(spark, SF_SMALL, "documents").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                             hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_bpe"](spark, SF_SMALL).collect()}
    assert got == want


def test_bpe_random_words():
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(public_vocabulary())
    enc = Encoder(open(public_vocabulary(), "rb").read())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghinorstu éß's1!\n") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == e.ids


def test_bpe_decode_edges(spark, empty):
    dec = Decoder(open(public_vocabulary(), "rb").read())
    with pytest.raises(ValueError):
        dec.decode(np.array([10**6]))
    one = spark.createDataFrame([(None,), (bytearray(),), (bytearray(dec.bytes.index(b"\xc3").to_bytes(4, "little")),)],
                                "token_ids binary")
    assert sorted(r["decoded"] for r in bpe_decode(one, public_vocabulary()).collect()) == ["", "", "\ufffd"]
    assert bpe_encode(empty, public_vocabulary()).count() == 0


# -- 2 URL filter -----------------------------------------------------------

def test_url_filter(spark):
    urls = [None, "", "no scheme.org/en/", "http://Example.ORG/es/x", "https://a.b.example.org/en/15?q", "ftp://org",
            "http://notexample.org/es/", "http://x.com/fr/1", "http://x.com/FR/1", "http://x.com/de/#", "://com/de/y",
            "http://a.spam-farm.net/en/", "http://spammy.net/en/", "http://free-bets.com/fr/1", "x://y://org/z",
            "http://org:80/en/", "http://tracker.net/ads?x", "http://tracker.net/\nads"] + ["http://x.org/1"] * 30
    rules = [host_rule("allow", "org", "/"), host_rule("block", "example.org", "/es/"),
             host_rule("block", "example.org", "/en/1"), host_rule("allow", "com", "/fr/"),
             host_rule("block", "com", "/de/"), host_rule("block", "whole.net"),
             Rule("ads", "block", "/ads", ())] + UNWANTED_HOSTS

    def expected(url):
        m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if r.host and (host == (h := r.name.split("/")[0]) or host.endswith("." + h))
                and path.startswith(r.name[len(h):]) and host]
        if fits:
            best = max(fits, key=lambda r: len(r.name))
            return host, path, best.name, best.action
        bad = "/ads" in host + path or any(
            re.search(rf"(^|[.-]){re.escape(r.name)}($|[.-])", host) for r in UNWANTED_HOSTS)
        return host, path, None, "block" if bad else "allow"
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("x"))
    got = filter_urls(pages, rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {
        i: expected(u) for i, u in enumerate(urls)}
    assert len(got) == len(urls)
    assert filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in filter_urls(pages, [], default="block").collect()} == {"block"}


@pytest.mark.parametrize("hot", [None, 5])
def test_thousands_of_url_rules_equal_trying_all(spark, hot, monkeypatch):
    """Host, path and query rules from a rule table, found through tokens,
    broadcast or joined with salted hot tokens, against every rule on every URL."""
    if hot:
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", 10)
        monkeypatch.setattr(url_filter, "HOT_URLS", hot)
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefgh") + rng.choice("xyz") + str(rng.randint(0, 60))
    rules = []
    for _ in range(700):
        act = rng.choice(["allow", "block"])
        rules += [url_filter.host_rule(act, f"{word()}.{rng.choice(['com', 'org'])}", rng.choice(["", "/", f"/{word()}/a"])),
                  url_filter.host_word_rule(act, word()), url_filter.path_word_rule(act, f"{word()}-{word()}"),
                  url_filter.path_word_rule(act, word()), url_filter.query_rule(act, f"{word()}_id")]
    rules += [url_filter.host_rule("block", "com", "/zz"), Rule("any", "block", "(?i)/[^?]*%00", ())]
    urls = [f"http://{word()}.{word()}.{rng.choice(['com', 'org'])}/{word()}{rng.choice('/-.')}{word()}/a?{word()}_id=1&B={word()}"
            for _ in range(400)] + ["http://b.com?ax1_id=2", "http://q.com/%00", "http://Q.com/ZZ#x", "http://q.com/zz1",
                                    "http://ax1?x=.by2.com/", "no", None] + ["http://hot.com/zz"] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.host) for r in rules], url_filter.RULES)
    path = scratch_path(spark, "url-rules")
    table.write.json(path)
    compiled = [(r, re.compile(r.pattern.replace("\\z", "\\Z"))) for r in set(rules)]

    def expected(u):
        m = re.search(r"://([^/?#]*)([^?#]*)(\?[^#]*)?", u or "")
        subject = lower(m[1]) + m[2] + (m[3] or "") if m else ""
        fits = [r for r, p in compiled if p.search(subject)] if subject else []
        if not fits:
            return None, None, "allow"
        best = max(fits, key=lambda r: (r.host, len(r.name), r.action == "block", r.name, r.action))
        return (best.name, None, best.action) if best.host else (None, best.name, best.action)
    got = filter_urls(pages, url_filter.read_rules(spark, path)).collect()
    assert len(got) == len(urls)
    assert {r["page_id"]: (r["rule"], r["pattern"], r["verdict"]) for r in got} == {
        i: expected(u) for i, u in enumerate(urls)}
    assert sum(r["pattern"] is not None for r in got) > 20 and sum(r["rule"] is not None for r in got) > 20
    tried = url_filter.candidate_rules(url_filter.url_subjects(pages), table, len(rules)).count()
    assert tried < 0.05 * len(set(urls)) * len(rules)


def test_unwanted_paths_and_queries(spark):
    urls = ["http://a.net/x/Online-Casino.html", "http://a.net/casinos", "http://a.net/p?a=1&PHPSESSID=2", "http://a.net/phpsessid=1",
            "http://a.net/wp-login.php?x", "http://adult-x.net/", "http://a.net/?ref=casino", "http://a.org/casino"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = filter_urls(pages, [host_rule("allow", "org", "/")] + url_filter.UNWANTED).collect()
    assert [r["verdict"] for r in sorted(got)] == ["block", "allow", "block", "allow", "block", "block", "allow", "allow"]


# -- 3 decontamination ------------------------------------------------------

def brute_hits(texts, items):
    def toks(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    wins = defaultdict(set)
    for i, t in items:
        w = toks(t)
        n = min(10, len(w))
        for j in range(len(w) - n + 1 if w and i is not None else 0):
            wins[tuple(w[j:j + n])].add(str(i))
    lengths = {len(k) for k in wins}
    for t in texts:
        w, hit, ids = toks(t), set(), set()
        for n in lengths:
            for j in range(len(w) - n + 1):
                got = wins.get(tuple(w[j:j + n]))
                if got:
                    hit.update(range(j, j + n))
                    ids |= got
        yield len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, docs, rows, empty, block):
    rng = random.Random(9)
    long = [r[1] for r in rows if r[1] and len(r[1]) > 400]
    items = [(i, " ".join(rng.choice(long).split()[3:3 + rng.randint(1, 40)])) for i in range(12)]
    items += [(50, "Über, straße"), (51, ""), (52, None), (None, "one two three"), (53, "ONE; two. Three!"),
              (53, "this VERY common line"), (54, "und " * 14), (55, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(docs.withColumn("items", F.lit(3)), bench, block_bytes=block).collect()
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    want = dict(zip(map(key, rows), brute_hits([r[1] for r in rows], items)))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_hit"], sorted(r["items"])) == want[key((r["doc_id"], r["text"]))]
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"]
    assert sum(r["n_hit"] > 0 for r in got) > 5
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_blocks_are_bounded_within_one_item(spark):
    """One id with a third of all texts does not come in one block; hits of
    its blocks are united, over more passes than one job runs."""
    rng = random.Random(2)
    texts = [prose(rng, 12) for _ in range(24)]
    items = [(1, t) for t in texts] + [(1, texts[0])] * 3 + [(2, "x" * 900), (3, texts[1] + " more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontamination._blocks(bench, "item_id", "text", 300))
    assert len(blocks) > decontamination.PASSES
    assert all(sum(len(t) for t in b[1]) <= 300 or len(b[1]) == 1 for b in blocks)
    assert sorted(x for b in blocks for x in zip(*b)) == sorted({(str(i), t) for i, t in items})
    docs = spark.createDataFrame([(1, " . ".join(texts)), (2, texts[1]), (3, "none of it")], "doc_id long, text string")
    got = decontaminate(docs, bench, block_bytes=300).collect()
    want = list(brute_hits([r["text"] for r in got], items))
    assert [(r["n_words"], r["n_hit"], sorted(r["items"])) for r in got] == want and want[0][1] > 200


# -- 4 line dedup -----------------------------------------------------------

def test_line_dedup(spark, docs, rows, empty):
    strip = " \t\n\x0b\x0c\r"
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            k = lower(x.strip(strip))
            if len(k) >= 20:
                holders[k].add(-1 if i is None else i)
    want = Counter()
    for i, t, *_ in rows:
        own = -1 if i is None else i
        ls = (t or "").split("\n")
        keep = [x for x in ls if len(holders[lower(x.strip(strip))]) < 3 or max(holders[lower(x.strip(strip))]) == own]
        want[(i, len(ls), len(ls) - len(keep), "\n".join(keep))] += 1
    got = dedup_lines(docs.withColumn("kept", F.lit(1)), batches=3, fanout=2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in got.collect()) == want
    assert sum(k[2] for k in want) > 30
    assert dedup_lines(empty, batches=2).count() == 0


def test_line_runs_levels(spark, docs):
    """Batches one after another: seen lines are anti-joined, runs compacted."""
    runs, seen = LineRuns(spark, fanout=2), set()
    for b in range(5):
        part = long_lines(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == b), "doc_id", "text")
        new = {bytes(r["key"]) for r in runs.unseen(part).select("key").collect()}
        own = {bytes(r["key"]) for r in part.select("key").collect()}
        assert new == own - seen
        seen |= own
        runs.add(part)
        assert all(len(level) < 2 for level in runs.levels)
    keys = [bytes(r["key"]) for r in runs.read().select("key").collect()]
    assert set(keys) == seen and len(keys) == len(seen)      # a key lies in one run
    want = defaultdict(set)
    for r in long_lines(docs, "doc_id", "text").collect():
        want[bytes(r["key"])].add(r["doc"])
    for least in (1, 2, 3):
        got = {bytes(r["key"]): (r["n_docs"], r["last"]) for r in runs.common(least).collect()}
        assert got == {k: (len(d), max((x for x in d if x is not None), default=None))
                       for k, d in want.items() if len(d) >= least}


def test_inner_names_as_input_columns(spark, docs):
    """Columns named like those that the operators use inside pass through."""
    names = ("row id whole alike lines gone same doc _same _lines key order0 best grown number at part first before "
             "shard_ _first _before _row _at _part url decided win _url token subject pos line n_docs last n").split()
    wide = docs.select("*", *[F.lit(f"own {c}").alias(c) for c in names])

    def same(make, new):
        a, b = make(docs), make(wide)
        assert set(names) < set(b.columns)
        cols = ["doc_id", "text", *new]
        assert sorted(map(str, b.select(*cols).collect())) == sorted(map(str, a.select(*cols).collect()))
        got = b.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [tuple(f"own {c}" for c in names)]
    same(dedup_lines, ["n_lines", "n_dropped", "kept"])
    same(lambda d: filter_urls(d, UNWANTED_HOSTS, "text"), ["host", "path", "rule", "verdict"])
    same(lambda d: assign_shards(d, "doc_id", [1.0] * 3, [1.0] * 4, ["text"]), ["shard", "grown_shard"])


# -- 5 sharding -------------------------------------------------------------

def test_sharding_equals_brute_force(spark, rows):
    """Shards, grown shards and slots recomputed from MD5."""
    import hashlib

    def shard(key, weights):
        def score(s):
            text = f"{'null' if key is None else key}:{s}"
            u = (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
            return -weights[s] / math.log(u)
        return max(range(len(weights)), key=lambda s: (score(s), s))
    df = spark.createDataFrame(rows, DOCS).select("doc_id", "text").repartition(7)
    for before, after in (([1.0] * 8, [1.0] * 9), ([1.0, 3.0], [2.0, 1.0, 1.0])):
        got = assign_shards(df, "doc_id", before, after, ["text"]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["shard"], r["grown_shard"]) == (shard(r["doc_id"], before), shard(r["doc_id"], after))
        for s in {r["shard"] for r in got}:
            mine = sorted((r for r in got if r["shard"] == s), key=lambda r: r["slot"])
            order = [(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode())
                     for r in mine]
            assert [r["slot"] for r in mine] == list(range(len(mine))) and order == sorted(order)


def test_sharding(spark, rows):
    df = spark.createDataFrame(rows + rows[:1] * 50, DOCS).withColumn("shard", F.lit("old"))
    got = assign_shards(df, "doc_id", [1.0, 2.0, 0.0, 1.0], [1.0, 2.0, 0.0, 1.0, 1.0], ["text"]).collect()
    slots, home = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        home[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        assert r["grown_shard"] in (r["shard"], 4) and r["shard"] != 2
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(v) == 1 for v in home.values()) and len(got) == len(rows) + 50
    many = assign_shards(spark.range(20_000), "id", [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0])
    n = {r["shard"]: r["count"] for r in many.groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02
    assert abs(many.filter("grown_shard = 3").count() / 20_000 - 0.2) < 0.02
    assert assign_shards(spark.range(0), "id", [1.0]).count() == 0
    with pytest.raises(ValueError):
        assign_shards(spark.range(1), "id", [0.0])


# -- 6 quality classifier ---------------------------------------------------

def test_crf_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    model = qc.Field(np.ones(1), rng.normal(size=(2, 2)))
    bound = np.array([0, 4, 5, 10])
    e = rng.normal(size=10)
    p, counts = qc.marginals(model, e, bound, pairs=True)
    want, pairs = np.zeros(10), np.zeros((2, 2))
    for a, b in zip(bound, bound[1:]):
        z, m, c = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for bits in range(2 ** (b - a)):
            y = [(bits >> k) & 1 for k in range(b - a)]
            s = sum(e[a + k] * y[k] for k in range(b - a)) + sum(model.step[y[k], y[k + 1]] for k in range(b - a - 1))
            w = math.exp(s)
            z += w
            m += w * np.array(y)
            for k in range(b - a - 1):
                c[y[k], y[k + 1]] += w
        want[a:b] = m / z
        pairs += c / z
    assert np.allclose(p, want) and np.allclose(counts, pairs)


def test_quality_classifier(spark, docs, rows, empty):
    from conftest import SF_CHECK
    from quarry.sources.tables import read_table
    d, lab = read_table(spark, SF_CHECK, "documents"), read_table(spark, SF_CHECK, "labels")
    model = qc.fit_classifier(d, lab, remainder("doc_id", 3) != 1)
    out = qc.classify_quality(d, model).join(lab.filter(remainder("doc_id", 3) == 1), "doc_id")
    assert out.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0] > 0.95
    got = qc.classify_quality(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert qc.classify_quality(empty, model).count() == 0
    none = qc.fit_classifier(d, lab.limit(0), F.lit(True))
    assert {r["predicted"] for r in qc.classify_quality(docs, none).collect()} == {1}


# -- 7 Jaccard join ---------------------------------------------------------

def brute_components(rows):
    sets = defaultdict(list)
    for i, t, *_ in rows:
        w = words(lower(t))
        s = {tuple(w[j:j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i].append(s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in ids:
        for j in ids:
            if j < i and any(100 * len(a & b) >= 80 * len(a | b) for a in sets[i] if a for b in sets[j] if b):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sets, {i: find(i) for i in ids}


def check_components(spark, rows):
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    got = jj.jaccard_components(df.repartition(4)).collect()
    sets, comp = brute_components(rows)
    assert Counter((r["doc_id"], r["n_shingles"]) for r in got) == Counter(
        (i, len(s)) for i, ss in sets.items() for s in ss)
    assert all(r["component_id"] == comp.get(r["doc_id"]) for r in got)
    return comp


def test_jaccard_components(spark, rows, empty):
    comp = check_components(spark, rows)
    assert Counter(comp.values())[100] == 20
    assert jj.jaccard_components(empty).count() == 0


def test_jaccard_threshold_and_chains(spark):
    """Pairs at and around 0.8, chains, groups around different centres."""
    rng = random.Random(11)
    rows, i = [], 0
    for n in (9, 12, 40, 90, 200):
        base = [f"t{rng.randrange(10 ** 6)}" for _ in range(n)]
        for step in range(12):
            rows.append((i, " ".join(base)))
            i += 1
            base = list(base)
            if step % 2:
                base[rng.randrange(len(base))] = f"u{i}"
            else:
                base = base[1:] + [f"v{i}" for _ in range(rng.randint(0, max(2, n // 9)))]
    rows += [(i + k, " ".join(f"a{j}" for j in range(5 + k))) for k in range(30)]
    comp = check_components(spark, rows)
    assert 5 < len(set(comp.values())) < len(comp)


def test_key_counts_cover_links():
    """With the chosen number of keys the first common shingle is in both."""
    for n in (1, 2, 5, 9, 10, 30, 400, 5000):
        for crowded in {0, n // 3, n}:
            k = jj.n_keys(n, crowded)
            outside = n - -(-80 * n // 100)
            assert 1 <= k <= outside + 1
            if crowded == 0:
                miss = np.prod([(outside - i) / (n - i) for i in range(k)])
                assert miss < jj.MISS or k == outside + 1
    assert jj.n_keys(5000, 0) < 20 < jj.n_keys(5000, 4500)


# -- 8 language ID ----------------------------------------------------------

def test_language_id(spark, docs, rows, empty):
    from conftest import SF_CHECK
    from quarry.sources.tables import read_table
    d = read_table(spark, SF_CHECK, "documents")
    learned = lid.fit_dictionaries(d, remainder("doc_id", 3) != 1)
    held = d.filter(remainder("doc_id", 3) == 1)
    out = lid.identify_language(held, learned)
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0] > 0.95
    got = {r["text"]: r for r in lid.identify_language(docs.withColumn("score", F.lit(0)), learned,
                                                       keep_text=True).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got[" \n\t "]["lang_pred"] == "und"
    assert all(r["lang_pred"] in learned or not any(c.isalpha() for c in t or "") for t, r in got.items())
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert lid.identify_language(empty, learned).count() == 0
    assert lid.fit_dictionaries(empty, F.lit(True)) == {}
    assert {r["lang_pred"] for r in lid.identify_language(docs, {}).collect()} == {"und"}
    assert {r["lang_pred"] for r in lid.identify_language(docs, {"xx": b"abc"}).collect()} == {"und", "xx"}


# -- 9 quality rules --------------------------------------------------------

def brute_statistics(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for x in t.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(wins)
    rep = {j for i, x in enumerate(wins) if n[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep)


def test_quality_rules(spark, docs, rows, empty):
    from conftest import SF_CHECK
    from quarry.sources.tables import read_table
    d, lab = read_table(spark, SF_CHECK, "documents"), read_table(spark, SF_CHECK, "labels")
    trees = qr.fit_rules(d, lab)
    for df in (docs.withColumn("kept", F.lit(0)), d):
        got = qr.quality_rules(df, trees, keep_text=True).collect()
        for r in got:
            n, chars, sym, dup, rep = want = brute_statistics(r["text"])
            assert tuple(r[c] for c in qr.BASE) == want
            assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n)
            assert not (r["kept"] and r["base_failed"])
    good = qr.quality_rules(d, trees).filter("not base_failed").join(lab, "doc_id")
    assert good.filter("kept and quality = 1 or not kept and quality = 0").count() > 0.97 * good.count()
    assert qr.quality_rules(empty, trees).count() == 0
    assert qr.fit_rules(d, lab.limit(0)) is None
    alone = qr.quality_rules(docs, None).collect()
    assert all(r["kept"] == (not r["base_failed"]) and r["score"] is None for r in alone)


def test_trees_are_monotone():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(800, 3))
    y = (rng.uniform(size=800) < 0.2 + 0.6 * np.abs(x[:, 0] - 0.5) + 0.2 * x[:, 1]).astype(float)
    trees = qr.fit_trees(x, y, np.array([-1, 1, 0]), trees=30)
    for f, sign in ((0, -1), (1, 1)):
        at = rng.uniform(size=(50, 3))
        line = np.stack([trees.score(np.where(np.arange(3) == f, v, at)) for v in np.linspace(0, 1, 60)])
        assert (sign * np.diff(line, axis=0) >= -1e-12).all()
    assert len(np.unique(trees.score(x))) > 5


# -- 10 LM scoring ----------------------------------------------------------

def test_lattice_equals_enumeration():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b"ba", b" ab", b"c", b"abc"]
    logp = np.log([.1, .05, .2, .1, .15, .05, .1, .1, .05, .1])
    model, at = lm.Lattice(pieces, logp), dict(zip(pieces, logp))
    rng = random.Random(4)
    ws = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(200)] + [b"ab" * 500]

    def every(w):
        if not w:
            yield 0.0
        for n in range(1, min(3, len(w)) + 1):
            if w[:n] in at:
                for rest in every(w[n:]):
                    yield at[w[:n]] + rest
    end = np.cumsum([len(w) for w in ws])
    start = end - [len(w) for w in ws]
    got, uses = model.words(np.frombuffer(b"".join(ws), np.uint8), start, end, np.ones(len(ws)))
    for w, g in list(zip(ws, got))[:200]:
        assert math.isclose(g, math.log(sum(map(math.exp, every(b" " + w)))), rel_tol=1e-9)
    assert math.isclose(sum(u * len(p) for u, p in zip(uses, pieces)), sum(len(w) + 1 for w in ws), rel_tol=1e-9)


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 5])
def test_lm_scores(spark, docs, rows, empty, frequent, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    pieces = lm.public_pieces()
    train = remainder("doc_id", 10) != 0
    got = lm.score_documents(docs, train, pieces).collect()
    toks = [(r[0], [*words(lower(r[1])), None]) for r in rows]
    c = Counter()
    for i, w in toks:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + .1) / (n + .1 * (v + 1))) for x in w), 6)) for i, w in toks)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(empty, train, pieces).count() == 0
    none = lm.score_documents(docs.limit(3), F.lit(False), pieces).collect()
    assert len(none) == 3 and all(r["train_tokens"] == r["n_known"] == r["base_score"] == 0 for r in none)




def test_language_is_learned_past_a_shared_header(spark):
    """Every text opens with the same long header in one language."""
    rng = random.Random(9)
    words_of = {c: ["".join(rng.choice(abc) for _ in range(rng.randint(3, 8))) for _ in range(60)]
                for c, abc in (("aa", "abcdefg"), ("bb", "hijklmn"), ("cc", "opqrstu"))}
    header = " ".join(rng.choice(words_of["aa"]) for _ in range(120)) + "\n"

    def body(c):
        return " ".join(rng.choice(words_of[c]) for _ in range(900))
    rows = [(i, header + body(c), c) for i, c in enumerate("aa bb cc".split() * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = lid.fit_dictionaries(docs, F.col("doc_id") < 18, chars=400)
    assert set(learned) == set(words_of) and max(map(len, learned.values())) < lid.DICTIONARY_BYTES
    tests = spark.createDataFrame([(i, body(c), c) for i, c in enumerate("aa bb cc".split() * 5)],
                                  "doc_id long, text string, lang string")
    got = lid.identify_language(tests, learned).collect()
    assert all(r["lang_pred"] == r["lang"] for r in got)
    # whole pieces only: a bound of two pieces and a half holds two
    small, lid.DICTIONARY_BYTES = lid.DICTIONARY_BYTES, 1000
    try:
        assert {len(d) for d in lid.fit_dictionaries(docs, F.col("doc_id") < 18, chars=400).values()} == {802}
    finally:
        lid.DICTIONARY_BYTES = small


def test_classifier_learns_from_the_whole_text(spark):
    """Only lines far beyond the first ``lines`` tell the classes apart."""
    same = ["a plain line of words that says nothing"] * 30

    def text(good, i):
        own = [f"A sentence of {i} calm words, with an end." if good else f"$$$ BUY {i} ### NOW !!! ###"] * 400
        return "\n".join(same + own)
    rows = [(i, text(i % 2 == 0, i), i % 2 == 0) for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows], "doc_id long, quality int, toxic int")
    model = qc.fit_classifier(docs, labels, F.col("doc_id") < 24, lines=20)
    got = {r["doc_id"]: r["predicted"] for r in qc.classify_quality(docs, model).collect()}
    assert all(got[i] == int(g) for i, _, g in rows if i >= 24)
