"""Benchmark decontamination by winnowing.

Of every ``WINNOW`` consecutive ``GRAM``-word hashes of a text the smallest
(the rightmost of equals) is its fingerprint.  Any shared run of
``GRAM + WINNOW - 1 = WINDOW`` words holds a whole winnowing window, so both
texts pick the same fingerprint inside it: joining the fingerprints of
training and test texts misses no such run.  Around each joined fingerprint
the hit is extended to the item windows of ``WINDOW`` words that contain it,
checked on their words.  Items shorter than ``WINDOW`` words lie below the
guarantee; each is one window, looked up whole.

The test side is sent to the tasks in blocks of at most ``BLOCK_BYTES`` of
text (or one text above it), one pass over the documents per block, and the
result written every ``PASSES`` passes; nothing is shuffled, so a passage that
every document holds costs no more than any other.

Edge cases: a null or empty text has no words and no hit; an item with a null
id or without words hits nothing; items that share an id count once; repeated
document rows are judged one by one; other columns pass through, and input
columns named like an output are replaced; an empty documents table gives an
empty result, an empty benchmark no hits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.stored import stored
from quarry.llm.textscan import ALNUM, Texts, field, map_slices, ngrams, row_of

WINDOW = 10
GRAM = 5
WINNOW = WINDOW - GRAM + 1
#: Bound on the item text that one pass sends to the tasks.
BLOCK_BYTES = 8 << 20
#: Passes that run in one job; their result is written before the next ones.
PASSES = 4

SPAN = T.StructType([field("start", T.IntegerType()), field("end", T.IntegerType())])
FIELDS = [field("n_words", T.LongType()), field("n_hit", T.LongType()),
          field("spans", T.ArrayType(SPAN)), field("items", T.ArrayType(T.StringType()))]


class Words:
    """Lower-cased words of a slice with their hashes."""

    def __init__(self, arr: pa.Array):
        self.texts = Texts(arr)
        self.start, self.end, self.bound = self.texts.spans(ALNUM, low=True)
        self.row = row_of(self.bound)
        self.hash = self.texts.span_hash(self.texts.prefix(low=True), self.start, self.end)

    def window(self, at: int, n: int) -> bytes:
        low = self.texts.low
        return b" ".join(low[a:b].tobytes() for a, b in zip(self.start[at:at + n], self.end[at:at + n]))


def fingerprints(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Positions (first word) and hashes of the winnowed fingerprints."""
    g, _ = ngrams(words.hash, words.row, GRAM)
    n = len(g) - WINNOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    least = g[:n].copy()
    for j in range(1, WINNOW):
        np.minimum(least, g[j:j + n], out=least)
    pick = np.zeros(n, dtype=np.int64)
    for j in range(1, WINNOW):
        pick[g[j:j + n] == least] = j
    whole = words.row[:n] == words.row[WINDOW - 1:WINDOW - 1 + n]
    at = np.unique((np.arange(n) + pick)[whole])
    return at, g[at]


class ItemIndex:
    """Fingerprints and windows of one block of items."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.words = Words(pa.array(texts, pa.string()))
        self.ids = ids
        count = np.diff(self.words.bound)
        self.prints = np.unique(fingerprints(self.words)[1])
        self.tables = {}
        for n in sorted({int(min(c, WINDOW)) for c in count if c}):
            g, whole = ngrams(self.words.hash, self.words.row, n)
            size = count[self.words.row[:len(g)]]
            at = np.flatnonzero(whole & (size == n if n < WINDOW else size >= n))
            at = at[np.argsort(g[at], kind="stable")]
            keys, first = np.unique(g[at], return_index=True)
            last = np.append(first[1:], len(at))
            items = [np.unique(self.words.row[at[a:b]]) for a, b in zip(first, last)]
            self.tables[n] = (keys, at[first], items)

    def windows(self, words: Words) -> tuple[np.ndarray, set[tuple[int, int]]]:
        """Which words are hit, and the (row, item) pairs of the hits."""
        cover = np.zeros(len(words.hash) + 1, dtype=np.int64)
        pairs: set[tuple[int, int]] = set()
        for n, (keys, sample, items) in self.tables.items():
            g, whole = ngrams(words.hash, words.row, n)
            if not len(g):
                continue
            if n == WINDOW:
                at, h = fingerprints(words)
                at = at[np.isin(h, self.prints)]
                at = np.unique((at[:, None] - np.arange(WINNOW)[None, :]).ravel())
                at = at[(at >= 0) & (at < len(g))]
            else:
                at = np.arange(len(g))
            at = at[whole[at]]
            slot = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            same = keys[slot] == g[at]
            for p, k in zip(at[same].tolist(), slot[same].tolist()):
                if words.window(p, n) == self.words.window(sample[k], n):
                    cover[p] += 1
                    cover[p + n] -= 1
                    row = int(words.row[p])
                    pairs.update((row, int(i)) for i in items[k])
        return np.cumsum(cover[:-1]) > 0, pairs


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """Item blocks of at most ``limit`` bytes of text, or of one text.  An
    item's texts may lie in several blocks; the passes unite its hits."""
    rows = items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).distinct()
    size = F.sum(F.octet_length("text").cast("long")).alias("b")
    total = rows.agg(size, F.count("*").alias("n")).first()
    if not total["n"]:
        return
    count = max(1, math.ceil(total["b"] / limit))
    while True:
        part = F.pmod(F.xxhash64("id", "text"), F.lit(count))
        largest = (rows.groupBy(part.alias("p")).agg(size, F.count("*").alias("n"))
                   .filter("n > 1").agg(F.max("b")).first()[0])
        if largest is None or largest <= limit:
            break
        count *= 2
    for k in range(count):
        got = rows.filter(part == k).orderBy("id", "text").collect()
        if got:
            yield [r["id"] for r in got], [r["text"] for r in got]


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _pass(docs: DataFrame, block, text_col: str, first: bool) -> DataFrame:
    names = [f.name for f in FIELDS]
    keep = [c for c in docs.columns if c not in names]
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def make():
        index = ItemIndex(*shared.value)

        def fn(batch):
            words = Words(batch.column(text_col))
            hit, pairs = index.windows(words)
            found = [set() for _ in range(batch.num_rows)]
            for row, item in pairs:
                found[row].add(index.ids[item])
            if not first:
                for row, spans in enumerate(batch.column("spans").to_pylist()):
                    for s in spans:
                        hit[words.bound[row] + s["start"]:words.bound[row] + s["end"]] = True
                for row, ids in enumerate(batch.column("items").to_pylist()):
                    found[row].update(ids)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            begin, stop = edge[0::2], edge[1::2]
            # a run that goes on into the next row is cut at the row's border
            cut = words.bound[1:-1]
            cut = cut[(cut > 0) & (cut < len(hit))]
            cut = np.unique(cut[hit[cut] & hit[cut - 1]]) if len(hit) else cut
            begin, stop = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([stop, cut]))
            per = np.searchsorted(begin, words.bound)
            base = np.repeat(words.bound[:-1], np.diff(per))
            spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(stop - base, pa.int32())],
                                               fields=[pa.field("start", pa.int32()), pa.field("end", pa.int32())])
            total = np.concatenate([[0], np.cumsum(hit)])
            ids = [sorted(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep]
                + [pa.array(np.diff(words.bound)), pa.array(np.diff(total[words.bound])), _lists(per, spans),
                   pa.array(ids, pa.list_(pa.string()))], names=keep + names)
        return fn
    return map_slices(docs, text_col, T.StructType([docs.schema[c] for c in keep] + FIELDS), make)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit`` (words inside item
    windows), ``spans`` (the hit runs as word positions, end excluded) and
    ``items`` (ids, as strings, of the items with occurring windows)."""
    out, done = docs, 0
    for block in _blocks(items, item_id, item_text, block_bytes):
        if done and done % PASSES == 0:
            out = stored(out, "decontamination")
        out, done = _pass(out, block, text_col, not done), done + 1
    return out if done else _pass(docs, ([], []), text_col, True)
