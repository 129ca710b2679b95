"""Quality rules: boosted trees over document statistics.

:func:`document_statistics` counts words, symbols, repeated lines and
repeated word windows of whole texts.  :func:`fit_rules` fits boosted
regression trees (logistic loss, histogram splits) to labelled documents;
along chosen features the score may only fall (or only rise).  The trees are
flattened into node arrays, so a batch of documents is scored level by level
with numpy indexing.

Edge cases: a null or empty text has zero words, fails the base rule and is
not kept; repeated rows are judged one by one; other columns pass through,
and input columns named like an output are replaced; an empty table gives an
empty result; without labels of both classes the base rule decides alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textscan import (NOT_SPACE, SLICE_BYTES, Texts, add_columns, byte_table, field, mix, ngrams, row_of)

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Bound on the labelled documents that the trees are fitted on.
FIT_DOCUMENTS = 6000

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
            "exclaim_per_word", "pipe_per_word", "digit_share", "distinct_share", "words_per_line", "stop_per_word"]
#: -1: the score may only fall along the feature.
MONOTONE = {"symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "exclaim_per_word": -1}

_SYMBOLS = byte_table("#*$%&|<>")
_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DIGIT = byte_table("0123456789")
_EXCLAIM, _PIPE, _STOP = byte_table("!"), byte_table("|"), byte_table(".?;:,")


def _per_row_distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per row."""
    key = mix(h + row.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, first = np.unique(key, return_index=True)
    return np.bincount(row[first], minlength=n)


def statistics(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The base counts (rows x 5) and the features (rows x 12) of a slice."""
    n = texts.n
    start, end, bound = texts.spans(NOT_SPACE)
    row = row_of(bound)
    pre = texts.prefix(low=False)
    h = texts.span_hash(pre, start, end)
    words = np.diff(bound)

    lead = (texts.buf & 0xC0) != 0x80
    in_word = NOT_SPACE[texts.buf]
    chars = np.add.reduceat(lead & in_word, texts.off[:-1], dtype=np.int64) if n else words
    symbols = texts.per_row(_SYMBOLS)

    ls, le, lbound = texts.lines()
    lrow = row_of(lbound)
    has_word = np.searchsorted(start, le) > np.searchsorted(start, ls)
    lines = np.bincount(lrow[has_word], minlength=n)
    dup_lines = lines - _per_row_distinct(lrow[has_word], texts.span_hash(pre, ls[has_word], le[has_word]), n)

    repeat = np.zeros(n, dtype=np.int64)
    g, whole = ngrams(h, row, WINDOW)
    if len(g):
        g = mix(g + row[:len(g)].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        s = np.sort(g[whole])
        again = s[1:][s[1:] == s[:-1]]
        if len(again):
            at = np.flatnonzero(whole & np.isin(g, again))
            cover = np.zeros(len(h) + 1, dtype=np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            repeat = np.bincount(row[np.cumsum(cover[:-1]) > 0], minlength=n)

    w = np.maximum(words, 1)
    base = np.stack([words, chars, symbols, dup_lines, repeat], axis=1).astype(np.int64)
    letters = np.maximum(texts.per_row(_LETTER), 1)
    feats = np.stack([
        np.log1p(words), chars / w, symbols / w, dup_lines / np.maximum(lines, 1), repeat / w,
        texts.per_row(_UPPER) / letters, texts.per_row(_EXCLAIM) / w, texts.per_row(_PIPE) / w,
        texts.per_row(_DIGIT) / np.maximum(chars, 1), _per_row_distinct(row, h, n) / w,
        words / np.maximum(lines, 1), texts.per_row(_STOP) / w], axis=1)
    return base, feats


# -- trees ------------------------------------------------------------------

@dataclass
class Trees:
    """Flattened trees, one row of the arrays per tree.  Node i of a tree
    goes on at ``child[i]`` (feature at or below the threshold) or at
    ``child[i] + 1``; a leaf goes on at itself."""
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good class for every row of ``x``."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, c, v in zip(self.feature, self.threshold, self.child, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                right = x[rows, f[at]] > t[at]
                at = np.where(c[at] == at, at, c[at] + right)
            out += v[at]
        return 1.0 / (1.0 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = 60, depth: int = 3,
              rate: float = 0.2, bins: int = 48, smooth: float = 2.0, least: float = 4.0) -> Trees:
    """Boosted trees for labels ``y`` in {0, 1}.  ``sign[f]`` is -1, 0 or 1:
    the score never rises, is free, or never falls along feature f.  A split
    on such a feature must order its two values, and both subtrees stay on
    their side of the middle between them."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    code = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p0 / (1 - p0)))
    margin = np.full(n, bias)
    size = 2 ** (depth + 1) - 1
    parts = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feat, thr = np.zeros(size, np.int64), np.zeros(size)
        child, val = np.arange(size), np.zeros(size)
        nodes, used = [(0, np.arange(n), -np.inf, np.inf, 0)], 1
        while nodes:
            i, idx, lo, hi, level = nodes.pop()
            gsum, hsum = grad[idx].sum(), hess[idx].sum()
            val[i] = rate * float(np.clip(gsum / (hsum + smooth), lo, hi))
            best = None
            if level < depth and hsum > least:
                for f in range(m):
                    if not len(edges[f]):
                        continue
                    k = len(edges[f]) + 1
                    gl = np.cumsum(np.bincount(code[idx, f], grad[idx], k))[:-1]
                    hl = np.cumsum(np.bincount(code[idx, f], hess[idx], k))[:-1]
                    vl = np.clip(gl / (hl + smooth), lo, hi)
                    vr = np.clip((gsum - gl) / (hsum - hl + smooth), lo, hi)
                    gain = gl * gl / (hl + smooth) + (gsum - gl) ** 2 / (hsum - hl + smooth)
                    ok = (hl > 0.5) & (hsum - hl > 0.5) & (sign[f] * (vr - vl) >= 0)
                    gain = np.where(ok, gain, -np.inf)
                    b = int(np.argmax(gain))
                    if gain[b] > gsum * gsum / (hsum + smooth) + 1e-9 and (best is None or gain[b] > best[0]):
                        best = (gain[b], f, b, vl[b], vr[b])
            if best is None:
                continue
            _, f, b, vl, vr = best
            feat[i], thr[i], child[i] = f, edges[f][b], used
            left = code[idx, f] <= b
            mid = (vl + vr) / 2
            bounds = [(lo, hi), (lo, hi)]
            if sign[f] > 0:
                bounds = [(lo, min(hi, mid)), (max(lo, mid), hi)]
            elif sign[f] < 0:
                bounds = [(max(lo, mid), hi), (lo, min(hi, mid))]
            nodes.append((used, idx[left], *bounds[0], level + 1))
            nodes.append((used + 1, idx[~left], *bounds[1], level + 1))
            used += 2
        parts.append((feat, thr, child, val))
        one = Trees(*(a[None] for a in parts[-1]), bias=0.0, depth=depth)
        q = one.score(x)
        margin += np.log(q / (1 - q))
    return Trees(*(np.stack(a) for a in zip(*parts)), bias=bias, depth=depth)


# -- operators --------------------------------------------------------------

_STAT_FIELDS = [field(c, T.LongType()) for c in BASE] + [field("features", T.ArrayType(T.DoubleType()))]


def document_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the five counts and the feature array."""
    def make():
        def fn(arr):
            base, feats = statistics(Texts(arr))
            flat = pa.ListArray.from_arrays(np.arange(0, feats.size + 1, len(FEATURES), dtype=np.int32),
                                            pa.array(feats.ravel()))
            return [base[:, i] for i in range(len(BASE))] + [flat]
        return fn
    return add_columns(docs, text_col, _STAT_FIELDS, make, drop=(text_col,))


def fit_rules(docs: DataFrame, labels: DataFrame, limit: int = FIT_DOCUMENTS, id_col: str = "doc_id",
              text_col: str = "text", label_col: str = "quality") -> Trees | None:
    """Trees fitted on at most ``limit`` labelled documents, those with the
    smallest hashes of their ids; ``None`` unless both classes occur."""
    picked = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(id_col, F.col(label_col).cast("int").alias("_label"))
              .orderBy(F.xxhash64(id_col), id_col, "_label").limit(limit))
    rows = (document_statistics(docs.select(id_col, text_col)
                                .join(F.broadcast(picked), id_col).select("_label", text_col), text_col)
            .select("_label", "features").toPandas())
    rows = rows[rows["_label"].isin([0, 1])]
    if rows["_label"].nunique() < 2:
        return None
    x = np.stack(rows["features"].to_numpy())
    y = rows["_label"].to_numpy(dtype=float)
    order = np.lexsort([*x.T, y])      # the fit does not depend on the row order
    return fit_trees(x[order], y[order], np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def quality_rules(docs: DataFrame, trees: Trees | None, text_col: str = "text", threshold: float = 0.5,
                  keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with the counts, ``base_failed``, ``score`` (the
    trees' probability of good quality; null without trees) and ``kept``."""
    fields = [field(c, T.LongType()) for c in BASE] + [
        field("base_failed", T.BooleanType()), field("score", T.DoubleType()), field("kept", T.BooleanType())]

    def make():
        def fn(arr):
            base, feats = statistics(Texts(arr))
            words, repeat = base[:, 0], base[:, 4]
            failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * words)
            score = trees.score(feats) if trees is not None else None
            kept = ~failed if score is None else ~failed & (score >= threshold)
            return [base[:, i] for i in range(len(BASE))] + [
                failed, pa.nulls(len(failed), pa.float64()) if score is None else score, kept]
        return fn
    # the statistics take many times a slice's bytes, the text passes through besides
    return add_columns(docs, text_col, fields, make, drop=() if keep_text else (text_col,), limit=SLICE_BYTES // 2)
