"""Line quality with a linear-chain conditional random field.

Every line of a text is labelled good or bad.  The features of a line and of
its two neighbours give its emission scores, a 2 x 2 table the transitions;
forward-backward marginals give each line's probability to be good, and their
mean, weighted by line length, is the document's score.

The field is fitted by gradient descent on the likelihood of line labels that
training documents hand down to their lines, on a bounded sample: at most
``FIT_DOCUMENTS`` labelled documents, chosen by the hash of their ids, and
``FIT_LINES`` lines in a row of each, from a place that the text's hash draws.
Texts are scored whole: all lines of a slice of
rows run through the recursion together, one step per line position.

Edge cases: a null or empty text is one empty line, which has a score like
any other; lines without characters weigh 1; repeated rows are scored one by
one; other columns pass through, and input columns named like an output are
replaced; an empty table gives an empty result; without labels of both
classes every line's probability is the share of good labels (1 if none).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textscan import NOT_SPACE, Texts, add_columns, byte_table, field, mix, row_of

FIT_DOCUMENTS = 3000
FIT_LINES = 200
STEPS = 150

_UPPER = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = byte_table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = byte_table("0123456789")
_SYMBOL = byte_table("#*$%&<>~^=+_{}[]\\/@")
_MARK, _PIPE, _STOP = byte_table("!?"), byte_table("|"), byte_table(".,;:")
LINE_FEATURES = ["bias", "log_chars", "empty", "upper", "digit", "symbol", "marks", "pipe", "stops",
                 "mean_word", "repeat", "short"]
N_OWN = len(LINE_FEATURES)


def line_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes, and the row borders."""
    ls, le, bound = texts.lines()
    n = len(ls)
    if not n:
        return np.zeros((0, N_OWN)), np.zeros(0, np.int64), bound

    def count(table):
        # a line ends with its line feed, so no segment is empty
        return np.add.reduceat(table[texts.buf], ls, dtype=np.int64)
    size = le - ls
    start, end, _ = texts.spans(NOT_SPACE)
    first = np.searchsorted(start, ls)
    words = np.searchsorted(start, le) - first
    chars = np.add.reduceat(np.concatenate([end - start, [0]]), np.minimum(first, len(start)), dtype=np.int64)
    chars = np.where(words > 0, chars, 0)
    line = np.repeat(np.arange(n), words)
    h = texts.span_hash(texts.prefix(low=True), start, end)
    key = mix(h + line.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    _, one = np.unique(key, return_index=True)
    kinds = np.bincount(line[one], minlength=n)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    letters = np.maximum(count(_UPPER) + count(_LOWER), 1)
    x = np.stack([np.ones(n), np.log1p(size) / 5, size == 0, count(_UPPER) / letters, count(_DIGIT) / c,
                  np.minimum(count(_SYMBOL) / w, 3), np.minimum(count(_MARK) / w, 3),
                  np.minimum(count(_PIPE) / w, 2), np.minimum(count(_STOP) / w, 2),
                  np.minimum(chars / w, 20) / 10, 1 - kinds / w, words < 5], axis=1).astype(np.float64)
    return x, size, bound


def with_neighbours(x: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The features of each line beside those of the line before and after in
    the same text (zeros at its ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    if len(x):
        before[bound[:-1]] = 0
        after[bound[1:] - 1] = 0
    return np.concatenate([x, before, after], axis=1)


@dataclass
class Field:
    """``emit``: weights of the good label; ``step[i, j]``: score of label j
    after label i (0 bad, 1 good)."""
    emit: np.ndarray
    step: np.ndarray


def _lse(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def _grid(emission: np.ndarray, bound: np.ndarray):
    """Rows from long to short, and how many are longer than each position."""
    size = np.diff(bound)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max(initial=0))
    alive = np.searchsorted(-size[order], -np.arange(longest), "left")
    return bound[:-1][order], alive


def marginals(model: Field, emission: np.ndarray, bound: np.ndarray,
              pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """P(good) of every line; ``emission`` is the good label's score (the bad
    one's is 0).  With ``pairs`` also the expected transition counts."""
    at0, alive = _grid(emission, bound)
    n = len(emission)
    fwd, back = np.zeros((2, n)), np.zeros((2, n))
    s = model.step
    for p, k in enumerate(alive):
        at = at0[:k] + p
        if p:
            a = fwd[:, at - 1]
            fwd[0, at] = _lse(a[0] + s[0, 0], a[1] + s[1, 0])
            fwd[1, at] = _lse(a[0] + s[0, 1], a[1] + s[1, 1])
        fwd[1, at] += emission[at]
    counts = np.zeros((2, 2)) if pairs else None
    for p in range(len(alive) - 2, -1, -1):
        nxt = at0[:alive[p + 1]] + p + 1
        b0, b1 = back[0, nxt], back[1, nxt] + emission[nxt]
        back[0, nxt - 1] = _lse(s[0, 0] + b0, s[0, 1] + b1)
        back[1, nxt - 1] = _lse(s[1, 0] + b0, s[1, 1] + b1)
        if pairs:
            z = _lse(fwd[0, nxt] + back[0, nxt], fwd[1, nxt] + back[1, nxt])
            for i in (0, 1):
                for j, b in ((0, b0), (1, b1)):
                    counts[i, j] += np.exp(fwd[i, nxt - 1] + s[i, j] + b - z).sum()
    odds = np.clip((fwd[0] + back[0]) - (fwd[1] + back[1]), -500, 500)
    return 1 / (1 + np.exp(odds)), counts


def fit_field(x: np.ndarray, bound: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = 0.1,
              ridge: float = 1e-4) -> Field:
    """Maximum likelihood by Adam; ``label`` per row, handed to its lines."""
    y = np.repeat(label, np.diff(bound)).astype(float)
    same = np.diff(bound) - 1
    seen = np.array([[same[label == 0].sum(), 0], [0, same[label == 1].sum()]], dtype=float)
    # rows count alike, whatever their number of lines
    share = np.repeat(1.0 / np.maximum(np.diff(bound), 1), np.diff(bound))
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        model = Field(theta[:-4], theta[-4:].reshape(2, 2))
        p, counts = marginals(model, x @ model.emit, bound, pairs=True)
        g = np.concatenate([x.T @ ((y - p) * share) / len(label),
                            ((seen - counts) / len(y)).ravel()]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        theta[-4:] = np.clip(theta[-4:], -2, 2)    # lines of one document always agree in training
    return Field(theta[:-4], theta[-4:].reshape(2, 2))


def document_scores(model: Field, texts: Texts) -> tuple[np.ndarray, list[np.ndarray]]:
    """Length-weighted mean of the good marginals per row, and the marginals."""
    x, size, bound = line_features(texts)
    if not texts.n:
        return np.zeros(0), []
    p, _ = marginals(model, with_neighbours(x, bound) @ model.emit, bound)
    w = np.maximum(size, 1).astype(float)
    row = row_of(bound)
    score = np.bincount(row, p * w, texts.n) / np.bincount(row, w, texts.n)
    return score, [p[a:b] for a, b in zip(bound, bound[1:])]


def fit_classifier(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality", limit: int = FIT_DOCUMENTS,
                   lines: int = FIT_LINES) -> Field:
    """The field of at most ``limit`` labelled documents that satisfy
    ``train`` (a condition on the labels' id), half of them of each class
    where there are as many; of a longer document ``lines`` lines in a row, at
    a place that the hash of its text draws."""
    known = labels.filter(train & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        id_col, F.col(label_col).cast("int").alias("_label"))
    picked = None
    for k in (0, 1):
        part = known.filter(F.col("_label") == k).orderBy(F.xxhash64(id_col), id_col).limit(limit // 2)
        picked = part if picked is None else picked.union(part)
    schema = [field("lines", T.ArrayType(T.DoubleType())), field("n", T.LongType())]

    def make():
        def fn(arr):
            texts = Texts(arr)
            x, _, bound = line_features(texts)
            drawn = [zlib.crc32(texts.buf[a:b]) for a, b in zip(texts.off, texts.off[1:])]
            cut = []
            for h, a, b in zip(drawn, bound.tolist(), bound[1:].tolist()):
                a += h % max(1, b - a - lines + 1)
                cut.append(x[a:min(b, a + lines)])
            return [pa.array([c.ravel() for c in cut], pa.list_(pa.float64())), pa.array([len(c) for c in cut])]
        return fn
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    got = add_columns(rows, text_col, schema, make, drop=(text_col,)).orderBy(id_col, "_label", "lines").toPandas()
    label = got["_label"].to_numpy(dtype=int)
    if len(set(label)) < 2:
        share = label.mean() if len(label) else 1.0
        emit = np.zeros(3 * N_OWN)
        emit[0] = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
        return Field(emit, np.zeros((2, 2)))
    bound = np.concatenate([[0], np.cumsum(got["n"].to_numpy())])
    x = np.concatenate([np.asarray(a).reshape(-1, N_OWN) for a in got["lines"]])
    return fit_field(with_neighbours(x, bound), bound, label)


def classify_quality(docs: DataFrame, model: Field, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``line_scores`` (P(good) per line), ``score``
    and ``predicted`` (1 where the score is at least 0.5)."""
    fields = [field("line_scores", T.ArrayType(T.DoubleType())), field("score", T.DoubleType()),
              field("predicted", T.IntegerType())]

    def make():
        def fn(arr):
            score, lines = document_scores(model, Texts(arr))
            return [pa.array(lines, pa.list_(pa.float64())), pa.array(score),
                    pa.array((score >= 0.5).astype(np.int32))]
        return fn
    return add_columns(docs, text_col, fields, make, drop=() if keep_text else (text_col,))
