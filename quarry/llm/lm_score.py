"""Language-model scoring over a subword lattice.

The pieces of an existing vocabulary span a lattice over every word; its
probability is the sum over all segmentations, by a forward recursion in log
space.  A document's probability is the product over its words and one end.
Piece weights start from the order of the vocabulary's own scores (Zipf's law
over the rank) and are fitted to the training documents by ``ROUNDS`` rounds
of expectation maximisation with that start as a prior; the pieces stay as
they are.

Words are counted once for the whole corpus, so the lattice runs once per
distinct word, not per occurrence: a word table (word, training count, log
probability) is aggregated by Spark and written out.  Documents read the
``FREQUENT`` most counted words (a fixed bound) from a broadcast; their other
words go to the word table by one shuffled join and come back as partial sums
per document.  The plain add-0.1 word model (``base_score``) uses the same
table.

Edge cases: a null or empty text is the end alone; a null id counts as the
empty string when its remainder is taken; repeated rows are counted and
scored one by one; only the id and the text are read, so other columns do not
matter; an empty table gives an empty result; without training documents the
counts are zero and the weights are the prior's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textscan import NOT_SPACE, Texts, field, map_slices, row_of, slices, text_slices
from quarry.llm.vectors import sum_vectors
from quarry.session import cut_lineage

FREQUENT = 200_000
ROUNDS = 1
#: Weight of the prior, in tokens.
PRIOR = 1000.0
#: Words of a task that are gathered before they are emitted.
GATHER = 400_000
_CELLS = 4 << 20
_B = np.uint64(0x9E6C63D0876A9A47)


def public_pieces(name: str = "piece_bpe_32k.model") -> list[tuple[bytes, float]]:
    """Pieces and scores of an installed public vocabulary, read on the
    driver.  A piece's word mark is a space; single bytes stand for
    themselves where no piece does; runs of word marks are left out."""
    import public_tokenizers
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out: dict[bytes, float] = {}
    for i in range(m.get_piece_size()):
        if m.is_control(i) or m.is_unknown(i):
            continue
        if m.is_byte(i):
            piece = bytes([int(m.id_to_piece(i)[1:-1], 16)])
            out.setdefault(piece, float("-inf"))
        else:
            piece = m.id_to_piece(i).replace("▁", " ").encode()
            if b"  " not in piece:
                out[piece] = m.get_score(i)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


class Lattice:
    """Pieces with log weights; the last weight is the end's."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        keys = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.slot, self.logp = keys[order], order, logp
        self.longest = max(map(len, pieces), default=0)
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_B) + b + 1) & (1 << 64) - 1
        return (h ^ h >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which rolling hashes are pieces, and which pieces."""
        key = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        at = np.flatnonzero(self.seen[(key >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, key[at]), len(self.keys) - 1)
        same = self.keys[place] == key[at]
        return at[same], self.slot[place[same]]

    def _edges(self, mat: np.ndarray, alive: np.ndarray):
        """All pieces in the words, ordered by start: start, end, words, ids.
        ``mat[p]`` are the bytes at position p, words from long to short;
        ``alive[p]`` words are longer than p."""
        for p in range(len(mat)):
            h = np.zeros(alive[p], dtype=np.uint64)
            for q in range(p, min(len(mat), p + self.longest)):
                n = alive[q]
                if not n:
                    break
                h = h[:n] * _B + mat[q, :n] + np.uint64(1)
                at, piece = self._find(h)
                if len(at):
                    yield p, q + 1, at, piece

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
              weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of every word ``data[start:end]``; with weights
        also the expected number of uses of every piece."""
        out = np.zeros(len(start))
        uses = np.zeros(len(self.logp)) if weight is not None else None
        size = end - start + 1                     # with the word mark
        order = np.argsort(-size, kind="stable")
        at = 0
        while at < len(order):
            top = int(size[order[at]])
            idx = order[at:at + max(1, _CELLS // top)]
            at += len(idx)
            length = size[idx]
            mat = np.zeros((top, len(idx)), dtype=np.uint8)
            mat[0] = 32
            for p in range(1, top):
                n = int(np.searchsorted(-length, -p, "left"))
                mat[p, :n] = data[start[idx[:n]] + p - 1]
            alive = np.searchsorted(-length, -np.arange(top), "left")
            mat = mat.astype(np.uint64) if top < 64 else mat
            fwd = np.full((top + 1, len(idx)), -np.inf)
            fwd[0] = 0
            edges = []
            for p, q, w, piece in self._edges(mat, alive):
                fwd[q, w] = np.logaddexp(fwd[q, w], fwd[p, w] + self.logp[piece])
                if uses is not None:
                    edges.append((p, q, w, piece))
            total = fwd[length, np.arange(len(idx))]
            out[idx] = total
            if uses is not None:
                back = np.full((top + 1, len(idx)), -np.inf)
                back[length, np.arange(len(idx))] = 0
                for p, q, w, piece in reversed(edges):
                    step = self.logp[piece] + back[q, w]
                    back[p, w] = np.logaddexp(back[p, w], step)
                    share = np.exp(fwd[p, w] + step - total[w]) * weight[idx[w]]
                    uses += np.bincount(piece, share, len(uses))
        return out, uses


def zipf_prior(n: int) -> np.ndarray:
    """Weights of n pieces in the order of their scores, and of the end."""
    w = 1.0 / (np.arange(n) + 2.7)
    w = np.append(w, w.mean())
    return w / w.sum()


def _word_arrays(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = Texts(arr)
    return t.low, t.off[:-1], t.off[1:] - 1


def word_counts(docs: DataFrame, text_col: str, train_col: str) -> DataFrame:
    """``word`` and its count ``c`` in training rows, for all words of all rows."""
    schema = T.StructType([field("word", T.BinaryType()), field("c", T.LongType())])

    def run(batches):
        words, counts, hashes, size = [], [], [], 0

        def gather():
            h = np.concatenate(hashes)
            _, first, back = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(back, np.concatenate(counts), len(first)).astype(np.int64)
            return pa.chunked_array(words).combine_chunks().take(pa.array(first)), n, h[first]

        for batch in batches:
            for piece in text_slices(batch, text_col):
                t = Texts(piece.column(text_col))
                start, end, bound = t.spans(NOT_SPACE)
                if not len(start):
                    continue
                h = t.span_hash(t.prefix(low=True), start, end)
                train = piece.column(train_col).to_numpy(zero_copy_only=False)[row_of(bound)]
                uniq, first, back = np.unique(h, return_index=True, return_inverse=True)
                counts.append(np.bincount(back, train, len(uniq)))
                hashes.append(uniq)
                a, b = start[first], end[first]
                off = np.concatenate([[0], np.cumsum(b - a)])
                take = np.arange(off[-1]) + np.repeat(a - off[:-1], b - a)
                words.append(pa.Array.from_buffers(pa.large_binary(), len(a), [
                    None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(t.low[take])]))
                size += len(a)
                if size > 2 * GATHER:
                    w, n, h = gather()
                    if len(n) > GATHER:
                        yield pa.RecordBatch.from_arrays([w.cast(pa.binary()), pa.array(n)], names=["word", "c"])
                        words, counts, hashes, size = [], [], [], 0
                    else:
                        words, counts, hashes, size = [w], [n], [h], len(n)
        if size:
            w, n, _ = gather()
            yield pa.RecordBatch.from_arrays([w.cast(pa.binary()), pa.array(n)], names=["word", "c"])
    return (docs.select(text_col, train_col).mapInArrow(run, schema)
            .groupBy("word").agg(F.sum("c").alias("c")))


def fit_pieces(counts: DataFrame, ends: int, pieces: list[bytes], prior: np.ndarray,
               rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces and the end, fitted to the counted words."""
    logp = np.log(prior)
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, logp))

        def uses(batches):
            lattice, total = Lattice(*shared.value), np.zeros(len(prior))
            for batch in batches:
                for a, b in slices(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)):
                    part = batch.slice(a, b - a)
                    total += lattice.words(*_word_arrays(part.column("word")),
                                           part.column("c").to_numpy().astype(float))[1]
            return total
        expected = sum_vectors(counts.filter("c > 0").select("word", "c"), uses, len(prior))
        expected[-1] += ends
        weight = expected + PRIOR * prior
        logp = np.log(weight / weight.sum())
    return logp


def _frequent(table: DataFrame) -> DataFrame:
    """The most counted words, ``FREQUENT`` at most: those at or above the
    least count class (eighths of a power of two) that keeps the bound."""
    step = F.floor(F.log2("c") * 8).cast("int")
    sizes = table.filter("c > 0").groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = None, 0
    for r in sorted(sizes, key=lambda r: -r["k"]):
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["k"]
    return table.filter(F.lit(False) if least is None else (F.col("c") > 0) & (step >= least))


def score_documents(docs: DataFrame, train: Column, pieces: list[tuple[bytes, float]], id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, ``n_tokens`` (words and the end),
    ``n_known`` (tokens that occur in training rows), ``train_tokens``,
    ``base_score`` (add-0.1 word model) and ``score`` (lattice model), both
    log10 of the text's probability."""
    rows = docs.select(id_col, text_col, train.alias("_train"))
    counts = cut_lineage(word_counts(rows, text_col, "_train"))
    ends = rows.filter("_train").count()
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n_train = (total["n"] or 0) + ends
    n_kinds = (total["v"] or 0) + (1 if ends else 0)
    names = [p for p, _ in pieces]
    logp = fit_pieces(counts, ends, names, zipf_prior(len(names)))
    norm = n_train + 0.1 * (n_kinds + 1)
    sc = docs.sparkSession.sparkContext

    model = sc.broadcast((names, logp))
    schema = T.StructType([field("h", T.LongType()), field("c", T.LongType()), field("lat", T.DoubleType())])

    def weigh(batches):
        lattice = Lattice(*model.value)
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)):
                part = batch.slice(a, b - a)
                t = Texts(part.column("word"))
                start, end = t.off[:-1], t.off[1:] - 1
                h = t.span_hash(t.prefix(low=True), start, end).view(np.int64)
                lat = lattice.words(t.low, start, end)[0] / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array(h), part.column("c"), pa.array(lat)], names=schema.names)
    table = cut_lineage(counts.mapInArrow(weigh, schema))

    top = _frequent(table).toPandas().sort_values("h")
    frequent = sc.broadcast((top["h"].to_numpy(), top["c"].to_numpy(), top["lat"].to_numpy(),
                             ends, norm, logp[-1] / np.log(10)))
    # per document one row of its own with what the frequent words give, and
    # one row per other distinct word; all meet again under the row's number
    out = T.StructType([field("rid", T.LongType()), field("own", T.BooleanType()), docs.schema[id_col],
                        field("n", T.LongType()), field("known", T.LongType()), field("base", T.DoubleType()),
                        field("lat", T.DoubleType()), field("h", T.LongType()), field("m", T.LongType())])

    def make():
        fh, fc, fl, ends, norm, end_lat = frequent.value
        fb = np.log10((fc + 0.1) / norm)

        def fn(batch):
            t = Texts(batch.column(text_col))
            start, end, bound = t.spans(NOT_SPACE)
            row = row_of(bound)
            h = t.span_hash(t.prefix(low=True), start, end).view(np.int64)
            if len(fh):
                slot = np.minimum(np.searchsorted(fh, h), len(fh) - 1)
                hot = fh[slot] == h
            else:
                slot, hot = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            r, s = row[hot], slot[hot]
            known = np.bincount(r, fc[s] > 0, t.n).astype(np.int64) + (1 if ends else 0)
            base = np.bincount(r, fb[s], t.n) + np.log10((ends + 0.1) / norm)
            lat = np.bincount(r, fl[s], t.n) + end_lat
            rid = batch.column("_rid").to_numpy()
            spread = (rid.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(np.ones(t.n, bool)), batch.column(id_col), pa.array(np.diff(bound) + 1),
                 pa.array(known), pa.array(base), pa.array(lat), pa.array(spread),
                 pa.array(np.zeros(t.n, np.int64))], names=out.names)
            r, g = row[~hot], h[~hot]
            if len(g):
                order = np.lexsort((g, r))
                r, g = r[order], g[order]
                new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (r[1:] != r[:-1])]))
                m = np.diff(np.append(new, len(g)))
                k = len(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[r[new]]), pa.array(np.zeros(k, bool)), pa.nulls(k, batch.schema.field(id_col).type),
                     *[pa.nulls(k, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                     pa.array(g[new]), pa.array(m)], names=out.names)
        return fn
    parts = map_slices(rows.select(F.monotonically_increasing_id().alias("_rid"), id_col, text_col),
                       text_col, out, make)
    side = table.select("h", F.col("c").alias("wc"), F.col("lat").alias("wl"))
    met = parts.join(side, "h", "left")
    m, wc = F.col("m"), F.coalesce("wc", F.lit(0))
    return (met.groupBy("rid").agg(
        F.max(id_col).alias(id_col), F.max("n").alias("n_tokens"),
        F.sum(F.when(F.col("own"), F.col("known")).otherwise(F.when(wc > 0, m).otherwise(0))).alias("n_known"),
        F.sum(F.when(F.col("own"), F.col("base")).otherwise(m * F.log10((wc + 0.1) / F.lit(norm)))).alias("base_score"),
        F.sum(F.when(F.col("own"), F.col("lat")).otherwise(m * F.col("wl"))).alias("score"))
        .select(id_col, "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                "base_score", "score"))
