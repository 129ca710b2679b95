"""Language identification by compression.

For every language a raw-content zstandard dictionary is made of lower-cased
texts in it.  A lower-cased text is compressed with each of them, piece by
piece; the language whose dictionary gives the smallest total is predicted.
The margin to the second smallest, per byte of the text, gives the score, and
a prediction with a narrow margin is marked as rejected.

The dictionaries are fitted on a bounded sample: at most ``FIT_DOCUMENTS``
documents per language, chosen by the hash of their ids, ``FIT_CHARS``
characters of each from a place that the hash draws, and ``DICTIONARY_BYTES``
in all (whole pieces).  Texts are scored whole.

Edge cases: a null text and one without a letter are ``und`` with score 0, as
is every text where no language was learned; with one language learned all
other texts get it with score 1; equal sizes go to the first language by
name; repeated rows are judged one by one; other columns pass through, and
input columns named like an output are replaced; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.textscan import add_columns, field

FIT_DOCUMENTS = 200
FIT_CHARS = 500
DICTIONARY_BYTES = 96 << 10
#: A text is compressed in pieces of this size, so that in a long one the
#: dictionary keeps deciding, not the text's own beginning.
PIECE_BYTES = 2_000
LEVEL = 6
#: Margins, in bits per byte of the text, below which a prediction is rejected.
NARROW = 0.05
#: The margin that gives a score of 0.73.
SCALE = 0.1

_LETTER = regex.compile(r"\p{L}")


def fit_dictionaries(docs: DataFrame, train: Column, lang_col: str = "lang", id_col: str = "doc_id",
                     text_col: str = "text", limit: int = FIT_DOCUMENTS, chars: int = FIT_CHARS) -> dict[str, bytes]:
    """Language -> dictionary, from the training rows with a language: of the
    ``limit`` rows with the smallest hashes of their ids a piece of ``chars``
    characters, at a place of the whole text that the hash draws.  A
    dictionary holds whole pieces, as many as fit ``DICTIONARY_BYTES``."""
    rows = docs.filter(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.xxhash64(id_col, F.lit("place")).alias("at"),
        F.col(text_col).alias("text"))
    begin = F.pmod("at", F.greatest(F.lit(1), F.char_length("text") - chars + 1).cast("long")).cast("int") + 1
    rows = rows.select("lang", "h", F.substring("text", begin, F.lit(chars)).alias("piece"))
    first = Window.partitionBy("lang").orderBy("h", "piece")
    got = rows.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= limit).orderBy("lang", "n").collect()
    out: dict[str, bytes] = {}
    for r in got:
        piece, held = r["piece"].lower().encode(), out.get(r["lang"], b"")
        if len(held) + len(piece) < DICTIONARY_BYTES:
            out[r["lang"]] = held + piece + b"\n"
    return {k: v for k, v in out.items() if v.strip()}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text",
                      pred_col: str = "lang_pred", keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` (0.5 for no margin,
    towards 1 for a wide one; 0 for ``und``) and ``rejected``."""
    fields = [field(pred_col, T.StringType()), field("score", T.DoubleType()), field("rejected", T.BooleanType())]
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def make():
        names = sorted(shared.value)
        coders = []
        for n in names:
            d = zstd.ZstdCompressionDict(shared.value[n], dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False,
                                              write_dict_id=False))

        def judge(text):
            if not names or text is None or not _LETTER.search(text):
                return "und", 0.0, True
            if len(names) == 1:
                return names[0], 1.0, False
            data = text.lower().encode()
            parts = [data[i:i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
            size = [sum(len(c.compress(p)) for p in parts) for c in coders]
            order = np.argsort(size, kind="stable")
            margin = 8.0 * (size[order[1]] - size[order[0]]) / len(data)
            return names[order[0]], float(1 / (1 + np.exp(-margin / SCALE))), margin < NARROW

        def fn(arr):
            got = [judge(t) for t in arr.to_pylist()]
            pred, score, rejected = zip(*got) if got else ((), (), ())
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]
        return fn
    return add_columns(docs, text_col, fields, make, drop=() if keep_text else (text_col,))
