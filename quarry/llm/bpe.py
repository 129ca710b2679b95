"""Byte-level BPE encoding and decoding of whole texts.

Encoding is exact and linear in the word: an Aho-Corasick automaton finds, at
every position, the longest vocabulary token that starts there; a walk takes
these tokens from the left, keeps one only if the pair it forms with its
neighbour is compatible (no merge of the pair, or inside it, would have come
first), goes over to the next shorter token where it is not, and steps back
where none is left.  The compatible sequence is the one that the merges give.
Decoding gathers byte ranges of the concatenated vocabulary by its offset
table, a slice of rows at a time.

The vocabulary file is read on the driver and broadcast (a few MB, its size
does not depend on the texts).  Words are encoded once per task and kept in a
table of at most ``CACHE_WORDS`` entries; longer words are encoded each time.

Edge cases: a null or empty text has no tokens and decodes to the empty
string; a special token's literal in a text is that one token, as in the
tokenizers library; repeated rows are encoded one by one; other columns pass
through, and input columns named like an output are replaced; an empty table
gives an empty result; a null token list decodes to the empty string, ids
outside the vocabulary are an error, and bytes that are not UTF-8 decode to
U+FFFD.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.llm.textscan import add_columns, field

CACHE_WORDS = 150_000
CACHE_WORD_BYTES = 48

#: Fixed value: the word pattern of byte-level BPE vocabularies.  Unicode
#: white space, which unlike the regex module's \s leaves out U+001C-U+001F.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary:
    printable Latin-1 stands for itself, the others for U+0100 onwards."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Decoder:
    """Offset table of one byte-level BPE file (the tokenizers library's JSON)."""

    def __init__(self, data: bytes):
        self.spec = json.loads(data)
        alphabet = byte_alphabet()
        self.raw = {t: bytes(alphabet[c] for c in t) for t in self.spec["model"]["vocab"]}
        self.added = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        ids = {self.raw[t]: i for t, i in self.spec["model"]["vocab"].items()}
        ids |= {c.encode(): i for c, i in self.added.items()}
        self.bytes = [b""] * (1 + max(ids.values()))
        for b, i in ids.items():
            self.bytes[i] = b
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])])
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes of the tokens, and the border of every token in them."""
        if len(ids) and int(ids.max()) >= len(self.offsets) - 1:
            raise ValueError(f"token id {int(ids.max())} is outside the vocabulary of {len(self.offsets) - 1}")
        begin = self.offsets[ids]
        border = np.concatenate([[0], np.cumsum(self.offsets[ids + 1] - begin)])
        at = np.arange(border[-1]) + np.repeat(begin - border[:-1], np.diff(border))
        return self.blob[at], border

    def texts(self, lists: list[bytes]) -> list[str]:
        """The texts of lists of token ids (little-endian unsigned 32-bit)."""
        ids = np.frombuffer(b"".join(lists), dtype="<u4").astype(np.int64)
        data, border = self.decode(ids)
        cut = border[np.concatenate([[0], np.cumsum([len(x) // 4 for x in lists])])].tolist()
        raw = data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]


class Encoder(Decoder):
    """Automaton and pair table besides."""

    def __init__(self, data: bytes):
        super().__init__(data)
        spec, raw = self.spec, self.raw
        ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        # the two halves of every merged token and its place in the merge order
        self.rank = {}
        self.halves = {}
        self.merged = {}
        for place, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = ids[raw[left]], ids[raw[right]]
            whole = ids.get(raw[left] + raw[right])
            if whole is None or whole in self.halves:
                continue
            self.halves[whole], self.rank[whole], self.merged[a, b] = (a, b), place, whole
        # tokens that the merges never leave whole are no candidates
        own = {i for b, i in ids.items() if len(b) == 1}
        for whole, (a, b) in self.halves.items():
            if a in own and b in own and self._compatible(a, b, aim=True):
                own.add(whole)
        self.ids = {b: i for b, i in ids.items() if i in own}
        # reversed tokens: matches that end at a place of the reversed word
        # are the tokens that start there
        self.automaton = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.automaton.add_word(b[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = {i: next((self.ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ids), None)
                        for b, i in self.ids.items()}
        self.length = [len(b) for b in self.bytes]
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        del self.spec, self.raw, self.bytes     # large, and needed no more
        self.split = (regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
                      if self.added else None)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.pairs) < CACHE_WORDS:
                self.pairs[key] = known
        return known

    def _compatible(self, left: int, right: int, aim: bool = False) -> bool:
        """Undo, latest first, the merges that made the two tokens.  A pair
        that meets at the border on the way and has a merge of its own, earlier
        than the merge undone last, would have been merged across the border.
        Among equal ranks the left merge comes first.  ``aim``: the merge of
        the two themselves is wanted and doesn't count."""
        rank, before = self.rank, len(self.rank)
        while True:
            made = None if aim else self.merged.get((left, right))
            if made is not None and rank[made] < before:
                return False
            aim = False
            rl, rr = rank.get(left, -1), rank.get(right, -1)
            if rl > rr:
                before, left = rl, self.halves[left][1]
            elif rr >= 0:
                before, right = rr + 1, self.halves[right][0]
            else:
                return True

    def word(self, data: bytes) -> list[int]:
        """Token ids of one word."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        longest = [0] * n
        seen = -1
        for end, token in self.automaton.iter(data[::-1].decode("latin-1")):
            at = n - 1 - end
            if at != seen or self.length[token] > self.length[longest[at]]:
                longest[at], seen = token, at
        length, shorter, compatible = self.length, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while True:
            end = at + length[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            token = shorter[token]
            while token is None:
                dead[at] = 1
                last = out.pop()
                at -= length[last]
                token = shorter[last]

    def word_ids(self, word: str) -> bytes:
        data = word.encode("utf-8")
        ids = np.array(self.word(data), dtype="<u4").tobytes()
        if len(data) <= CACHE_WORD_BYTES and len(self.cache) < CACHE_WORDS:
            self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, make = self.cache.get, self.word_ids
        if self.split is not None and self.split.search(text):
            return b"".join(
                self.added[part].to_bytes(4, "little") if part in self.added
                else b"".join([get(w) or make(w) for w in PATTERN.findall(part)])
                for part in self.split.split(text) if part)
        return b"".join([get(w) or make(w) for w in PATTERN.findall(text)])


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Path of an installed public vocabulary; read on the driver only."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _share(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text", out_col: str = "token_ids",
               keep_text: bool = True) -> DataFrame:
    """Every row of ``df`` with the token ids of its text in ``out_col``, as a
    binary of little-endian unsigned 32-bit integers."""
    shared = _share(df, vocab_path)

    def make():
        vocab = Encoder(shared.value)

        def fn(arr):
            return [pa.array([vocab.encode(t) for t in arr.to_pylist()], pa.binary())]
        return fn
    return add_columns(df, text_col, [field(out_col, T.BinaryType())], make,
                       drop=() if keep_text else (text_col,))


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Every row of ``df`` with the text that the token ids stand for."""
    shared = _share(df, vocab_path)

    def make():
        vocab = Decoder(shared.value)

        def fn(arr):
            return [pa.array(vocab.texts([x or b"" for x in arr.to_pylist()]), pa.string())]
        return fn
    return add_columns(df, ids_col, [field(out_col, T.StringType())], make)


def bpe_round_trip(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "token_ids",
                   out_col: str = "decoded", keep_text: bool = True) -> DataFrame:
    """Every row of ``df`` with the token ids of its text and the text that
    they stand for, in one pass (one Python worker a task in place of two)."""
    shared = _share(df, vocab_path)

    def make():
        vocab = Encoder(shared.value)

        def fn(arr):
            ids = [vocab.encode(t) for t in arr.to_pylist()]
            return [pa.array(ids, pa.binary()), pa.array(vocab.texts(ids), pa.string())]
        return fn
    return add_columns(df, text_col, [field(ids_col, T.BinaryType()), field(out_col, T.StringType())], make,
                       drop=() if keep_text else (text_col,))
