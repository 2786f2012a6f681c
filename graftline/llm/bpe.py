"""Byte-level BPE by backtracking over longest matches.

A token sequence is the BPE encoding of its text exactly if every two adjacent tokens are: merging their
bytes by rank ends in these two tokens. So the encoder needs no merge loop. It takes the longest token at
the current byte (from a trie over the tokens, whose bytes are mapped to Latin-1 for pyahocorasick), keeps
it if it is compatible with the token before, else tries the next shorter one, and steps back when none is
left. Positions once found to be dead ends are marked, so each is left at most once and the time is linear.
Compatibility of token pairs is memoised.

A blank before a character that isn't blank always begins a word of the pattern, so texts are first cut there
and the ids of each such part are remembered; the pattern only sees parts that are new.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# The pattern that cuts text before byte-level merges, and the folder of the public vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"

MEMO_WORDS = 400_000  # words and pairs remembered per worker
MEMO_PAIRS = 400_000
MEMO_CHARS = 48  # longer words are encoded anew
LONG_TEXT = 1 << 20  # longer texts are cut into words one by one
FAR = 1 << 60
WHITE = regex.compile(r"\s")


class _Irregular(Exception):
    """A part begins with white space, so blanks don't cut the text."""


class _Parts(dict):
    """Ids of the parts of texts cut at blanks; ``lead`` tells whether the blank belongs to the part."""

    def __init__(self, bpe: ByteBPE, lead: bool):
        super().__init__()
        self.bpe, self.lead = bpe, lead

    def __missing__(self, part: str) -> list[int]:
        if self.lead and (not part or part[0].isspace() or WHITE.match(part)):
            raise _Irregular
        ids = self.bpe.encode_words(" " + part if self.lead else part)
        if len(part) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[part] = ids
        return ids


class ByteBPE:
    """Encoder for a vocabulary given as token bytes and ranks; the ranks are the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.words = regex.compile(PATTERN)
        self.id_of = {t.decode("latin-1"): r for t, r in ranks.items()}
        self.longest = max(map(len, self.id_of))
        self.trie = ahocorasick.Automaton()
        for t, r in self.id_of.items():
            self.trie.add_word(t, r)
        size = max(self.id_of.values()) + 1
        self.n_bytes = np.zeros(size, np.int64)
        self.left, self.right = [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self.first, self.rest = _Parts(self, False), _Parts(self, True)
        ids = self.id_of
        for t, r in sorted(ids.items(), key=lambda x: x[1]):
            self.n_bytes[r] = len(t)
            for cut in range(1, len(t)):
                a, b = ids.get(t[:cut]), ids.get(t[cut:])
                if a is not None and b is not None and a < r and b < r and self._stay_apart(a, b):
                    self.left[r], self.right[r] = a, b
                    self.merged[a, b] = r
                    break

    def _stay_apart(self, x: int, y: int) -> bool:
        """Whether merging the bytes of two adjacent tokens ends in these tokens.

        Going back in time, the later of the two last merges is undone, and at each stage no merge across
        the border may have come before it: a smaller rank, or, against the right token, an equal one.
        """
        merged, left, right, before = self.merged, self.left, self.right, FAR
        while True:
            across = merged.get((x, y))
            if across is not None and across < before:
                return False
            if x > y:
                before, x = x, right[x]
            else:
                before, y = y + 1, left[y]
            if x < 0 or y < 0:  # undone down to a byte, then the other is one too
                return True

    def _compatible(self, x: int, y: int) -> bool:
        known = self.fits.get((x, y))
        if known is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[x, y] = self._stay_apart(x, y)
        return known

    def _match(self, word: str, at: int, most: int) -> tuple[int, int]:
        """Length and id of the longest token at byte ``at`` of at most ``most`` bytes; length 0 if none."""
        ids = self.id_of
        for n in range(most, 0, -1):
            r = ids.get(word[at : at + n])
            if r is not None:
                return n, r
        return 0, -1

    def encode_word(self, text: str) -> list[int]:
        word = text.encode("utf-8").decode("latin-1")
        whole = self.id_of.get(word)
        if whole is not None:
            return [whole]
        end, at, out, lengths = len(word), 0, [], []
        dead = bytearray(end + 1)
        most = self.trie.longest_prefix(word[: self.longest])
        while True:
            n, r = self._match(word, at, most)
            if not n:
                dead[at] = 1
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                out.pop()
                n = lengths.pop()
                at, most = at - n, n - 1
            elif dead[at + n] or out and not self._compatible(out[-1], r):
                most = n - 1
            else:
                out.append(r)
                lengths.append(n)
                at += n
                if at == end:
                    return out
                most = self.trie.longest_prefix(word[at : at + self.longest])

    def pieces(self, text: str) -> Iterable[str]:
        if len(text) > LONG_TEXT:
            return (m.group() for m in self.words.finditer(text))
        return self.words.findall(text)

    def encode_piece(self, word: str) -> list[int]:
        ids = self.memo.get(word)
        if ids is None:
            ids = self.encode_word(word)
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = ids
        return ids

    def encode_words(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self.memo.get, self.encode_piece
        for word in self.pieces(text):
            out += known(word) or piece(word)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for a null or empty text."""
        if not text:
            return []
        first, *rest = text.split(" ")
        try:
            out = list(self.first[first])
            for ids in map(self.rest.__getitem__, rest):
                out += ids
            return out
        except _Irregular:
            return self.encode_words(text)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        try:
            return len(self.first[first]) + sum(map(len, map(self.rest.__getitem__, rest)))
        except _Irregular:
            known, piece = self.memo.get, self.encode_piece
            return sum(len(known(w) or piece(w)) for w in self.pieces(text))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBPE:
    """One encoder per vocabulary and process. In a worker the file is the one that ``send_vocabulary`` sent."""
    sent = SparkFiles.get(os.path.basename(path)) if TaskContext.get() else path
    return ByteBPE(read_ranks(sent if os.path.exists(sent) else path))


def send_vocabulary(spark: SparkSession, path: str) -> None:
    """Let Spark carry the driver's vocabulary file to the executors, once for each Spark context."""
    context = spark.sparkContext
    sent = getattr(context, "_graftline_vocabularies", set())
    if path not in sent and os.path.exists(path):
        context.addFile(path)
        context._graftline_vocabularies = sent | {path}


def encode_table(df: DataFrame, doc_id: str, text: str, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id, ids``: the token ids of every text.

    A null or empty text gets an empty list, a blank one the ids of its blanks. Repeated rows and ids are
    kept, a null id is passed on, other columns are ignored, an empty table gives no rows. Whole texts of
    any length are encoded, in linear time.
    """
    send_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for b in batches:
            lists = [np.asarray(encode(t.as_py()), np.int32) for t in b.column(1)]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*lists, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[doc_id, "ids"])

    return df.select(doc_id, text).mapInArrow(run, schema)


def decode_table(df: DataFrame, doc_id: str, ids: str = "ids", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``doc_id, text``: the texts of lists of token ids, the empty text of an empty or null list. An id that the
    vocabulary lacks is an error; bytes that are no UTF-8 become replacement characters."""
    send_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([T.StructField(doc_id, df.schema[doc_id].dataType), T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: t.encode("latin-1") for t, r in encoder(vocabulary).id_of.items()}
        for b in batches:
            texts = [b"".join(map(token.__getitem__, x.as_py() or ())).decode("utf-8", "replace") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=schema.names)

    return df.select(doc_id, ids).mapInArrow(run, schema)


def count_table(df: DataFrame, keep: list[str], text: str, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every row; null and empty texts have 0 tokens."""
    send_vocabulary(df.sparkSession, vocabulary)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_tokens", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(vocabulary).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], names=[*keep, "n_tokens"])

    return df.select(text, *keep).mapInArrow(run, schema)
