"""Splitting oversized texts at natural boundaries by structure-tree packing.

Every text is read as a tree: headings by level, paragraphs and block markup, list items by depth, lines,
sentences, words. A node that fits is one unit. Only a node that doesn't fit is descended into; its
children are packed, and neighbours among the results are merged from the bottom up while they fit. A word
that is itself too large is cut between characters. Consecutive pieces overlap by repeating the last
``overlap`` tokens of a piece at the start of the next.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from graftline.llm.bpe import BYTE_BPE_50K, ByteBPE, encoder, send_vocabulary

LINES = "\n\r\v\f\x85\u2028\u2029"
# ranks of boundaries: the children of a node are separated by its highest one
TOKEN, WORD, SENTENCE, LINE, ITEM, PARAGRAPH, HEADING = 1, 2, 4, 6, 8, 12, 14
_BLOCK = r"(?:p|div|section|article|table|ul|ol|blockquote|pre)\b"
# patterns of boundaries, what one of must occur in the text, and the rank; the group ``gap`` is where the boundary lies
_MARKS = [
    (re.compile(r"[.!?…]['\")\]»”’]*(?P<gap>\s+)(?=\S)"), ".!?…", lambda m: SENTENCE),
    (re.compile(r"[。！？；]['\")\]»”’」』]*(?P<gap>)(?=[^\s」』])"), "。！？；", lambda m: SENTENCE),
    (re.compile(r"(?P<gap>\r\n|[\n\r\v\f\x85\u2028\u2029]|(?i:<br\s*/?>))"), LINES + "<", lambda m: LINE),
    (re.compile(r"(?m)^(?P<gap>[ \t]*)(?=(?:[-*+•·]|\d{1,3}[.)])[ \t])"), LINES, lambda m: ITEM + 3 - min(3, len(m.group("gap").expandtabs(4)) // 2)),
    (re.compile(r"(?P<gap>)(?i:(?=<li\b))"), "<", lambda m: ITEM + 3),
    (re.compile(r"(?P<gap>\n[ \t\r]*\n\s*|\r[ \t]*\r\s*|\u2029\s*)"), LINES, lambda m: PARAGRAPH),
    (re.compile(rf"(?P<gap>(?i:(?=<{_BLOCK})|</{_BLOCK}>))"), "<", lambda m: PARAGRAPH),
    (re.compile(r"(?m)^(?P<gap>)(?=(#{1,6})[ \t]\S)"), "#", lambda m: HEADING + 6 - len(m.group(2))),
    (re.compile(r"(?P<gap>)(?i:(?=<h([1-6])\b))"), "<", lambda m: HEADING + 6 - int(m.group(2))),
]
LEAST_BUDGET = 4  # tokens; below the limit less any overlap, so pieces of so few with nothing else fit
KINDS = {TOKEN: "token", WORD: "word", SENTENCE: "sentence", LINE: "line", PARAGRAPH: "paragraph"}


def kind(rank: int) -> str:
    return KINDS.get(rank) or ("end" if not rank else "heading" if rank >= HEADING else "item")


class Outline:
    """A text with its words, tokens and boundaries."""

    def __init__(self, text: str, bpe: ByteBPE):
        words, known, piece = list(bpe.pieces(text)), bpe.memo.get, bpe.encode_piece
        ids = [known(w) or piece(w) for w in words]
        self.text = text
        self.word_char = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        self.word_token = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(self.word_token[-1]))
        self.token_byte = np.concatenate([[0], np.cumsum(bpe.n_bytes[flat])])
        raw = np.frombuffer(text.encode("utf-8"), np.uint8)
        starts = np.concatenate([(raw & 0xC0) != 0x80, [True]])
        self.clean = starts[self.token_byte]  # tokens that begin at a character
        self.token_char = (np.cumsum(starts) - 1)[self.token_byte]
        self.rank = np.full(len(words) + 1, WORD, np.int8)
        self.rank[[0, -1]] = 0
        for pattern, signs, rank in _MARKS:
            if not any(c in text for c in signs):
                continue
            found = [(*m.span("gap"), rank(m)) for m in pattern.finditer(text)]
            if found:
                self._mark(*(np.array(c) for c in zip(*found, strict=True)))

    def _mark(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray) -> None:
        """Boundaries lie somewhere from ``start`` to ``end``; take the last word start there, or the next after."""
        w = np.searchsorted(self.word_char, end, "right") - 1
        for n in np.flatnonzero(self.word_char[w] < start):
            # only blanks belong to the word so far: it may begin the next unit
            w[n] += bool(self.text[self.word_char[w[n]] : end[n]].strip())
        inside = (w > 0) & (w < len(self.rank) - 1)
        np.maximum.at(self.rank, w[inside], rank[inside].astype(np.int8))

    def __len__(self) -> int:
        return int(self.word_token[-1])

    def pack(self, budget: int) -> list[tuple[int, int, int]]:
        """Units ``(first token, end token, rank of the boundary at the end)`` of at most ``budget`` tokens."""
        return self._pack(0, len(self.rank) - 1, budget)

    def _pack(self, lo: int, hi: int, budget: int) -> list[tuple[int, int, int]]:
        a, b = int(self.word_token[lo]), int(self.word_token[hi])
        if b - a <= budget:
            return [(a, b, int(self.rank[hi]))]
        if hi - lo == 1:
            return self._cut_word(a, b, int(self.rank[hi]), budget)
        inner = self.rank[lo + 1 : hi]
        edges = [lo, *(np.flatnonzero(inner == inner.max()) + lo + 1).tolist(), hi]
        out: list[tuple[int, int, int]] = []
        at = self.word_token[edges].tolist()
        for n, (left, right) in enumerate(zip(edges, edges[1:], strict=False)):
            fits = at[n + 1] - at[n] <= budget
            for unit in ((at[n], at[n + 1], int(self.rank[right])),) if fits else self._pack(left, right, budget):
                if out and unit[1] - out[-1][0] <= budget:
                    out[-1] = (out[-1][0], unit[1], unit[2])
                else:
                    out.append(unit)
        return out

    def _cut_word(self, a: int, b: int, rank: int, budget: int) -> list[tuple[int, int, int]]:
        out = []
        while b - a > budget:
            at = a + budget
            while at > a + 1 and not self.clean[at]:
                at -= 1
            while at < b and not self.clean[at]:  # one character of more tokens than the budget
                at += 1
            out.append((a, at, TOKEN))
            a = at
        if a < b:
            out.append((a, b, rank))
        return out


def split_text(text: str | None, limit: int, overlap: int, bpe: ByteBPE) -> list[tuple[int, int, int, int, str]]:
    """Pieces ``(first token, first char, end char, tokens, kind of the cut at the end)``."""
    if not text:
        return []
    whole = bpe.count(text)
    if whole <= limit:
        return [(0, 0, len(text), whole, "end")]
    outline = Outline(text, bpe)  # only of texts that must be cut
    budget = limit - overlap
    while True:
        pieces, worst = [], 0
        for n, (a, b, rank) in enumerate(outline.pack(budget)):
            if n:
                a = max(0, a - overlap)
                while not outline.clean[a]:
                    a -= 1
            start, end = int(outline.token_char[a]), int(outline.token_char[b])
            tokens = bpe.count(text[start:end])  # a piece stands alone, so its own encoding counts
            while tokens > limit and budget <= LEAST_BUDGET and start < pieces[-1][2]:  # give up overlap, not the limit
                start += max(1, (pieces[-1][2] - start) // 2)
                tokens = bpe.count(text[start:end])
            worst = max(worst, tokens - limit)
            pieces.append((a, start, end, tokens, kind(rank)))
        if worst <= 0:
            return pieces
        if budget <= LEAST_BUDGET:
            raise ValueError(f"no pieces of at most {limit} tokens")
        budget = max(LEAST_BUDGET, budget - worst)


def split_table(df: DataFrame, doc_id: str, text: str, limit: int = 512, overlap: int = 32, vocabulary: str = BYTE_BPE_50K, keep_text: bool = True) -> DataFrame:
    """Pieces of every text: ``doc_id, piece, n_pieces, start_char, end_char, n_tokens, cut`` and ``text``.

    A text within the limit is one piece. Of a larger one each piece, encoded on its own, has at most
    ``limit`` tokens, and each but the first begins ``overlap`` tokens before the end of the one before (a
    few more where that falls inside a character). ``cut`` names the boundary at the end of the piece.
    Positions count characters. Null and empty texts give no piece, repeated rows are split each, other
    columns are ignored. Whole texts of any length are split, in one row's memory.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("the overlap must be well below the limit")
    send_vocabulary(df.sparkSession, vocabulary)
    out = [T.StructField(doc_id, df.schema[doc_id].dataType)]
    out += [T.StructField(c, T.IntegerType(), False) for c in ("piece", "n_pieces", "start_char", "end_char", "n_tokens")]
    out += [T.StructField("cut", T.StringType(), False)] + [T.StructField("piece_text", T.StringType(), False)] * keep_text
    schema = T.StructType(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows: list[tuple] = []
                for r, t in enumerate(part.column(1)):
                    whole = t.as_py()
                    pieces = split_text(whole, limit, overlap, bpe)
                    rows += [(r, n, len(pieces), s, e, tokens, cut, *([whole[s:e]] if keep_text else [])) for n, (_, s, e, tokens, cut) in enumerate(pieces)]
                if rows:
                    index, *cols = zip(*rows, strict=True)
                    ids = part.column(0).take(pa.array(index, pa.int32()))
                    kinds = [pa.int32()] * 5 + [pa.string()] * (len(cols) - 5)
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return df.select(doc_id, text).mapInArrow(run, schema)
