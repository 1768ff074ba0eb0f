"""Splitting oversized items at natural boundaries (p9): content-defined chunking.

A text is read as the words between which no token can reach over, so a piece that begins and ends between words has
exactly the tokens it has within the text. A rolling hash of the last words marks landmarks; the first landmark between
the least and the greatest size snaps to the nearest natural boundary: a blank line, else a line or sentence end, else
white space. The next piece begins the overlap before the cut. As landmarks and boundaries depend on nearby text only,
an edit alters the pieces around it and the later cuts fall where they fell before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.tokens import DEFAULT_VOCABULARY, Sizer, SizerSource
from foliospark.sources.tables import safe_key

#: Words under the rolling hash.
SPAN = 8
#: The least new tokens of a piece, as a share of the most; landmarks lie this share of the most apart on average.
LEAST, APART = 0.5, 0.25
#: A word of more tokens than this, or than a quarter of the least size, is cut into strings of fewer tokens.
LONG_WORD = 64


class Text:
    """A text's words with their places, tokens, boundaries and landmark hashes."""

    def __init__(self, text: str, sizer: Sizer, unit: int = LONG_WORD):
        words = sizer.words(text)
        d = np.fromiter(map(sizer.known.__getitem__, words), np.int64, len(words))
        self.text = text
        self.sliced = bool(len(d)) and int((d & 0xFFFFF).max()) > unit
        if self.sliced:
            cut: list[str] = []
            for w, n in zip(words, (d & 0xFFFFF).tolist()):
                size = unit if w.isascii() else max(1, unit // 4)  # a character has four bytes at most, a token one at least
                cut += [w] if n <= unit else [w[i : i + size] for i in range(0, len(w), size)]
            words = cut
            d = np.fromiter(map(sizer.known.__getitem__, words), np.int64, len(words))
        self.words, self.sizer, n = words, sizer, len(words)
        self.at = np.zeros(n + 1, np.int64)  # characters before word i
        np.cumsum(np.fromiter(map(len, words), np.int64, n), out=self.at[1:])
        self.cum = np.zeros(n + 1, np.int64)  # tokens before word i
        np.cumsum(d & 0xFFFFF, out=self.cum[1:])
        kind, h = d >> 20 & 15, (d >> 24).astype(np.uint64)
        line, many, stop, white = ((kind >> b & 1).astype(bool) for b in range(4))
        # rank of the boundary before word i: 3 blank line, 2 line or sentence end, 1 white space, 0 within a word
        rank = np.zeros(n + 1, np.int8)
        if n:
            nxt, prev = np.append(line[1:], False), np.insert(line[:-1], 0, False)
            rank[:n] = white
            rank[:n][line & ~prev] = 2
            rank[:n][white & np.insert(stop[:-1], 0, False)] = 2
            rank[:n][line & ~prev & (many | nxt)] = 3
            rank[0] = 0
        roll = np.zeros(n, np.uint64)
        for j in range(min(SPAN, n)):
            roll[j:] += h[: n - j] * np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64))
        self.roll = roll >> np.uint64(40)
        self.places = [np.flatnonzero(rank == r).tolist() for r in range(4)]
        self.cum_list, self.at_list = self.cum.tolist(), self.at.tolist()

    def begin(self, word: int, overlap: int) -> tuple[int, int]:
        """(character, tokens up to the word) of a piece that repeats `overlap` tokens before the word."""
        if not overlap or not word:
            return self.at_list[word], 0
        goal = self.cum_list[word] - overlap
        if goal <= 0:
            return 0, self.cum_list[word]
        i = bisect_right(self.cum_list, goal) - 1
        if self.cum_list[i] == goal:
            return self.at_list[i], overlap
        # the overlap begins inside word i: after as many of its tokens, but at a whole character
        ids = self.sizer.encoder.encode_ordinary(self.words[i].encode("utf-8", "replace").decode())
        head = self.sizer.encoder.decode_bytes(ids[: goal - self.cum_list[i]])
        k = len(head.decode("utf-8", "ignore"))
        tail = self.words[i][k:]
        return self.at_list[i] + k, self.sizer.count(tail) + self.cum_list[word] - self.cum_list[i + 1]

    def near(self, word: int, lo: int, hi: int, reach: int) -> int:
        """The natural boundary nearest to `word` within lo..hi: the strongest kind that lies within reach tokens."""
        for r in (3, 2, 1):
            p = self.places[r]
            i = bisect_left(p, word)
            best = None
            for j in (i - 1, i):
                if 0 <= j < len(p) and lo <= p[j] <= hi:
                    gap = abs(self.cum_list[p[j]] - self.cum_list[word])
                    if (r == 1 or gap <= reach) and (best is None or gap < best[0]):
                        best = (gap, p[j])
            if best:
                return best[1]
        return word

    def pieces(self, limit: int, overlap: int) -> list[tuple[int, int, int]]:
        """(first character, character after the last, tokens) of pieces of at most `limit` tokens."""
        out, n = [], len(self.words)
        word = 0
        most = max(1, limit - overlap)
        marks = np.flatnonzero(self.roll % np.uint64(max(2, int(most * APART))) == 0) + 1
        marks = marks.tolist()  # a landmark is the boundary after the word that closes it
        while True:
            start, had = self.begin(word, overlap)
            room = limit - had
            end = self.cum_list[word] + room
            rest = had + self.cum_list[n] - self.cum_list[word]
            if self.sliced and self.cum_list[n] <= end:
                rest = self.sizer.count(self.text[start:])
            if self.cum_list[n] <= end and rest <= limit:
                out.append((start, self.at_list[n], rest))
                return out
            hi = min(n - 1, max(word + 1, bisect_right(self.cum_list, end) - 1))
            lo = min(hi, max(word + 1, bisect_left(self.cum_list, self.cum_list[word] + int(room * LEAST))))
            j = bisect_left(marks, lo)
            mark = marks[j] if j < len(marks) and marks[j] <= hi else hi
            cut = self.near(mark, lo, hi, most // 4)
            n_tokens = had + self.cum_list[cut] - self.cum_list[word]
            if self.sliced:  # parts of a word may join to other tokens than they have alone
                n_tokens = self.sizer.count(self.text[start : self.at_list[cut]])
                while n_tokens > limit and cut > word + 1:
                    cut = max(word + 1, cut - max(1, (cut - word) // 16))
                    n_tokens = self.sizer.count(self.text[start : self.at_list[cut]])
            out.append((start, self.at_list[cut], n_tokens))
            word = cut


def split_items(df: DataFrame, id_col: str, text_col: str, sizes: list[tuple[int, int]], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(size_limit, id, piece, start_char, end_char, n_tokens, text): pieces of the texts longer than each size.

    sizes: (limit, overlap) pairs, 0 <= overlap < limit. A text is read once for all sizes. Texts within a size, null
    and empty ones have no pieces there. Pieces cover the text without gap; each repeats the overlap before it. Rows
    are treated one by one, so repeated rows give repeated pieces, ties and hot keys play no part, and no shuffle is made.
    """
    for limit, overlap in sizes:
        if not 0 <= overlap < limit:
            raise ValueError(f"overlap {overlap} doesn't fit into {limit}")
    source = SizerSource(df.sparkSession, vocabulary)
    id_, kind, outer = safe_key(df, id_col)
    src = df.select(id_.alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    smallest = min((s for s, _ in sizes), default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = source.get()
        for pdf in batches:
            rows: list[tuple] = []
            room = 0
            for i, text in zip(pdf["id"], pdf["text"]):
                if len(text.encode("utf-8", "replace")) <= smallest:  # a token has a byte at least
                    continue
                t = Text(text, sizer, max(4, min(LONG_WORD, smallest // 4)))
                total = t.cum_list[-1]
                for limit, overlap in sizes:
                    if total > limit:
                        rows += [(limit, i, p, a, b, n, text[a:b]) for p, (a, b, n) in enumerate(t.pieces(limit, overlap))]
                room += len(text)
                if room > 4_000_000:
                    yield pd.DataFrame(rows, columns=["size_limit", "id", "piece", "start_char", "end_char", "n_tokens", "text"])
                    rows, room = [], 0
            yield pd.DataFrame(rows, columns=["size_limit", "id", "piece", "start_char", "end_char", "n_tokens", "text"])

    out = src.mapInPandas(run, f"size_limit int, id {kind}, piece int, start_char bigint, end_char bigint, n_tokens int, text string")
    return out.withColumn("id", F.col("id").cast(outer))
