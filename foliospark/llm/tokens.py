"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read once on the driver and broadcast, so executors need no copy of it. A worker process builds
the encoder once and keeps it, with the sizes of the words it has met, for all its tasks.
"""

from __future__ import annotations

import base64
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.tables import safe_key

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern of the vocabulary, and the same in the syntax of the faster standard module.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Words kept per process.
KEPT = 400_000


def _store() -> dict:
    """Per process; functions sent by value get fresh globals with each task, a module does not."""
    return sys.modules.setdefault("_foliospark_store", types.ModuleType("_foliospark_store")).__dict__


class Sizer:
    """Counts tokens; splits texts into the words between which no token can reach over."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encoder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        # letters and spaces on which the two patterns differ: numbers that are no digits, separators of old terminals
        self.odd = frozenset("\x1c\x1d\x1e\x1f") | {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")}
        #: word -> tokens | class << 20 | hash << 24; class bits: line end, several, ends a sentence, begins with white space
        self.known = _Known(self)

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for null and empty ones. Long texts are sized line by line, which changes nothing."""
        if not text:
            return 0
        return len(self.encoder.encode_ordinary(text.encode("utf-8", "replace").decode()))

    def words(self, text: str) -> list[str]:
        """The text in order, cut where the pattern cuts; joined again it is the text."""
        if not self.odd.isdisjoint(set(text)):
            import regex

            return regex.findall(PATTERN, text)
        return _FAST.findall(text)


class _Known(dict):
    """Describes words as they are met and keeps the first KEPT of them."""

    def __init__(self, sizer: Sizer):
        super().__init__()
        self.sizer = sizer

    def __missing__(self, word: str) -> int:
        lines = word.count("\n")
        kind = (lines > 0) | (lines > 1) << 1 | (word.rstrip("\"')»”")[-1:] in tuple(".!?…:;")) << 2 | word[:1].isspace() << 3
        v = self.sizer.count(word) | kind << 20 | (zlib.crc32(word.encode("utf-8", "replace")) * 0x9E3779B1 >> 3 & 0x7FFFFFFF) << 24
        if len(self) < KEPT:
            self[word] = v
        return v


class SizerSource:
    """What tasks get instead of a Sizer: the broadcast file."""

    def __init__(self, spark: SparkSession, path: str = DEFAULT_VOCABULARY):
        with open(path, "rb") as f:
            data = f.read()
        self.key, self.data = f"sizer {zlib.crc32(data)}", spark.sparkContext.broadcast(data)

    def get(self) -> Sizer:
        store = _store()
        if self.key not in store:
            store[self.key] = Sizer(self.data.value)
        return store[self.key]


def sized(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n, kept columns): tokens of each row's text, 0 where it is null or empty."""
    keep = keep or []
    source = SizerSource(df.sparkSession, vocabulary)
    id_, _, kind = safe_key(df, id_col)
    src = df.select(id_.alias("id"), F.col(text_col).alias("text"), *(F.col(c) for c in keep))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "text") + ", n bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizer = source.get()
        for pdf in batches:
            n = [sizer.count(t) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(n=n)

    return src.mapInPandas(run, schema).withColumn("id", F.col("id").cast(kind))
