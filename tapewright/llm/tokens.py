"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the default tokenizer, and the folder it is looked for in; both are parameters.
TOKENIZER_DIR = os.environ.get("TAPEWRIGHT_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_50k.tiktoken"
#: How byte-level BPE of this vocabulary cuts a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The encoder's pattern engine runs out of stack on runs of blanks of about a million; longer ones than this are encoded by themselves.
BLANKS = 100_000
_RUN = re.compile("[\\t\\n\\v\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % BLANKS)


def load_encoding(path: str):
    """The tiktoken encoding of a rank file (one base64 token and its rank a line)."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("tapewright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_text(encoding, text: str | None) -> int:
    """Tokens of a text, encoded whole; null and empty have none.

    A run of blanks begins a word of the pattern and, but for the last blank where text follows, is one: so a very long run is a piece of its own, and what comes
    before and after is encoded as it stands.
    """
    n, start = 0, 0
    for m in _RUN.finditer(text or ""):
        end = m.end() - (m.end() < len(text))
        n += len(encoding.encode_ordinary(text[start : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        start = end
    return n + len(encoding.encode_ordinary(text[start:])) if text else 0


def with_tokens(df: DataFrame, text: str = "text", tokenizer: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) and ``n_tokens``. Narrow, one Arrow batch at a time; the vocabulary is loaded once per task."""
    path = tokenizer or os.path.join(TOKENIZER_DIR, TOKENIZER)
    keep = [c for c in df.columns if c != text] if keep is None else keep

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_encoding(path)
        for s in batches:
            yield pd.Series([count_text(encoding, t) for t in s], dtype="int64")

    return df.select(*keep, count(F.col(text)).alias("n_tokens"))
