"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vocabulary stays outside the repository; another file of the same format may be named.
VOCABULARY = os.environ.get("VERIDEX_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a .tiktoken file, kept per Python worker."""
    if path not in _loaded:
        tiktoken = importlib.import_module("tiktoken")
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(column: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of each text; null and empty texts have 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = encoding(path)
        for batch in batches:
            yield pd.Series([len(own.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    return count(column)
