"""Counting tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: where the vocabulary files of public tokenizers lie; a parameter of every caller
TOKENIZERS = "/opt/tokenizers"
#: fixed value: the pre-tokenizer pattern that belongs to the published byte-level vocabulary
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a longer text is encoded in parts, cut at line breaks or else anywhere
_PART = 50_000


def token_counter(spark: SparkSession, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
    """A function from a text column to its number of tokens; null for null.

    The vocabulary (a file of fixed size, about a megabyte) is read once on the driver and shared with the executors, which need
    no files of their own.
    """
    if os.path.getsize(path) > 64 << 20:
        raise ValueError(f"{path} is no vocabulary file: it has more than 64 MB")
    with open(path, "rb") as file:
        vocabulary = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.value.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

        def size(text: str | None) -> int | None:
            if text is None:
                return None
            total = 0
            while len(text) > _PART:
                cut = text.rfind("\n", 1, _PART) + 1 or _PART
                total += len(encoding.encode_ordinary(text[:cut]))
                text = text[cut:]
            return total + len(encoding.encode_ordinary(text))

        for batch in batches:
            yield batch.map(size).astype("Int64")

    def tokens(text: Column) -> Column:
        return count(text)

    return tokens
