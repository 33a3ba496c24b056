"""Sizes of texts in tokens of a public tokenizer whose vocabulary file's path is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenizer pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: longest run that is handed to the tokenizer at once
RUN = 100_000


@lru_cache(2)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, enc) -> int:
    """Tokens of a text of any length. Very long texts are counted in runs cut before a blank that stands
    between two other characters, where the pattern cuts as well; only a run without such a blank is cut elsewhere."""
    n, at = 0, 0
    while len(text) - at > RUN:
        cut = at + RUN
        while cut > at + 1 and not (text[cut] == " " and not text[cut - 1].isspace() and not text[cut + 1:cut + 2].isspace()):
            cut -= 1
        if cut <= at + 1:
            cut = at + RUN
        n += len(enc.encode_ordinary(text[at:cut]))
        at = cut
    return n + len(enc.encode_ordinary(text[at:]))


def token_count(path: str = VOCABULARY):
    """Arrow function of a text column: number of tokens; null and empty texts have none."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(path)
        for texts in batches:
            yield texts.map(lambda t: count_tokens(t, enc) if t else 0).astype("int64")

    return count


def tokens(text: Column, path: str = VOCABULARY) -> Column:
    return token_count(path)(text)
