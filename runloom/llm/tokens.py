"""Token counts of whole texts under a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Byte-pair ranks, one "base64-token rank" per line.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to these ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer of ``path``; loaded once per Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def with_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", path: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of each whole text instead of the text; null and empty texts have 0."""
    kept = [c for c in df.columns if c != text]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(tokens, T.LongType())])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode_ordinary
        for frame in frames:
            yield frame[kept].assign(**{tokens: [len(encode(x)) if x else 0 for x in frame[text]]})

    return df.select(*[F.col(f"`{c}`") for c in [*kept, text]]).mapInPandas(count, schema)
