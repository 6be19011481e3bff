"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str):
    """The tokenizer of a ranks file, loaded once a process."""
    if path not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def with_sizes(docs: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """docs without the text, with n_tokens; a null text has 0. Whole texts are encoded."""
    path = path or default_vocabulary()
    others = [f for f in docs.schema.fields if f.name not in (text_col, "n_tokens")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "n_tokens long"])

    def run(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b[text_col]]
            yield b.drop(columns=text_col).assign(n_tokens=pd.Series(n, index=b.index, dtype="int64"))

    return docs.select(*[F.col(f.name) for f in others], text_col).mapInPandas(run, schema)
