"""Token counts of texts under a public tokenizer (byte-level BPE ranks file)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenizing pattern that belongs to the ranks file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CACHE: dict[str, tiktoken.Encoding] = {}


def encoding(path: str = DEFAULT) -> tiktoken.Encoding:
    if path not in _CACHE:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _CACHE[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]


def token_counts(path: str = DEFAULT):
    """mapInPandas: all columns but text kept, n_tokens added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for pdf in batches:
            n = [len(enc.encode_ordinary(t)) for t in pdf["text"]]
            yield pdf.drop(columns="text").assign(n_tokens=np.array(n, np.int64))

    return run
