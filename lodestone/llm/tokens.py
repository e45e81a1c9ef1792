"""Sizes of texts in tokens of a public byte-level tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Default vocabulary (tiktoken rank file); never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the public pre-tokenizer pattern that belongs to this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: list[str | None], path: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text; 0 for null."""
    enc = encoder(path)
    return np.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts], np.int64)


def counted(batches: Iterator[pa.RecordBatch], text: str, path: str) -> Iterator[pa.RecordBatch]:
    """Replaces the column ``text`` by ``n_tokens``, keeping the others."""
    for b in batches:
        i = b.schema.get_field_index(text)
        n = count_tokens(b.column(i).to_pylist(), path)
        names = [x for x in b.schema.names if x != text]
        yield pa.record_batch([b.column(b.schema.get_field_index(x)) for x in names] + [pa.array(n)], names=[*names, "n_tokens"])
