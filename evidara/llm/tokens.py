"""Sizes and offsets in tokens of public tokenizers; the folder of their vocabulary files is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import cache

import numpy as np

#: Where the vocabulary files lie, unless a path is given.
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How a byte-level vocabulary's text is cut before merging: fixed values.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(path: str | None = None):
    import tiktoken

    with open(path or f"{FOLDER}/{VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(path: str | None = None) -> Callable[[list[str]], list[int]]:
    own = encoding(path)
    return lambda texts: [len(own.encode_ordinary(t)) for t in texts]


def token_starts(text: str, path: str | None = None) -> np.ndarray:
    """The character at which each token starts, and the text's length; tokens within one character start at it."""
    own = encoding(path)
    ids = own.encode_ordinary(text)
    size = np.fromiter((len(own.decode_single_token_bytes(i)) for i in ids), np.int64, len(ids))
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
    at = np.cumsum(size) - size
    return np.append(chars[at] - 1 if len(ids) else np.empty(0, np.int64), len(text))
