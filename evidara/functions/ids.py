"""Identifiers: digests in base 58, cache keys, names."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the alphabet without characters that look alike.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
WIDTH = 22


def base58(digest: bytes) -> str:
    """A 128-bit digest in base 58, padded to one width."""
    n, out = int.from_bytes(digest, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = ALPHABET[r] + out
    return out.rjust(WIDTH, ALPHABET[0])


def digest_id(text: str) -> str:
    return base58(hashlib.md5(text.encode()).digest())


def ids_of(text: Column | str) -> Column:
    """Base-58 digests of a string column, batch by batch."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else digest_id(x))

    return run(text)


def section_id(document: Column | str, position: Column | str) -> Column:
    return ids_of(F.concat_ws("/s/", document, F.col(position).cast("string") if isinstance(position, str) else position.cast("string")))


def chunk_id(document: Column | str, seq: Column | str) -> Column:
    return ids_of(F.concat_ws("/c/", document, F.col(seq).cast("string") if isinstance(seq, str) else seq.cast("string")))


def cache_key(**parts: Column) -> Column:
    """The SHA-256 of 'name:value;...' in the order given; booleans in lower case, nulls empty."""
    return F.sha2(F.concat_ws(";", *(F.concat(F.lit(f"{k}:"), F.coalesce(v.cast("string"), F.lit(""))) for k, v in parts.items())), 256)


def stored_name(name: str) -> str:
    """A file name in ASCII kebab case with a lower-case suffix."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    stem, dot, suffix = plain.rpartition(".")
    if not dot:
        stem, suffix = plain, ""
    kebab = re.sub(r"[^a-z0-9]+", "-", stem.lower()).strip("-") or "document"
    return kebab + (f".{suffix.lower()}" if suffix else "")


def stored_names(name: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: None if x is None else stored_name(x))

    return run(name)
