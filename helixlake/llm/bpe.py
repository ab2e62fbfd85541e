"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text longer than this is cut at safe boundaries before it is encoded.
CHUNK_CHARS = 1 << 16

#: Between a letter and what is no letter, between a digit and what is no digit, or before one space between
#: two that are none: the match that ends there ends there whatever follows, and the next one starts there. So
#: the pieces encode as the whole text does.
SAFE_CUT = regex.compile(
    r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=\S)(?= [^\s])"
)
#: Runs of white space that the library's matcher would need too deep a stack for. One is a match of its own,
#: without its last character where something follows it.
LONG_SPACES = regex.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}+")


class Coder(tiktoken.Encoding):
    """An encoding, and ``whole``: one of the same ranks that takes all it is given as one match."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("whole", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> Coder:
    """The encoding of a rank file (lines of base64 token and rank), loaded once per worker."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Coder(ranks, pattern)


def pieces(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """``text`` cut at the first safe boundary at or after each ``size`` characters."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc: Coder, size: int = CHUNK_CHARS) -> np.ndarray:
    """The ids of a text by a pattern whose white space matches are those of ``public_tokenizers.PATTERN``."""
    if len(text) <= min(size, CHUNK_CHARS):
        return np.asarray(enc.encode_ordinary(text), dtype=np.int32)
    found, at = [], 0
    for run in LONG_SPACES.finditer(text):
        found += [enc.encode_ordinary(p) for p in pieces(text[at : run.start()], size)]
        at = run.end() - (run.end() < len(text))
        found.append(enc.whole.encode_ordinary(text[run.start() : at]))
    found += [enc.encode_ordinary(p) for p in pieces(text[at:], size)]
    return np.concatenate([np.asarray(ids, dtype=np.int32) for ids in found])


def encode_column(df: DataFrame, rank_file: str, pattern: str, text: str = "text", output: str = "ids") -> DataFrame:
    """``df`` with ``output``: the token ids of each whole text, in text order, without special tokens.

    A null or empty text gives an empty list; every row and every other column stays, repeated rows
    and duplicate ids included. ``output`` replaces a column of that name. The rank file has to be at
    the same path on every executor. Memory: one Arrow batch of texts.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pd.Series([encode(t or "", enc) for t in batch])

    return df.withColumn(output, ids(F.coalesce(df[text].cast("string"), F.lit(""))))


def decode_column(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", output: str = "bytes") -> DataFrame:
    """``df`` with ``output``: the raw bytes that each list of token ids stands for (null: no bytes)."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            yield pd.Series([b"" if t is None else enc.decode_bytes(t.tolist()) for t in batch])

    return df.withColumn(output, decoded(F.col(ids)))


def digests(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: adds n_tokens, ids_sha256 and decoded_sha256.

    The ids of a text are dropped once they are digested and decoded again, so that neither ids nor
    bytes travel between Python and the JVM.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoding(rank_file, pattern)
        names = [str(k) for k in range(enc.n_vocab)]
        for batch in batches:
            rows = []
            for t in batch:
                ids = encode(t or "", enc).tolist()
                joined = " ".join([names[k] for k in ids]).encode()
                rows.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ("n_tokens", "ids_sha256", "decoded_sha256")
    made = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), digest(F.coalesce(df[text].cast("string"), F.lit(""))).alias("digest"))
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in names]
    return made.select(*kept, *[F.col("digest")[c].alias(c) for c in names])
