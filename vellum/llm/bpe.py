"""Byte-level BPE encoding and decoding.

The merges are those of a local rank file, run by the tiktoken library inside Arrow functions: a map over
rows, without a shuffle. The driver reads the rank file (its size is checked) and broadcasts its bytes, so
executors need no copy of it.
"""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.pieces import streamed
from vellum.llm.common import idle_memory

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A rank file larger than this is refused rather than broadcast.
MAX_RANK_BYTES = 64 << 20
#: Texts are handed to the library in pieces of at least so many characters.
PIECE_CHARS = 1 << 16
#: No match of the splitting pattern holds a visible character followed by white space, and what follows such
#: a place is matched as if the text began there; so a text may be cut there without changing its tokens.
SAFE_CUT = re.compile(r"(?<=\S)(?=\s)")

_codecs: dict = {}


def pieces(text: str, size: int = PIECE_CHARS):
    """Cuts a long text at safe boundaries, each piece size characters or more but for the last."""
    start = 0
    while len(text) - start > size:
        found = SAFE_CUT.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


class Codec:
    """Built for what it is used for: the table of tokens, and for encoding the library's merges as well."""

    def __init__(self, ranks: bytes, pattern: str | None):
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, ranks.splitlines()))}
        self.tokens = {rank: token for token, rank in merges.items()}
        if pattern:
            import tiktoken

            self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) <= PIECE_CHARS:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


def _codec(ranks, pattern: str | None) -> Codec:
    """One codec for each Python worker and rank file; building it takes a tenth of a second."""
    digest, shared = ranks
    key = (digest, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def _broadcast(df: DataFrame, ranks_path: str | None):
    path = Path(ranks_path or public_tokenizers.path(RANKS))
    if (size := path.stat().st_size) > MAX_RANK_BYTES:
        raise ValueError(f"{path} has {size} bytes; at most {MAX_RANK_BYTES} are broadcast")
    data = path.read_bytes()
    return hashlib.sha256(data).hexdigest(), df.sparkSession.sparkContext.broadcast(data)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", ranks_path: str | None = None, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """Adds the token ids of each whole text.

    ids: the new column, array<int>, or with packed a binary of little-endian unsigned 32-bit integers.
    A null text counts as empty and has no tokens. Repeated rows are encoded alike; an empty table stays empty.
    Special tokens' strings in a text are ordinary text. An existing column of that name is replaced.
    """
    ranks, pattern = _broadcast(df, ranks_path), pattern or public_tokenizers.PATTERN

    def run(texts: pa.Array) -> pa.Array:
        codec = _codec(ranks, pattern)
        found = (np.array(codec.encode(t.as_py() or ""), dtype="<u4") for t in texts)
        if packed:
            return pa.array([a.tobytes() for a in found], pa.binary())
        return pa.array([a.astype(np.int32) for a in found], pa.list_(pa.int32()))

    return df.withColumn(ids, F.arrow_udf(streamed(run, idle_memory), "binary" if packed else "array<int>")(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", ranks_path: str | None = None) -> DataFrame:
    """Adds the raw bytes that the ids stand for (binary; cut texts need not be whole UTF-8).

    ids: array<int> or the packed form of encode. Null ids and null members give null and nothing.
    Ids without a rank raise an error.
    """
    ranks = _broadcast(df, ranks_path)
    packed = dict(df.dtypes)[ids] == "binary"

    def run(column: pa.Array) -> pa.Array:
        codec = _codec(ranks, None)
        read = (lambda v: np.frombuffer(v, dtype="<u4").tolist()) if packed else (lambda v: [i for i in v if i is not None])
        return pa.array([None if v is None else codec.decode(read(v)) for v in (x.as_py() for x in column)], pa.binary())

    return df.withColumn(out, F.arrow_udf(streamed(run, idle_memory), "binary")(F.col(ids)))
