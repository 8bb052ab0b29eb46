"""Encoding of a corpus with a public byte-level BPE vocabulary.

Forced boundaries: where two neighbouring bytes stand together inside no token of the vocabulary, no
merge can ever cross, so the text may be cut there. Such a cut leaves the result as it is if the
pre-tokenizer, too, sees the same pieces on both sides, which holds when the cut is between two
characters, the left one is no blank (runs of blanks look ahead) and the right one is no apostrophe
(contractions). Every cut text becomes a few fragments, mostly words with the blank before them; each
different fragment is encoded once per task and the ids are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pre-tokenizer of the 50k byte-level vocabularies, a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Multi-byte white space in UTF-8 (U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000), fixed values.
_WIDE_BLANKS = ("\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　")
_ASCII_BLANKS = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "


@dataclass(frozen=True)
class TokenizerConfig:
    #: Vocabulary in tiktoken's format: lines of base64 token and rank.
    ranks_path: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    #: Bound of the file that is sent to every executor.
    max_vocabulary_bytes: int = 64 << 20
    #: Different fragments a task remembers before it starts afresh; of no effect on the result.
    fragment_cache: int = 500_000


class Encoder:
    """Ids of texts by one vocabulary; lives in a Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int):
        import tiktoken

        self.bpe = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache_size, self.cache = cache, {}
        joined = np.zeros((256, 256), bool)
        for token in ranks:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8)
                joined[b[:-1], b[1:]] = True
        allowed = ~joined
        starts = np.ones(256, bool)
        starts[0x80:0xC0] = False  # not inside a character
        starts[ord("'")] = False
        allowed &= starts[None, :]
        allowed[list(_ASCII_BLANKS), :] = False
        self.allowed = allowed
        self.wide_ends = {c.encode() for c in _WIDE_BLANKS}
        self.wide_last = np.zeros(256, bool)
        self.wide_last[[c[-1] for c in self.wide_ends]] = True

    def cuts(self, data: bytes) -> np.ndarray:
        """Offsets at which `data` may be cut."""
        b = np.frombuffer(data, np.uint8)
        at = np.flatnonzero(self.allowed[b[:-1], b[1:]]) + 1
        doubtful = self.wide_last[b[at - 1]]
        if doubtful.any():
            bad = [i for i in np.flatnonzero(doubtful) if data[at[i] - 2 : at[i]] in self.wide_ends or data[at[i] - 3 : at[i]] in self.wide_ends]
            at = np.delete(at, bad)
        return at

    def encode(self, text: str) -> list[int]:
        data = text.encode("utf-8", "replace")
        ids: list[int] = []
        cache = self.cache
        ends = [0, *self.cuts(data).tolist(), len(data)]
        for start, end in zip(ends, ends[1:]):
            fragment = data[start:end]
            known = cache.get(fragment)
            if known is None:
                if len(cache) >= self.cache_size:
                    cache.clear()
                known = cache[fragment] = self.bpe.encode_ordinary(fragment.decode())
            ids += known
        return ids


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: bytes, config: TokenizerConfig) -> Encoder:
    """The encoder of this worker, built once."""
    key = (hashlib.sha256(vocabulary).digest(), config.pattern, config.fragment_cache)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}
        _ENCODERS[key] = Encoder(ranks, config.pattern, config.fragment_cache)
    return _ENCODERS[key]


def vocabulary(df: DataFrame, config: TokenizerConfig) -> Broadcast:
    """The vocabulary file, sent to the executors; its size is checked first."""
    path = Path(config.ranks_path)
    if path.stat().st_size > config.max_vocabulary_bytes:
        raise ValueError(f"{path} is larger than {config.max_vocabulary_bytes} bytes")
    return df.sparkSession.sparkContext.broadcast(path.read_bytes())


def _map_texts(df: DataFrame, text: str, out: str, out_type: T.DataType, build, config: TokenizerConfig) -> DataFrame:
    kept = [c for c in df.columns if c not in (text, out)]
    sent = vocabulary(df, config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(sent.value, config)
        for batch in batches:
            found = [enc.encode(t) if t else [] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), build(found)], [*kept, out])

    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, out_type)])
    return df.select(*kept, F.col(text)).mapInArrow(run, schema)


def encode_corpus(df: DataFrame, text: str = "text", out: str = "ids", config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """`df` with the column `out`, the ids of `text` without special tokens, in place of `text`.

    Null and empty texts give an empty array; a text of blanks is encoded like any other, and the
    names of special tokens in a text are ordinary text. Whole texts are encoded, whatever their length.
    Other columns stay as they are; one named like `out` is replaced. No shuffle.
    """

    def lists(found: list[list[int]]) -> pa.Array:
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        values = np.fromiter((i for x in found for i in x), np.int32, offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return _map_texts(df, text, out, T.ArrayType(T.IntegerType()), lists, config)


def count_tokens(df: DataFrame, text: str = "text", out: str = "n_tokens", config: TokenizerConfig = TokenizerConfig()) -> DataFrame:
    """`df` with the number of ids of `text` in place of `text`; 0 for null and empty texts."""
    return _map_texts(df, text, out, T.IntegerType(), lambda found: pa.array([len(x) for x in found], pa.int32()), config)
