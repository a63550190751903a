"""Byte-level BPE over Arrow batches: encode whole texts with the tokenizers library, keep offsets, decode by the reversed byte table.

Each match of the split pattern is encoded on its own. A text is split once; the distinct matches of a slice go through the
library in one call and are kept in a bounded cache of the worker, so a common word costs a gather instead of a merge.

Defined results: a null text is the empty text (no tokens); long texts are encoded whole; repeated rows give repeated results;
an empty table gives an empty table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .batches import map_texts, table

CACHE_PIECES = 250_000
LONGEST_CACHED = 1_000


def byte_table() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 upwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that the merges of lower rank leave of ``token``."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts[0], parts[1]


def byte_of() -> np.ndarray:
    """The byte table reversed: the byte that each character of a token's spelling stands for."""
    out = np.zeros(0x200, dtype=np.uint8)
    for byte, char in enumerate(byte_table()):
        out[ord(char)] = byte
    return out


class Codec:
    """Encoder and decoder of one vocabulary file; lives in a Python worker."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokens = read_ranks(path)
        ranks = {t: i for i, t in enumerate(self.tokens)}
        shown = byte_table()
        spelled = ["".join(shown[b] for b in t) for t in self.tokens]
        merges = []
        for token in self.tokens:
            if len(token) > 1:
                left, right = last_merge(token, ranks)
                merges.append((spelled[ranks[left]], spelled[ranks[right]]))
        self.spelled, self.byte_of = spelled, byte_of()
        self.library = Tokenizer(models.BPE(vocab={s: i for i, s in enumerate(spelled)}, merges=merges))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.known: dict[str, int] = {}
        self.pool = np.zeros(0, dtype=np.uint32)
        self.bounds = np.zeros(1, dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        pieces = [self.split(t) for t in texts]
        counts = np.fromiter(map(len, pieces), dtype=np.int64, count=len(texts))
        flat = [p for own in pieces for p in own]
        if not flat:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        fresh = [p for p in distinct if p not in self.known]
        added = [x.ids for x in self.library.encode_batch_fast(fresh, add_special_tokens=False)]
        widths = np.fromiter(map(len, added), dtype=np.int64, count=len(added))
        bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(widths)))
        pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(added), dtype=np.uint32, count=int(widths.sum()))))
        place = dict(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        each = np.fromiter((place[p] if p in place else self.known[p] for p in distinct), dtype=np.int64, count=len(distinct))
        if len(self.known) < CACHE_PIECES:
            # Matches that are very long stay out of the cache.
            if max(map(len, fresh), default=0) <= LONGEST_CACHED:
                self.known.update(place)
                self.pool, self.bounds = pool, bounds
            else:
                self._keep([p for p in fresh if len(p) <= LONGEST_CACHED], place, pool, bounds)
        which = each[coded.indices.to_numpy(zero_copy_only=False)]
        starts, width = bounds[which], bounds[which + 1] - bounds[which]
        ends = np.cumsum(width)
        ids = pool[np.repeat(starts - (ends - width), width) + np.arange(ends[-1])]
        ends_by_text = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return ids, np.diff(ends_by_text)

    def _keep(self, pieces: list[str], place: dict[str, int], pool: np.ndarray, bounds: np.ndarray) -> None:
        """Add the ids of ``pieces`` alone to the cache."""
        n = len(self.known)
        at = [place[p] for p in pieces]
        self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.pool = np.concatenate((self.pool, *[pool[bounds[k] : bounds[k + 1]] for k in at]))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(bounds[np.array(at, dtype=np.int64) + 1] - bounds[at])))

    def decode(self, ids) -> bytes:
        """The bytes that the characters of the tokens' spellings stand for; a character split over tokens comes together again."""
        return self.byte_of[np.frombuffer("".join(map(self.spelled.__getitem__, ids)).encode("utf-16-le"), dtype=np.uint16)].tobytes()

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character span of each token: from the character that holds its first byte to past the one that holds its last."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        holder = np.cumsum((raw & 0xC0) != 0x80) - 1
        return holder[starts], holder[ends - 1] + 1


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the default vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _lists(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(flat).cast(kind))


def encode(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and character spans of every text: id, ids array<int>, starts array<int>, ends array<int>."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    kind = df.schema[id_col].dataType.simpleString()

    def work(part, texts):
        tool = codec(path, pattern)
        ids, counts = tool.encode(texts)
        spans = [tool.spans(t, own) if len(own) else (own, own) for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
        starts = np.concatenate([s for s, _ in spans])
        ends = np.concatenate([e for _, e in spans])
        return pa.RecordBatch.from_arrays([part.column(0), _lists(ids, counts, pa.int32()), _lists(starts, counts, pa.int32()), _lists(ends, counts, pa.int32())], names=[id_col, "ids", "starts", "ends"])

    return map_texts(df, id_col, text_col, work, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: id, bytes binary, text string (bytes that form no character read as U+FFFD). A null list gives no bytes."""
    path = path or vocabulary()[0]
    pattern = vocabulary()[1]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in batches:
            tool = codec(path, pattern)
            raw = [tool.decode(ids or ()) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in raw], pa.string())], names=[id_col, "bytes", "text"])

    return df.select(df[id_col], df[ids_col]).mapInArrow(run, f"`{id_col}` {kind}, bytes binary, text string")


def round_trip(df: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and return a digest of both: id, n_tokens, ids_sha256, decoded_sha256."""
    path, pattern = path or vocabulary()[0], pattern or vocabulary()[1]
    kind = df.schema[id_col].dataType.simpleString()

    def work(part, texts):
        tool = codec(path, pattern)
        ids, counts = tool.encode(texts)
        own = np.split(ids, np.cumsum(counts)[:-1])
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(counts),
                pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in own], pa.string()),
                pa.array([hashlib.sha256(tool.decode(x.tolist())).hexdigest() for x in own], pa.string()),
            ],
            names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_texts(df, id_col, text_col, work, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
