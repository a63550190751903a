"""Packing by powers of two: documents are cut into pieces of binary lengths, and pieces of one length share a bucket.

A document's ids are cut from its start into as many pieces of ``longest`` ids as it holds; the rest is cut by its binary digits,
greatest first. A piece is a sequence of its own, so that no sequence crosses documents and none is padded; a batch is drawn from one
bucket, whose sequences have all the same length.

``pieces`` encodes and cuts where a text lies; the ids leave the task only where they are asked for. ``bucketed`` numbers the pieces of
each bucket without gaps: equal pieces are counted first, hash bins of bounded size are numbered by their counts, and a piece has the
place of its rank in its bin. Numbers follow from the rows alone, not from their partitions.

Defined results: a null or empty text has the closing id alone; rows of a null id are packed like others; repeated rows (and rows
that repeat an id with another text) are packed each; long texts are encoded whole; an empty table gives an empty table; other columns
of the input are neither read nor returned.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import cut, slices, table
from .pools import Pool, flattened, per_row, runs, strings_of

LONGEST = 4096
CLOSING = 2  # the id after each document
BIN_PIECES = 1 << 18


SPECIAL = "<|"  # begins the strings of special tokens, which count as such in texts
BETWEEN = "<|endoftext|>"
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[0x41:0x5B] += 0x20
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, dtype=bool)
MARK[list(b'.,;:!?)"')] = True


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What is encoded on its own, one after another, and the bounds of each text's: words between ASCII white space, A-Z lowered, cut
    before a mark that follows a letter or digit. Texts that may hold a special token are only cut at white space."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    low = PLAIN[raw]
    cuts = np.zeros(len(raw), dtype=bool)
    cuts[1:] = LETTER[low[:-1]] & MARK[low[1:]]
    special = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
    if special.any():
        own = np.repeat(special, np.diff(bounds))
        low, cuts = np.where(own, raw, low), cuts & ~own
    before = np.cumsum(cuts)
    spaced = np.full(len(raw) + (int(before[-1]) if len(raw) else 0), 0x20, dtype=np.uint8)
    spaced[np.arange(len(raw)) + before] = low
    wider = bounds + np.concatenate(([0], before))[bounds]
    words = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(wider.tobytes()), pa.py_buffer(spaced.tobytes())))
    at = words.offsets.to_numpy()
    return words.flatten(), at - at[0]


class WordCoder:
    """Ids of texts by a tokenizer that lowers letters and drops white space, so that words can be encoded on their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.between = self.tool.token_to_id(BETWEEN)
        self.pool = Pool(self._encode)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        special = np.array([SPECIAL in w for w in words])
        if not special.any():
            return self._joined(words)
        ids, widths = self._joined([w for w in words if SPECIAL not in w])
        more, wide = flattened([self.tool.encode(w, add_special_tokens=False).ids for w in words if SPECIAL in w])
        order = np.argsort(np.concatenate((np.flatnonzero(~special), np.flatnonzero(special))))
        ids, widths = np.concatenate((ids, more)), np.concatenate((widths, wide))
        return runs(ids, (np.cumsum(widths) - widths)[order], widths[order]), widths[order]

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in one call, with a special token between them that tells where each ends."""
        if not words:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        found = []
        for at in range(0, len(words), 1000):
            found.append(np.array(self.tool.encode_batch_fast([BETWEEN.join(words[at : at + 1000])], add_special_tokens=False)[0].ids, dtype=np.int64))
            found.append(np.array([self.between]))
        ids = np.concatenate(found)
        ends = np.flatnonzero(ids == self.between)
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        words, bounds = words_of(column)
        coded = words.dictionary_encode()
        ids, widths = self.pool.gather(self.pool.look_up(strings_of(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)])
        return ids, per_row(bounds, widths)


@lru_cache(maxsize=2)
def coder(path: str) -> WordCoder:
    return WordCoder(path)


def binary_cuts(sizes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the pieces of documents of ``sizes`` ids; ``longest`` is a power of two."""
    digits = longest // (1 << np.arange(1, longest.bit_length()))  # longest / 2 down to 1
    held = (sizes[:, None] & digits[None, :]) > 0
    whole = sizes // longest
    counts = whole + held.sum(axis=1)
    owner = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.full(len(owner), longest, dtype=np.int64)
    length[place >= whole[owner]] = np.broadcast_to(digits, held.shape)[held]
    ends = np.cumsum(length)
    first = np.cumsum(sizes) - sizes
    return owner, ends - length - first[owner], length


def pieces(df: DataFrame, path: str | None = None, longest: int = LONGEST, closing: int = CLOSING, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start (ids of its document before it), length, ids (array; left out unless ``with_ids``), ids_crc32 (of the
    ids as little-endian 32-bit integers), doc_tokens (ids of the whole document)."""
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = df.schema[id_col].dataType.simpleString()
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def run(batches):
        for part in slices(batches):
            flat, counts = coder(path).encode(part.column(1))
            sizes = counts + 1
            closed = np.cumsum(sizes) - 1
            ids = np.full(int(sizes.sum()), closing, dtype="<u4")
            inner = np.ones(len(ids), dtype=bool)
            inner[closed] = False
            ids[inner] = flat
            owner, start, length = binary_cuts(sizes, longest)
            bounds = np.concatenate(([0], np.cumsum(length)))
            raw = memoryview(ids).cast("B")
            sums = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            columns = [part.column(0).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(sizes[owner])]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if with_ids else "")
    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def bucketed(cuts: DataFrame, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """``cuts`` (columns of ``pieces``) with bucket (binary logarithm of the length), place (from 0, in the bucket), sequence_id and offset.

    A sequence's number holds its bucket above 48 bits of its place, so that numbers need no count over all buckets.
    """
    names = cuts.columns
    same = cut(cuts.groupBy(*names).agg(F.count("*").alias("copies_")))
    bins = max(1, -(-(same.agg(F.sum("copies_")).first()[0] or 0) // bin_pieces))
    same = same.withColumn("bucket", F.bit_count(F.col("length") - 1)).withColumn("bin_", F.pmod(F.xxhash64(*names), F.lit(bins)))
    sizes = same.groupBy("bucket", "bin_").agg(F.sum("copies_").alias("n"))
    before = Window.partitionBy("bucket").orderBy("bin_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("bucket", "bin_", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_"))
    inside = Window.partitionBy("bucket", "bin_").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    ranked = same.withColumn("rank_", F.coalesce(F.sum("copies_").over(inside), F.lit(0))).join(sizes, ["bucket", "bin_"])
    each = ranked.withColumn("copy_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies_") - 1)))
    place = F.col("first_") + F.col("rank_") + F.col("copy_")
    return each.select(*[F.col(f"`{c}`") for c in names], "bucket", place.alias("place"), (F.shiftleft(F.col("bucket").cast("long"), 48) + place).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bucketed(pieces(table(spark, sf_dir, "documents"), with_ids=False))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
