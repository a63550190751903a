"""Alignment of two tokenizers over the same bytes, with Arrow tables inside the tasks.

Every text, with a space before it, is encoded by a byte-level tokenizer (A) and by a piece tokenizer (B). In a slice of texts the
tokens are flattened with the index of their document, running sums of their byte lengths within the document give their ends, and an
outer hash join of A and B on (document, end) gives one row for every place where a token ends. Between two such places lie one token
of A and one of B, so the rows are the links; where both end, a group ends.

An id pair counts once a document. A slice counts its pairs with ``Table.group_by``; Spark merges the slices' counts. A slice's
pairs fetch their counts once (a pair is one row of a slice, however often it stands there), and meet the documents of the slice again,
which hold their pairs as places in the slice's sorted list. So no pair is hot, and nothing is broadcast but the highest count by A id.

Texts are cut for encoding before a space between a character that is no space and one that is no white space. No match of A's
pattern crosses such a place, and no piece of B holds a space behind another character (checked when the model is read); so what lies
between is encoded alone, once a worker.

Defined results: texts that are null or empty, or whose joined tokens differ from a space and the text (such as texts with U+2581), have
no tokens and count 0; strings of special tokens are plain text; rows of a null id and repeated rows are documents each; long texts are
aligned whole; an empty table gives an empty table; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut, slices, table, written
from .bpe import byte_of
from .pools import Pool, flattened, per_row, strings_of

JOINED = 50  # chunks in one call
SLICE = 1 << 20  # bytes of text that are aligned at once
SPACE = "▁"  # stands for a space in the pieces of B
BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def solid(raw: np.ndarray) -> np.ndarray:
    """Places where a character begins that surely is no white space: visible ASCII, or others but the blocks that hold white space."""
    follows = np.append(raw[1:], 0)
    near = ((raw == 0xC2) & ((follows == 0x85) | (follows == 0xA0))) | ((raw == 0xE1) & ((follows == 0x9A) | (follows == 0xA0))) | ((raw == 0xE2) & (follows <= 0x81)) | ((raw == 0xE3) & (follows == 0x80))
    return ((raw > 0x20) & (raw < 0x7F)) | ((raw >= 0xC2) & ~near)


def chunks(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The chunks of all texts (a space before each), and the bounds of each text's; an empty text has none."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()), pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    bounds = bounds - bounds[0]
    begins = np.zeros(len(raw), dtype=bool)
    if len(raw):
        begins[1:-1] = (raw[1:-1] == 0x20) & (raw[:-2] != 0x20) & solid(raw)[2:]
        filled = bounds[1:] > bounds[:-1]
        begins[bounds[1:][filled] - 1] = False  # the last byte of a text
        begins[bounds[:-1][filled]] = True
    starts = np.append(np.flatnonzero(begins), len(raw))
    found = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes()))
    return found.dictionary_encode(), np.searchsorted(starts, bounds)


def spell(texts: list[str], ids: np.ndarray, widths: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Whether the bytes of each text's tokens are the text."""
    own = [tokens[i] for i in ids.tolist()]
    ends = np.cumsum(widths).tolist()
    return np.fromiter((b"".join(own[e - w : e]) == t.encode() for t, w, e in zip(texts, widths.tolist(), ends, strict=True)), dtype=bool, count=len(texts))


def joined_ids(texts: list[str], encode, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of chunks one after another and how many each has, of many chunks in one call: the texts of JOINED chunks are put together, and
    cut again where as many bytes are spelled as a chunk has. Only chunks that begin with a space and a visible character follow another
    one, as they do in a text; the others begin a call."""
    joined, owner = [], []
    for t in texts:
        follows = len(t) > 1 and t[0] == " " and ("!" <= t[1] <= "~" or t[1].isalnum())
        if follows and joined and len(owner[-1]) < JOINED:
            joined[-1].append(t)
            owner[-1].append(len(t.encode()))
        else:
            joined.append([t])
            owner.append([len(t.encode())])
    ids, _ = flattened(encode(["".join(own) for own in joined]))
    ends, wanted = np.cumsum(sizes[ids]), np.cumsum([n for own in owner for n in own])
    at = np.searchsorted(ends, wanted) + 1
    if (np.append(ends, -1)[at - 1] != wanted).any():  # some bytes are not spelled
        return flattened(encode(texts))
    return ids, np.diff(at, prepend=0)


class Pair:
    """Two tokenizers, the bytes of their tokens, and the ids of chunks met so far; lives in a Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(path_a)
        a.encode_special_tokens = True
        b = SentencePieceProcessor(model_file=path_b)
        back = byte_of()
        names = [a.id_to_token(i) for i in range(a.get_vocab_size())]
        bytes_a = [bytes(back[ord(c)] for c in name) if max(map(ord, name)) < len(back) else name.encode() for name in names]
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
            raise ValueError("a piece holds a space behind another character")
        bytes_b = [bytes([int(BYTE.fullmatch(p)[1], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.sizes = [pa.array([len(t) for t in own], pa.int64()) for own in (bytes_a, bytes_b)]
        self.names = [pa.array([str(i) for i in range(len(own))]) for own in (bytes_a, bytes_b)]
        self.pools = [
            Pool(lambda texts: joined_ids(texts, lambda some: [x.ids for x in a.encode_batch_fast(some, add_special_tokens=False)], np.array([len(t) for t in bytes_a])), check=lambda *found: spell(*found, bytes_a)),
            Pool(lambda texts: flattened(b.encode([t[1:] for t in texts], num_threads=1)), check=lambda *found: spell(*found, bytes_b)),  # B adds the space
        ]

    def encode(self, column: pa.Array) -> list[pa.ListArray]:
        """Ids by document of A and of B; empty for documents without tokens."""
        coded, bounds = chunks(column)
        distinct, which = strings_of(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False)
        slots = [pool.look_up(distinct)[which] for pool in self.pools]
        wrong = ~(self.pools[0].good[slots[0]] & self.pools[1].good[slots[1]])
        counts = np.diff(bounds)
        keep = np.repeat(per_row(bounds, wrong) == 0, counts)
        bounds = np.concatenate(([0], np.cumsum(per_row(bounds, keep))))
        out = []
        for pool, own in zip(self.pools, slots, strict=True):
            ids, widths = pool.gather(own[keep])
            ends = np.concatenate(([0], np.cumsum(per_row(bounds, widths))))
            out.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return out


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def vocabularies() -> tuple[str, str]:
    """Paths of the default tokenizers A and B."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def token_ends(ids: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """doc, end (in bytes of its document), and the id: one row per token."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    running = pc.cumulative_sum(sizes.take(flat))
    starts = pc.list_value_length(ids).to_numpy(zero_copy_only=False).cumsum()  # tokens up to each document's end
    before = np.concatenate(([0], running.to_numpy()))[np.concatenate(([0], starts[:-1]))] if len(starts) else starts
    return pa.table({"doc": doc, "end": pc.subtract(running, pa.array(before, pa.int64()).take(doc)), name: flat})


def joined_ends(a: pa.ListArray, b: pa.ListArray, tool: Pair) -> pa.Table:
    """doc, end, a, b: a row per place where a token of A or of B ends, in order; the id is null of the one that does not end there."""
    left, right = token_ends(a, tool.sizes[0], "a"), token_ends(b, tool.sizes[1], "b")
    return left.join(right, keys=["doc", "end"], join_type="full outer", use_threads=False).combine_chunks().sort_by([("doc", "ascending"), ("end", "ascending")])


def group_sizes(ends: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each group: its document, and how many tokens of A and of B it has."""
    has_a, has_b = (ends[c].is_valid().to_numpy() for c in ("a", "b"))
    last = np.flatnonzero(has_a & has_b)
    sizes = [np.diff(np.cumsum(has)[last], prepend=0) for has in (has_a, has_b)]
    return ends["doc"].to_numpy()[last], *sizes


def lists(flat: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), flat)


def spelled(a: pa.ListArray, b: pa.ListArray, groups: tuple, rows: int, tool: Pair) -> pa.Array:
    """``a1,a2|b1;a3|b2,b3`` of each document."""
    doc, size_a, size_b = groups
    sides = [pc.binary_join(lists(names.take(ids.flatten()), size), ",") for names, ids, size in zip(tool.names, (a, b), (size_a, size_b), strict=True)]
    return pc.binary_join(lists(pc.binary_join_element_wise(*sides, "|"), np.bincount(doc, minlength=rows)), ";")


def align(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids, b_ids, a_sizes, b_sizes (arrays; the latter: tokens of A and of B in each group)."""
    path_a, path_b = path_a or vocabularies()[0], path_b or vocabularies()[1]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches, limit=SLICE):
            tool = pair(path_a, path_b)
            a, b = tool.encode(part.column(1))
            doc, *sizes = group_sizes(joined_ends(a, b, tool))
            counts = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), a, b, *[lists(pa.array(s.astype(np.int32)), counts) for s in sizes]], names=[id_col, "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>")


def linked(df: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds, told by ``pairs``: a slice (block, pairs: its distinct id pairs in order, times: documents of the slice that
    hold each) and a document (pairs null; places: of its pairs in the slice's list, times: its links of each)."""
    kind = df.schema[id_col].dataType.simpleString()
    shown = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        for number, part in enumerate(slices(batches, limit=SLICE)):
            tool, rows = pair(path_a, path_b), part.num_rows
            a, b = tool.encode(part.column(1))
            ends = joined_ends(a, b, tool)
            groups = group_sizes(ends)
            counts = [pc.list_value_length(a), pc.list_value_length(b), *[pa.array(np.bincount(d, minlength=rows)) for d in (groups[0], ends["doc"].to_numpy())]]
            digests = [hashlib.sha256(t.as_buffer()).hexdigest() if len(t.as_py()) else "" for t in spelled(a, b, groups, rows, tool)]
            # The token that covers a place is the next one that ends there or later; the last place of a document ends both.
            ids = [pc.fill_null_backward(ends[c]).cast(pa.int64()) for c in ("a", "b")]
            pairs = pc.bit_wise_or(pc.shift_left(ids[0], 32), ids[1]).combine_chunks()
            coded = pairs.dictionary_encode()
            values = coded.dictionary.to_numpy()
            order = np.argsort(values)
            rank = np.empty(len(values), dtype=np.int64)
            rank[order] = np.arange(len(values))
            wide = max(1, len(values))
            key = ends["doc"].to_numpy().astype(np.int64) * wide + rank[coded.indices.to_numpy()]
            held = pa.table({"key": key}).group_by("key", use_threads=False).aggregate([([], "count_all")]).sort_by("key")
            doc, place = np.divmod(held["key"].to_numpy(), wide)
            partial = pa.table({"place": place}).group_by("place", use_threads=False).aggregate([([], "count_all")]).sort_by("place")
            own = np.bincount(doc, minlength=rows)
            block = pa.array(np.full(rows + 1, task | number))
            ident = pa.concat_arrays([part.column(0), pa.nulls(1, part.column(0).type)])
            whole = [pa.concat_arrays([c.cast(pa.int64()), pa.array([None], pa.int64())]) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    block,
                    ident,
                    *whole,
                    pa.array([*digests, None], pa.string()),
                    pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), lists(pa.array(values[order]), np.array([len(values)]))]),
                    pa.concat_arrays([lists(pa.array(place.astype(np.int32)), own), pa.nulls(1, pa.list_(pa.int32()))]),
                    pa.concat_arrays([lists(held["count_all"].combine_chunks().cast(pa.int32()), own), lists(partial["count_all"].combine_chunks().cast(pa.int32()), np.array([len(values)]))]),
                ],
                names=["block", "id", *shown, "groups_sha256", "pairs", "places", "times"],
            )

    schema = f"block long, id {kind}, {', '.join(f'{c} long' for c in shown)}, groups_sha256 string, pairs array<long>, places array<int>, times array<int>"
    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, schema)


def pair_counts(linked_rows: DataFrame) -> DataFrame:
    """pair (A id above 32 bits of B id), n_docs (documents that hold it linked), best (no pair of its A id has more)."""
    slices_ = linked_rows.where(F.col("pairs").isNotNull())
    merged = cut(slices_.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n_docs")))
    most = merged.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))  # a row an id of A's vocabulary
    return merged.withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(most), "a").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_counts(df: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its A id's highest count), count_sum (of the counts over links), groups_sha256."""
    path_a, path_b = path_a or vocabularies()[0], path_b or vocabularies()[1]
    kind = df.schema[id_col].dataType.simpleString()
    rows = written(linked(df, path_a, path_b, id_col, text_col))
    slice_pairs = rows.where(F.col("pairs").isNotNull()).select(F.col("block").alias("slice"), F.explode("pairs").alias("pair"))
    known = slice_pairs.join(pair_counts(rows), "pair").select("slice", "pair", "n_docs", "best")
    docs = rows.where(F.col("pairs").isNull()).drop("pairs")

    def add_up(own: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("pair")
        n_docs, best = counts["n_docs"].to_numpy(), counts["best"].to_numpy()
        places, times = (own[c].combine_chunks().flatten().to_numpy() for c in ("places", "times"))
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(own["places"]).to_numpy())))
        sums = [per_row(bounds, times * values[places]) if len(places) else np.zeros(own.num_rows, dtype=np.int64) for values in (best.astype(np.int64), n_docs)]
        columns = [own["id"], own["n_a"], own["n_b"], own["n_groups"], own["n_links"], pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)), own["groups_sha256"]]
        return pa.table(columns, names=[id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    schema = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return docs.groupBy("block").cogroup(known.groupBy("slice")).applyInArrow(add_up, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(table(spark, sf_dir, "documents"))
