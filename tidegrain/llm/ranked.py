"""Ranked lexical search: documents grouped by the mask of an item's terms that they hold.

1. One pass over the texts counts the terms that any item of a block of items has: per document its length in terms, term slots and
   occurrences. What the statistics need (documents, all terms, documents by term) is counted over all rows.
2. A task takes the rows in blocks of documents. A term's bitmap has a bit for each document of the block. Starting from one group of
   all documents, an item's terms, greatest bound first, split every group in two by bitmap intersection and difference; a group is
   dropped once the terms left cannot lift it to the score that is to be met. What is left are the distinct masks that can matter.
3. Masks are scored by descending bound (the sum of their terms' greatest contributions within the block) until the next bound is below
   the k-th score. Where no score is known yet, a part of the greatest bound is tried first and lowered until k documents meet it.
   The k best of an item stay with the task and are what later blocks have to meet.
4. The k best of all tasks are merged, first by salt and then by item.

Items are a stated set of queries and pass over all documents in blocks of bounded size. Nothing is cut: a group is left out only where its bound is below the
k-th score found.

Defined results: a null text has no terms; documents without terms do not count; rows of a null id count in the statistics and are not
returned; repeated documents are documents each; repeated items count once; an item without terms, and an empty table, give no rows;
ties go to the smaller id; other columns are neither read nor returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import cut, slices, table

BLOCK_ITEMS, BLOCK_TERMS = 1024, 100_000  # of a block of items, about
BLOCK_DOCS = 8192
SALTS = 64
TRY = 0.6  # share of the greatest bound that is tried first where no score is known

#: Bytes of terms as they are (A-Z lowered), all others as a space.
TERM_BYTES = np.full(256, 0x20, dtype=np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    TERM_BYTES[_b] = _b + 32 if 0x41 <= _b <= 0x5A else _b


def term_lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts one after another, and the bounds of each text's."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(TERM_BYTES[raw].tobytes()))
    lists = pc.ascii_split_whitespace(plain)
    flat, at = lists.flatten(), lists.offsets.to_numpy()
    full = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    return flat.filter(full), before[at - at[0]]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, terms, times: the distinct terms of each item and how often it has them; items without terms left out."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches):
        for part in slices(batches):
            flat, bounds = term_lists(part.column(1))
            rows = []
            for ident, own in zip(part.column(0).to_pylist(), np.split(np.array(flat.to_pylist(), dtype=object), bounds[1:-1]), strict=True):
                times: dict[str, int] = {}
                for t in own:
                    times[t] = times.get(t, 0) + 1
                if times:
                    rows.append({"id": ident, "terms": list(times), "times": list(times.values())})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("id", part.schema.field(0).type), ("terms", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]))

    return items.select(items[id_col].alias("id"), items[text_col].cast("string").alias("text")).distinct().mapInArrow(run, f"id {kind}, terms array<string>, times array<long>")


def postings(docs: DataFrame, terms: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms of the document with repeats), slots (of ``terms``), tfs: one row per document that has a term."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = dict(zip(terms, range(len(terms)), strict=True))

    def run(batches):
        for part in slices(batches):
            flat, bounds = term_lists(part.column(1))
            coded = flat.dictionary_encode()
            slot = np.fromiter((place.get(t, -1) for t in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
            slots = slot[coded.indices.to_numpy(zero_copy_only=False)]
            counts = np.diff(bounds)
            owner = np.repeat(np.arange(len(counts)), counts)[slots >= 0]
            key, tfs = np.unique(owner * max(1, len(terms)) + slots[slots >= 0], return_counts=True)
            owner, slots = np.divmod(key, max(1, len(terms)))
            own = np.searchsorted(owner, np.arange(len(counts) + 1))
            full = counts > 0
            lists = [pa.ListArray.from_arrays(pa.array(own.astype(np.int32)), pa.array(x.astype(np.int32))) for x in (slots, tfs)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), *lists], names=["id", "n", "slots", "tfs"]).filter(pa.array(full))

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, n long, slots array<int>, tfs array<int>")


class Block:
    """A block of documents by term: places, what an occurrence is worth, its greatest within the block."""

    def __init__(self, ids: list, lengths: np.ndarray, slots: pa.ListArray, tfs: pa.ListArray, n_terms: int, documents: int, all_terms: int):
        self.ids = ids
        bounds = slots.offsets.to_numpy().astype(np.int64)
        flat = slots.flatten().to_numpy().astype(np.int64)
        tf = tfs.flatten().to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(lengths)), np.diff(bounds))
        m = 100 - 75 + (75 * lengths * documents) // all_terms
        worth = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(flat, kind="stable")
        self.doc, self.worth = doc[order], worth[order]
        self.at = np.searchsorted(flat[order], np.arange(n_terms + 1))
        self.most = np.zeros(n_terms, dtype=np.int64)
        held = np.flatnonzero(np.diff(self.at))
        if len(held):
            self.most[held] = np.maximum.reduceat(self.worth, self.at[held])
        self.words = -(-len(lengths) // 64)

    def bitmap(self, slot: int) -> np.ndarray:
        bits = np.zeros(self.words * 64, dtype=np.uint8)
        bits[self.doc[self.at[slot] : self.at[slot + 1]]] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def every(self) -> np.ndarray:
        bits = np.zeros(self.words * 64, dtype=np.uint8)
        bits[: len(self.ids)] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def masks(self, slots: np.ndarray, bounds: np.ndarray, maps: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Groups of equal masks whose bound is at least ``least``: bitmaps and bounds, by descending bound."""
        groups, sums = self.every()[None, :], np.zeros(1, dtype=np.int64)
        left = np.concatenate((np.cumsum(bounds[::-1])[::-1], [0]))
        for j in range(len(slots)):
            held, rest = groups & maps[j], groups & ~maps[j]
            keep = rest.any(axis=1) & (sums + left[j + 1] >= least)
            with_ = held.any(axis=1) & (sums + left[j] >= least)
            groups, sums = np.concatenate((held[with_], rest[keep])), np.concatenate((sums[with_] + bounds[j], sums[keep]))
            if not len(groups):
                break
        order = np.argsort(-sums, kind="stable")
        return groups[order], sums[order]

    def scores(self, docs: np.ndarray, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), dtype=np.int64)
        for slot, w in zip(slots.tolist(), weights.tolist(), strict=True):
            s, e = self.at[slot], self.at[slot + 1]
            own = self.doc[s:e]
            at = np.searchsorted(own, docs)
            hit = at < len(own)
            hit[hit] = own[at[hit]] == docs[hit]
            out[hit] += w * self.worth[s:e][at[hit]]
        return out


def best_of_block(block: Block, slots: np.ndarray, weights: np.ndarray, best: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    """``best`` (pairs of negative score and id, sorted, k at most) with the documents of the block taken in."""
    bounds = weights * block.most[slots]
    order = np.argsort(-bounds, kind="stable")
    order = order[bounds[order] > 0]
    slots, weights, bounds = slots[order], weights[order], bounds[order]
    total = int(bounds.sum())
    least = -best[-1][0] if len(best) == k else 1
    if total < least:
        return best
    maps = [block.bitmap(s) for s in slots.tolist()]
    tried = least if len(best) == k else max(1, int(total * TRY))
    while True:
        groups, sums = block.masks(slots, bounds, maps, tried)
        found, at, size = list(best), 0, 1
        # Masks by descending bound; one after another at first, then in growing runs.
        while at < len(groups) and not (len(found) == k and sums[at] < -found[-1][0]):
            together = np.bitwise_or.reduce(groups[at : at + size], axis=0)
            docs = np.flatnonzero(np.unpackbits(together.view(np.uint8), bitorder="little"))
            got = block.scores(docs, slots, weights)
            keep = got >= (-found[-1][0] if len(found) == k else 1)
            found = sorted(found + [(-s, block.ids[d]) for s, d in zip(got[keep].tolist(), docs[keep].tolist(), strict=True)])[:k]
            at, size = at + size, size * 2
        if tried == 1 or (len(found) == k and -found[-1][0] >= tried):
            return found
        tried = max(1, int(tried * TRY))


def weight(documents: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * held + 1)))


def ranked_block(docs: DataFrame, asked: list, k: int, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    """item_id, doc (id of a document), score: the ``k`` best of every task for each item of a bounded block."""
    terms = sorted({t for r in asked for t in r["terms"]})
    place = dict(zip(terms, range(len(terms)), strict=True))
    rows = cut(postings(docs, terms, id_col, text_col))
    documents, all_terms = rows.agg(F.count("*"), F.sum("n")).first()
    held = {r["slot"]: r["df"] for r in rows.select(F.explode("slots").alias("slot")).groupBy("slot").agg(F.count("*").alias("df")).collect()}  # one row a term of the block
    wanted = []
    for r in asked:
        slots = np.array([place[t] for t in r["terms"]], dtype=np.int64)
        weights = np.array([n * weight(documents, held.get(s, 0)) for s, n in zip(slots.tolist(), r["times"], strict=True)], dtype=np.int64)
        wanted.append((r["id"], slots, weights))
    kind = docs.schema[id_col].dataType.simpleString()
    item_type = docs.sparkSession.createDataFrame([], f"i {item_kind}").toArrow().schema.field("i").type

    def run(batches):
        best: list[list] = [[] for _ in wanted]
        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                part = pa.RecordBatch.from_arrays([c.take(pa.array(np.arange(part.num_rows))) for c in part.columns], schema=part.schema)
                block = Block(part.column(0).to_pylist(), part.column(1).to_numpy().astype(np.int64), part.column(2), part.column(3), len(terms), documents, all_terms)
                for i, (_, slots, weights) in enumerate(wanted):
                    best[i] = best_of_block(block, slots, weights, best[i], k)
        if doc_type is not None:
            flat = [(wanted[i][0], d, -s) for i, own in enumerate(best) for s, d in own]
            columns = [pa.array([x[0] for x in flat], item_type), pa.array([x[1] for x in flat], doc_type), pa.array([x[2] for x in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc", "score"])

    return rows.where(F.col("id").isNotNull()).mapInArrow(run, f"item_id {item_kind}, doc {kind}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """item_id, rank, id of the document, score: the ``k`` best documents of every item."""
    item_kind = items.schema[item_col].dataType.simpleString()
    every = cut(item_terms(items, item_col, item_text))
    n, total = every.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-n // block_items), -(-total // BLOCK_TERMS))
    block = F.pmod(F.xxhash64("id", "terms", "times"), F.lit(blocks))
    found = None
    for b in range(blocks):
        asked = every.where(block == b).sort("id", "terms").collect()  # a block of bounded size
        part = ranked_block(docs, asked, k, id_col, text_col, item_kind).withColumn("copy_", F.lit(b))
        found = part if found is None else found.unionByName(part)
    last = [F.desc("score"), F.asc("doc")]
    salted = Window.partitionBy("copy_", "item_id", F.spark_partition_id() % SALTS).orderBy(*last)
    found = found.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    out = found.withColumn("rank", F.row_number().over(Window.partitionBy("copy_", "item_id").orderBy(*last))).where(F.col("rank") <= k)
    return out.select(F.col("item_id").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("doc").alias(id_col), "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, s),
r AS (SELECT item_id, doc_id, sum(q * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nn) // ll)))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
