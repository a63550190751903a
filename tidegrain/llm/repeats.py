"""Removal of repeated byte strings with suffix arrays of shards, built by induced sorting (induced.py).

A string of ``length`` bytes that also starts earlier (smaller id, or same document and earlier start) is a repeat; the bytes that
repeats cover go. Finding them:

1. In every string of ``length`` bytes the 32-byte gram of least hash is its anchor, so equal strings have equal anchors at the same
   place. A text becomes a few pieces: maximal runs of strings with one anchor. Pieces that are equal as a whole collapse to the
   earliest, first within a task and then per anchor bucket; the others are repeats already.
2. How many different pieces an anchor has is counted before: tasks count the anchors that have several, and the counts are added up. An
   anchor with more than HOT_PIECES (a line that stands in a great many texts) is hot, whatever the size of the table: all its pieces
   are dealt by their own hash instead of meeting in one bucket.
3. A hot anchor's pieces become single strings. The earliest of equal ones is a minimum by string hash, combined within tasks first;
   the others are spans, found by a join that adaptive execution can split. No two of the earliest are equal, and equal strings have
   equal anchors, so the suffix sort has nothing to add for them.
4. Any other anchor with two or more different pieces goes to the shard of its hash with the bytes of those pieces, HOT_PIECES at most.
   A shard's pieces, joined by separators, are suffix-sorted with shared prefixes; strings whose shared prefix reaches ``length`` are
   equal, and all but the earliest are repeats.
5. The spans of a document meet at its text, which is cut.

Results are exact but for collisions of 64-bit hashes of pieces and 128-bit hashes of strings. Defined results: a null or empty text has no bytes; texts shorter than
``length`` stay whole, and so do rows of a null id; rows that repeat an id are taken to hold the same text and get the same result; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut, slices, table
from .induced import later_copies
from .stats import Buffer

GRAM = 32
SLICE = 1 << 20
HELD_SEEDS = 1 << 19
BUCKET_BYTES = 6 << 20
SHARD_BYTES = 2 << 20
HOT_PIECES = 50_000  # an anchor with more different pieces is settled string by string
HOT_ANCHORS = 1 << 20  # the hottest that tasks are told of (8 MB); a bucket tells of any other by itself
SEED = np.dtype([("anchor", np.uint64), ("piece", np.uint64), ("doc", np.int64), ("start", np.int32), ("n", np.int32)])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` hashes, the position of its least one, the leftmost of equals; by doubling."""
    at, low, span = np.arange(len(hashes), dtype=np.int32), hashes, 1
    while span < width:
        step = min(span, width - span)
        n = len(low) - step
        right = low[step:] < low[:n]
        at, low = np.where(right, at[step:], at[:n]), np.where(right, low[step:], low[:n])
        span += step
    return at


def pieces(column: pa.Array, ids: np.ndarray, length: int) -> np.ndarray:
    """SEED rows of a string column: for each run of string starts with one anchor, its first start and their number."""
    b = Buffer(column)
    raw = b.raw
    if len(raw) < length:
        return np.zeros(0, dtype=SEED)
    gram = np.arange(len(raw) - GRAM + 1)
    hashes = b.hashes(gram, gram + GRAM)
    at = anchors(hashes, length - GRAM + 1)
    starts = np.arange(len(at))
    owner = b.owner(starts)
    inside = starts + length <= b.bounds[owner + 1]
    starts, at, owner = starts[inside], at[inside], owner[inside]
    if not len(starts):
        return np.zeros(0, dtype=SEED)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    n = np.diff(np.append(first, len(starts)))
    begin, anchor, doc = starts[first], at[first].astype(np.int64), owner[first]
    out = np.empty(len(first), dtype=SEED)
    out["anchor"] = hashes[anchor]
    out["piece"] = b.hashes(begin, begin + n - 1 + length) ^ ((anchor - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    out["doc"], out["start"], out["n"] = ids[doc], begin - b.bounds[doc], n
    return out


def collapse(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal pieces (sorted by anchor and piece), and the pieces that repeat one."""
    order = np.lexsort((seeds["start"], seeds["doc"], seeds["piece"], seeds["anchor"]))
    s = seeds[order]
    if not len(s):
        return s, s
    new = np.concatenate(([True], (s["anchor"][1:] != s["anchor"][:-1]) | (s["piece"][1:] != s["piece"][:-1])))
    head = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    same_place = (s["doc"] == s["doc"][head]) & (s["start"] == s["start"][head])
    return s[new], s[~new & ~same_place]


def spans_of(seeds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, start and end of the bytes that repeated pieces cover, touching ones joined."""
    order = np.lexsort((seeds["start"], seeds["doc"]))
    doc, start = seeds["doc"][order], seeds["start"][order].astype(np.int64)
    end = start + seeds["n"][order] - 1 + length
    if not len(doc):
        return doc, start, end
    # Ends rise with starts: pieces of one document follow each other.
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])))
    at = np.flatnonzero(new)
    return doc[at], start[at], end[np.append(at[1:], len(doc)) - 1]


def deal(kept: np.ndarray, buckets: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collapsed seeds with their buckets: that of their anchor; pieces of a hot anchor go by their own hash, with ``n`` negated."""
    is_hot = np.isin(kept["anchor"], hot)
    seeds = kept.copy()
    seeds["n"][is_hot] *= -1
    return seeds, (np.where(is_hot, kept["piece"], kept["anchor"]) % np.uint64(buckets)).astype(np.int64)


def with_ids(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.where(df[id_col].isNotNull()).select(df[id_col].cast("long"), df[text_col].cast("string"))


def held_seeds(batches, length: int):
    """The seeds of the texts of a task, a bounded number at a time, the earliest of equal pieces and those that repeat one."""
    held: list[np.ndarray] = []
    for part in slices(batches, limit=SLICE):
        held.append(pieces(part.column(1), part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), length))
        if sum(map(len, held)) >= HELD_SEEDS:
            full = collapse(np.concatenate(held))
            held.clear()
            yield full
    if held:
        yield collapse(np.concatenate(held))


def hot_anchors(df: DataFrame, length: int, id_col: str, text_col: str) -> np.ndarray:
    """Sorted anchors with more than HOT_PIECES pieces, as counted where several stand in what a task holds at once.

    An anchor that stands there once at most each time is not counted; it brings one piece for each such part of the table.
    """

    def run(batches):
        for kept, _ in held_seeds(batches, length):
            anchor, n = np.unique(kept["anchor"], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["anchor", "n"])

    counts = with_ids(df, id_col, text_col).mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    hottest = counts.where(F.col("n") > HOT_PIECES).orderBy(F.desc("n"), "anchor").limit(HOT_ANCHORS).collect()
    return np.sort(np.array([r["anchor"] for r in hottest], dtype=np.int64).view(np.uint64))


def piece_spans(df: DataFrame, length: int, buckets: int, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Rows for the next step by bucket: packed seeds (blob), or a span of pieces that repeat within the task (doc, start, end)."""

    def run(batches):
        for kept, again in held_seeds(batches, length):
            kept, place = deal(kept, buckets, hot)
            order = np.argsort(place, kind="stable")
            met, first = np.unique(place[order], return_index=True)  # the buckets of this task only: their number may be far greater
            blobs = list(zip(met.tolist(), np.split(kept[order], first[1:]), strict=True)) if len(kept) else []
            # Fields one after another, rows by document: runs of near values, which shuffle compression likes.
            packed = [(k, b"".join(np.ascontiguousarray(x[f]).tobytes() for f in SEED.names)) for k, x in ((k, x[np.lexsort((x["start"], x["doc"]))]) for k, x in blobs)]
            doc, start, end = spans_of(again, length)
            a, b = len(packed), len(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in packed] + (doc % buckets).tolist(), pa.int32()),
                    pa.array([x for _, x in packed] + [None] * b, pa.binary()),
                    pa.array([None] * a + doc.tolist(), pa.int64()),
                    pa.array([None] * a + start.tolist(), pa.int64()),
                    pa.array([None] * a + end.tolist(), pa.int64()),
                ],
                names=["bucket", "blob", "doc", "start", "end"],
            )

    return with_ids(df, id_col, text_col).mapInArrow(run, "bucket int, blob binary, doc long, start long, end long")


def unpack(blobs) -> np.ndarray:
    parts = []
    for raw in blobs:
        n = len(raw) // SEED.itemsize
        x, at = np.empty(n, dtype=SEED), 0
        for name in SEED.names:
            size = SEED[name].itemsize * n
            x[name] = np.frombuffer(raw[at : at + size], dtype=SEED[name])
            at += size
        parts.append(x)
    return np.concatenate(parts) if parts else np.zeros(0, dtype=SEED)


def bucket_spans(length: int):
    """Per bucket: spans of repeated pieces (whole), and the pieces of anchors that have several or are hot."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        packed = group["blob"].notna()
        seeds = unpack(group["blob"][packed])
        marked = np.unique(seeds["anchor"][seeds["n"] < 0])
        seeds["n"] = np.abs(seeds["n"])
        kept, again = collapse(seeds)
        doc, start, end = (np.concatenate((x, group[c][~packed].to_numpy(dtype=np.int64))) for x, c in zip(spans_of(again, length), ("doc", "start", "end"), strict=True))
        fresh = np.concatenate(([True], kept["anchor"][1:] != kept["anchor"][:-1])) if len(kept) else np.zeros(0, dtype=bool)
        group_of = np.cumsum(fresh) - 1
        held = np.bincount(group_of)[group_of] if len(kept) else group_of
        hot = np.isin(kept["anchor"], marked) | (held > HOT_PIECES)
        wanted = hot | (held > 1)
        k, hot = kept[wanted], hot[wanted]
        return pd.DataFrame(
            {
                "doc": np.concatenate((doc, k["doc"])),
                "start": np.concatenate((start, k["start"].astype(np.int64))),
                "end": np.concatenate((end, k["start"].astype(np.int64) + k["n"] - 1 + length)),
                "anchor": pd.array(np.concatenate((np.zeros(len(doc), dtype=np.int64), k["anchor"].view(np.int64))), dtype="Int64").copy(),
                "whole": np.concatenate((np.ones(len(doc), dtype=bool), np.zeros(len(k), dtype=bool))),
                "hot": np.concatenate((np.zeros(len(doc), dtype=bool), hot)),
            }
        )

    return work


def shard_spans(length: int):
    """Per shard: spans of the strings that start earlier in another piece, by the suffix array of the pieces."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["doc", "start", "anchor"]).sort_values(["doc", "start"])
        raw = group["bytes"].tolist()
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        text = np.zeros(int(sizes.sum()) + len(raw), dtype=np.uint16)
        begin = np.cumsum(sizes + 1) - sizes - 1
        inner = np.ones(len(text), dtype=bool)
        inner[begin + sizes] = False
        text[inner] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint16) + 1
        valid = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(valid, begin, 1)
        np.add.at(valid, begin + sizes - length + 1, -1)
        again = np.flatnonzero(later_copies(text, length, np.cumsum(valid)[:-1] > 0))
        piece = np.searchsorted(begin, again, side="right") - 1
        start = group["start"].to_numpy()[piece] + again - begin[piece]
        found = np.empty(len(again), dtype=SEED)
        found["doc"], found["start"], found["n"] = group["doc"].to_numpy()[piece], start, 1
        doc, start, end = spans_of(found, length)
        return pd.DataFrame({"doc": doc, "start": start, "end": end})

    return work


def cut_bytes(raw: bytes, starts, ends) -> tuple[bytes, int]:
    """The bytes outside the spans, and the number of maximal removed runs."""
    cover = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(cover, np.asarray(starts, dtype=np.int64), 1)
    np.add.at(cover, np.asarray(ends, dtype=np.int64), -1)
    gone = np.cumsum(cover)[:-1] > 0
    return np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes(), int((gone & ~np.concatenate(([False], gone[:-1]))).sum())


def by_id(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text_: the same for both joins with the texts, so that Spark shuffles them once."""
    return df.select(df[id_col].cast("long").alias("doc"), df[text_col].cast("string").alias("text_")).where("doc IS NOT NULL")


def piece_texts(df: DataFrame, pieces_: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, raw (the bytes of the text), p (start, end, anchor) for each piece."""
    lists = pieces_.groupBy("doc").agg(F.collect_list(F.struct("start", "end", "anchor")).alias("parts"))  # of one document: bounded by its text
    texts = by_id(df, id_col, text_col).join(lists, "doc")
    return texts.select("doc", F.col("text_").cast("binary").alias("raw"), F.explode("parts").alias("p"))


def hot_strings(df: DataFrame, hot: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """doc, start, h1, h2 (two hashes of its bytes) for each string of the hot pieces."""
    one = piece_texts(df, hot, id_col, text_col).select("doc", "raw", F.explode(F.sequence(F.col("p.start"), F.col("p.end") - length)).alias("start"))
    string = F.substring(F.col("raw"), (F.col("start") + 1).cast("int"), F.lit(length))
    return one.select("doc", "start", F.xxhash64(string).alias("h1"), F.xxhash64(string, F.lit(1)).alias("h2"))


def earliest_strings(strings: DataFrame) -> DataFrame:
    """h1, h2, head (doc, start) of the strings that stand in several places; partial minima leave one row a task for each string."""
    heads = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("head"), F.max(F.struct("doc", "start")).alias("last"))
    return heads.where("head <> last").drop("last")


def hot_spans(df: DataFrame, hot: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """doc, start, end of the strings of hot pieces that start earlier too. Both sides of the join are cut, so that it can be split."""
    strings = cut(hot_strings(df, hot, length, id_col, text_col))
    later = strings.join(cut(earliest_strings(strings)), ["h1", "h2"]).where(F.struct("doc", "start") != F.col("head"))
    return later.select("doc", "start", (F.col("start") + length).alias("end"))


def repeated_spans(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, start, end: byte spans covered by repeats; spans of a document may overlap."""
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(df[text_col].cast("string"))), F.lit(0))).first()[0]
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parallel, -(-size // BUCKET_BYTES))
    mapped = piece_spans(df, length, buckets, hot_anchors(df, length, id_col, text_col), id_col, text_col)
    met = cut(mapped.groupBy("bucket").applyInPandas(bucket_spans(length), "doc long, start long, end long, anchor long, whole boolean, hot boolean"))
    wanted = met.where("not whole and not hot")
    n_hot, load = met.where("not whole").agg(F.count_if("hot"), F.coalesce(F.sum(F.when(~F.col("hot"), F.col("end") - F.col("start"))), F.lit(0))).first()
    shards = max(parallel, -(-load // SHARD_BYTES))
    parts = piece_texts(df, wanted, id_col, text_col)
    taken = parts.select("doc", F.col("p.start").alias("start"), F.col("p.anchor").alias("anchor"), F.substring(F.col("raw"), (F.col("p.start") + 1).cast("int"), (F.col("p.end") - F.col("p.start")).cast("int")).alias("bytes"))
    taken = taken.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    sorted_ = taken.groupBy("shard").applyInPandas(shard_spans(length), "doc long, start long, end long")
    found = met.where("whole").select("doc", "start", "end").unionByName(sorted_)
    return found.unionByName(hot_spans(df, met.where("hot"), length, id_col, text_col)) if n_hot else found


def remove_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay)."""
    spans = repeated_spans(df, length, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    kind = df.schema[id_col].dataType.simpleString()
    rows = by_id(df, id_col, text_col).join(spans, "doc", "left").select("doc", "text_", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
    none = F.lit(None).cast("array<long>")
    without = df.where(df[id_col].isNull()).select(F.lit(None).cast("long").alias("doc"), df[text_col].cast("string").alias("text_"), none.alias("starts"), none.alias("ends"))

    def run(batches):
        for part in slices(batches, limit=SLICE):
            out = []
            for text, starts, ends in zip(*[c.to_pylist() for c in part.columns[1:]], strict=True):
                raw = (text or "").encode()
                kept, runs = cut_bytes(raw, starts, ends) if starts else (raw, 0)
                out.append((len(raw), len(raw) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept))
            n, removed, runs, digest, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.unionByName(without).mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").withColumn(id_col, F.col(f"`{id_col}`").cast(kind))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
