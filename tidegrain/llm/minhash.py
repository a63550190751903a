"""Near duplicates by b-bit MinHash: signatures, band candidates, collision-corrected estimates, then an exact check on full sets.

1. One pass over the texts gives each document its set size, a fingerprint of the set, 72 minima as 24 bands of 3, and the low 4 bits
   of 64 minima as 4 bit planes. Documents of equal sets form a class; its least id stands for it.
2. Bands give candidates without pairs: in each bucket (and in its parts that share the next one and two bands) every member is tied
   to the least and to the greatest member. Counts, minima and maxima are combined before the shuffle, and the join back splits a hot
   bucket.
3. A tie survives if the similarity estimated from the planes is at least ``LOOSE``, well below the threshold; surviving ties make
   families. Two documents at the threshold share no band with a chance of 3e-8; in a bucket they share, both must be like one of its
   two ends. An end that is unlike them got there by 3 common minima, in the parts by 6 or 9 (at a similarity of 0.2 that is one in
   15,000 or in 2 million members); no part of two bands is shared by 0.5 % of pairs at 0.8. README has the measured rate of misses.
4. Families are checked whole: all intersections of full sets come from products of incidence matrices, family by family. A family
   too large for one task is cut into blocks, and each pair of blocks is a task. Only ties of the exact graph leave a task.
5. Components of the exact ties give the result.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; shorter texts than a shingle have one
shingle, the whole sequence; rows of a null id take no part (component null, kept); repeated rows of an id are one document and each
get its result; an empty table gives an empty table; other columns are not read (``keep_one`` keeps them as they are).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import cut, slices, table
from .components import components
from .stats import ODD, SEPARATOR, SLICE, Buffer, mixed

BANDS, ROWS, PLANES, PLANE_BITS = 24, 3, 4, 64
LOOSE = 0.4
BLOCK_DOCS, BLOCK_VALUES = 512, 1 << 21
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _hash_numbers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(71)
    a = r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, r.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words, A-Z lowered."""
    b = Buffer(column)
    b.raw = LOWER[b.raw]
    starts, ends = b.runs(~SEPARATOR[b.raw])
    words = b.hashes(starts, ends)
    counts = np.bincount(b.owner(starts), minlength=b.rows)
    n = max(0, len(words) - width + 1)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        key = key * np.uint64(ODD) + words[k : k + n]
    key = mixed(key)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(key[at : at + c - width + 1]))
        elif c:
            whole = np.array([c], dtype=np.uint64)  # an array: it wraps around without a warning
            for w in words[at : at + c]:
                whole = whole * np.uint64(ODD) + w
            out.append(mixed(whole))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += c
    return out


def minima(values: np.ndarray) -> np.ndarray:
    a, c = _hash_numbers()
    low = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(values), 1024):
        part = values[i : i + 1024]
        low = np.minimum(low, (part[:, None] * a[None, :] + c[None, :]).min(axis=0))
    return low


def signature(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint (2 longs), bands and bit planes of a set."""
    print_ = np.array([np.bitwise_xor.reduce(mixed(values + np.uint64(1))), (mixed(values ^ np.uint64(ODD))).sum(dtype=np.uint64)], dtype=np.uint64)
    low = mixed(minima(values))
    rows = low.reshape(BANDS, ROWS)
    band = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        band = band * np.uint64(ODD) + rows[:, k]
    weights = np.uint64(1) << np.arange(PLANE_BITS, dtype=np.uint64)
    planes = np.array([(((low[:PLANE_BITS] >> np.uint64(p)) & np.uint64(1)) * weights).sum(dtype=np.uint64) for p in range(PLANES)], dtype=np.uint64)
    return print_, mixed(band), planes


def signatures(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, print (2 longs), bands, planes; the last three null for an empty set."""
    kind = df.schema[id_col].dataType.simpleString()
    lists = pa.list_(pa.int64())

    def run(batches):
        for part in slices(batches, limit=SLICE):
            sets = shingle_sets(part.column(1), width)
            made = [signature(s) if len(s) else None for s in sets]
            columns = [pa.array([None if m is None else m[k].view(np.int64).tolist() for m in made], lists) for k in range(3)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), *columns], names=[id_col, "n_shingles", "print", "bands", "planes"])

    return df.select(df[id_col], df[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_shingles long, print array<long>, bands array<long>, planes array<long>")


def estimate(x, y):
    """Similarity from two arrays of bit planes: the share of equal low bits, less what chance gives."""
    differ = F.lit(0).cast("long")
    for p in range(PLANES):
        differ = differ.bitwiseOR(x[p].bitwiseXOR(y[p]))
    equal = 1 - F.bit_count(differ) / PLANE_BITS
    chance = 2.0**-PLANES
    return (equal - chance) / (1 - chance)


def candidate_ties(classes: DataFrame) -> DataFrame:
    """u, v: members of a bucket, or of its parts, tied to the least and the greatest member, where the estimate allows it."""
    bands = classes.select("rep", F.posexplode("bands").alias("band", "h"), F.col("bands").alias("all"))
    at = lambda k: F.element_at("all", F.pmod(F.col("band") + k, F.lit(BANDS)).cast("int") + 1)
    rows = bands.select("rep", "band", "h", at(1).alias("h1"), at(2).alias("h2"))
    ends = lambda keys: rows.groupBy(*keys).agg(F.min("rep").alias("least"), F.max("rep").alias("greatest")).where("least <> greatest")
    rows = cut(rows.join(ends(["band", "h"]), ["band", "h"]))
    both = F.explode(F.array("least", "greatest")).alias("v")
    ties = rows.select(F.col("rep").alias("u"), both)
    rows = rows.drop("least", "greatest")
    for keys in (["band", "h", "h1"], ["band", "h", "h1", "h2"]):
        ties = ties.unionByName(rows.join(ends(keys), keys).select(F.col("rep").alias("u"), both))
    ties = ties.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    planes = classes.select("rep", "planes")
    x, y = planes.withColumnsRenamed({"rep": "u", "planes": "pu"}), planes.withColumnsRenamed({"rep": "v", "planes": "pv"})
    met = ties.join(x, "u").join(y, "v")
    return met.where(estimate([F.col("pu")[p] for p in range(PLANES)], [F.col("pv")[p] for p in range(PLANES)]) >= LOOSE).select("u", "v")


def exact_ties(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Ties (node, least node of its part) of the graph of sets with 100 * intersection >= percent * union."""
    k = len(ids)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(k), sizes)
    shared = held[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    if len(column):
        column = np.cumsum(np.concatenate(([0], (column[1:] != column[:-1]).astype(np.int64))))
    both = np.zeros((k, k), dtype=np.float32)
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        s, e = np.searchsorted(column, [c, c + 2048])
        part = np.zeros((k, 2048), dtype=np.float32)
        part[row[s:e], column[s:e] - c] = 1
        both += part @ part.T
    shared_n = both.astype(np.int64)
    linked = 100 * shared_n >= percent * (sizes[:, None] + sizes[None, :] - shared_n)
    part_of = np.full(k, -1)
    out = []
    for i in np.argsort(ids, kind="stable"):
        if part_of[i] >= 0:
            continue
        front = np.zeros(k, dtype=bool)
        front[i] = True
        reached = front.copy()
        while front.any():
            front = linked[front].any(axis=0) & ~reached
            reached |= front
        part_of[reached] = i
        out += [(ids[j], ids[i]) for j in np.flatnonzero(reached) if j != i]
    return out


def exact_links(df: DataFrame, families: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """u, v: ties of the exact graph within families (columns node, component, n_shingles)."""
    load = families.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("values"))
    blocks = load.select("component", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("values") / BLOCK_VALUES)).cast("int").alias("n_blocks"))
    placed = families.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")).select("node", "component", "block", "n_blocks")
    texts = df.select(df[id_col].alias("node"), df[text_col].cast("string").alias("text_"))
    joined = placed.join(texts, "node")
    kind = df.schema[id_col].dataType.simpleString()

    def sets(batches):
        for part in slices(batches, column=4, limit=SLICE):
            found = [s.tobytes() for s in shingle_sets(part.column(4), width)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], names=["node", "component", "block", "n_blocks", "shingles"])

    full = joined.select("node", "component", "block", "n_blocks", "text_").mapInArrow(sets, f"node {kind}, component {kind}, block int, n_blocks int, shingles binary")
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    full = full.withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))

    def check(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node")
        ties = exact_ties(group["node"].to_numpy(), [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]], percent)
        return pd.DataFrame(ties, columns=["u", "v"])

    return full.groupBy("component", "low", "high").applyInPandas(check, f"u {kind}, v {kind}")


def near_duplicates(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (least id reachable over links), kept (the id is that least one)."""
    every = cut(signatures(df, width, id_col, text_col))
    counted = every.where(F.col("print").isNotNull() & F.col(id_col).isNotNull())
    classes = cut(counted.groupBy("print").agg(F.min(F.struct(F.col(id_col).alias("rep"), "n_shingles", "bands", "planes")).alias("s")).select("print", "s.*"))
    families = components(candidate_ties(classes)).join(classes.select(F.col("rep").alias("node"), "n_shingles"), "node")
    linked = components(exact_links(df, families, width, percent, id_col, text_col))
    named = classes.select("print", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = every.join(named, "print", "left").withColumn("component_id", F.when(F.col(id_col).isNotNull(), F.coalesce("component", F.col(id_col))))
    return out.select(id_col, "n_shingles", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all columns kept."""
    lost = near_duplicates(docs, width, percent).where("not kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


OP6_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 80 * (a.n + b.n - k)),
d AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, d.y FROM r JOIN d ON r.y = d.x)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, t.doc_id = c.m AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = t.doc_id
"""
