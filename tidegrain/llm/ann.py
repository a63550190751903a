"""Nearest neighbours by largest inner product: a hash-prefix forest over shards of the vectors.

Vectors are scaled by the greatest norm and given one more coordinate that makes all norms 1, so the nearest by inner product is the
nearest by angle. A tree orders the vectors of a shard by a long string of random hyperplane signs, kept as a sorted array. A query
descends to its longest common prefix in each tree, then all trees ascend together, one sign at a time, until the runs that share the
prefix hold ``budget`` entries (the last step tree by tree); these candidates are scored in single precision, and all that come within its error of the best
``k`` are scored again exactly, in double precision.

The queries are a stated set and meet the rows in blocks: a task holds one block of queries and one shard, whose sizes are fixed, so
its memory and the candidates it scores do not grow with the table. A shard leaves each query's best few. Equal vectors are one entry
with its least ids, so a vector with a third of all rows costs one entry; no bucket is capped.

Defined results: rows whose id or vector is null, and vectors that are empty, zero, or hold a null or non-finite component, take no part;
neither do vectors whose length is not the most common one. Ties go to the smaller id; a repeated row counts once. Queries
without candidates, and an empty table, give no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import cut, table

TREES, SIGNS = 128, 24
DIRECTORY = 12  # signs of a prefix whose runs are looked up in a table
BUDGET = 2048  # entries (with repeats) that the runs of all trees hold in a shard
SHARD, BLOCK = 4096, 4096
CHUNK = 512  # vectors hashed at once


class Forest:
    """Sorted arrays of hash strings over the unit vectors of one shard."""

    def __init__(self, unit: np.ndarray, planes: np.ndarray):
        self.planes = planes
        strings = self.strings(unit)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        self.size = len(unit)
        edges = np.arange((1 << DIRECTORY) + 1, dtype=np.int32) << (SIGNS - DIRECTORY)
        self.directory = np.stack([np.searchsorted(own, edges) for own in self.sorted])  # where each short prefix begins
        self.flat = self.order.ravel()
        self.first = np.arange(TREES) * self.size  # where a tree begins in ``flat``
        self.met = np.zeros(self.size, dtype=bool)

    def strings(self, unit: np.ndarray) -> np.ndarray:
        """The hash string of each vector in each tree, first sign highest: trees x vectors."""
        weights = (1 << np.arange(SIGNS - 1, -1, -1)).astype(np.float32)
        out = np.empty((TREES, len(unit)), dtype=np.int32)
        for at in range(0, len(unit), CHUNK):
            signs = (unit[at : at + CHUNK] @ self.planes > 0).reshape(-1, TREES, SIGNS)
            out[:, at : at + CHUNK] = (signs.astype(np.float32) @ weights).astype(np.int32).T  # below 2**24: exact
        return out

    def runs(self, unit: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query and tree, the run of sorted positions that shares a prefix with the query.

        All runs have the deepest common level at which they hold less than ``budget`` entries together; then tree after tree ascends
        one sign more until they hold ``budget``.
        """
        strings = self.strings(unit)
        low, high = np.zeros((len(unit), TREES), dtype=np.int64), np.full((len(unit), TREES), self.size, dtype=np.int64)
        # Runs only grow upwards, so the queries whose runs are full at DIRECTORY signs are the ones to look for below.
        deep = (np.subtract(*self._at(strings, DIRECTORY)[::-1]).sum(axis=1)) >= budget
        for open_, top in ((np.flatnonzero(deep), SIGNS), (np.flatnonzero(~deep), DIRECTORY)):
            below = None
            for level in range(top, -1, -1):
                if not len(open_):
                    break
                s, e = self._at(strings[:, open_], level)
                if below is None:
                    below = (s, s)  # nothing yet
                enough = (e - s).sum(axis=1) >= budget if level else np.ones(len(open_), dtype=bool)
                if enough.any():
                    s0, e0 = below[0][enough], below[1][enough]
                    s1, e1 = s[enough], e[enough]
                    grown = (e0 - s0).sum(axis=1)[:, None] + np.cumsum((e1 - s1) - (e0 - s0), axis=1)
                    up = np.concatenate((np.ones((len(grown), 1), dtype=bool), grown[:, :-1] < budget), axis=1)
                    low[open_[enough]], high[open_[enough]] = np.where(up, s1, s0), np.where(up, e1, e0)
                open_, below = open_[~enough], (s[~enough], e[~enough])
        return low, high

    def _at(self, strings: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the run of ``level`` common signs, queries x trees."""
        if level <= DIRECTORY:
            prefix, spread = strings.T >> (SIGNS - level), DIRECTORY - level
            trees = np.arange(TREES)
            return self.directory[trees, prefix << spread], self.directory[trees, (prefix + 1) << spread]
        rest = (1 << (SIGNS - level)) - 1
        s = np.column_stack([np.searchsorted(own, asked & ~rest, side="left") for own, asked in zip(self.sorted, strings, strict=True)])
        return s, np.column_stack([np.searchsorted(own, asked | rest, side="right") for own, asked in zip(self.sorted, strings, strict=True)])

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The distinct entries of the runs of all trees."""
        wide = high - low
        ends = np.cumsum(wide)
        at = np.repeat(low + self.first - (ends - wide), wide) + np.arange(ends[-1])
        self.met[self.flat[at]] = True
        near = np.flatnonzero(self.met)
        self.met[near] = False
        return near


def hyperplanes(size: int) -> np.ndarray:
    return np.random.default_rng(97).standard_normal((size, TREES * SIGNS)).astype(np.float32)


def scores_of(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products added up alike for every pair, so equal vectors score alike."""
    return (rows * query).sum(axis=1)


def usable(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(doubles, lambda x: x != 0)


def search(df: DataFrame, is_query: Column, k: int = 20, budget: int = BUDGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the ``k`` nearest found for each row of ``is_query``, its own row left out."""
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("vec"), is_query.alias("asks")).where(usable(df[vector_col]) & F.col("id").isNotNull()).dropDuplicates(["id", "vec"])
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = size["n"] if size else 1
    rows = rows.where(F.size("vec") == size)
    first = Window.partitionBy("vec").orderBy("id")
    entries = cut(rows.select("id", "vec").withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("entry", F.col("ids")[0]))
    asked = cut(rows.where("asks").groupBy("vec").agg(F.min("id").alias("asker")))
    n, norm = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards, blocks = max(1, math.ceil(n / SHARD)), max(1, math.ceil(asked.count() / BLOCK))
    kind = df.schema[id_col].dataType.simpleString()
    place = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = entries.withColumn("shard", place("entry", shards)).withColumn("block", every(blocks))
    asks = asked.withColumn("block", place("asker", blocks)).withColumn("shard", every(shards))

    def meet(found: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(wanted):
            return pd.DataFrame({"asker": [], "id": [], "score": []})
        vectors, queries = np.stack(found["vec"].to_numpy()), np.stack(wanted["vec"].to_numpy())
        scaled = vectors / norm
        lift = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
        forest = Forest(np.column_stack([scaled, lift]).astype(np.float32), hyperplanes(size + 1))
        unit = queries / np.sqrt((queries * queries).sum(axis=1))[:, None]
        low, high = forest.runs(np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32), budget)
        rough, asked_rough = scaled.astype(np.float32), unit.astype(np.float32)
        error = 4e-7 * size  # of a single-precision product of vectors of length 1 at most
        ids, entry = found["ids"].to_numpy(), found["entry"].to_numpy()
        out = []
        for q, asker in enumerate(wanted["asker"].to_numpy()):
            near = forest.candidates(low[q], high[q])
            if len(near) > k + 1:
                about = rough[near] @ asked_rough[q]
                near = near[about >= np.partition(about, len(about) - k - 1)[len(about) - k - 1] - error]
            s = scores_of(queries[q], vectors[near])
            best = np.lexsort((entry[near], -s))[: k + 1]
            pairs = sorted(((-s[b], i) for b in best for i in ids[near[b]]))[: k + 1]
            out += [(asker, i, -x) for x, i in pairs]
        return pd.DataFrame(out, columns=["asker", "id", "score"])

    met = data.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(meet, f"asker {kind}, id {kind}, score double")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    top = met.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("r", "id", "score"))).alias("top"))
    answers = asked.join(top, "asker").select("vec", "top")
    queries = rows.where("asks").select(F.col("id").alias("query_id"), "vec").join(answers, "vec")
    own = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, k)
    return queries.select("query_id", F.posexplode(own).alias("p", "t")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("t.id").alias(id_col), F.col("t.score").alias("score"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
