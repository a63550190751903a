"""Quality classifier: histogram gradient-boosted trees over document statistics, scored by vectorised traversal of flat arrays.

Trees are fitted with numpy on a bounded sample of labelled rows (``max_rows``, the labels of smallest id hash); features are the
statistics of stats.py alone. A fitted forest is five arrays (feature, threshold, left, right, value), small and bounded, that travel
with the task; every text of the table is then counted and scored where it lies, without a shuffle.

Defined results: a null or empty text has all statistics 0 and gets the score of those; repeated labels of a document vote (a tie
counts as 1), rows of null label or id teach nothing; without labels every score is 0.5; repeated rows get equal scores; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import crc_bucket, least_by_hash, slices, table
from .stats import NAMES, SLICE, count, document_stats, features, map_counts

MAX_ROWS = 20_000
BINS = 64
THRESHOLD = 0.3


@dataclass
class Forest:
    """Nodes of all trees in flat arrays; a leaf has left = right = itself. ``roots``: first node of each tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values, all rows and trees descending one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, least: int = 10, ridge: float = 1.0) -> Forest:
    """Boost the logistic loss with trees grown level by level on histograms of binned features."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    if not len(y):
        return Forest(*[np.zeros(0, dtype=np.int64)] * 4, np.zeros(0), np.zeros(0, dtype=np.int64), 0.0, 0)
    prior = (y.sum() + 1.0) / (len(y) + 2.0)
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    margin = np.full(len(y), base)
    roots = []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        here = np.full(len(y), roots[-1])
        open_nodes = [roots[-1]]
        for level in range(depth + 1):
            grown = []
            for node in open_nodes:
                own = np.flatnonzero(here == node)
                gs, hs = g[own].sum(), h[own].sum()
                nodes[node][4] = -rate * gs / (hs + ridge)
                if level == depth or len(own) < 2 * least:
                    continue
                best = (1e-6, 0, 0)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    size = len(e) + 1
                    n = np.cumsum(np.bincount(binned[own, f], minlength=size))[:-1]
                    gl = np.cumsum(np.bincount(binned[own, f], weights=g[own], minlength=size))[:-1]
                    hl = np.cumsum(np.bincount(binned[own, f], weights=h[own], minlength=size))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(n < least) | (len(own) - n < least)] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[0] <= 1e-6:
                    continue
                _, f, k = best
                left = len(nodes)
                nodes[node][:4] = [f, edges[f][k], left, left + 1]
                nodes.extend([[0, 0.0, left, left, 0.0], [0, 0.0, left + 1, left + 1, 0.0]])
                here[own] = np.where(binned[own, f] <= k, left, left + 1)
                grown += [left, left + 1]
            open_nodes = grown
        flat = np.array(nodes)
        margin += flat[here, 4]
    flat = np.array(nodes)
    return Forest(flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64), flat[:, 3].astype(np.int64), np.where(flat[:, 2] == np.arange(len(flat)), flat[:, 4], 0.0), np.array(roots), base, depth)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and label (``y``) of at most ``max_rows`` labelled documents outside the held-out fifth."""
    votes = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (crc_bucket(id_col) != 0)).groupBy(F.col(id_col).alias("id_")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = votes.join(F.broadcast(least_by_hash(votes.select("id_"), "id_", max_rows)), "id_")
    texts = docs.select(docs[id_col].alias("id_"), docs[text_col].alias("text_")).join(F.broadcast(chosen), "id_")  # max_rows rows of an id and an int
    return document_stats(texts, "id_", "text_", ("y",)).dropDuplicates(["id_"])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, **options) -> Forest:
    rows = labelled_sample(docs, labels, label, max_rows).toPandas().sort_values("id_")
    return fit(features({n: rows[n].to_numpy() for n in NAMES}), rows["y"].to_numpy(dtype=np.float64), **options)


def score(df: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, extra: tuple[str, ...] = ()) -> DataFrame:
    """id, score double, predicted int (1 from ``threshold``), then ``extra`` columns of the input."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def work(part, counts):
        s = forest.score(features(counts))
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *[part.column(2 + i) for i in range(len(extra))]], names=[id_col, "score", "predicted", *extra])

    return map_counts(df, work, ", ".join([f"`{id_col}` {kinds[id_col]}", "score double", "predicted int", *[f"`{c}` {kinds[c]}" for c in extra]]), id_col, text_col, extra)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    forest = learn(docs, labels)
    names = docs.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    text = names.index("text")

    def run(batches):
        for part in slices(batches, column=text, limit=SLICE):
            s = forest.score(features(count(part.column(text))))
            yield part.filter(pa.array(s >= threshold))

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, kinds)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_bucket() == 0).alias("held_out"), "score", "predicted")
