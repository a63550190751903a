"""Quality rules as a learned decision list: sequential covering on labelled statistics, emitted as ordered Spark conditions.

A rule is a conjunction of thresholds that marks documents to reject. It is grown on two thirds of the labelled rows by the gain of
information about the rows it covers, pruned on the other third by (rejects - keeps) / covered, and accepted while its precision
there holds; the rejects that it covers are then put aside. The list becomes one ``when`` chain over the statistics.

The labelled sample is bounded (``max_rows``); statistics are counted for every text. Defined results: a null or empty text has all
counts 0, so it fails the base rule (fewer than 10 words); without labels the list is empty and rejects nothing; repeated rows get
equal verdicts; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import table
from .quality import MAX_ROWS, labelled_sample
from .stats import FEATURES, NAMES, RATIOS, document_stats, features

Condition = tuple[str, str, float]  # feature, "<=" or ">", threshold
CUTS = 48
PRECISION = 0.9


def _covers(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for name, sign, at in rule:
        column = x[:, FEATURES.index(name)]
        out &= column <= at if sign == "<=" else column > at
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int) -> list[Condition]:
    rule: list[Condition] = []
    covered = np.ones(len(x), dtype=bool)
    while len(rule) < most and (~bad[covered]).any():
        p0, n0 = bad[covered].sum(), (~bad[covered]).sum()
        if not p0:
            break
        best, gain = None, 1e-9
        for f, name in enumerate(FEATURES):
            column = x[covered, f]
            cuts = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 2)[1:-1]))
            below = column[:, None] <= cuts[None, :]
            for sign, inside in (("<=", below), (">", ~below)):
                p, n = inside[bad[covered]].sum(axis=0), inside[~bad[covered]].sum(axis=0)
                g = p * (np.log2((p + 1e-9) / (p + n + 1e-9) + 1e-12) - np.log2(p0 / (p0 + n0)))
                k = int(np.argmax(g))
                if g[k] > gain:
                    best, gain = (name, sign, float(cuts[k])), float(g[k])
        if best is None:
            break
        rule.append(best)
        covered &= _covers(x, [best])
    return rule


def _worth(x: np.ndarray, bad: np.ndarray, rule: list[Condition]) -> float:
    c = _covers(x, rule)
    return float((bad[c].sum() - (~bad[c]).sum()) / max(1, c.sum()))


def learn_list(x: np.ndarray, bad: np.ndarray, precision: float = PRECISION, most_rules: int = 12, most_conditions: int = 4) -> list[list[Condition]]:
    """Ordered rules; a row that one of them covers is rejected."""
    third = np.arange(len(x)) % 3 == 2
    grow_x, grow_bad, prune_x, prune_bad = x[~third], bad[~third].astype(bool), x[third], bad[third].astype(bool)
    rules: list[list[Condition]] = []
    while len(rules) < most_rules and grow_bad.any() and len(prune_x):
        rule = _grow(grow_x, grow_bad, most_conditions)
        if not rule:
            break
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: _worth(prune_x, prune_bad, r))
        c = _covers(prune_x, rule)
        if not c.any() or prune_bad[c].mean() < precision:
            break
        rules.append(rule)
        left, rest = ~_covers(grow_x, rule), ~c
        grow_x, grow_bad, prune_x, prune_bad = grow_x[left], grow_bad[left], prune_x[rest], prune_bad[rest]
    return rules


def _value(name: str) -> Column:
    if name in RATIOS:
        above, below = RATIOS[name]
        return F.col(above).cast("double") / F.greatest(F.col(below), F.lit(1)).cast("double")
    return F.col(name).cast("double")


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: false for the first rule that covers, else true."""
    out = None
    for rule in rules:
        met = F.lit(True)
        for name, sign, at in rule:
            met = met & (_value(name) <= at if sign == "<=" else _value(name) > at)
        out = F.when(met, False) if out is None else out.when(met, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS, **options) -> list[list[Condition]]:
    rows = labelled_sample(docs, labels, label, max_rows).toPandas().sort_values("id_")
    rows = rows.sample(frac=1.0, random_state=5)
    return learn_list(features({n: rows[n].to_numpy() for n in NAMES}), rows["y"].to_numpy() == 0, **options)


def judge(df: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed and kept."""
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return document_stats(df, id_col, text_col).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = judge(docs, learn(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
