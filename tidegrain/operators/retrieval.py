"""The best items for each of many questions, from an inverted index in blocks.

An item's score for a question is the sum of the weights of the question's terms that it holds, less a penalty for each key that both
name. Words, entity values, strategies and item types are all terms, each with its own weight; a term may open an item to a question or
only add to the score of one that another term has opened.

The index holds a posting for each item and term, keyed by the term and the item's block, so that a frequent term is dealt over as many
tasks as there are blocks; a term meets only the blocks that hold it. A question first looks up its rarer terms. What it then has not
met can score no more than the weights of the terms left, so it is finished once its k-th score is above that; the others go on with more
terms, in the last round with all. Nothing is cut: an item is left out only where its bound is below the k-th score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrain.functions.text import tokens
from tidegrain.sources.keep import keep

from .checks import union_all
from .ranking import first_rows

BLOCK_ITEMS = 1 << 16
HOPEFUL = 4  # times k: items that are scored first
ROUNDS = (0.5, 0.75, 1.0)  # share of a question's terms that are looked up, rarest first
MARK = "\x1f"  # between the parts of terms that are no words
NONE = "array<string>"


def term(name: Column, weight: float | Column, opens: bool = True) -> Column:
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    return F.struct(name.alias("term"), weight.cast("double").alias("weight"), F.lit(opens).alias("opens"))


def words(text: Column, weight: float) -> Column:
    """The distinct words of a text as terms."""
    return F.transform(F.coalesce(tokens(text), F.array().cast(NONE)), lambda t: term(t, weight))


def marked(kind: str, *parts: Column) -> Column:
    """A term that is no word: an item type, the value of an entity, a strategy."""
    return F.concat_ws(MARK, F.lit(kind), *[p.cast("string") for p in parts])


def index(items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Items (evidence_id, terms, keys) with their block; written once for many searches."""
    n = items.count()
    none = F.array().cast(NONE)
    lists = [F.array_distinct(F.coalesce(c, none)).alias(c) for c in ("terms", "keys")]
    return keep(items.select("evidence_id", *lists, F.pmod(F.xxhash64("evidence_id"), F.lit(max(1, -(-n // block_items)))).alias("block")))


def asked(questions: DataFrame) -> DataFrame:
    """query_id, weights and opens (maps by term), q_keys: questions (query_id, terms, keys) with each term once, at its greatest weight."""
    each = questions.select("query_id", F.explode("terms").alias("t")).groupBy("query_id", F.col("t.term").alias("term")).agg(F.max("t.weight").alias("weight"), F.max("t.opens").alias("opens"))
    pairs = lambda c: F.map_from_entries(F.collect_list(F.struct("term", c))).alias(c)
    maps = each.groupBy("query_id").agg(pairs("weight"), pairs("opens"))  # of one question
    keys = questions.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("keys", F.array().cast(NONE))))).alias("q_keys"))
    return keep(maps.join(keys, "query_id"))


def score_pairs(pairs: DataFrame, indexed: DataFrame, questions: DataFrame, penalty: float = 0.0) -> DataFrame:
    """``pairs`` (query_id, evidence_id and more) with shared (terms in common), opened (of them, those that open) and score."""
    met = pairs.join(indexed.select("evidence_id", "terms", "keys"), "evidence_id").join(questions, "query_id")
    met = met.withColumn("common_", F.array_intersect("terms", F.map_keys("weight")))
    points = F.aggregate("common_", F.lit(0.0), lambda a, t: a + F.col("weight")[t]) - F.lit(float(penalty)) * F.size(F.array_intersect("keys", "q_keys"))
    opened = F.size(F.filter("common_", lambda t: F.col("opens")[t]))
    return met.select(*pairs.columns, F.size("common_").cast("long").alias("shared"), opened.cast("long").alias("opened"), points.alias("score"))


def best_items(questions: DataFrame, indexed: DataFrame, k: int, penalty: float = 0.0, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """query_id, evidence_id, shared, opened, score, rank: of the items that a term opens, the ``k`` best, ties by id.

    questions: as ``asked`` gives them. Weights are not negative.
    """
    terms = questions.select("query_id", F.explode("weight").alias("term", "weight"), "opens").withColumn("opens", F.col("opens")[F.col("term")])
    adds = terms.groupBy("query_id").agg(F.sum(F.when(F.col("opens"), 0.0).otherwise(F.col("weight"))).alias("adds"))
    opening = terms.where("opens").drop("opens")
    held = keep(indexed.select("evidence_id", "block", F.explode("terms").alias("term")).join(opening.select("term").distinct(), "term", "left_semi"))
    blocks = keep(held.groupBy("term", "block").agg(F.count("*").alias("n")))
    met = opening.join(blocks.groupBy("term").agg(F.sum("n").alias("df")), "term")
    order = Window.partitionBy("query_id").orderBy(F.col("df") / F.greatest("weight", F.lit(1e-9)), "term")
    left = keep(met.withColumn("place", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy("query_id"))))
    done = []
    for share in rounds:
        last = share >= 1.0
        now = F.col("place") <= F.ceil(F.col("m") * F.lit(share))
        rest = left.groupBy("query_id").agg(F.sum(F.when(now, 0.0).otherwise(F.col("weight"))).alias("rest")).join(adds, "query_id").select("query_id", (F.col("rest") + F.col("adds")).alias("rest"))
        first = left.where(now).join(blocks.select("term", "block"), "term")
        pairs = first.join(held, ["term", "block"]).groupBy("query_id", "evidence_id").agg(F.sum("weight").alias("low")).join(rest, "query_id")
        # The exact scores of the few that look best give a floor, below whose k-th no bound has to be scored.
        pairs = keep(pairs)
        hopeful = score_pairs(first_rows(pairs, ["query_id"], [F.desc("low"), "evidence_id"], HOPEFUL * k).select("query_id", "evidence_id"), indexed, questions, penalty)
        floor = first_rows(hopeful, ["query_id"], [F.desc("score"), "evidence_id"], k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        pairs = pairs.join(floor, "query_id").where(F.col("floor").isNull() | (F.col("low") + F.col("rest") >= F.col("floor")))
        scored = score_pairs(pairs.select("query_id", "evidence_id", "rest"), indexed, questions, penalty)
        top = first_rows(scored, ["query_id"], [F.desc("score"), "evidence_id"], k)
        group = Window.partitionBy("query_id")
        top = keep(top.withColumn("finished", F.lit(last) | ((F.count("*").over(group) == k) & (F.min("score").over(group) > F.col("rest")))))
        done.append(top.where("finished").drop("finished", "rest"))
        left = left.join(done[-1].select("query_id").distinct(), "query_id", "left_anti")
        if last or left.isEmpty():
            break
    return union_all(done).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id")))


def with_neighbours(base: DataFrame, questions: DataFrame, indexed: DataFrame, edges: DataFrame, k: int, seeds: int, penalty: float = 0.0, less: DataFrame | None = None) -> DataFrame:
    """query_id, evidence_id, score, rank: the ``k`` best once the neighbours of a question's ``seeds`` best items have gained 1; a
    neighbour without a score has 0.5: one that no term opened or, where ``less`` (query_id, less) was taken from all scores of a
    question, one of 0 or below. base: ``best_items`` of at least ``k`` and ``seeds``."""
    base = keep(base)
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    best = base.where(F.col("rank") <= seeds).select("query_id", F.col("evidence_id").alias("source_id"))
    near = keep(best.join(both, "source_id").select("query_id", F.col("target_id").alias("evidence_id")).distinct())
    known = score_pairs(near, indexed, questions, penalty).where("opened > 0")
    if less is not None:
        known = known.join(less, "query_id").withColumn("score", F.col("score") - F.col("less")).where("score > 0")
    known = known.select("query_id", "evidence_id", (F.col("score") + 1.0).alias("lifted"))
    lifted = near.join(known, ["query_id", "evidence_id"], "left").withColumn("lifted", F.coalesce("lifted", F.lit(0.5)))
    met = base.select("query_id", "evidence_id", "score").join(lifted, ["query_id", "evidence_id"], "full").select("query_id", "evidence_id", F.coalesce("lifted", "score").alias("score"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "evidence_id"))).where(F.col("rank") <= k)
