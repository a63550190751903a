"""Evidence rows, their graph, retrieval for batches of questions, and the scores of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrain.functions.text import all_tokens, let, tokens

from . import retrieval as R
from .ordered import at_rank, at_share, value_ranks


def stable_evidence_id(*parts: Column) -> Column:
    return F.concat(F.lit("EV_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


def fact(df: DataFrame, layer: str, kind: str, entities: dict[str, Column], payload: list[str], text: Column) -> DataFrame:
    """One evidence row per row: id, layer, type, entities map, payload as JSON, text."""
    pairs = [x for k, v in entities.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        stable_evidence_id(F.lit(layer), F.lit(kind), *[v.cast("string") for v in entities.values()]).alias("evidence_id"),
        F.lit(layer).alias("layer"), F.lit(kind).alias("evidence_type"), F.create_map(*pairs).alias("entities"), F.to_json(F.struct(*payload)).alias("payload"), text.alias("text"),
    )


def edges_on(left: DataFrame, right: DataFrame, key: str, kind: str) -> DataFrame:
    """source_id, target_id, kind: evidence of the two sides that name the same entity."""
    a = left.select(F.col("evidence_id").alias("source_id"), F.col("entities")[key].alias("k")).where("k IS NOT NULL")
    b = right.select(F.col("evidence_id").alias("target_id"), F.col("entities")[key].alias("k")).where("k IS NOT NULL")
    return a.join(b, "k").where("source_id <> target_id").select("source_id", "target_id", F.lit(kind).alias("kind")).distinct()


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """evidence_id of everything within ``depth`` undirected steps of the seeds (column evidence_id), the seeds included."""
    both = edges.select("source_id", "target_id").unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    reached = seeds.select("evidence_id").distinct()
    for _ in range(depth):
        step = reached.join(both, F.col("evidence_id") == F.col("source_id")).select(F.col("target_id").alias("evidence_id"))
        reached = reached.unionByName(step).distinct()
    return reached


def mentions(items: DataFrame, names: DataFrame, id_col: str, most_tokens: int = 3) -> DataFrame:
    """id, entity, n: the longest name (column name, words parted by blanks) that a text holds word for word, the last in order of
    equally long ones, and how many names it holds. Names of more than ``most_tokens`` words are not looked for."""

    def runs(w: Column) -> Column:
        of = lambda n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.flatten(F.array(*[of(n) for n in range(1, most_tokens + 1)])))

    held = items.select(id_col, F.explode(let(all_tokens(F.col("text")), runs)).alias("name")).join(names.select("name").distinct(), "name").distinct()
    return held.groupBy(id_col).agg(F.max(F.struct(F.length("name").alias("l"), "name"))["name"].alias("entity"), F.count("*").alias("n"))


def index_of(items: DataFrame, *more: Column) -> DataFrame:
    """Items (evidence_id, text) as an index of their words and of further terms."""
    none = F.array().cast(R.NONE)
    return R.index(items.select("evidence_id", F.concat(F.coalesce(tokens(F.col("text")), none), F.array(*more) if more else none).alias("terms"), none.alias("keys")))


def question_terms(queries: DataFrame, weight: float, *more: Column) -> DataFrame:
    terms = R.words(F.col("query"), weight)
    return R.asked(queries.select("query_id", (F.concat(terms, F.array(*more)) if more else terms).alias("terms"), F.array().cast(R.NONE).alias("keys")))


def lexical(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k items that share most tokens with each question; ties by id."""
    return R.best_items(question_terms(queries, 1), index_of(items), k).select("query_id", "evidence_id", "shared", "rank")


def structured(queries: DataFrame, items: DataFrame, edges: DataFrame, k: int, seeds: int = 8) -> DataFrame:
    """Two points a shared token, a bonus for the type a question wants, one for neighbours of its best items; the k best.

    queries: query_id, query, wanted_type. items: evidence_id, evidence_type, text. Items without a shared token have no score of their own.
    """
    asked = question_terms(queries, 2, R.term(R.marked("type", F.col("wanted_type")), 10, opens=False))
    indexed = index_of(items, R.marked("type", F.col("evidence_type")))
    return R.with_neighbours(R.best_items(asked, indexed, max(k, seeds)), asked, indexed, edges, k, seeds)


def prioritised(queries: DataFrame, items: DataFrame, priorities: dict[str, tuple[str, ...]], k: int) -> DataFrame:
    """The k best by the priority that a question's intent gives to an item's type, then by shared tokens, then by id.

    queries: query_id, query, intent. items: evidence_id, evidence_type, text. priorities: of an intent, its types, first ones first. Items
    that share no token and have no type of the intent are left out.
    """
    step = 1e6  # above any number of shared words
    ranks = [R.term(R.marked("type", F.lit(t)), F.when(F.col("intent") == name, step * (len(types) - i)).otherwise(0.0)) for name, types in priorities.items() for i, t in enumerate(types)]
    terms = F.filter(F.array(*ranks), lambda t: t["weight"] > 0)
    asked = R.asked(queries.select("query_id", F.concat(R.words(F.col("query"), 1), terms).alias("terms"), F.array().cast(R.NONE).alias("keys")))
    out = R.best_items(asked, index_of(items, R.marked("type", F.col("evidence_type"))), k)
    priority = F.floor(F.col("score") / step).cast("int")
    return out.select("query_id", "evidence_id", priority.alias("priority"), (F.col("score") - priority * step).cast("long").alias("shared"), "rank")


def in_context(queries: DataFrame, items: DataFrame, edges: DataFrame, bonuses: dict[str, dict[str, float]], strategies: tuple[str, ...], k: int, seeds: int = 8) -> DataFrame:
    """Structured retrieval in full: query_id, evidence_id, score, rank.

    Two points a shared token; the bonus that the intent gives to a type; 20 for an entity of the context that agrees and -5 for one that
    differs; 18 for the strategy that a question names and -4 for any other; then one for neighbours of the best, 0.5 for those without a
    score. Items of a score of 0 or less are left out. A question of the intent what_if, or of an entity that no item has, finds nothing.

    queries: query_id, query, intent, context (map of keys and values). items: evidence_id, evidence_type, text, entities (map).
    """
    known = items.select(F.explode("entities").alias("key", "value")).select("key", F.lower("value").alias("value")).distinct()
    wanted = queries.where(F.col("context").isNotNull()).select("query_id", F.explode("context").alias("key", "value")).select("query_id", "key", F.lower("value").alias("value"))
    unknown = wanted.join(known, ["key", "value"], "left_anti").select("query_id").distinct()
    rows = queries.where("intent <> 'what_if'").join(unknown, "query_id", "left_anti")
    named = F.filter(F.array(*[F.lit(s) for s in strategies]), lambda s: F.array_contains(tokens(F.col("query")), F.lower(s)))
    entity = lambda k, v: R.marked("entity", k, F.lower(v))
    types = F.filter(F.array(*[R.term(R.marked("type", F.lit(t)), F.when(F.col("intent") == name, float(b)).otherwise(0.0)) for name, own in bonuses.items() for t, b in own.items()]), lambda t: t["weight"] > 0)
    # An entity that agrees has 25 here, because the key that both name takes 5 away; a strategy has 22, because each one named takes 4.
    context = F.coalesce("context", F.create_map().cast("map<string,string>"))
    agree = F.transform(F.map_entries(context), lambda e: R.term(entity(e["key"], e["value"]), 25))
    same = F.transform(named, lambda s: R.term(R.marked("strategy", s), 22))
    asked = R.asked(rows.select("query_id", F.concat(R.words(F.col("query"), 2), types, agree, same).alias("terms"), F.map_keys(context).alias("keys")))
    entities = F.coalesce("entities", F.create_map().cast("map<string,string>"))
    own = F.concat(F.coalesce(tokens(F.col("text")), F.array().cast(R.NONE)), F.array(R.marked("type", F.col("evidence_type"))), F.transform(F.map_entries(entities), lambda e: entity(e["key"], e["value"])), F.array(R.marked("strategy", F.coalesce(entities["strategy"], F.lit("")))))
    indexed = R.index(items.select("evidence_id", own.alias("terms"), F.map_keys(entities).alias("keys")))
    less = rows.select("query_id", (F.size(named) * 4.0).alias("less"))
    base = R.best_items(asked, indexed, max(k, seeds), penalty=5.0).join(less, "query_id").withColumn("score", F.col("score") - F.col("less")).where("score > 0").drop("less")
    near = R.with_neighbours(base, asked, indexed, edges.join(items.select(F.col("evidence_id").alias("target_id")), "target_id", "left_semi").join(items.select(F.col("evidence_id").alias("source_id")), "source_id", "left_semi"), k, seeds, penalty=5.0, less=less)
    return near.select("query_id", "evidence_id", "score", "rank")


def ranking_metrics(ranking: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Per question: recall and precision at k and the reciprocal rank of the first hit; questions without gold are left out."""
    n = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = ranking.join(gold.select("query_id", "evidence_id").withColumn("hit", F.lit(1)), ["query_id", "evidence_id"], "left")
    per = hits.groupBy("query_id").agg(
        *[F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias(f"hits_{k}") for k in ks], *[F.count_if(F.col("rank") <= k).alias(f"seen_{k}") for k in ks], F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first")
    )
    met = n.join(per, "query_id", "left")
    out = [c for k in ks for c in ((F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}"), F.try_divide(F.col(f"hits_{k}"), F.col(f"seen_{k}")).alias(f"precision_{k}"))]
    return met.select("query_id", *out, F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"))


def latency(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, greatest, median and 95th percentile by interpolation, and the latter as an order statistic."""
    at = F.least(F.col("total") - 1, F.floor(F.col("total") * 0.95)) + 1
    ranked = value_ranks(df, keys, value).groupBy(*keys)
    return ranked.agg(F.max("total").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), at_share(0.5, value).alias("p50"), at_share(0.95, value).alias("p95"), at_rank(at, value).alias("p95_rank"))
