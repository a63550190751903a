"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Each source's target in words follows from the weights; a target stops at ``most`` times its source and the excess is shared again.
2. A source's texts are cut into blocks of words, the blocks permuted by a hash of their place, and the target becomes an exact
   number of blocks, the source's quota: whole passes over the permutation and a last partial pass.
3. A binary tree splits these quotas among output shards. Each node hands half of its blocks to its left child; how many of each
   source is a multivariate hypergeometric draw (sources one after another, each a hypergeometric draw by inversion from its mode),
   so every shard is a random sample of the mix and the quotas add up exactly at every level.
4. The leaves give each shard a run of every source's permutation, disjoint from all others: a block is drawn by the shard whose run
   holds its rank, and what no run holds is not drawn. Within a shard, blocks are ordered by another hash: their places.

Ranks come from counts per (source, hash bin) and a window inside each bin; there are so many bins that one holds about
``BIN_BLOCKS`` blocks, so neither a source with a third of all rows nor a large table makes a large group. A node is a row with the
counts of all sources, so the tree is one job without a shuffle between levels. Only sums per source go to the driver: two numbers.

Defined results: a null text has size 0 and nothing is taken of it; a null source is a source of its own, last in order; repeated
rows are taken alike; an empty table gives an empty result; other columns are not read. The same input and seed give the same mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import cut, table

WORDS = r"[^\x20\x09-\x0D]+"
BIN_BLOCKS = 1 << 10
BLOCK_WORDS = 256
BLOCKS_PER_SHARD = 1 << 15
DOCUMENTS_PER_SHARD = 1 << 12  # of whole documents
LEVELS = 6  # of the tree in one step; then its nodes are dealt to tasks anew
SEED = 17


@dataclass
class Mix:
    """documents: doc_id, source, size, n_rows, source_size, target. draws: doc_id, source, size, block, copy, words, shard, place."""

    documents: DataFrame
    draws: DataFrame


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_no, source_size, target. ``sizes``: source, source_size, one row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    ranked = sizes.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights)) + 1)
    ranked = ranked.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    before = Window.orderBy("full_at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    # The first source, by the level at which it is full, that the common level does not fill sets that level.
    common = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source_no", "level"))).over(every)["level"]
    return ranked.withColumn("target", F.when(common.isNull(), F.col("cap")).otherwise(F.least("cap", common * F.col("w")))).select("source", "source_no", "source_size", "target")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def log_factorial(x: Column) -> Column:
    """ln x! by Stirling's series at x + 9, carried back to x + 1."""

    def series(z: Column) -> Column:
        steps = reduce(lambda a, k: a * (z - float(k)), range(1, 9), F.lit(1.0))
        return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.ln(steps)

    return _let(x.cast("double") + 9.0, series)


def log_binomials(plus: list[tuple[Column, Column]], minus: tuple[Column, Column]) -> Column:
    """Sum of ln C(n, k) over ``plus`` less the one of ``minus``; one expression evaluated over an array, so that it stays short."""
    terms = [(sign * part, x) for sign, (n, k) in [*[(1.0, p) for p in plus], (-1.0, minus)] for part, x in ((1.0, n), (-1.0, k), (-1.0, n - k))]
    return F.aggregate(F.array(*[F.struct(F.lit(sign).alias("sign"), x.alias("x")) for sign, x in terms]), F.lit(0.0), lambda a, t: a + t["sign"] * log_factorial(t["x"]))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Inversion from the mode: probabilities are taken off ``u`` in turn above and below the mode until it is used up."""
    low = F.greatest(F.lit(0).cast("long"), draws - (total - good))
    high = F.least(draws, good)
    mode = F.greatest(low, F.least(high, F.floor((draws + 1) * ((good + 1) / (total + 2))).cast("long")))

    def walk(s: Column) -> Column:
        n, g, d, lo, hi, m, top = (s[k] for k in ("n", "g", "d", "lo", "hi", "m", "top"))
        share = g / F.greatest(n, F.lit(1))
        spread = F.sqrt(F.greatest(F.lit(0.0), d * share * (1 - share)))
        steps = F.sequence(F.lit(1).cast("long"), F.least(hi - lo, F.ceil(spread * 12).cast("long") + 30) + 1)
        start = F.struct(m.alias("up"), top.alias("p_up"), m.alias("down"), top.alias("p_down"), (s["u"] - top).alias("left"), m.alias("x"))

        def step(a: Column, _: Column) -> Column:
            up, down = a["up"].cast("double"), a["down"].cast("double")
            p_up = F.when(a["up"] < hi, a["p_up"] * (g - up) * (d - up) / ((up + 1) * (n - g - d + up + 1))).otherwise(F.lit(0.0))
            p_down = F.when(a["down"] > lo, a["p_down"] * down * (n - g - d + down) / ((g - down + 1) * (d - down + 1))).otherwise(F.lit(0.0))
            after_up = a["left"] - p_up
            after = after_up - p_down
            moved = F.struct(
                F.least(hi, a["up"] + 1).alias("up"),
                p_up.alias("p_up"),
                F.greatest(lo, a["down"] - 1).alias("down"),
                p_down.alias("p_down"),
                F.when(after_up <= 0, after_up).otherwise(after).alias("left"),
                F.when(after_up <= 0, F.least(hi, a["up"] + 1)).when(after <= 0, F.greatest(lo, a["down"] - 1)).otherwise(m).alias("x"),
            )
            return F.when(a["left"] <= 0, a).otherwise(moved)

        return F.aggregate(steps, start, step, lambda a: a["x"])

    def with_top(s: Column) -> Column:
        top = F.exp(log_binomials([(s["g"], s["m"]), (s["n"] - s["g"], s["d"] - s["m"])], (s["n"], s["d"])))
        return _let(F.struct(*[s[k].alias(k) for k in ("n", "g", "d", "lo", "hi", "m", "u")], top.alias("top")), walk)

    return _let(F.struct(total.alias("n"), good.alias("g"), draws.alias("d"), low.alias("lo"), high.alias("hi"), mode.alias("m"), u.alias("u")), with_top)


def uniform(seed: int, *parts: Column) -> Column:
    """A number between 0 and 1 from 52 bits of a hash."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def halved(node: Column, parts: Column, seed: int) -> Column:
    """The children of a node as an array of (node, parts). ``parts``: source_no, start (of its run) and n of each source, in order."""

    def draw(state: Column, part: Column) -> Column:
        taken = hypergeometric(state["total"], part["n"], state["draws"], uniform(seed, node, part["source_no"]))
        return _let(taken, lambda x: F.struct((state["total"] - part["n"]).alias("total"), (state["draws"] - x).alias("draws"), F.concat(state["left"], F.array(x)).alias("left")))

    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    start = _let(total, lambda t: F.struct(t.alias("total"), F.floor(t / 2).cast("long").alias("draws"), F.array().cast("array<bigint>").alias("left")))

    def children(left: Column) -> Column:
        first = F.zip_with(parts, left, lambda p, x: F.struct(p["source_no"].alias("source_no"), p["start"].alias("start"), x.alias("n")))
        second = F.zip_with(parts, left, lambda p, x: F.struct(p["source_no"].alias("source_no"), (p["start"] + x).alias("start"), (p["n"] - x).alias("n")))
        return F.array(F.struct((node * 2).alias("node"), first.alias("parts")), F.struct((node * 2 + 1).alias("node"), second.alias("parts")))

    return _let(F.aggregate(parts, start, draw, lambda s: s["left"]), children)


def split_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """source_no, shard (from 0), start, n: the run of each source's permutation that each of 2 ** ``depth`` shards draws.

    Nodes are numbered from the root 1, the children of k are 2k and 2k + 1. ``quotas``: source_no, quota.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source_no", F.lit(0).cast("long").alias("start"), F.col("quota").alias("n")))).alias("parts"))  # sources
    nodes = nodes.select(F.lit(1).cast("long").alias("node"), "parts")
    for level in range(depth):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition("node")
        nodes = nodes.select(F.inline(halved(F.col("node"), F.col("parts"), seed)))
    return nodes.select((F.col("node") - (1 << depth)).alias("shard"), F.inline("parts")).where("n > 0")


def mix(df: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int | None = BLOCK_WORDS, blocks_per_shard: int = BLOCKS_PER_SHARD, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    """Draw the mix. ``block_words`` None takes whole documents as blocks."""
    rows = df.select(df[id_col].alias("doc_id"), df[source_col].alias("source"), word_count(df[text_col]).alias("size"))
    count = F.lit(1).cast("long") if block_words is None else F.ceil(F.col("size") / block_words).cast("long")
    docs = cut(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")).withColumn("n_blocks", count))
    sizes = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.sum("n_blocks").alias("blocks"))
    aims = cut(targets(sizes, weights, share, most).join(sizes.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    n_blocks = aims.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    digits = max(1, -(-max(0, (n_blocks - 1) // BIN_BLOCKS).bit_length() // 4))  # hexadecimal, of the hash
    docs = docs.join(aims.drop("blocks"), docs["source"].eqNullSafe(aims["source"])).drop(aims["source"])

    blocks = docs.where("n_blocks > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    bound = lambda j: F.floor(j * F.col("size") / F.col("n_blocks")).cast("long")
    place_key = lambda s, *more: F.md5(F.concat_ws("|", F.lit(str(s)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), *[F.col(c).cast("string") for c in ("block", *more)]).cast("binary"))
    blocks = blocks.withColumn("words", bound(F.col("block") + 1) - bound(F.col("block"))).withColumn("key", place_key(seed)).withColumn("bin", F.substring("key", 1, digits))
    inside = Window.partitionBy("source_no", "bin").orderBy("key", "doc_id", "size", "block")
    load = F.col("words") * F.col("n_rows")
    blocks = cut(
        blocks.withColumn("at", F.row_number().over(inside) - 1).withColumn("run", F.sum(load).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", "source", "size", "source_no", "source_size", "target", "n_rows", "block", "words", "bin", "at", "run")
    )
    bins = blocks.groupBy("source_no", "bin").agg(F.count("*").alias("n"), F.sum(load).alias("words"))
    bins = bins.withColumn("head", F.substring("bin", 1, digits // 2))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_heads, in_head = Window.partitionBy("source_no").orderBy("head"), Window.partitionBy("source_no", "head").orderBy("bin")
    heads = bins.groupBy("source_no", "head").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).select("source_no", "head", before("n", of_heads).alias("n_head"), before("words", of_heads).alias("words_head"))
    bins = bins.select("source_no", "head", "bin", before("n", in_head).alias("n_in"), before("words", in_head).alias("words_in")).join(heads, ["source_no", "head"])
    bins = bins.select("source_no", "bin", (F.col("n_head") + F.col("n_in")).alias("n_before"), (F.col("words_head") + F.col("words_in")).alias("words_before"))
    placed = blocks.join(bins, ["source_no", "bin"]).withColumn("rank", F.col("n_before") + F.col("at"))
    placed = placed.withColumn("passes", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))).cast("long")).withColumn("last", F.col("target") - F.col("passes") * F.col("source_size"))
    near = (F.col("words_before") + F.col("run") - load / 2 <= F.col("last")) & (F.col("last") > 0)
    placed = cut(placed.select("doc_id", "source", "size", "source_no", "n_rows", "block", "words", "rank", "passes", near.alias("near")))
    quotas = cut(
        placed.groupBy("source_no").agg(F.count("*").alias("n_all"), F.max("passes").alias("passes"), F.count_if("near").alias("n_last"))
        .select("source_no", "n_all", (F.col("passes") * F.col("n_all") + F.col("n_last")).alias("quota"))
    )
    total = quotas.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    depth = max(1, (max(0, total - 1) // blocks_per_shard).bit_length())
    # A run and the ranks that it may hold meet in stretches of a run's mean length.
    width = quotas.select("source_no", "n_all", F.ceil(F.greatest("quota", F.lit(1)) / (1 << depth)).cast("long").alias("width"))
    part = lambda c: F.floor(c / F.col("width")).cast("long")
    runs = cut(split_tree(quotas, depth, seed)).join(width.drop("n_all"), "source_no").withColumn("part", F.explode(F.sequence(part(F.col("start")), part(F.col("start") + F.col("n") - 1)))).select("source_no", "part", "shard", "start", "n")
    draws = placed.join(width, "source_no").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(most)).cast("long"))))
    draws = draws.withColumn("rest", F.col("rank") + F.col("copy") * F.col("n_all")).withColumn("part", part(F.col("rest")))
    draws = draws.join(runs, ["source_no", "part"]).where("rest >= start AND rest < start + n")
    local = Window.partitionBy("shard").orderBy(place_key(seed + 1, "copy"), "doc_id", "size", "block", "copy")
    draws = draws.withColumn("place", F.row_number().over(local).cast("long")).select("doc_id", "source", "size", "n_rows", "block", "copy", "words", "shard", "place")
    return Mix(docs.select("doc_id", "source", "size", "n_rows", "source_size", "target"), draws)


def mixed_documents(df: DataFrame, blocks_per_shard: int = DOCUMENTS_PER_SHARD, **options) -> DataFrame:
    """The documents of the mix, each as often as it is drawn (0 to ``most`` times), with the columns of ``df``, shard by shard in the order of their places."""
    drawn = mix(df, block_words=None, blocks_per_shard=blocks_per_shard, **options).draws.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("w"), "shard", "place")
    keyed = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"), df["doc_id"].alias("id"), df["source"].alias("of"), word_count(df["text"]).alias("words"))
    met = keyed["id"].eqNullSafe(drawn["d"]) & keyed["of"].eqNullSafe(drawn["s"]) & (keyed["words"] == drawn["w"])
    return keyed.join(drawn, met).select("row", "shard", "place").repartition("shard").sortWithinPartitions("shard", "place").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and of the draws: shards (shard:words of each shard that takes of the document), first_shard and first_place (-1 and 0 where nothing is taken)."""
    result = mix(table(spark, sf_dir, "documents"))
    by_shard = result.draws.groupBy("doc_id", "source", "size", "shard").agg(F.sum("words").alias("words"), F.min("place").alias("place"))
    taken = by_shard.groupBy(F.col("doc_id").alias("d_"), F.col("source").alias("s_"), F.col("size").alias("w_")).agg(
        F.sum("words").alias("taken"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shard", "words"))), lambda x: F.concat_ws(":", x["shard"], x["words"])), ",").alias("shards"),
        F.min(F.struct("shard", "place")).alias("first"),
    )
    docs = result.documents
    met = docs["doc_id"].eqNullSafe(taken["d_"]) & docs["source"].eqNullSafe(taken["s_"]) & (docs["size"] == taken["w_"])
    rows = docs.join(taken, met, "left").withColumn("row_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit("")).alias("shards"), F.coalesce("first.shard", F.lit(-1)).cast("long").alias("first_shard"), F.coalesce("first.place", F.lit(0)).cast("long").alias("first_place"))


def op8_sql(blocks_per_shard: int = BLOCKS_PER_SHARD) -> str:
    """The same draws in SQL, tree included."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS source_no FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][source_no % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, cap / w AS full_at FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lev
  FROM f WINDOW b AS (ORDER BY full_at, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_no, source_size, least(cap, w * (SELECT lev FROM l WHERE lev <= full_at ORDER BY full_at, source_no LIMIT 1)) AS target FROM l),
j AS (SELECT d.*, t.source_no, t.source_size, t.target, ceil(size / {BLOCK_WORDS})::BIGINT AS n_blocks, floor(t.target / greatest(t.source_size, 1)) AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, unnest(range(n_blocks)) AS block FROM j WHERE n_blocks > 0),
k AS (SELECT *, md5('{SEED}|' || doc_id || '|' || block) AS key, floor((block + 1) * size / n_blocks)::BIGINT - floor(block * size / n_blocks)::BIGINT AS words FROM e),
c AS (SELECT *, row_number() OVER o - 1 AS rank, sum(words) OVER (o ROWS UNBOUNDED PRECEDING) AS run FROM k WINDOW o AS (PARTITION BY source_no ORDER BY key, doc_id, block)),
q AS (SELECT source_no, count(*) AS n_all, (max(passes) * count(*) + count(*) FILTER (target - passes * source_size > 0 AND run - words / 2 <= target - passes * source_size))::BIGINT AS quota FROM c GROUP BY source_no),
h AS (SELECT greatest(1, len(bin(((sum(quota) - 1) // {blocks_per_shard})::BIGINT))) AS depth FROM q),
-- The tree: a node's sources one after another, then its two children. nos: sources; lefts: what the left child has of those drawn.
tree(level, node, nos, starts, ns, lefts, total, draws) AS (
  SELECT 0, 1::BIGINT, list(source_no ORDER BY source_no), list(0::BIGINT), list(quota ORDER BY source_no), []::BIGINT[], sum(quota)::BIGINT, (sum(quota) // 2)::BIGINT FROM q
  UNION ALL
  SELECT CASE WHEN more THEN level ELSE level + 1 END, CASE WHEN more THEN node ELSE 2 * node + side END, nos,
    CASE WHEN more OR side = 0 THEN starts ELSE list_transform(starts, lambda s, i: s + lefts[i]) END,
    CASE WHEN more THEN ns WHEN side = 0 THEN lefts ELSE list_transform(ns, lambda n, i: n - lefts[i]) END,
    CASE WHEN more THEN list_append(lefts, x) ELSE [] END,
    CASE WHEN more THEN total - g ELSE half END, CASE WHEN more THEN draws - x ELSE half // 2 END
  FROM (SELECT *, CASE WHEN more THEN coalesce(seen[len(list_filter(p, lambda y, i: u > list_sum(p[1:i]))) + 1], mode) END AS x,
      (list_sum(ns) // 2 + CASE WHEN side = 1 THEN list_sum(ns) % 2 ELSE 0 END)::BIGINT AS half
    FROM (SELECT *, list_transform(seen, lambda y: exp(lgamma(g + 1) - lgamma(y + 1) - lgamma(g - y + 1) + lgamma(total - g + 1) - lgamma(draws - y + 1) - lgamma(total - g - draws + y + 1) - lgamma(total + 1) + lgamma(draws + 1) + lgamma(total - draws + 1))) AS p
      FROM (SELECT *, list_prepend(mode, list_filter(flatten(list_transform(range(1, steps + 1), lambda y: [mode + y, mode - y])), lambda y: y BETWEEN low AND high)) AS seen
        FROM (SELECT *, greatest(low, least(high, floor((draws + 1) * ((g + 1) / (total + 2)))::BIGINT)) AS mode,
            least(high - low, ceil(sqrt(greatest(0, draws * (g / greatest(total, 1)) * (1 - g / greatest(total, 1)))) * 12)::BIGINT + 30) + 1 AS steps
          FROM (SELECT *, greatest(0, draws - (total - g)) AS low, least(draws, g) AS high, unnest(CASE WHEN more THEN [0] ELSE [0, 1] END) AS side,
              (('0x' || substr(md5('{SEED}|' || node || '|' || no), 1, 13))::BIGINT + 0.5) / (1::BIGINT << 52)::DOUBLE AS u
            FROM (SELECT *, len(lefts) < len(ns) AS more, ns[len(lefts) + 1] AS g, nos[len(lefts) + 1] AS no FROM tree, h WHERE level < depth))))))),
v AS (SELECT node - (1 << depth) AS shard, unnest(nos) AS source_no, unnest(starts) AS start, unnest(ns) AS n FROM tree, h WHERE level = depth),
b AS (SELECT c.doc_id, c.block, c.words, y.copy, v.shard, row_number() OVER (PARTITION BY v.shard ORDER BY md5('{SEED + 1}|' || c.doc_id || '|' || c.block || '|' || y.copy), c.doc_id, c.block, y.copy) AS place
  FROM c JOIN q USING (source_no) CROSS JOIN range(3) AS y(copy) JOIN v ON v.source_no = c.source_no AND c.rank + y.copy * q.n_all >= v.start AND c.rank + y.copy * q.n_all < v.start + v.n),
x AS (SELECT doc_id, shard, sum(words)::BIGINT AS words, min(place) AS place FROM b GROUP BY doc_id, shard),
z AS (SELECT doc_id, sum(words)::BIGINT AS taken, string_agg(shard || ':' || words, ',' ORDER BY shard) AS shards, min(shard) AS first_shard, arg_min(place, shard) AS first_place FROM x GROUP BY doc_id)
SELECT j.doc_id, j.size, j.source_size, j.target, coalesce(z.taken, 0)::BIGINT AS taken, coalesce(z.shards, '') AS shards, coalesce(z.first_shard, -1)::BIGINT AS first_shard, coalesce(z.first_place, 0)::BIGINT AS first_place FROM j LEFT JOIN z ON j.doc_id = z.doc_id
"""


OP8_SQL = op8_sql()
