"""Fidelity of answers: citations, numbers and meanings of claims held against the evidence that they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import failed

NUMBER = r"(?<![\w.])-?\d+(?:\.\d+)?(?![\w.]*\w)"
NONE = "array<string>"


def numbers(text: Column) -> Column:
    """The numbers that stand in a text by themselves, in order; none for a null text."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))


def ids(c: str) -> Column:
    return F.array_distinct(F.coalesce(F.col(c), F.array().cast(NONE)))


def citations(answers: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per answer: valid (all that the answer or a claim cites is there), complete (the answer cites just what its claims do, and each claim
    something; without claims, nothing) and n_unknown.

    answers: answer_id, citations. claims: answer_id, evidence_ids. evidence: evidence_id.
    """
    per = claims.select("answer_id", ids("evidence_ids").alias("e")).groupBy("answer_id").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("of_claims"), F.min(F.size("e")).alias("fewest"))
    rows = answers.select("answer_id", ids("citations").alias("own")).join(per, "answer_id", "left").withColumn("of_claims", F.coalesce("of_claims", F.array().cast(NONE)))
    cited = rows.select("answer_id", F.explode(F.array_union("own", "of_claims")).alias("evidence_id"))
    unknown = cited.join(evidence.select("evidence_id").distinct(), "evidence_id", "left_anti").groupBy("answer_id").agg(F.count("*").alias("n_unknown"))
    same = (F.size(F.array_except("own", "of_claims")) == 0) & (F.size(F.array_except("of_claims", "own")) == 0)
    met = rows.join(unknown, "answer_id", "left").withColumn("n_unknown", F.coalesce("n_unknown", F.lit(0).cast("long")))
    return met.select("answer_id", (F.col("n_unknown") == 0).alias("valid"), (same & (F.coalesce("fewest", F.lit(1)) > 0)).alias("complete"), "n_unknown")


def support(claims: DataFrame, evidence: DataFrame, tolerance: float = 1e-6, meanings: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Per claim: n_numbers of its text, n_supported (within ``tolerance``, absolute and relative, of a number in the payload of an evidence
    that it cites), and violations: the codes of words that the evidence it cites does not bear out.

    claims: claim_id, text, evidence_ids. evidence: evidence_id, payload (JSON text), semantics. meanings: code to a pattern of words and
    the semantics that some cited evidence must have.
    """
    known = evidence.select("evidence_id", numbers(F.col("payload")).alias("held"), F.array(F.coalesce("semantics", F.lit(""))).alias("means"))
    cited = claims.select("claim_id", F.explode(ids("evidence_ids")).alias("evidence_id")).join(known, "evidence_id")
    merged = cited.groupBy("claim_id").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.array_distinct(F.flatten(F.collect_list("means"))).alias("means"))  # of what one claim cites
    rows = claims.select("claim_id", "text", numbers(F.col("text")).alias("said")).join(merged, "claim_id", "left")
    rows = rows.withColumns({"held": F.coalesce("held", F.array().cast("array<double>")), "means": F.coalesce("means", F.array().cast(NONE))})
    near = lambda x, y: F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    backed = F.filter("said", lambda x: F.exists("held", lambda y: near(x, y)))
    broken = {code: F.lower("text").rlike(words) & ~F.array_contains("means", meaning) for code, (words, meaning) in (meanings or {}).items()}
    violations = failed(broken) if broken else F.array().cast(NONE)
    return rows.select("claim_id", F.size("said").alias("n_numbers"), F.size(backed).alias("n_supported"), violations.alias("violations"))


def fact_fidelity(expected: DataFrame, claims: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per case: n_expected facts, n_found (some claim of the answer states the value, numbers within ``tolerance``) and fidelity (null where
    nothing is expected).

    expected: answer_id, fact, value. claims: answer_id, facts (map of text).
    """
    said = claims.where(F.col("facts").isNotNull()).select("answer_id", F.explode("facts").alias("fact", "said")).distinct()
    met = expected.join(said, ["answer_id", "fact"], "left")
    x, y = F.col("value").try_cast("double"), F.col("said").try_cast("double")
    hit = F.coalesce(F.col("value") == F.col("said"), F.lit(False)) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
    per = met.groupBy("answer_id", "fact", "value").agg(F.max(hit).alias("hit"))
    return per.groupBy("answer_id").agg(F.count("*").alias("n_expected"), F.count_if("hit").alias("n_found")).withColumn("fidelity", F.try_divide(F.col("n_found").cast("double"), F.col("n_expected").cast("double")))


def order_fidelity(ordered: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Per answer: whether the orders it tells of (answer_id and ``keys``, as often as they stand there) are just those of the decision."""
    count = lambda df, name: df.groupBy("answer_id", *keys).agg(F.count("*").alias(name))
    met = count(ordered, "a_").join(count(told, "b_"), ["answer_id", *keys], "full")
    return met.groupBy("answer_id").agg((F.count_if(~F.col("a_").eqNullSafe(F.col("b_"))) == 0).alias("equal"), F.sum(F.coalesce("a_", F.lit(0))).alias("n_ordered"), F.sum(F.coalesce("b_", F.lit(0))).alias("n_told"))
