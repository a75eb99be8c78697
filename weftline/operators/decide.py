"""From scored pairs to matches: threshold, margin, recovery over one hop, constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import lexicon as X
from weftline.functions import text as T
from weftline.functions.similarity import jaro_winkler_col
from weftline.operators.blocking import PAIR


def base_filter(scored: DataFrame, threshold: float = X.MATCH_THRESHOLD, score: str = "match_probability") -> DataFrame:
    return scored.filter(F.col(score) >= threshold)


def relative_margin(accepted: DataFrame, ratio: float = X.MARGIN_RATIO, score: str = "match_probability") -> DataFrame:
    """Rows with at least ``ratio`` of the best accepted score of their master row, which a column ``best`` may tell."""
    if "best" in accepted.columns:
        return accepted.filter(F.col(score) >= ratio * F.col("best"))
    best = F.max(score).over(W.partitionBy("source1_entity_id"))
    return accepted.withColumn("_best", best).filter(F.col(score) >= ratio * F.col("_best")).drop("_best")


def _sided(scored: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """Candidates with their record and which table it is of; the table decides, not the id."""
    parts = [T.ensure_normalized(t).select(F.col("entity_id").alias("candidate_id"), F.lit(k).alias("src"), "business_name_norm", "business_address_norm", "country") for k, t in ((2, s2), (3, s3))]
    return scored.join(parts[0].unionByName(parts[1]), "candidate_id", "left")


def transitive_recovery(scored: DataFrame, accepted: DataFrame, s2: DataFrame, s3: DataFrame, borderline: float = X.BORDERLINE_THRESHOLD, similarity: float = X.RECOVERY_SIMILARITY) -> DataFrame:
    """Pairs that an accepted match of the same master row brings in.

    Only where matches of exactly one of the two tables are accepted; only candidates of the other table
    with the borderline score, the same country, and similar names and addresses. One hop.
    """
    rows = _sided(scored.join(accepted.select(*PAIR).withColumn("_in", F.lit(True)), list(PAIR), "left"), s2, s3).filter("src is not null")
    one = rows.filter("_in").groupBy("source1_entity_id").agg(F.min("src").alias("lo"), F.max("src").alias("hi")).filter("lo = hi").select("source1_entity_id", F.col("lo").alias("have"))
    rows = rows.join(one, "source1_entity_id")
    c = F.col
    a = rows.filter((c("src") == c("have")) & c("_in")).alias("a")
    b = rows.filter((c("src") != c("have")) & c("_in").isNull() & (c("match_probability") >= borderline)).alias("b")
    near = a.join(b, c("a.source1_entity_id") == c("b.source1_entity_id")).filter(T.country_equal(c("a.country"), c("b.country")))
    alike = 0.6 * jaro_winkler_col(c("a.business_name_norm"), c("b.business_name_norm")) + 0.4 * jaro_winkler_col(c("a.business_address_norm"), c("b.business_address_norm"))
    near = near.select(c("b.source1_entity_id"), c("b.candidate_id"), alike.alias("alike"))
    return near.filter(F.col("alike") >= similarity).select(*PAIR).distinct()


def apply_decision(
    scored: DataFrame,
    s1: DataFrame,
    s2: DataFrame,
    s3: DataFrame,
    candidates: DataFrame | None = None,
    base_threshold: float = X.MATCH_THRESHOLD,
    margin_ratio: float = X.MARGIN_RATIO,
    recovery: bool = True,
    borderline_threshold: float = X.BORDERLINE_THRESHOLD,
    transitive_sim_threshold: float = X.RECOVERY_SIMILARITY,
) -> DataFrame:
    """(source1_entity_id, ids) for every master row: accepted ids in order, then recovered ones."""
    accepted = relative_margin(base_filter(scored, base_threshold), margin_ratio).select(*PAIR)
    more = transitive_recovery(scored, accepted, s2, s3, borderline_threshold, transitive_sim_threshold) if recovery else None
    if candidates is not None:
        accepted, more = (t if t is None else t.join(candidates.select(*PAIR), list(PAIR), "left_semi") for t in (accepted, more))
    return accepted_lists(s1, accepted, more)


def accepted_lists(s1: DataFrame, accepted: DataFrame, recovered: DataFrame | None = None) -> DataFrame:
    """(source1_entity_id, ids) for every master row: accepted ids in order, then recovered ones, without the row's own.

    Repeats go where the lists are made, so that pairs are shuffled once.
    """
    found = accepted.select(*PAIR, F.lit(0).alias("late"))
    if recovered is not None:
        found = found.unionByName(recovered.select(*PAIR, F.lit(1).alias("late")))
    return match_lists(s1, found.filter("candidate_id <> source1_entity_id")).withColumn("ids", F.array_distinct("ids"))


def match_lists(s1: DataFrame, found: DataFrame) -> DataFrame:
    """One row per master row; ``found`` may order ids by a column ``late``."""
    if "late" not in found.columns:
        found = found.withColumn("late", F.lit(0))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("late", "candidate_id"))), lambda x: x["candidate_id"])
    lists = found.groupBy("source1_entity_id").agg(ids.alias("ids"))
    every = s1.select(F.col("entity_id").alias("source1_entity_id"))
    return every.join(lists, "source1_entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def rule_decision(scored: DataFrame, threshold: float = X.RULE_THRESHOLD, margin_ratio: float = X.RULE_MARGIN_RATIO, score: str = "score") -> DataFrame:
    """Decision of the rule matcher: threshold, then margin."""
    return relative_margin(base_filter(scored, threshold, score), margin_ratio, score)
