"""Summaries of tables and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators.blocking import union_sources


def inference_summary(s1: DataFrame, matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per country and, with a null country, in total: entities, matched, singletons, mean matches and
    candidates. ``matches`` and ``candidates`` have (source1_entity_id, ids)."""
    n = lambda df, name: df.select("source1_entity_id", F.size("ids").alias(name))
    rows = s1.select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("country", F.lit("")).alias("country"))
    rows = rows.join(n(matches, "m"), "source1_entity_id", "left").join(n(candidates, "c"), "source1_entity_id", "left").fillna(0, ["m", "c"])
    some = F.sum((F.col("m") > 0).cast("int"))
    return rows.rollup("country").agg(
        F.count(F.lit(1)).alias("entities"),
        some.alias("matched"),
        (F.count(F.lit(1)) - some).alias("singletons"),
        F.sum("m").alias("matches"),
        F.avg("m").alias("avg_matches"),
        F.avg("c").alias("avg_candidates"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of several tables."""
    return union_sources(*(t.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("rows")) for k, t in tables.items()))


def country_pivot(s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """(country, source_1, source_2, source_3, total) with 0 where a table has none."""
    rows = union_sources(*(t.select("country", F.lit(f"source_{k}").alias("src")) for k, t in ((1, s1), (2, s2), (3, s3))))
    names = ["source_1", "source_2", "source_3"]
    out = rows.groupBy("country").pivot("src", names).count().fillna(0, names)
    return out.withColumn("total", sum((F.col(c) for c in names), F.lit(0)))


def match_histogram(truth: DataFrame) -> DataFrame:
    """(bucket, entities, percent): all three buckets, also where they are empty."""
    counted = truth.groupBy(T.match_bucket(F.size("matched_entity_ids")).alias("bucket")).count()
    buckets = truth.sparkSession.createDataFrame([("0 matches",), ("1 match",), (">1 matches",)], "bucket string")
    n = truth.agg(F.count(F.lit(1)).alias("n"))
    # Three rows and one row.
    out = buckets.join(counted, "bucket", "left").crossJoin(F.broadcast(n))
    entities = F.coalesce("count", F.lit(0))
    return out.select("bucket", entities.alias("entities"), F.when(F.col("n") > 0, entities / F.col("n") * 100.0).otherwise(0.0).alias("percent"))


def mean_matches_by_source(truth: DataFrame) -> DataFrame:
    """One row: mean number of ids of the second and the third table, by their prefix."""
    n = lambda p: F.avg(F.size(F.filter("matched_entity_ids", lambda x: x.startswith(p))))
    return truth.agg(n("S2-").alias("avg_s2"), n("S3-").alias("avg_s3"))


def matched_pairs(truth: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """True pairs with both records; pairs with unknown ids go."""
    side = lambda df, key, p: df.select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in ("business_name", "business_address", "country")))
    edges = truth.select("source1_entity_id", F.explode("matched_entity_ids").alias("candidate_id"))
    return edges.join(side(s1, "source1_entity_id", "s1"), "source1_entity_id").join(side(union_sources(s2, s3), "candidate_id", "m"), "candidate_id")


def id_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids of both tables."""
    return a.select("entity_id").intersect(b.select("entity_id"))


def dangling_refs(truth: DataFrame, s2: DataFrame, s3: DataFrame) -> DataFrame:
    """True pairs whose second id no table has."""
    edges = truth.select("source1_entity_id", F.explode("matched_entity_ids").alias("candidate_id"))
    return edges.join(union_sources(s2, s3).select(F.col("entity_id").alias("candidate_id")), "candidate_id", "left_anti").select("source1_entity_id", "candidate_id")


def prefix_compliance(tables: dict[str, DataFrame]) -> DataFrame:
    """(prefix, rows, without): ids that lack the prefix of their table."""
    bad = lambda p: F.coalesce(F.sum((~F.col("entity_id").startswith(p)).cast("int")), F.lit(0))
    return union_sources(*(t.agg(F.lit(p).alias("prefix"), F.count(F.lit(1)).alias("rows"), bad(p).alias("without")) for p, t in tables.items()))


def distinct_entities(pairs: DataFrame, *by: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count_distinct("source1_entity_id").alias("entities"), F.count(F.lit(1)).alias("pairs"))


def hash_sample(df: DataFrame, key: Column, n: int = 10, seed: int = 42) -> DataFrame:
    """n rows with the smallest hash of a key: a sample that reruns agree on."""
    return df.orderBy(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), key).limit(n)


def progress(scored: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: pairs scored, master rows with candidates, matches, master rows with matches."""
    a = scored.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("source1_entity_id").alias("with_candidates"))
    b = matches.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("source1_entity_id").alias("with_matches"))
    return a.crossJoin(F.broadcast(b))  # two single rows


def progress_of_masters(masters: DataFrame, matches: DataFrame) -> DataFrame:
    """:func:`progress` from one row per master row with candidates: their number ``n`` and the score of its
    best match, ``best``, null without one. Matches are only counted."""
    a = masters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count(F.lit(1)).alias("with_candidates"), F.count("best").alias("with_matches"))
    b = matches.agg(F.count(F.lit(1)).alias("matches"))
    return a.crossJoin(F.broadcast(b)).select("pairs", "with_candidates", "matches", "with_matches")  # two single rows
