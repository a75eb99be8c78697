"""Quality of matches and of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.session import checkpointed
from weftline.functions import text as T
from weftline.operators.blocking import PAIR

#: Thresholds that a sweep tries.
THRESHOLDS = tuple(round(0.3 + 0.025 * k, 4) for k in range(27))
#: Where a threshold is preferred if it is among the best.
PREFERRED = (0.65, 0.75)


def clean_ids(c: Column) -> Column:
    """Trimmed distinct ids without blanks."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.strip), lambda x: F.coalesce(x != "", F.lit(False))))


def f05(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    """F0.5 of one entity: 1 if both sets are empty, 0 if one is."""
    p, r = n_hit / n_pred, n_hit / n_true
    return (
        F.when((n_pred == 0) & (n_true == 0), 1.0)
        .when((n_pred == 0) | (n_true == 0) | (n_hit == 0), 0.0)
        .otherwise(1.25 * p * r / (0.25 * p + r))
    )


def precision(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    return F.when((n_true == 0) & (n_pred > 0), 0.0).when(n_pred == 0, 1.0).otherwise(n_hit / n_pred)


def recall(n_pred: Column, n_true: Column, n_hit: Column) -> Column:
    return F.when(n_true == 0, F.when(n_pred == 0, 1.0).otherwise(0.0)).otherwise(n_hit / n_true)


def entity_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(source1_entity_id, f0_5, precision, recall) for every entity of the truth; both tables have ids."""
    t = truth.select("source1_entity_id", clean_ids(F.col("matched_entity_ids")).alias("t"))
    p = pred.select("source1_entity_id", clean_ids(F.col("ids")).alias("p"))
    rows = t.join(p, "source1_entity_id", "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))
    n = (F.size("p"), F.size("t"), F.size(F.array_intersect("p", "t")))
    return rows.select("source1_entity_id", f05(*n).alias("f0_5"), precision(*n).alias("precision"), recall(*n).alias("recall"))


def macro_metrics(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Means over the truth's entities; 0 without any."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return entity_metrics(pred, truth).agg(mean("f0_5"), mean("precision"), mean("recall"))


def threshold_sweep(scored: DataFrame, truth: DataFrame, entities: DataFrame | None = None, thresholds=THRESHOLDS) -> DataFrame:
    """Macro metrics at each threshold, rounded to four places.

    Every pair is read once: per entity, counts at each threshold are sums of comparisons, so that pairs
    are never multiplied by thresholds. Entities without pairs count as predicting nothing. Where ``scored``
    has a boolean column ``hit``, it tells the true pairs, and pairs are not joined with the truth.
    """
    edges = truth.select("source1_entity_id", F.explode(clean_ids(F.col("matched_entity_ids"))).alias("candidate_id")).withColumn("hit", F.lit(1))
    sizes = truth.select("source1_entity_id", F.size(clean_ids(F.col("matched_entity_ids"))).alias("n_true"))
    if entities is not None:
        sizes = sizes.join(entities.select("source1_entity_id").distinct(), "source1_entity_id", "left_semi")
    marked = scored if "hit" in scored.columns else scored.join(edges, list(PAIR), "left").withColumn("hit", F.col("hit").isNotNull())
    counts = marked.groupBy("source1_entity_id").agg(
        F.array(*(F.sum((F.col("match_probability") >= t).cast("int")) for t in thresholds)).alias("pred"),
        F.array(*(F.sum(((F.col("match_probability") >= t) & F.col("hit")).cast("int")) for t in thresholds)).alias("hits"),
    )
    rows = sizes.join(counts, "source1_entity_id", "left")
    ts = F.array(*map(F.lit, thresholds))
    rows = rows.select("n_true", F.posexplode(ts).alias("k", "threshold"), "pred", "hits")
    n = (F.coalesce(F.get("pred", F.col("k")), F.lit(0)), F.col("n_true"), F.coalesce(F.get("hits", F.col("k")), F.lit(0)))
    mean = lambda f, name: F.round(F.avg(f(*n)), 4).alias(name)
    return rows.groupBy("threshold").agg(mean(precision, "precision"), mean(recall, "recall"), mean(f05, "f0_5"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """One row of the curve: of those with the best F0.5 the middle one of the preferred range, else the
    one with the highest precision, then threshold."""
    top = curve.agg(F.max("f0_5").alias("top"))
    best = curve.join(F.broadcast(top), F.col("f0_5") >= F.col("top") - 1e-6).drop("top")
    lo, hi = PREFERRED
    best = best.withColumn("preferred", F.col("threshold").between(lo - 1e-9, hi + 1e-9))
    # The curve has one row per threshold.
    every = W.partitionBy("preferred").orderBy("threshold")
    ranked = best.withColumns({"at": F.row_number().over(every) - 1, "of": F.count(F.lit(1)).over(W.partitionBy("preferred"))})
    middle = F.col("preferred") & (F.col("at") == F.floor(F.col("of") / 2))
    return ranked.orderBy(middle.desc(), F.desc("precision"), F.desc("threshold")).limit(1).select(*curve.columns)


def binary_metrics(scored: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    """One row: ROC-AUC, average precision, accuracy, precision, recall, F1 and the confusion matrix.

    Areas are summed over distinct scores, ties as one step; they are 0 if a class is missing. Distinct
    scores are dealt out in ranges; a running sum over ranges gives each range where its counts start.
    """
    by = scored.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    by = checkpointed(by.repartitionByRange(F.desc("s")).withColumn("part", F.spark_partition_id()))
    # One row per range.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    start = by.groupBy("part").agg(F.sum("p").alias("ps"), F.sum("n").alias("ns"))
    zero = F.lit(0).cast("long")
    start = start.select(
        "part", F.coalesce(F.sum("ps").over(before), zero).alias("tp0"), F.coalesce(F.sum("ns").over(before), zero).alias("fp0"), F.sum("ps").over(every).alias("pos"), F.sum("ns").over(every).alias("neg")
    )
    down = W.partitionBy("part").orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = by.withColumns({"tp1": F.sum("p").over(down), "fp1": F.sum("n").over(down)}).join(start, "part")
    run = run.withColumns({"tp": F.col("tp0") + F.col("tp1"), "fp": F.col("fp0") + F.col("fp1")})
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    roc = F.when(both, F.col("n") * (F.col("tp") - F.col("p") / 2) / (F.col("pos") * F.col("neg"))).otherwise(0.0)
    ap = F.when(both, F.col("p") / F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    hit = (F.col("s") >= threshold).cast("int")
    sums = run.agg(
        F.sum(roc).alias("roc_auc"),
        F.sum(ap).alias("pr_auc"),
        *(F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(k) for k, x in (("tp", hit * F.col("p")), ("fp", hit * F.col("n")), ("fn", (1 - hit) * F.col("p")), ("tn", (1 - hit) * F.col("n")))),
    )
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    r5 = lambda c, k: F.round(F.coalesce(c, F.lit(0.0)), 5).alias(k)
    return sums.select(
        r5(F.col("roc_auc"), "roc_auc"),
        r5(F.col("pr_auc"), "pr_auc"),
        r5(div(tp + tn, tp + tn + fp + fn), "accuracy"),
        r5(div(tp, tp + fp), "precision"),
        r5(div(tp, tp + fn), "recall"),
        r5(div(2 * tp, 2 * tp + fp + fn), "f1"),
        "tp", "fp", "fn", "tn",
    )
