"""The three ways from raw tables to matches, and training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import lexicon as X
from weftline.functions.text import ensure_normalized
from weftline.operators import blocking, decide, features, metrics, models, reports, retrieval, validate
from weftline.session import checkpointed
from weftline.sources import tsv


def batch_matches(s1: DataFrame, s2: DataFrame, s3: DataFrame, model, threshold: float = X.MATCH_THRESHOLD, margin_ratio: float = X.MARGIN_RATIO, **options) -> dict[str, DataFrame]:
    """Normalise, block, compute features, score, decide.

    ``model`` has ``transform`` or ``score``. Returns candidates, scored pairs and match lists; candidates
    and scores are materialised, as several results read them.
    """
    s1, s2, s3 = map(ensure_normalized, (s1, s2, s3))
    pairs = checkpointed(blocking.generate_candidates(s1, s2, s3, **options))
    matrix = features.build_feature_matrix(pairs, s1, s2, s3)
    scored = checkpointed(model.score(matrix) if hasattr(model, "score") else models.score(model, matrix))
    matches = decide.apply_decision(scored, s1, s2, s3, pairs, threshold, margin_ratio)
    return {"candidates": blocking.candidate_lists(s1, pairs), "scored": scored, "matches": matches}


def run_test_inference(spark: SparkSession, test_dir: str, out_dir: str, model, threshold: float = X.MATCH_THRESHOLD, **options) -> dict:
    """Files in, validated files out, with a summary table."""
    tables = tsv.load_test_data(spark, test_dir)
    s1, s2, s3 = (tables[f"source{k}"] for k in (1, 2, 3))
    found = batch_matches(s1, s2, s3, model, threshold, **options)
    matches, candidates = checkpointed(found["matches"]), checkpointed(found["candidates"])
    validate.validate_inference_outputs(s1, s2, s3, candidates, matches)
    order = tsv.with_ordinal(s1)
    paths = {"matches": f"{out_dir}/matching_results.tsv", "candidates": f"{out_dir}/candidate_pairs.tsv"}
    tsv.write_submission(matches, order, "matched_entity_ids", paths["matches"])
    tsv.write_submission(candidates, order, "candidate_entity_ids", paths["candidates"])
    return {"matches": matches, "candidates": candidates, "summary": reports.inference_summary(s1, matches, candidates), "paths": paths}


def run_rule_matching(spark: SparkSession, test_dir: str, out_dir: str, open_vocabulary: bool = True, stemming: bool = True, limit: int | None = None) -> dict:
    """The rule matcher over files. ``limit`` takes the first master rows only, as an option to try things out."""
    tables = tsv.load_test_data(spark, test_dir)
    s1, s2, s3 = (tables[f"source{k}"] for k in (1, 2, 3))
    if limit is not None:
        s1 = s1.limit(limit)
    index = retrieval.build_index(s2, s3, open_vocabulary, stemming)
    pairs = checkpointed(retrieval.tiered_lookup(s1, index, open_vocabulary, stemming).select("source1_entity_id", "candidate_id"))
    matches = decide.match_lists(s1, retrieval.rule_decision(retrieval.rule_scores(pairs, s1, s2, s3)))
    matches, candidates = checkpointed(matches), checkpointed(blocking.candidate_lists(s1, pairs))
    validate.validate_inference_outputs(s1, s2, s3, candidates, matches)
    order = tsv.with_ordinal(s1)
    paths = {"matches": f"{out_dir}/matching_results.tsv", "candidates": f"{out_dir}/candidate_pairs.tsv"}
    tsv.write_submission(matches, order, "matched_entity_ids", paths["matches"])
    tsv.write_submission(candidates, order, "candidate_entity_ids", paths["candidates"])
    return {"matches": matches, "candidates": candidates, "paths": paths}


def query_matches(s1: DataFrame, s2: DataFrame, s3: DataFrame, model, threshold: float = 0.50, margin_ratio: float = X.MARGIN_RATIO, open_vocabulary: bool = True, stemming: bool = True) -> DataFrame:
    """The single-query matcher: lookup, nine features, model score, threshold and margin."""
    index = retrieval.build_index(s2, s3, open_vocabulary, stemming)
    pairs = retrieval.query_lookup(s1, index, open_vocabulary, stemming).select("source1_entity_id", "candidate_id")
    rows = retrieval.raw_pairs(pairs, s1, s2, s3).select("source1_entity_id", "candidate_id", *features.compact_features("n1", "a1", "n2", "a2"))
    scored = model.score(rows) if hasattr(model, "score") else models.score(model, rows)
    return decide.relative_margin(decide.base_filter(scored, threshold), margin_ratio)


def train(labeled: DataFrame, n_splits: int = 5, seed: int = X.SEED, rounds: int = 100) -> dict:
    """Both models, their metrics on the validation split, and the one to ship.

    Where boosted trees win, an ensemble over folds of the training entities is shipped, so that the
    validation entities stay unseen by what a threshold is tuned for.
    """
    features.check_no_leakage(labeled)
    known, val = labeled.filter("split = 'train'").drop("split"), labeled.filter("split = 'val'").drop("split")
    marked = labeled.withColumn("_val", F.col("split") == "val").drop("split")
    fitted = {"boosted_trees": models.train_boosted_trees(marked, features.feature_columns(known), seed, rounds, "_val"), "logistic": models.train_logistic(known)}
    scores = {k: models.evaluate(m, val) for k, m in fitted.items()}
    name = models.choose(scores)
    out = {"models": fitted, "metrics": scores, "chosen": name, "model": fitted[name]}
    if name == "boosted_trees":
        ensemble, held, summary = models.train_cv_ensemble(known, n_splits, seed, rounds)
        out |= {"model": ensemble, "out_of_fold": held, "summary": summary}
    return out


def tune_threshold(model, val: DataFrame, truth: DataFrame, entities: DataFrame | None = None, thresholds=metrics.THRESHOLDS) -> tuple[DataFrame, float]:
    """The curve and the threshold to use."""
    scored = model.score(val) if hasattr(model, "score") else models.score(model, val)
    curve = checkpointed(metrics.threshold_sweep(scored, truth, entities, thresholds))
    return curve, float(metrics.best_threshold(curve).first()["threshold"])
