"""Pair features, labels and splits."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.functions import blocks
from weftline.functions import lexicon as X
from weftline.functions import similarity as S
from weftline.functions import text as T
from weftline.operators import overlap
from weftline.operators.blocking import PAIR, union_sources
from weftline.session import checkpointed

#: In order of the feature matrix.
FEATURES = (
    "name_ratio", "name_token_sort_ratio", "name_token_set_ratio", "name_partial_ratio", "name_jaccard",
    "name_first_word_match", "name_length_diff", "name_num_common_tokens",
    "addr_ratio", "addr_token_sort_ratio", "addr_partial_ratio", "addr_jaccard",
    "pincode_match", "has_landmark_both", "same_country", "combined_similarity",
    "name_phonetic_sim", "addr_numeric_similarity", "name_acronym_match",
)
META = (*PAIR, "label", "split", "match_probability")


def feature_columns(df: DataFrame) -> list[str]:
    """Whatever is not an id, a label, a split or a score."""
    return [c for c in df.columns if c not in META]


def with_entity_tokens(df: DataFrame) -> DataFrame:
    """Tokens are made once per entity, before pairs multiply rows."""
    df = T.ensure_normalized(df)
    return df.withColumns({"name_tokens": T.extract_tokens(F.col("business_name_norm")), "addr_tokens": T.extract_tokens(F.col("business_address_norm"))})


_SIDE = ("business_name_norm", "business_address_norm", "address_pincode", "has_landmark", "country", "name_tokens", "addr_tokens")


def join_records(pairs: DataFrame, s1: DataFrame, *others: DataFrame) -> DataFrame:
    """Pairs with the columns of both records, prefixed a_ and b_; pairs with unknown ids go."""
    side = lambda df, key, p: with_entity_tokens(df).select(F.col("entity_id").alias(key), *(F.col(c).alias(f"{p}_{c}") for c in _SIDE))
    return pairs.select(*PAIR).join(side(s1, "source1_entity_id", "a"), "source1_entity_id").join(side(union_sources(*others), "candidate_id", "b"), "candidate_id")


def pair_features(records: DataFrame) -> DataFrame:
    """Ids and features of joined records; strings cross to Python once per pair."""
    c = lambda side, name: F.col(f"{side}_{name}")
    both = lambda name: (c("a", name), c("b", name))
    name, addr = both("business_name_norm"), both("business_address_norm")
    rows = records.withColumn("chars", S.character_features(*name, *addr))
    plain = {
        "name_jaccard": S.jaccard(*both("name_tokens")),
        "name_first_word_match": S.first_word_match(*name),
        "name_length_diff": S.length_diff(*name),
        "name_num_common_tokens": F.size(F.array_intersect(*both("name_tokens"))),
        "addr_jaccard": S.jaccard(*both("addr_tokens")),
        "pincode_match": S.pincode_match(*both("address_pincode")),
        "has_landmark_both": (F.coalesce(c("a", "has_landmark"), F.lit(False)) & F.coalesce(c("b", "has_landmark"), F.lit(False))).cast("int"),
        "same_country": T.country_equal(*both("country")).cast("int"),
        "combined_similarity": 0.6 * F.col("chars.name_token_set_ratio") + 0.4 * F.col("chars.addr_token_sort_ratio"),
        "addr_numeric_similarity": S.numeric_similarity(*addr),
        "name_acronym_match": S.acronym_match(*name),
    }
    return rows.select(*PAIR, *((plain[f] if f in plain else F.col(f"chars.{f}")).alias(f) for f in FEATURES))


def build_feature_matrix(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, embeddings: DataFrame | None = None, max_pairs: int | None = None) -> DataFrame:
    """Features of all pairs with known ids. ``embeddings`` (entity_id, embedding) adds their cosine;
    ``max_pairs`` keeps the first pairs in id order."""
    if max_pairs is not None:
        pairs = pairs.orderBy(*PAIR).limit(max_pairs)
    out = pair_features(join_records(pairs, s1, s2, s3))
    if embeddings is not None:
        vec = lambda key, name: embeddings.select(F.col("entity_id").alias(key), S.normalised(F.col("embedding")).alias(name))
        out = out.join(vec("source1_entity_id", "_a"), "source1_entity_id", "left").join(vec("candidate_id", "_b"), "candidate_id", "left")
        out = out.withColumn("embedding_cosine_sim", F.coalesce(S.cosine(F.col("_a"), F.col("_b")), F.lit(0.0))).drop("_a", "_b")
        out = out.select(*PAIR, *FEATURES, "embedding_cosine_sim")
    return out


def overlap_features(s1: DataFrame, candidates: DataFrame, least: int = X.MIN_SHARED_TOKENS) -> DataFrame:
    """The feature matrix of the pairs whose names share so many tokens, without a shuffle of pairs."""
    return listed_features(overlap_lists(s1, candidates, least), least)


def overlap_lists(s1: DataFrame, candidates: DataFrame, least: int = X.MIN_SHARED_TOKENS, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """Lists of rows, whose names may share so many tokens, with what features look at. ``carry`` is made per row."""
    name, address = (F.coalesce(c, F.lit("")) for c in ("business_name_norm", "business_address_norm"))
    columns = {
        "name": name,
        "words": T.extract_tokens(name),
        "first": F.regexp_extract(name, r"^\s*(\S+)", 1),
        "short": T.initialism(name),
        "upper": T.acronym_words(name),
        "address": address,
        "order": T.in_order(address),
        "address_words": T.hashed(T.extract_tokens(address)),
        "numbers": T.numbers(address),
        "pincode": T.safe(F.col("address_pincode")),
        "landmark": F.coalesce("has_landmark", F.lit(False)),
    }
    return overlap.blocks(s1, candidates, least, columns, carry or {})


def listed_features(met: DataFrame, least: int = X.MIN_SHARED_TOKENS, on_pairs: Mapping[str, Column] | None = None) -> DataFrame:
    """The feature matrix of the pairs of :func:`overlap_lists`, which Python makes: no text crosses once per pair.
    ``on_pairs`` adds columns over x and y, which have what rows carry."""
    item = lambda side: met.schema[f"{side}s"].dataType.elementType["item"].dataType
    schema = types.StructType([types.StructField(c, item(c)) for c in "xy"] + [types.StructField(c, types.DoubleType() if k == "double" else types.IntegerType()) for c, k in blocks.MADE.items()])
    arrow = to_arrow_schema(schema)
    rows = met.mapInArrow(lambda batches: blocks.features(batches, arrow, least), schema)
    plain = {
        # Only rows of one country meet, and none without.
        "same_country": F.lit(1),
        "combined_similarity": 0.6 * F.col("name_token_set_ratio") + 0.4 * F.col("addr_token_sort_ratio"),
    }
    out = {f: plain.get(f, F.col(f)) for f in FEATURES} | dict(on_pairs or {})
    return rows.select(F.col("x.entity_id").alias("source1_entity_id"), F.col("y.entity_id").alias("candidate_id"), *(c.alias(k) for k, c in out.items()))


#: Vectors that are compared with as many others in one go.
VECTORS = 2048


def nearest_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """(vec_id, other, cosine): of each (vec_id, label, e) the k others of its label with the highest cosines
    over six places, ties by id.

    Blocks of a label are multiplied as matrices; a pair of blocks returns what may be among the best.
    """
    counts = vectors.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / VECTORS).alias("blocks"))
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks"))
    # One row per label; vectors without a label join nothing.
    rows = vectors.filter("e is not null").join(F.broadcast(counts), "label").groupBy("label", block.alias("block"))
    rows = checkpointed(rows.agg(F.sort_array(F.collect_list(F.struct("vec_id", "e"))).alias("v")).select("label", F.col("v.vec_id").alias("id"), F.flatten("v.e").alias("e")))
    pairs = sum(r["n"] ** 2 for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    work = rows.join(rows.select("label", F.col("id").alias("other_id"), F.col("e").alias("f")), "label").drop("label").repartition(max(1, min(pairs, 4096)))
    kind = dict(vectors.dtypes)["vec_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                a, b = r.e.reshape(len(r.id), -1), r.f.reshape(len(r.other_id), -1)
                with np.errstate(invalid="ignore"):  # a vector of zeros is near none
                    s = (a / np.sqrt((a * a).sum(axis=1))[:, None]) @ (b / np.sqrt((b * b).sum(axis=1))[:, None]).T
                s[np.isnan(s)] = -np.inf
                s[r.id[:, None] == r.other_id[None, :]] = -np.inf
                at = min(k, s.shape[1])
                # Room for what rounding to six places makes equal.
                i, j = np.nonzero((s >= np.partition(s, -at, axis=1)[:, -at, None] - 2e-6) & (s > -np.inf))
                yield pd.DataFrame({"vec_id": r.id[i], "other": r.other_id[j], "cosine": s[i, j]})

    found = work.mapInPandas(run, f"vec_id {kind}, other {kind}, cosine double").withColumn("cosine", F.round("cosine", 6))
    rank = F.row_number().over(W.partitionBy("vec_id").orderBy(F.desc("cosine"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def compact_features(n1: str, a1: str, n2: str, a2: str) -> list:
    """The nine features of the single-query matcher as columns over raw text, the first constant."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    name, addr = (low(n1), low(n2)), (low(a1), low(a2))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) >= 2))
    nset, aset = S.token_set_ratio_col(*name), S.token_set_ratio_col(*addr)
    return [
        F.lit(1.0).alias("constant"),
        S.ratio_col(*name).alias("name_ratio"),
        nset.alias("name_token_set_ratio"),
        S.partial_ratio_col(*name).alias("name_partial_ratio"),
        S.jaccard(words(name[0]), words(name[1])).alias("name_jaccard"),
        S.ratio_col(*addr).alias("addr_ratio"),
        aset.alias("addr_token_set_ratio"),
        S.token_sort_ratio_col(*addr).alias("addr_token_sort_ratio"),
        (0.5 * nset + 0.5 * S.token_sort_ratio_col(*addr)).alias("combined"),
    ]


def true_edges(truth: DataFrame) -> DataFrame:
    edges = truth.select(T.strip(F.col("source1_entity_id")).alias("source1_entity_id"), F.explode("matched_entity_ids").alias("m"))
    return edges.select("source1_entity_id", T.strip(F.col("m")).alias("candidate_id")).distinct()


def assign_labels(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Label 1 for true pairs, else 0."""
    edges = true_edges(truth).withColumn("_hit", F.lit(1))
    return pairs.join(edges, list(PAIR), "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def class_balance(labeled: DataFrame) -> DataFrame:
    """One row: counts, positives in percent, negatives per positive (infinite without positives)."""
    n, pos = F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))
    return labeled.agg(
        n.alias("total"),
        pos.alias("positives"),
        (n - pos).alias("negatives"),
        F.when(n > 0, pos / n * 100.0).otherwise(0.0).alias("positive_percent"),
        F.when(pos > 0, (n - pos) / pos).otherwise(F.lit(float("inf"))).alias("negatives_per_positive"),
    )


def _order(seed: int):
    return F.md5(F.concat(F.col("source1_entity_id"), F.lit(f":{seed}")))


def _entities(labeled: DataFrame) -> DataFrame:
    """One row per master entity, with whether it has a true pair."""
    return labeled.groupBy("source1_entity_id").agg(F.max("label").alias("stratum"))


def _placed(labeled: DataFrame, seed: int) -> DataFrame:
    """(source1_entity_id, stratum, place, all): the place, from 1, of each entity in its stratum of
    ``all`` entities, by a hash of its id.

    Places come from sums over hash ranges, so that a stratum is never sorted in one task.
    """
    keyed = _entities(labeled).withColumn("key", _order(seed)).withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy("stratum", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("stratum").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("stratum", "range", before.alias("before"), F.sum("n").over(W.partitionBy("stratum")).alias("all"))
    rank = F.row_number().over(W.partitionBy("stratum", "range").orderBy("key", "source1_entity_id"))
    ranked = keyed.withColumn("rank", rank).join(sums, ["stratum", "range"])
    return ranked.select("source1_entity_id", "stratum", (F.col("rank") + F.col("before")).alias("place"), "all")


def split_by_entity(labeled: DataFrame, test_size: float = 0.2, seed: int = X.SEED) -> DataFrame:
    """Adds ``split``: of each stratum, entities with the smallest keys are val, the others train.

    A key is a hash of the entity, so no entity is on both sides and reruns agree. Of n entities
    floor(test_size * n + 0.5) are val.
    """
    val = F.col("place") <= F.floor(test_size * F.col("all") + 0.5)
    return labeled.join(_placed(labeled, seed).select("source1_entity_id", F.when(val, "val").otherwise("train").alias("split")), "source1_entity_id")


def check_no_leakage(labeled: DataFrame) -> None:
    both = labeled.groupBy("source1_entity_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").limit(5).collect()
    if both:
        raise ValueError(f"Data leakage: entities in both splits: {[r[0] for r in both]}")


def fold_of(labeled: DataFrame, n_splits: int = 5, seed: int = X.SEED) -> DataFrame:
    """Adds ``fold``: the entities of each stratum are dealt to the folds in turn, in hash order, so that
    folds differ by at most one entity of a stratum."""
    fold = F.pmod(F.col("place") - 1 + F.col("stratum"), F.lit(n_splits)).cast("int")
    return labeled.join(_placed(labeled, seed).select("source1_entity_id", fold.alias("fold")), "source1_entity_id")


def prepare_training_dataset(pairs: DataFrame, s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, test_size: float = 0.2, seed: int = X.SEED) -> DataFrame:
    """Features, labels and split of candidate pairs."""
    return split_by_entity(assign_labels(build_feature_matrix(pairs, s1, s2, s3), truth), test_size, seed)
