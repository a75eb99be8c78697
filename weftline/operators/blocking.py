"""Candidate generation: which rows of the other tables each row of the master table is compared with.

All strategies are equi-joins on (country, key) followed by an aggregate or a window. Candidates are long
tables (source1_entity_id, candidate_id).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import grams
from weftline.functions import lexicon as X
from weftline.functions import text as T
from weftline.operators import overlap
from weftline.session import checkpointed

#: Rows that a sliding window reads together.
BLOCK = 4096

#: Texts that are compared with as many others in one go, and tasks for that.
TEXTS, MOST_TASKS = 8192, 4096

PAIR = ("source1_entity_id", "candidate_id")


def union_sources(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with a country that is not blank, and its key."""
    return T.ensure_normalized(df).withColumn("country_key", T.country_key(F.coalesce("country", F.lit("")))).filter("country_key <> ''")


def _both(df: DataFrame) -> Column:
    """Name and address, one space between."""
    return F.concat_ws(" ", "business_name_norm", "business_address_norm")


def tfidf_neighbors(s1: DataFrame, candidates: DataFrame, top_k: int = X.TOP_K, pad: bool = True, max_gram_share: float | None = None) -> DataFrame:
    """The top_k candidates of each row by cosine of tf-idf weighted character n-grams, per country.

    Weights are (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1) with n and df of the country's candidates, and
    vectors have length 1. n-grams that no candidate has do not count. Ties go to the smaller id. With
    ``pad``, rows get min(top_k, n) candidates even where nothing is shared. Result: source1_entity_id,
    candidate_id, similarity.

    ``max_gram_share`` leaves n-grams out of the products that more than this share of a country's
    candidates has; by default all take part, which is exact.

    Every text is compared with every other of its country, blocks of texts at a time, and each pair of
    blocks returns its best only. The work grows with the product of the tables, the data that move do not.
    """
    q, c = _keyed(s1), _keyed(candidates)
    sizes = c.groupBy("country_key").agg(F.count(F.lit(1)).alias("n"))
    asked, offered = (checkpointed(_bags(rows)) for rows in (q, c))
    terms = offered.select("country_key", F.explode(F.array_distinct(T.char_grams(F.col("bag")))).alias("g"), F.size("ids").alias("held"))
    idf = terms.groupBy("country_key", "g").agg(F.sum("held").alias("df"))
    # One row per country, for the n-grams of an alphabet.
    out = F.col("df") > F.lit(1.0 if max_gram_share is None else max_gram_share) * F.col("n")
    idf = idf.join(F.broadcast(sizes), "country_key").select("country_key", "g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), (out if max_gram_share is not None else F.lit(False)).alias("out"))
    idf = idf.groupBy("country_key").agg(F.collect_list(F.struct("g", "idf", "out")).alias("x")).select("country_key", *(F.col(f"x.{f}").alias(f) for f in ("g", "idf", "out")))

    mine = _blocks(asked, F.struct("bag", F.col("id").alias("k")), "a").select("country_key", F.col("a.bag").alias("texts"), F.col("a.k").alias("at"))
    theirs = _blocks(offered, F.struct(F.get("ids", F.lit(0)).alias("least"), "bag", F.col("id").alias("k")), "b").select("country_key", F.col("b.bag").alias("others"), F.col("b.k").alias("other_at"))
    # So many tasks as there are pairs of blocks, up to a bound: each is work for seconds on little data.
    count = {r["country_key"]: r["n"] for r in mine.groupBy("country_key").agg(F.count(F.lit(1)).alias("n")).collect()}
    tasks = sum(r["n"] * count.get(r["country_key"], 0) for r in theirs.groupBy("country_key").agg(F.count(F.lit(1)).alias("n")).collect())
    work = mine.join(theirs, "country_key").join(idf, "country_key").drop("country_key").repartition(max(1, min(tasks, MOST_TASKS)))
    near = work.mapInPandas(_nearest(top_k), "at long, other_at long, s double")
    # A text has the ids of its equals: of its master rows all, of its candidates the first.
    near = near.join(offered.select(F.col("id").alias("other_at"), F.slice("ids", 1, top_k).alias("ids")), "other_at").select("at", F.explode("ids").alias("candidate_id"), "s")
    rank = F.row_number().over(W.partitionBy("at").orderBy(F.round("s", 9).desc(), "candidate_id"))
    near = near.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    best = near.join(asked.select(F.col("id").alias("at"), F.explode("ids").alias("source1_entity_id")), "at").select(*PAIR, F.col("s").alias("similarity"))
    if not pad:
        return best
    best = checkpointed(best)
    return best.unionByName(_padding(q, c, best, top_k))


def _bags(rows: DataFrame) -> DataFrame:
    """(id, country_key, bag, ids): the words of name and address in order, whose n-grams are those of the
    text, with the sorted ids of the rows that have them. Rows of one id are one text."""
    bag = F.array_join(F.sort_array(F.split(F.btrim(F.regexp_replace(F.lower(F.array_join(F.collect_list(_both(rows)), " ")), r"\s+", " ")), " ")), " ")
    rows = rows.groupBy("country_key", "entity_id").agg(bag.alias("bag"))
    return rows.groupBy("country_key", "bag").agg(F.sort_array(F.collect_list("entity_id")).alias("ids")).select(F.monotonically_increasing_id().alias("id"), "country_key", "bag", "ids")


def _blocks(bags: DataFrame, item: Column, name: str) -> DataFrame:
    """Lists of about TEXTS items of one country."""
    counts = bags.groupBy("country_key").agg(F.ceil(F.count(F.lit(1)) / TEXTS).alias("blocks"))
    block = F.pmod(F.xxhash64("bag"), F.col("blocks"))
    return bags.join(F.broadcast(counts), "country_key").groupBy("country_key", block.alias("block")).agg(F.sort_array(F.collect_list(item)).alias(name))


def _nearest(top_k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                left_out = frozenset(r.g[r.out.astype(bool)])
                a, b, s = grams.nearest(r.texts.tolist(), r.others.tolist(), dict(zip(r.g, r.idf, strict=True)), left_out, top_k)
                yield pd.DataFrame({"at": r.at[a], "other_at": r.other_at[b], "s": s})

    return run


def _padding(q: DataFrame, c: DataFrame, best: DataFrame, top_k: int) -> DataFrame:
    """For rows with fewer than top_k neighbours, the smallest ids of their country besides.

    2 * top_k ids per country are enough: at most top_k of them are neighbours already.
    """
    rank = F.row_number().over(W.partitionBy("country_key").orderBy("entity_id"))
    fillers = c.select("country_key", "entity_id").withColumn("r", rank).filter(F.col("r") <= 2 * top_k)
    fillers = fillers.groupBy("country_key").agg(F.sort_array(F.collect_list("entity_id")).alias("fillers"))
    held = best.groupBy("source1_entity_id").agg(F.collect_set("candidate_id").alias("held"))
    rows = q.select("country_key", F.col("entity_id").alias("source1_entity_id")).join(held, "source1_entity_id", "left")
    rows = rows.withColumn("held", F.coalesce("held", F.array().cast("array<string>"))).filter(F.size("held") < top_k)
    # One row of bounded size per country.
    rows = rows.join(F.broadcast(fillers), "country_key")
    free = F.slice(F.array_except("fillers", "held"), 1, F.lit(top_k) - F.size("held"))
    return rows.select("source1_entity_id", F.explode(free).alias("candidate_id"), F.lit(0.0).alias("similarity"))


def sorted_neighborhood(s1: DataFrame, s2: DataFrame, s3: DataFrame | None = None, window_size: int = X.WINDOW_SIZE, prefix_len: int = 4) -> DataFrame:
    """Pairs of a master row and another row at most window_size - 1 places apart when the rows of a
    country are sorted by (prefix, name, table, id). Blank countries form one group.

    Rows are range-sorted and numbered once over all countries. Blocks of BLOCK numbers, each with the
    first rows of the next block, are then read off by a sliding window, so that neither a country nor a
    name gathers in one task.
    """
    parts = [(k, t) for k, t in enumerate((s1, s2, s3), 1) if t is not None]
    rows = union_sources(
        *(
            T.ensure_normalized(t).select(
                "entity_id", F.lit(k).alias("src"), T.country_key(F.coalesce("country", F.lit(""))).alias("country_key"), F.coalesce("business_name_norm", F.lit("")).alias("name")
            )
            for k, t in parts
        )
    )
    order = ("country_key", "prefix", "name", "src", "entity_id")
    rows = rows.withColumn("prefix", T.prefix_key(F.col("name"), prefix_len)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select("entity_id", "src", "country_key", F.monotonically_increasing_id().alias("place")))
    # Places leave gaps between partitions; one count per partition closes them.
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).count()
    before = F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part")
    rows = rows.withColumn("n", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    block = F.floor(F.col("n") / BLOCK)
    again = F.when(F.col("n") % BLOCK < window_size - 1, F.array(block, block - 1)).otherwise(F.array(block))
    rows = rows.select("entity_id", "src", "country_key", "n", block.alias("own"), F.explode(again).alias("block"))
    ahead = F.collect_list(F.struct("entity_id", "src", "country_key")).over(W.partitionBy("block").orderBy("n").rowsBetween(1, window_size - 1))
    pairs = rows.withColumn("ahead", ahead).filter(F.col("own") == F.col("block")).select("entity_id", "src", "country_key", F.explode("ahead").alias("b"))
    one = ((F.col("src") == 1) != (F.col("b.src") == 1)) & (F.col("country_key") == F.col("b.country_key"))
    first = F.col("src") == 1
    return (
        pairs.filter(one)
        .select(
            F.when(first, F.col("entity_id")).otherwise(F.col("b.entity_id")).alias("source1_entity_id"),
            F.when(first, F.col("b.entity_id")).otherwise(F.col("entity_id")).alias("candidate_id"),
        )
        .distinct()
    )


def token_overlap(s1: DataFrame, candidates: DataFrame, min_shared_tokens: int = X.MIN_SHARED_TOKENS) -> DataFrame:
    """Pairs of one country whose names share at least so many distinct tokens, each once."""
    return overlap.overlapping(s1, candidates, min_shared_tokens)


def generate_candidates(
    s1: DataFrame,
    s2: DataFrame,
    s3: DataFrame,
    top_k: int = X.TOP_K,
    window_size: int = X.WINDOW_SIZE,
    min_shared_tokens: int = X.MIN_SHARED_TOKENS,
    strategies: Iterable[str] = ("tfidf", "neighborhood", "tokens"),
) -> DataFrame:
    """The union of the strategies, each pair once.

    Pairs that share tokens, whose number grows with the square of the rows, are not compared with the others:
    of those, the few that share tokens are left out by a look at the tokens of both rows.
    """
    s1, s2, s3 = map(T.ensure_normalized, (s1, s2, s3))
    rest = union_sources(s2, s3)
    strategies = set(strategies)
    found = {
        "tfidf": lambda: tfidf_neighbors(s1, rest, top_k).select(*PAIR),
        "neighborhood": lambda: sorted_neighborhood(s1, s2, s3, window_size),
    }
    near = [f() for k, f in found.items() if k in strategies]
    if "tokens" not in strategies:
        return union_sources(*near).distinct()
    tokens = token_overlap(s1, rest, min_shared_tokens)
    if _roams(s1) and _roams(rest):
        tokens = tokens.distinct()
    return tokens.unionByName(_sharing_fewer(checkpointed(union_sources(*near).distinct()), s1, rest, min_shared_tokens)) if near else tokens


def _roams(rows: DataFrame) -> bool:
    """Whether an id is in more than one country, so that it may meet another in each."""
    countries = _keyed(rows).groupBy("entity_id").agg(F.min("country_key").alias("lo"), F.max("country_key").alias("hi"))
    return bool(countries.filter("lo <> hi").take(1))


def _sharing_fewer(pairs: DataFrame, s1: DataFrame, candidates: DataFrame, least: int) -> DataFrame:
    """The pairs that :func:`token_overlap` does not return."""

    def tokens(rows: DataFrame, key: str, name: str) -> DataFrame:
        rows = _keyed(rows).select("country_key", F.col("entity_id").alias(key), T.extract_tokens(F.col("business_name_norm")).alias("t"))
        return rows.groupBy("country_key", key).agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias(name))

    a, b = PAIR
    rows = pairs.join(tokens(s1, a, "ts"), a).join(tokens(candidates, b, "us"), ["country_key", b])
    return pairs.join(rows.filter(F.size(F.array_intersect("ts", "us")) >= least).select(*PAIR), list(PAIR), "left_anti")


def candidate_lists(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source1_entity_id, ids): sorted ids, for every master row."""
    lists = pairs.groupBy("source1_entity_id").agg(F.sort_array(F.collect_set("candidate_id")).alias("ids"))
    every = s1.select(F.col("entity_id").alias("source1_entity_id"))
    return every.join(lists, "source1_entity_id", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def evaluate_blocking(pairs: DataFrame, truth: DataFrame, n_s1: int | Column, n2: int, n3: int) -> DataFrame:
    """One row: recall in percent, reduction ratio, candidates per master row, and the counts."""
    edges = truth.select("source1_entity_id", F.explode("matched_entity_ids").alias("candidate_id"))
    hits = edges.join(pairs.distinct().withColumn("hit", F.lit(1)), list(PAIR), "left")
    t = hits.agg(F.count(F.lit(1)).alias("total_true_matches"), F.coalesce(F.sum("hit"), F.lit(0)).alias("captured_matches"))
    p = pairs.agg(F.count(F.lit(1)).alias("total_candidates"))
    possible = n_s1 * (n2 + n3)
    # Two single rows.
    row = t.crossJoin(F.broadcast(p))
    return row.select(
        F.when(F.col("total_true_matches") > 0, F.col("captured_matches") / F.col("total_true_matches") * 100.0).otherwise(100.0).alias("recall"),
        (1.0 - F.col("total_candidates") / possible if possible else F.lit(0.0)).alias("reduction_ratio"),
        (F.col("total_candidates") / n_s1 if n_s1 else F.lit(0.0)).alias("avg_candidates_per_s1"),
        "total_candidates",
        "total_true_matches",
        "captured_matches",
    )


# Settings that tuning tries in turn: top_k, window_size, min_shared_tokens.
GRID = ((15, 10, 2), (20, 12, 2), (25, 15, 1), (30, 20, 1))


def tune_blocking(s1: DataFrame, s2: DataFrame, s3: DataFrame, truth: DataFrame, target_recall: float = 98.0, grid=GRID) -> tuple[dict, DataFrame]:
    """The first setting that reaches the recall, else the last, with its candidates."""
    n1, n2, n3 = s1.count(), s2.count(), s3.count()
    for top_k, window_size, shared in grid:
        pairs = generate_candidates(s1, s2, s3, top_k, window_size, shared).persist()
        metrics = evaluate_blocking(pairs, truth, n1, n2, n3).first().asDict()
        if metrics["recall"] >= target_recall or (top_k, window_size, shared) == grid[-1]:
            return {"top_k": top_k, "window_size": window_size, "min_shared_tokens": shared} | metrics, pairs
        pairs.unpersist()
    raise ValueError("no setting to try")
