"""Mixing sources to target weights.

Every document gets a pseudo-random key from its id. Keys order the documents of a source; the key
space is cut into equal ranges, the sizes of each (source, range) are summed where the rows are, and a
running sum over ranges gives each range its offset. Only inside a range are rows sorted. A range holds
about PER_RANGE rows or fewer, so a source with a third of all rows is spread over very many groups.

A source is read as often as its budget allows; in the last, partial pass documents are taken in key
order until the budget is met exactly, cutting the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, n_words, sketch_of, within

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Rows that a range holds about, beyond the 4096 ranges that there always are.
PER_RANGE = 10_000


def _placed(doc_id: Column, text: Column) -> Column:
    """What a row is placed by: its id, or its text where there is none, so that such rows are spread too."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target), one row per source.

    Sources in code point order, null last, get the weights in turn. A target stops at ``max_epochs``
    times the size; what it gives up is reshared by weight. Sources with the smallest size per weight
    are the ones that stop, so running sums in that order find them in one pass. The window runs over
    one row per source.
    """
    turn = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    cap = F.col("source_size") * F.lit(max_epochs)
    rated = sizes.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double").alias("weight"))
    order = W.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    rated = rated.withColumn("level", level).withColumn("over", cap / F.col("weight") <= F.col("level"))
    # The first source that does not stop sets the level for all that follow.
    rest = F.min(F.when(~F.col("over"), F.struct(cap / F.col("weight"), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("over"), cap.cast("double")).otherwise(F.col("weight") * rest)
    return rated.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = 7,
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, epochs, source and k, what the row is placed by.

    ``taken`` is the number of words that the mix takes, repeats counted; per source it sums to the
    target, rounded. ``epochs`` is the number of whole copies nearest to that. Null texts and texts
    without words have size 0. A null source is a source of its own. A row with a null id is placed by
    its text; rows that repeat an id are rows of their own, ordered by size. Reruns agree.
    """
    rows = docs.select(
        _placed(F.col(id_col), F.col(text_col)).alias("k"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size")
    )
    rows = checkpointed(rows.withColumn("key", F.md5(F.concat("k", F.lit(f":{seed}")))))
    digits = max(3, math.ceil(math.log(max(1, rows.count() / PER_RANGE), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    up_to = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = checkpointed(ranges.withColumn("offset", F.coalesce(F.sum("in_range").over(up_to), F.lit(0))))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, max_epochs)
    marks = ranges.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    marks = marks.select(F.col("source").alias("s"), F.col("range").alias("r"), "offset", "source_size", "target")
    joined = rows.join(marks, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    inside = W.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
    return (
        joined.withColumn("before", before)
        .withColumns({"whole": whole, "part": part})
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("whole") * F.col("size") + F.col("part")).cast("long").alias("taken"),
            (F.col("whole") + (2 * F.col("part") > F.col("size")).cast("long")).alias("epochs"),
            "source",
            "k",
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, each as often as its epochs say, texts whole, with all their columns.

    Rows without words take no room and stay once. Rows that repeat an id, a source and a size share
    their epochs evenly, the first by text taking what is left over.
    """
    key = ["k", "source", "size"]
    rows = docs.select(F.struct("*").alias("row"), _placed(F.col(id_col), F.col(text_col)).alias("k"))
    take = checkpointed(mix(docs, id_col, text_col, source_col, **options).select(*key, F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs")).alias("n")))
    each = checkpointed(take.groupBy("k").agg(F.count(F.lit(1)).alias("held"), F.max("n").alias("n")).filter("n > 0"))
    out = rows.join(each.filter("held = 1").select("k", "n"), "k").select("row", "n")
    several = checkpointed(take.join(each.filter("held > 1").select("k"), "k", "left_semi").groupBy(*key).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")))
    if several.first() is not None:
        some = rows.filter(within(F.xxhash64("k"), sketch_of(several, F.xxhash64("k")))).select("row", "k", F.col("row")[source_col].alias("source"), n_words(F.col("row")[text_col]).alias("size"))
        some = some.join(several.withColumnRenamed("source", "source2"), ["k", "size"]).filter(F.col("source").eqNullSafe(F.col("source2")))
        turn = F.row_number().over(W.partitionBy("k", "size", "source").orderBy(F.col("row")[text_col], F.xxhash64(F.to_json("row"))))
        some = some.withColumn("turn", turn)
        out = out.unionByName(some.select("row", (F.floor(F.col("n") / F.col("held")) + (F.col("turn") <= F.col("n") % F.col("held")).cast("long")).alias("n")))
    return out.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':7') AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         (3 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN cap / weight <= level THEN cap ELSE
           weight * (SELECT arg_min(level, (cap / weight, source)) FROM l WHERE cap / weight > level) END AS target
  FROM l
), p AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p
), r AS (
  SELECT *, greatest(0, least(size, budget - whole * source_size - before)) AS part FROM q
)
SELECT doc_id, size, source_size, target, (whole * size + part)::BIGINT AS taken,
       (whole + CASE WHEN 2 * part > size THEN 1 ELSE 0 END)::BIGINT AS epochs
FROM r
"""
