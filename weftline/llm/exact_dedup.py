"""Exact deduplication by deterministic block naming.

A text is cut into blocks of a fixed length. Distinct blocks are sorted and numbered, so that equal
blocks and no others get the same integer name. Neighbouring names are then paired, distinct pairs
are sorted and numbered in the same way, and so on until every text has one name. Two texts carry the
same (level, name) exactly when they are equal; no hash decides equality.

A fingerprint (length and 64-bit hash) only rules texts out: a text whose fingerprint occurs once has
no copy and needs no name. Names are made from distinct blocks, which each task reduces before the
shuffle, so a block that a third of all rows share arrives once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm.common import checkpointed, sketch_of, within

BLOCK_CHARS = 4096


def normalised(text: Column) -> Column:
    """Each run of separators becomes one space; null counts as empty."""
    # A lone space is left as it is, so that the replacement only touches what it changes.
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _named(values: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column with integer names in sort order."""
    distinct = values.select(column).distinct()
    # Ranges are found from a sample that passes through the driver; the start of a block is enough.
    ranged = F.substring(column, 1, 32) if isinstance(distinct.schema[column].dataType, StringType) else F.col(column)
    distinct = distinct.repartitionByRange(ranged).sortWithinPartitions(column)
    return checkpointed(distinct.withColumn("name", F.monotonically_increasing_id()))


def block_names(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """From (rid, norm) to (rid, level, name), equal for equal texts only.

    ``rid`` must be unique. An empty text has one empty block.
    """
    blocks = F.when(
        F.length("norm") > block_chars, F.regexp_extract_all("norm", F.lit("(?s).{1,%d}" % block_chars), F.lit(0))
    ).otherwise(F.array("norm"))
    parts = texts.select("rid", F.size(blocks).alias("n"), F.posexplode(blocks).alias("i", "value"))
    longest = texts.agg(F.max(F.length("norm"))).first()[0] or 0
    out, level = None, 0
    n_blocks = max(1, -(-longest // block_chars))
    while True:
        names = _named(parts, "value")
        named = checkpointed(parts.join(names, "value").select("rid", "n", "i", "name"))
        done = named.filter("n = 1").select("rid", F.lit(level).alias("level"), "name")
        out = done if out is None else out.unionByName(done)
        if n_blocks <= 1:
            return out
        level, n_blocks = level + 1, (n_blocks + 1) // 2
        half = F.floor(F.col("i") / 2).cast("int")
        parts = (
            named.filter("n > 1")
            .groupBy("rid", half.alias("i"))
            .agg(
                F.floor((F.first("n") + 1) / 2).cast("int").alias("n"),
                F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"),
                F.max(F.when(F.col("i") % 2 == 1, F.col("name"))).alias("b"),
            )
            .select("rid", "n", "i", F.struct("a", F.coalesce("b", F.lit(-1)).alias("b")).alias("value"))
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays. Null ids come last; of rows with the
    same id and text one stays. A null text is an empty one, and empty texts equal each other. An empty
    table gives an empty result. Other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    key = [F.xxhash64("norm").alias("h"), F.length("norm").alias("len")]
    signed = checkpointed(base.select("doc_id", *key, F.sha2("norm", 256).alias("text_sha256")))
    repeated = checkpointed(signed.groupBy("h", "len").count().filter("count > 1").select("h", "len"))
    single = signed.join(repeated, ["h", "len"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    texts = base.select("doc_id", "norm", *key).filter(within(F.col("h"), sketch_of(repeated, F.col("h"))))
    texts = texts.join(repeated, ["h", "len"], "left_semi")
    texts = checkpointed(texts.select("doc_id", "norm").withColumn("rid", F.monotonically_increasing_id()))
    rows = checkpointed(
        block_names(texts, block_chars).join(texts.select("rid", "doc_id", F.sha2("norm", 256).alias("text_sha256")), "rid")
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    groups = rows.groupBy("level", "name").agg(first, F.count(F.lit(1)).alias("group_size"))
    copies = rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept"), "text_sha256"
    )
    return single.unionByName(copies)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose id no dropped row has stay without being shuffled. Of rows that repeat an id and a text
    one stays, told by a hash of all its columns.
    """
    groups = checkpointed(exact_groups(docs, id_col, text_col))
    gone = checkpointed(groups.filter("not kept").select(F.xxhash64("doc_id").alias("k")))
    touched = within(F.xxhash64(F.col(id_col).cast(groups.schema["doc_id"].dataType)), sketch_of(gone, F.col("k")))
    kept = groups.filter("kept").select(F.col("doc_id").alias("keep"), F.col("text_sha256").alias("text"))
    # Under one name, the columns of the table cannot clash with others.
    rows = docs.filter(touched).select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("keep")) & (F.col("sha") == F.col("text")), "left_semi")
    found = found.groupBy("id", "sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return docs.filter(~touched).unionByName(found.select("row.*"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)
"""
