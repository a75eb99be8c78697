"""Pieces shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import checkpointed

__all__ = ["SPACES", "WORD_GAP", "checkpointed", "documents", "labels", "n_words", "sketch_of", "text_batches", "within", "words"]

#: The separators of words, as characters and as a pattern.
SPACES = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_batches(df: DataFrame, most: int = 200) -> DataFrame:
    """Limits the rows that the session sends to Python at once.

    Texts and sets of n-grams are large, and a batch is held several times over on its way.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))
    return df


def words(text: Column) -> Column:
    """Words between runs of separators; an empty array for null and blank texts."""
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.split(inner, WORD_GAP)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, WORD_GAP))).otherwise(F.lit(0)).cast("long")


#: A sketch has 16 bits a key, in 64-bit words, between these numbers of words.
LEAST_WORDS, MOST_WORDS = 1 << 12, 1 << 20


def one_bit(x: Column) -> Column:
    """The long with the bit that the last six bits of x name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))


def as_array(table: DataFrame, at: str, value: str) -> Column:
    """A scalar subquery: the values of a table of bounded size in the order of ``at``."""
    return table.agg(F.transform(F.sort_array(F.collect_list(F.struct(at, value))), lambda x: x[value]).alias("x")).scalar()


def sketch_of(keys: DataFrame, key: Column) -> Column:
    """A scalar subquery with a bit for each residue of a key. ``keys`` should be materialised: it is counted.

    It only serves to leave out rows early that a join would leave out. Its size grows with the keys up
    to MOST_WORDS; beyond, more rows go to the join, and in the end all.
    """
    n = keys.count()
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << max(0, n // 4 - 1).bit_length()))
    bit = F.pmod(key, F.lit(words * 64))
    held = keys.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(one_bit(bit)).alias("x"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(held, "w", "left")
    return as_array(every.select("w", F.coalesce("x", F.lit(0).cast("long")).alias("x")), "w", "x")


def within(key: Column, sketch: Column) -> Column:
    """Whether the key's bit is set."""
    bit = F.pmod(key, F.size(sketch) * 64)
    return F.call_function("shiftright", F.get(sketch, F.floor(bit / 64).cast("int")), bit.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1
