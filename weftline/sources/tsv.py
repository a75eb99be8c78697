"""Tab-separated tables: entities, truth, candidates, matches; and Parquet for labelled pairs.

Empty fields are empty strings, not nulls. Sinks write one file where order is part of the format, as a
directory like every Spark sink; pass the directory back to the readers.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import NORMALIZED, normalize_dataframe, strip

ENTITY_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
CANDIDATE_COLUMNS = ("source1_entity_id", "candidate_entity_ids")


def _strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def _header(spark: SparkSession, path: str) -> list[str]:
    try:
        rows = spark.read.text(path).limit(1).collect()
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return rows[0][0].rstrip("\r").split("\t") if rows else []


def check_columns(found: list[str], expected: tuple[str, ...], name: str) -> None:
    """Names and order must agree."""
    if list(found) != list(expected):
        raise ValueError(f"Invalid columns in {name}: expected {list(expected)}, found {list(found)}")


def validate_source_columns(df: DataFrame, name: str) -> None:
    check_columns(df.columns, ENTITY_COLUMNS, name)


def validate_ground_truth_columns(df: DataFrame, name: str) -> None:
    check_columns(df.columns, TRUTH_COLUMNS, name)


def read_table(spark: SparkSession, path: str, columns: tuple[str, ...] = ENTITY_COLUMNS) -> DataFrame:
    """All columns as strings, after a check of the header line."""
    check_columns(_header(spark, path), columns, path)
    df = spark.read.csv(path, sep="\t", header=True, schema=_strings(columns), quote="", escape="")
    return df.select(*(F.coalesce(c, F.lit("")).alias(c) for c in columns))


def read_columns(spark: SparkSession, path: str, *wanted: str, columns: tuple[str, ...] = ENTITY_COLUMNS) -> DataFrame:
    """Some columns only; the others are not parsed."""
    return read_table(spark, path, columns).select(*wanted)


def parse_id_list(c: Column) -> Column:
    """A comma list as an array of trimmed ids without blanks; null and blank give an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def as_id_list(df: DataFrame, column: str) -> DataFrame:
    """Parses a column unless it is an array already."""
    if isinstance(df.schema[column].dataType, T.ArrayType):
        return df.withColumn(column, F.coalesce(column, F.array().cast("array<string>")))
    return df.withColumn(column, parse_id_list(F.col(column)))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return as_id_list(read_table(spark, path, TRUTH_COLUMNS), "matched_entity_ids")


def _first_that_reads(read, *paths: str) -> DataFrame:
    for k, path in enumerate(paths):
        try:
            return read(path)
        except FileNotFoundError:
            if k == len(paths) - 1:
                raise
    raise FileNotFoundError


def load_training_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    tables = {f"source{k}": read_table(spark, f"{folder}/train_source{k}.tsv") for k in (1, 2, 3)}
    truth = _first_that_reads(lambda p: read_ground_truth(spark, p), f"{folder}/train_ground_truth.tsv", f"{folder}/ground_truth.tsv")
    return tables | {"ground_truth": truth}


def load_test_data(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {f"source{k}": read_table(spark, f"{folder}/test_source{k}.tsv") for k in (1, 2, 3)}


def load_all_data(spark: SparkSession, train: str, test: str) -> dict[str, DataFrame]:
    return {f"train_{k}": v for k, v in load_training_data(spark, train).items()} | {f"test_{k}": v for k, v in load_test_data(spark, test).items()}


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """(source1_entity_id, candidate_id), one row per pair."""
    both = (f"{folder}/candidate_pairs_train.tsv", f"{folder}/candidate_pairs.tsv")
    df = _first_that_reads(lambda p: read_table(spark, p, CANDIDATE_COLUMNS), *both)
    return df.select("source1_entity_id", F.explode(parse_id_list(F.col("candidate_entity_ids"))).alias("candidate_id"))


def read_normalized(spark: SparkSession, path: str) -> DataFrame:
    """A table that :func:`write_normalized` wrote; the landmark column is a boolean again."""
    columns = ENTITY_COLUMNS + NORMALIZED
    df = read_table(spark, path, columns)
    return df.withColumn("has_landmark", F.lower("has_landmark") == "true")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="", lineSep="\n", escapeQuotes=False)


def write_entities(df: DataFrame, path: str) -> None:
    """An entity table; nulls become empty fields."""
    _write(df.select(*ENTITY_COLUMNS), path)


def write_id_lists(lists: DataFrame, order: DataFrame, column: str, path: str) -> None:
    """One line per row of ``order`` (source1_entity_id, ordinal), in its order; missing lists are empty.

    ``lists`` has (source1_entity_id, ids). The range sort keeps the order over as many files as there
    are partitions; their names sort in line order.
    """
    found = order.join(lists, "source1_entity_id", "left").orderBy("ordinal")
    _write(found.select("source1_entity_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column)), path)


def write_submission(lists: DataFrame, order: DataFrame, column: str, path: str) -> None:
    """As :func:`write_id_lists`, in one file."""
    found = order.join(lists, "source1_entity_id", "left").select("ordinal", "source1_entity_id", F.coalesce(F.array_join("ids", ","), F.lit("")).alias(column))
    _write(found.repartitionByRange(1, "ordinal").sortWithinPartitions("ordinal").drop("ordinal"), path)


def write_candidates(pairs: DataFrame, path: str) -> None:
    lists = pairs.groupBy("source1_entity_id").agg(F.array_join(F.sort_array(F.collect_set("candidate_id")), ",").alias("candidate_entity_ids"))
    _write(lists, path)


def write_normalized(df: DataFrame, path: str) -> None:
    out = normalize_dataframe(df.select(*ENTITY_COLUMNS))
    _write(out.withColumn("has_landmark", F.initcap(F.col("has_landmark").cast("string"))), path)


def with_ordinal(df: DataFrame, column: str = "entity_id") -> DataFrame:
    """(source1_entity_id, ordinal) in file order."""
    return df.select(F.col(column).alias("source1_entity_id"), F.monotonically_increasing_id().alias("ordinal"))


def save_labeled(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_labeled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_params(spark: SparkSession, params: dict, path: str) -> None:
    """Parameters and logs as one JSON line."""
    import json

    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str) -> dict:
    import json

    return json.loads(spark.read.text(path).first()[0])


def update_threshold(spark: SparkSession, threshold: float, path: str) -> dict:
    """Stores a tuned threshold beside the other parameters."""
    try:
        params = load_params(spark, path)
    except AnalysisException:
        params = {}
    params["match_threshold"] = round(threshold, 4)
    save_params(spark, params, path)
    return params
