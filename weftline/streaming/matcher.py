"""Rule matching of a stream of master rows against static tables.

Each micro-batch is looked up in the postings, which are built once, scored and decided; there is no
state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import retrieval
from weftline.session import checkpointed
from weftline.sources.tsv import ENTITY_COLUMNS

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ENTITY_COLUMNS])


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Master rows from the TSV files that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).csv(folder, schema=SCHEMA, sep="\t", header=True, quote="")


def match_stream(stream: DataFrame, s2: DataFrame, s3: DataFrame, out: str, checkpoint: str, open_vocabulary: bool = True, stemming: bool = True, **trigger) -> StreamingQuery:
    """Appends (source1_entity_id, candidate_id, score, batch) as Parquet; a repeated batch overwrites itself."""
    index = checkpointed(retrieval.build_index(s2, s3, open_vocabulary, stemming))

    def run(batch: DataFrame, number: int) -> None:
        s1 = batch.na.fill("")
        pairs = retrieval.tiered_lookup(s1, index, open_vocabulary, stemming).select("source1_entity_id", "candidate_id")
        found = retrieval.rule_decision(retrieval.rule_scores(pairs, s1, s2, s3))
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
